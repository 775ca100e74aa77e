"""Analysis of a crawl into findings, and the tables that everything else reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N
from pagelens.operators.page_rules import flat_pages, page_findings
from pagelens.operators.site_rules import site_findings
from pagelens.sources.crawl import crawl_tables
from pagelens.sources.store import stored


def score_of(severity="severity", effort="effort") -> Column:
    """What a finding is worth: the weight of its severity for each unit of effort."""
    return D.weight(F.col(severity)) / F.greatest(F.lit(1), F.col(effort))


def work_order() -> list[Column]:
    return [F.asc("layer"), D.rank(F.col("severity")).asc(), score_of().desc(), F.asc("rule"), F.asc("url"), F.asc("page_id")]


def analyse(flat: DataFrame, sites: DataFrame) -> DataFrame:
    """All findings, numbered within their site in the order of work."""
    found = page_findings(flat).unionByName(site_findings(flat, sites))
    return found.withColumn("finding_no", F.row_number().over(Window.partitionBy("run_id", "site_id").orderBy(*work_order())).cast("long"))


def touched(found="evidence", url="url") -> Column:
    """Every url of a finding: its own first, then those of its evidence."""
    e = F.col(found)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(e[k], none) for k in ("urls", "orphans", "targets", "dead")]
    deep = F.coalesce(F.transform(e["pages"], lambda p: p.url), none)
    examples = F.coalesce(F.flatten(F.map_values(e["examples"])), none)
    return F.array_distinct(F.filter(F.concat(F.array(F.col(url)), *lists, deep, examples), lambda u: u != ""))


@dataclass
class Audit:
    runs: DataFrame
    sites: DataFrame
    pages: DataFrame
    flat: DataFrame
    findings: DataFrame


_made: dict[tuple[str, str], Audit] = {}


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    """The planted crawl of a folder and its findings, as tables stored once an application: the parse is the dear part, and a
    stored table outlives its executors."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        runs, sites, pages = crawl_tables(spark, sf_dir)
        pages, sites = stored(pages, "pages"), stored(sites, "sites")
        flat = stored(flat_pages(pages), "flat")
        _made[key] = Audit(runs, sites, pages, flat, stored(analyse(flat, sites), "findings"))
    return _made[key]


def health(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Per site: findings, pages (of any state) and the health score, halves rounded to even."""
    n = pages.groupBy("run_id", "site_id").agg(F.count("*").alias("pages"))
    p = found.join(n, ["run_id", "site_id"]).groupBy("run_id", "site_id").agg(
        F.sum(D.weight(F.col("severity")) / F.when(F.col("url") == "", 1.0).otherwise(F.greatest(F.lit(1.0), F.sqrt("pages")))).alias("penalty"), F.count("*").alias("findings")
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - F.coalesce("penalty", F.lit(0.0)) / 3))).cast("int")
    return n.join(p, ["run_id", "site_id"], "left").select("run_id", "site_id", "pages", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), score.alias("score"))


def at_least(severity: str) -> Column:
    if severity not in D.SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}; one of {', '.join(D.SEVERITIES)}")
    return D.rank(F.col("severity")) <= D.SEVERITIES.index(severity)


def slice_of_page(found: DataFrame, page_url: str) -> DataFrame:
    """Findings that touch a page, own address first: an equality on keys, not a loop over pairs."""
    key = N.same_key(F.lit(page_url))
    via = F.when(N.same_key("url") == key, "url").when(F.exists(touched(), lambda u: N.same_key(u) == key), "evidence")
    return found.withColumn("matched_via", via).where("matched_via is not null")
