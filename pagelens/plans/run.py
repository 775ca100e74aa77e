"""An audit from sites to stored tables, in steps that can be taken up again; and the events that tell how far it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import urls as N
from pagelens.functions.head import extract_head
from pagelens.operators.findings import Audit, analyse
from pagelens.operators.page_rules import flat_pages
from pagelens.plans.errors import NoSites, RunAlreadyDone, RunNotFound
from pagelens.plans.read import check_params
from pagelens.sources.discovery import discover, same_site
from pagelens.sources.files import GUESSES
from pagelens.sources.http import AuditConfig, fetch_pages, network
from pagelens.sources.store import replace_findings

Told = Callable[[str, dict], None]


def _silent(event: str, facts: dict) -> None:
    pass


def _landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _step(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], told: Told) -> DataFrame:
    """The table of a step; made unless an earlier run has finished it."""
    path = f"{folder}/{name}"
    again = _there(spark, path)
    if not again:
        make().write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    told(name, {"rows": out.count(), "resumed": again})
    return out


def land_discovery(spark: SparkSession, sites: DataFrame, config: AuditConfig, transport) -> DataFrame:
    """Responses (url, status, text) of robots.txt, sitemaps and what these name, two levels of indexes deep."""
    from pagelens.sources import files as S

    site = sites.select(N.rstrip(N.site_form("origin")).alias("site")).distinct()
    get = lambda urls: fetch_pages(urls.distinct(), config.policy, transport).select(F.col("requested_url").alias("url"), "status", "text")
    robots = get(site.select(F.concat("site", F.lit("/robots.txt")).alias("url")))
    named = S.robots_sitemaps(robots.select(F.regexp_replace("url", "/robots.txt$", "").alias("site"), "text"))
    guesses = site.join(named.select("site").distinct(), "site", "left_anti").select(F.explode(F.array(*[F.concat("site", F.lit(g)) for g in GUESSES])).alias("url"))
    first = get(named.select(N.site_form("url").alias("url")).unionByName(guesses))
    inner = lambda maps: get(maps.where(S.is_sitemap_index(F.col("text"))).select(F.explode(S.sitemap_locs(F.col("text"))).alias("url")).select(N.site_form("url").alias("url")))
    second = inner(first)
    return robots.unionByName(first).unionByName(second).unionByName(inner(second)).dropDuplicates(["url"])


def audit_sites(spark: SparkSession, sites: DataFrame, folder: str, run_id: int = 1, config: AuditConfig | None = None, transport=network, on_event: Told = _silent) -> Audit:
    """Discovers, loads and judges the sites (column origin); every step is a table in the folder, so a run that stopped goes on
    where it was when it is called again. on_event(step, facts) hears of each finished step."""
    how = config or AuditConfig()
    check_params(max_pages=how.max_pages, severity=how.min_severity)
    if sites.isEmpty():
        raise NoSites("no site to audit")
    responses = _step(spark, folder, "responses", lambda: land_discovery(spark, sites, how, transport), on_event)
    queue = _step(spark, folder, "queue", lambda: _queue(sites, responses, how), on_event)
    loaded = _step(spark, folder, "loaded", lambda: fetch_pages(queue.select("url").distinct(), how.policy, transport), on_event)
    counters = _step(spark, folder, "discovery", lambda: discover(sites, responses, max_urls=how.max_pages, respect_robots=how.respect_robots).counters, on_event)
    pages = _step(spark, folder, "pages", lambda: _pages(queue, loaded, run_id), on_event)
    site = _step(spark, folder, "sites", lambda: _sites(counters, pages, run_id), on_event)
    flat = _step(spark, folder, "flat", lambda: flat_pages(pages), on_event)
    if not _there(spark, f"{folder}/runs"):
        replace_findings(analyse(flat, site), f"{folder}/findings")
    found = spark.read.parquet(f"{folder}/findings")
    on_event("findings", {"rows": found.count(), "resumed": _there(spark, f"{folder}/runs")})
    runs = spark.createDataFrame([(run_id, 0, "")], "run_id int, started_at long, label string")
    runs.write.mode("overwrite").parquet(f"{folder}/runs")  # the run is finished
    return Audit(runs, site, pages, flat, found)


def resume_audit(spark: SparkSession, sites: DataFrame, folder: str, **more) -> Audit:
    """Goes on with a run that has begun in the folder and isn't finished."""
    if not _there(spark, f"{folder}/responses"):
        raise RunNotFound(f"no run has begun in {folder}")
    if _there(spark, f"{folder}/runs"):
        raise RunAlreadyDone(f"the run in {folder} is finished")
    return audit_sites(spark, sites, folder, **more)


def _queue(sites: DataFrame, responses: DataFrame, how: AuditConfig) -> DataFrame:
    return discover(sites, responses, max_urls=how.max_pages, respect_robots=how.respect_robots).urls


def _pages(queue: DataFrame, loaded: DataFrame, run_id: int) -> DataFrame:
    got = queue.join(loaded.withColumnRenamed("requested_url", "url"), "url", "left")
    host = N.bare_netloc("site")
    site_id = F.pmod(F.xxhash64("site"), F.lit(1 << 40))
    head = F.when(F.col("ok") & same_site("final_url", "site"), extract_head(F.col("text"), F.col("final_url")))
    return got.select(
        F.lit(run_id).alias("run_id"), site_id.alias("site_id"), host.alias("host"), F.col("site").alias("origin"), F.col("no").alias("page_id"), "url", "final_url", "source",
        F.when(F.col("ok"), "done").otherwise("error").alias("state"), "status", "redirects", "elapsed_ms", "content_type", "cache_state", F.lit(False).alias("cache_stale"), head.alias("head"),
    )


def _sites(counters: DataFrame, pages: DataFrame, run_id: int) -> DataFrame:
    done = pages.groupBy("site_id", "host", "origin").agg(F.max(F.col("state") == "done").alias("any"))
    return done.join(counters, done["origin"] == counters["site"]).select(
        F.lit(run_id).alias("run_id"), "site_id", "host", "origin", "robots_present", (F.col("sitemaps_seen") > 0).alias("sitemaps_seen"), (F.col("sitemap_via") == "robots").alias("robots_sitemaps"),
        F.when(F.col("any"), "done").otherwise("error").alias("state"),
    )
