"""Markdown reports as string columns, ready for df.write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.operators.findings import Audit, slice_of_page
from pagelens.operators.tasks import build_tasks
from pagelens.plans.read import severity_counts, site_rows

SITE = ["run_id", "site_id"]


def report_rules(a: Audit) -> DataFrame:
    """Per site and rule: how many findings, the first one's severity."""
    return a.findings.groupBy(*SITE, "rule").agg(F.count("*").alias("n"), F.min_by("severity", "finding_no").alias("severity"))


def site_reports(a: Audit) -> DataFrame:
    """One Markdown text a site: head, severities, rules in their order."""
    line = F.concat(F.lit("| "), "rule", F.lit(" | "), "severity", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rules = report_rules(a).groupBy(*SITE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(D.rank(F.col("severity")).alias("o"), "rule", line.alias("t")))), lambda x: x.t), "\n").alias("rules"))
    counts = severity_counts(a.findings, *SITE)
    said = F.concat_ws(", ", *[F.concat(F.lit(f"{s}: "), F.coalesce(s, F.lit(0)).cast("string")) for s in D.SEVERITIES])
    rows = site_rows(a).select(*SITE, "host", "pages", "score").join(counts, SITE, "left").join(rules, SITE, "left")
    text = F.concat(
        F.lit("# "), "host", F.lit("\n\nScore "), F.col("score").cast("string"), F.lit(" of 100, "), F.col("pages").cast("string"), F.lit(" pages\n\n"), said, F.lit("\n\n| rule | severity | findings |\n|---|---|---|\n"), F.coalesce("rules", F.lit("")), F.lit("\n")
    )
    return rows.select(*SITE, "host", text.alias("report"))


def portfolio_report(a: Audit) -> DataFrame:
    """One Markdown text a run: totals of done sites, and the table of sites, lowest score first."""
    s = site_rows(a)
    done = F.col("state") == "done"
    line = F.concat(F.lit("| "), "host", F.lit(" | "), F.col("score").cast("string"), F.lit(" | "), F.col("tasks").cast("string"), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.when(done, F.struct("score", (-F.col("tasks")).alias("o"), "host", line.alias("t")))))
    r = s.groupBy("run_id").agg(
        F.sum(F.when(done, F.col("tasks"))).alias("tasks"), F.sum(F.when(done, F.col("pages"))).alias("pages"), F.count_if(done & (F.col("critical") > 0)).alias("critical_sites"), F.transform(rows, lambda x: x.t).alias("lines")
    )
    text = F.concat(
        F.lit("# Portfolio\n\n"), F.col("tasks").cast("string"), F.lit(" tasks, "), F.col("pages").cast("string"), F.lit(" pages, "), F.col("critical_sites").cast("string"), F.lit(" sites with critical findings\n\n| site | score | tasks |\n|---|---|---|\n"), F.array_join("lines", "\n"), F.lit("\n")
    )
    return r.select("run_id", text.alias("report"))


def page_report(a: Audit, run_id: int, page_url: str) -> DataFrame:
    """One Markdown text: the findings that touch a page, in the order of work."""
    f = slice_of_page(a.findings.where(F.col("run_id") == run_id), page_url)
    line = F.concat(F.lit("- "), "severity", F.lit(" "), "rule", F.lit(" ("), "matched_via", F.lit("): "), "message")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site_id", "finding_no", line.alias("t")))), lambda x: x.t), "\n")
    return f.agg(F.concat(F.lit(f"# {page_url}\n\n"), F.count("*").cast("string"), F.lit(" findings\n\n"), lines, F.lit("\n")).alias("report"))


def task_bodies(a: Audit) -> DataFrame:
    return build_tasks(a.findings).select(*SITE, "rule", "subject", "title", "body")


def write_reports(a: Audit, folder: str) -> None:
    """The sinks: a text file set of site reports by run, the portfolio, tasks as JSON lines."""
    site_reports(a).select("run_id", "host", F.col("report").alias("value")).write.mode("overwrite").partitionBy("run_id", "host").text(f"{folder}/sites")
    portfolio_report(a).select("run_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("run_id").text(f"{folder}/portfolio")
    build_tasks(a.findings).write.mode("overwrite").json(f"{folder}/tasks")
