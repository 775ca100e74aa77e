"""Findings grouped into tasks; the tracker plan; summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N
from pagelens.operators.findings import at_least

GROUP = ["run_id", "site_id", "host", "origin", "rule", "subject"]


def subject_of() -> Column:
    """What a task of a rule that is split is about: the first of these that the evidence has."""
    e = F.col("evidence")
    parts = [F.when(F.coalesce(e[k], F.lit("")) != "", F.concat(F.lit(f"{k}="), F.substring(e[k], 1, 80))) for k in ("section", "post_type", "cluster", "value")]
    return F.when(F.col("rule").isin(D.SPLIT_BY_SUBJECT), F.coalesce(*parts, F.lit(""))).otherwise("")


def fingerprint(site: Column, rule: Column, subject: Column) -> Column:
    return F.concat(F.lit(D.MARK), F.substring(F.sha1(F.concat_ws("|", site, rule, subject)), 1, 12))


def build_tasks(found: DataFrame, min_severity: str = "medium", include_rules: list[str] | None = None) -> DataFrame:
    """One task a site, rule and subject: the worst severity, the dearest effort, urls in first-seen order."""
    f = found.where(at_least(min_severity))
    if include_rules is not None:
        f = f.where(F.col("rule").isin(include_rules))
    f = f.withColumn("subject", subject_of())
    own = F.filter(F.concat(F.coalesce(F.col("evidence.urls"), F.array().cast("array<string>")), F.array("url")), lambda u: u != "")
    t = f.groupBy(*GROUP).agg(
        F.min_by(F.struct("severity", "layer", "message", "detail"), F.struct(D.rank(F.col("severity")), "finding_no")).alias("worst"),
        F.max("effort").alias("effort"), F.count("*").alias("items"), F.min("finding_no").alias("first_no"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("finding_no", own.alias("u")))), lambda x: x.u))).alias("urls"),
    )
    n = F.when(F.size("urls") > 0, F.size("urls")).otherwise(F.col("items"))
    label = N.tracker_host("origin")
    layer = F.col("worst.layer")
    severity = F.col("worst.severity")
    name = D.pick(layer, D.LAYERS, "")
    t = t.select(
        *GROUP, severity.alias("severity"), layer.alias("layer"), "effort", "urls", n.cast("long").alias("count"), "first_no", F.col("worst.message").alias("message"), F.col("worst.detail").alias("detail"),
        fingerprint(F.col("origin"), F.col("rule"), F.col("subject")).alias("fingerprint"),
        F.coalesce(D.pick(severity, D.DUE_DAYS), F.lit(30)).alias("due_days"),
        F.array(F.concat(F.lit("seo:"), name), F.concat(F.lit("seo:"), severity), label).alias("tags"),
        F.col("rule").isin(D.AUTOFIXABLE).alias("autofixable"),
    )
    title = F.concat(F.lit("["), label, F.lit("] "), "message", F.when((F.col("count") > 1) & ~F.col("message").contains("pages)"), F.concat(F.lit(" — "), F.col("count").cast("string"), F.lit(" pages"))).otherwise(""))
    return t.withColumn("title", title).withColumn("body", body())


def body() -> Column:
    listed = F.array_join(F.transform(F.slice("urls", 1, 15), lambda u: F.concat(F.lit("- "), u)), "\n")
    more = F.when(F.size("urls") > 15, F.concat(F.lit("\nand "), (F.size("urls") - 15).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(
        F.lit("Site: "), "origin", F.lit("\nLayer: "), D.pick(F.col("layer"), D.LAYERS, ""), F.lit(" · Severity: "), "severity", F.lit(" · Effort: "), D.pick(F.col("effort"), D.EFFORTS, ""),
        F.lit("\n\nWhat to do: "), "detail", F.lit("\n\nPages:\n"), listed, more, F.lit("\n\n—\nAudit mark: "), "fingerprint",
    )


def task_order() -> list[Column]:
    return [D.rank(F.col("severity")).asc(), F.asc("layer"), F.desc("count"), F.asc("first_no"), F.asc("rule"), F.asc("subject")]


def task_summary(tasks: DataFrame) -> DataFrame:
    """Per run and site: tasks, pages touched, autofixable, tasks by severity and by layer."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in D.SEVERITIES] + [F.count_if(F.col("layer") == k).alias(f"layer_{k}") for k in D.LAYERS]
    return tasks.groupBy("run_id", "site_id").agg(F.count("*").alias("tasks"), F.sum("count").cast("long").alias("pages_touched"), F.count_if("autofixable").alias("autofixable"), *by)


SECTIONS = {"critical": "Critical: now", "high": "High: this week", "medium": "Medium: this month", "low": "Medium: this month", "info": "Medium: this month"}


def tracker_plan(tasks: DataFrame, today: str) -> DataFrame:
    """Entries for a tracker, due so many days after `today` (yyyy-mm-dd)."""
    return tasks.select(
        "run_id", "site_id", "host", "rule", "subject", "fingerprint", "title", "severity", "count", "autofixable", D.pick(F.col("severity"), SECTIONS, "Medium: this month").alias("section"),
        F.date_add(F.lit(today).cast("date"), F.col("due_days")).alias("due"), "layer", "first_no",
    )


def plan_order() -> list[Column]:
    """Order of a tracker's entries within a run."""
    return [D.rank(F.col("severity")).asc(), F.asc("host"), F.asc("rule"), F.asc("subject")]


def ordered_plan(plan: DataFrame) -> DataFrame:
    """The plan with each entry's position in its run."""
    return plan.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(*plan_order())).cast("long"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("run_id", "section").agg(F.count("*").alias("tasks"), F.countDistinct("host").alias("sites"), F.count_if("autofixable").alias("autofixable"), F.sum("count").cast("long").alias("pages_touched"))


def numbered(tasks: DataFrame) -> DataFrame:
    """position of each task in its site's order of work."""
    return tasks.withColumn("position", F.row_number().over(Window.partitionBy("run_id", "site_id").orderBy(*task_order())).cast("long"))
