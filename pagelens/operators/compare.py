"""Two runs of the same sites compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N

KEY = ["host", "rule", "key"]


def _side(found: DataFrame, run: int, name: str) -> DataFrame:
    """The last finding of each rule and address: the message is no part of the key."""
    last = F.max_by(F.struct("url", "severity", "layer", "message"), "finding_no").alias(name)
    return found.where(F.col("run_id") == run).groupBy("host", "rule", N.rstrip("url").alias("key")).agg(last)


def compare_runs(found: DataFrame, before: int, after: int) -> DataFrame:
    """kind (fixed, remains, appeared) of every finding of either run; values are the earlier run's where it has it."""
    both = _side(found, before, "b").join(_side(found, after, "a"), KEY, "full_outer")
    kind = F.when(F.col("b").isNull(), "appeared").when(F.col("a").isNull(), "fixed").otherwise("remains")
    v = F.coalesce("b", "a")
    return both.select("host", "rule", kind.alias("kind"), v.url.alias("url"), v.severity.alias("severity"), v.layer.alias("layer"), v.message.alias("message"))


def change_order() -> list[Column]:
    return [D.rank(F.col("severity")).asc(), F.asc("layer"), F.asc("rule"), F.asc("host"), F.asc("url")]


def top_changes(changes: DataFrame, most: int = 50) -> DataFrame:
    """Of each kind the first changes in their order, with position and the total of the kind."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*change_order())).cast("long")
    return changes.withColumn("position", place).where(F.col("position") <= most).join(F.broadcast(changes.groupBy("kind").agg(F.count("*").alias("total"))), "kind")


def morning_report(found: DataFrame, pages: DataFrame, scores: DataFrame, before: int, after: int) -> DataFrame:
    """What a scheduled run tells: one row a host that both runs saw, those with new findings first; a host of one run only says so."""
    told = compare_summary(compare_runs(found, before, after), pages, scores, before, after)
    one = (F.col("before_pages") == 0) | (F.col("after_pages") == 0)
    said = F.when(one, F.lit("only one run: nothing to compare")).when(~F.col("reliable"), F.concat(F.lit("fewer pages than before, compare with care: "), "summary")).otherwise(F.col("summary"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("appeared_weight"), F.desc("appeared"), "host")).cast("long")
    return told.select("host", "fixed", "remains", "appeared", "appeared_weight", F.concat("host", F.lit(": "), said).alias("line")).withColumn("position", place)


def compare_summary(changes: DataFrame, pages: DataFrame, scores: DataFrame, before: int, after: int) -> DataFrame:
    """Per host: counts and weights by kind, scores, and whether the later run covers enough pages to be believed."""
    kinds = ["fixed", "remains", "appeared"]
    c = changes.groupBy("host").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], *[F.sum(F.when(F.col("kind") == k, D.weight(F.col("severity"))).otherwise(0)).cast("long").alias(f"{k}_weight") for k in kinds]
    )
    n = pages.groupBy("host").agg(F.count_if(F.col("run_id") == before).alias("before_pages"), F.count_if(F.col("run_id") == after).alias("after_pages"))
    s = scores.groupBy("host").agg(F.max(F.when(F.col("run_id") == before, F.col("score"))).alias("before_score"), F.max(F.when(F.col("run_id") == after, F.col("score"))).alias("after_score"))
    out = c.join(n, "host").join(s, "host")
    reliable = ~((F.col("before_pages") > 0) & (F.col("after_pages") < F.col("before_pages") * (1 - D.COVERAGE_TOLERANCE)))
    delta = F.col("after_score") - F.col("before_score")
    trend = F.when(delta > 0, F.concat(F.lit("score up by "), delta.cast("string"))).when(delta < 0, F.concat(F.lit("score down by "), (-delta).cast("string"))).otherwise("score unchanged")
    parts = F.concat_ws(", ", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k} "), F.col(k).cast("string"))) for k in ("fixed", "appeared", "remains")])
    said = F.when((F.col("fixed") == 0) & (F.col("appeared") == 0), F.when(F.col("remains") > 0, F.concat(F.lit("nothing changed: "), F.col("remains").cast("string"), F.lit(" findings remain"))).otherwise("no changes"))
    return out.withColumn("reliable", reliable).withColumn("summary", F.coalesce(said, F.concat(parts, F.lit("; "), trend)))


def previous_runs(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """For every site and run: the run of the same host that was started last before it."""
    j = sites.join(F.broadcast(runs), "run_id")
    return j.select("host", "run_id", F.lag("run_id").over(Window.partitionBy("host").orderBy("started_at", "run_id")).alias("previous_run"))
