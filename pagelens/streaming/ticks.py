"""The audit schedule: when a tick starts a run, as columns and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_days(raw) -> Column:
    """'1,4' (Monday is 1) to [0, 3]; nothing, * or nonsense is every day."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s", "")
    nums = F.transform(F.filter(F.split(s, ","), lambda x: x.rlike("^[0-9]{1,3}$")), lambda x: x.cast("int") - 1)
    good = F.array_sort(F.array_distinct(F.filter(nums, lambda n: n.between(0, 6))))
    return F.when(s.isin("", "*", "daily") | (F.size(good) == 0), F.sequence(F.lit(0), F.lit(6))).otherwise(good)


def days_label(raw) -> Column:
    """The days of parse_days in words."""
    names = F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    days = parse_days(raw)
    return F.when(F.size(days) == 7, "every day").otherwise(F.array_join(F.transform(days, lambda d: F.get(names, d)), ", "))


def due_reason(ts, enabled, days, hour, last_date) -> Column:
    """disabled, other_day, too_early, already_today, on_time or catching_up; ts is UTC, days as from parse_days."""
    now = F.hour(ts)
    return (
        F.when(~enabled, "disabled").when(~F.array_contains(days, F.weekday(ts)), "other_day").when(now < hour, "too_early")
        .when(F.date_format(ts, "yyyy-MM-dd") == F.coalesce(last_date, F.lit("")), "already_today").when(now == hour, "on_time").otherwise("catching_up")
    )


def fired(ticks: DataFrame, hour: int, days: str) -> DataFrame:
    """Of ticks (portfolio, ts): the first of each portfolio and date that may start a run."""
    d = ticks.withColumn("reason", due_reason(F.col("ts"), F.lit(True), parse_days(F.lit(days)), F.lit(hour), F.lit(None).cast("string")))
    d = d.where(F.col("reason").isin("on_time", "catching_up")).withColumn("day", F.to_date("ts"))
    first = F.row_number().over(Window.partitionBy("portfolio", "day").orderBy("ts"))
    return d.withColumn("_n", first).where("_n = 1").drop("_n")


def fired_stream(ticks: DataFrame, hour: int, days: str, late: str = "1 day") -> DataFrame:
    """The same over a stream of ticks: one run a portfolio and date, by deduplication within the watermark."""
    reason = due_reason(F.col("ts"), F.lit(True), parse_days(F.lit(days)), F.lit(hour), F.lit(None).cast("string"))
    d = ticks.withWatermark("ts", late).where(reason.isin("on_time", "catching_up")).withColumn("day", F.to_date("ts"))
    return d.dropDuplicatesWithinWatermark(["portfolio", "day"])


def estimate_minutes(sites, max_pages) -> tuple[Column, Column]:
    """From and to so many minutes for an audit."""
    each = F.least(F.lit(0.5), F.greatest(F.lit(0.05), max_pages / 100.0))
    low = F.greatest(F.lit(1), F.bround(sites * each).cast("int"))
    return low, F.greatest(low + 1, (low * 2))


def when_label(ts, now) -> Column:
    """How long ago, in words."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600)
    return (
        F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit(" h ago"))).when(hours < 48, "yesterday")
        .when(hours < 24 * 30, F.concat(F.floor(hours / 24).cast("string"), F.lit(" days ago"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def pending(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The pages still to fetch: a queue less what is done or failed, in the queue's order."""
    return queue.join(done.select("run_id", "page_id"), ["run_id", "page_id"], "left_anti")


def resumable_sites(sites: DataFrame) -> DataFrame:
    """Sites that a resumed run goes on with; failed ones are not tried again."""
    return sites.where(F.col("state").isin("pending", "discovering", "fetching"))
