"""Concrete field values for findings that one value can mend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import text as T
from pagelens.functions import urls as N


def title_fix() -> tuple[Column, Column]:
    """(proposed, confidence) from title, h1, page_url and origin."""
    current, name = T.collapse("title"), T.brand("origin")
    # the brand at the end goes first: every page repeats it
    low = F.lower(current)
    ends = (name != "") & F.endswith(low, F.lower(name))
    bare = F.when(ends, F.regexp_replace(F.substring(current, F.lit(1), F.length(current) - F.length(name)), r"(?U)\s*$", "")).otherwise(current)
    stripped = F.when(ends & bare.rlike("[|—–-]$"), F.regexp_replace(F.regexp_replace(bare, "[|—–-]$", ""), r"(?U)\s*$", "")).otherwise(current)
    fits = F.length(stripped).between(D.TITLE_MIN, D.TITLE_MAX)
    long = F.when(fits, stripped).otherwise(T.trim_to(stripped, D.TITLE_MAX))
    h1 = T.collapse(F.get("h1", F.lit(0)))
    base = F.when(h1 != "", h1).otherwise(T.capitalize(T.slug_words("page_url")))
    made = F.when((name != "") & ~F.lower(base).contains(F.lower(name)), F.concat(base, F.lit(" — "), name)).otherwise(base)
    made = F.when(F.length(made) > D.TITLE_MAX, T.trim_to(made, D.TITLE_MAX)).otherwise(made)
    is_long = F.length(current) > D.TITLE_MAX
    proposed = F.when(is_long, long).when(base == "", "").otherwise(made)
    sure = F.when(is_long, "high").when((base == "") | (F.length(made) < D.TITLE_MIN), "needs_review").otherwise("high")
    return proposed, sure


def description_fix() -> tuple[Column, Column]:
    """A long description is cut; a missing one is never made up."""
    current = T.collapse("description")
    is_long = F.length(current) > D.DESC_MAX
    return F.when(is_long, T.trim_to(current, D.DESC_MAX, D.DESC_MIN)).otherwise(""), F.when(is_long, "high").otherwise("needs_review")


def canonical_fix() -> tuple[Column, Column]:
    own = F.col("page_url")
    return own, F.when((own == "") | (F.col("rule") == "canonical.points_elsewhere"), "needs_review").otherwise("high")


def fix_plan(found: DataFrame, flat: DataFrame) -> DataFrame:
    """One fix a page and field; where several rules ask for one field, the first that needs a person, else the first."""
    f = found.where((F.col("url") != "") & F.col("rule").isin(list(D.FIX_FIELD))).select(
        "run_id", "site_id", "host", "origin", "finding_no", "rule", "url", N.rstrip("url").alias("key"), D.pick(F.col("rule"), D.FIX_FIELD).alias("field")
    )
    page = flat.select("run_id", "site_id", N.rstrip("page_url").alias("key"), F.col("page_url").alias("_page"), "title", "description", "canonical", "h1")
    j = f.join(page, ["run_id", "site_id", "key"], "left").withColumn("page_url", F.coalesce("_page", F.lit("")))
    parts = {"meta_title": (title_fix(), T.collapse("title")), "meta_description": (description_fix(), T.collapse("description")), "canonical_url": (canonical_fix(), T.collapse("canonical"))}
    choose = lambda k: F.coalesce(*[F.when(F.col("field") == name, k(v)) for name, v in parts.items()])
    j = j.select("run_id", "site_id", "host", "finding_no", "rule", "url", "key", "field", choose(lambda v: v[0][0]).alias("proposed"), choose(lambda v: v[0][1]).alias("sure"), choose(lambda v: v[1]).alias("current"))
    j = j.withColumn("confidence", F.when(F.col("rule").isin(D.NEEDS_HUMAN), "needs_review").otherwise(F.col("sure")))
    j = j.where(~((F.col("proposed") != "") & (T.collapse("proposed") == F.col("current")))).withColumn("ready", (F.col("proposed") != "") & (F.col("confidence") == "high"))
    first = F.row_number().over(Window.partitionBy("run_id", "site_id", "key", "field").orderBy("ready", "finding_no"))
    return j.withColumn("_n", first).where("_n = 1").drop("_n", "key", "sure")


def fix_order() -> list[Column]:
    return [F.desc("ready"), F.asc("url"), F.asc("field"), F.asc("site_id")]


def only_ready(fixes: DataFrame) -> DataFrame:
    """Fixes that can be put in place without a person."""
    return fixes.where("ready")


def fixes_screen(fixes: DataFrame, most: int = 80) -> DataFrame:
    """Of every run the first fixes in their order, with position."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*fix_order())).cast("long")
    return fixes.withColumn("position", place).where(F.col("position") <= most)


def fix_summary(fixes: DataFrame) -> DataFrame:
    by = [F.count_if(F.col("field") == k).alias(k) for k in ("meta_title", "meta_description", "canonical_url")]
    return fixes.groupBy("run_id", "site_id").agg(F.count("*").alias("total"), F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("needs_review"), F.countDistinct("url").alias("pages"), *by)
