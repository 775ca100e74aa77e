"""The internal link graph of each site: edges, orphans, dead ends, broken edges, click depth."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls as N
from pagelens.sources.store import stored

SITE = ["run_id", "site_id"]
KEEP = 16


def edges(flat: DataFrame) -> DataFrame:
    """page_id, src, href and key (the comparison key of the target) of every internal link."""
    return flat.select(*SITE, "page_id", F.col("page_url").alias("src"), F.posexplode("links_internal").alias("pos", "href")).withColumn("key", N.graph_key("href"))


def orphans(flat: DataFrame) -> DataFrame:
    """Indexable pages, the home page aside, that no internal link of the site points to."""
    pages = flat.where((F.col("page_url") != "") & ~F.col("noindex") & (F.coalesce("status", F.lit(200)) < 400) & ~N.is_root("page_url")).withColumn("key", N.graph_key("page_url"))
    return pages.join(edges(flat).select(*SITE, "key").distinct(), [*SITE, "key"], "left_anti")


def dead_ends(flat: DataFrame) -> DataFrame:
    return flat.where((F.col("page_url") != "") & ~F.col("noindex") & (F.coalesce("status", F.lit(200)) < 400) & (F.col("links_internal_total") == 0))


def broken_edges(flat: DataFrame) -> DataFrame:
    """Links to pages of the site that answered 400 or more; of equal keys the last page's status counts."""
    status = flat.where((F.col("page_url") != "") & F.col("status").isNotNull()).groupBy(*SITE, N.graph_key("page_url").alias("key")).agg(F.max_by("status", "page_id").alias("target_status"))
    return edges(flat).join(status.where("target_status >= 400"), [*SITE, "key"])


def click_depth(flat: DataFrame) -> DataFrame:
    """run_id, site_id, key, depth: the least number of clicks from a site's home pages, by frontiers of one step.

    Every step joins only the pages reached in the step before and keeps those not seen yet; it is
    stored, so that lineage stays short, and so is all that was seen, every KEEP steps. Sites take
    as many steps as the deepest of them; it ends when no site has a page left to reach.
    """
    keep = lambda df: stored(df, "walk")
    pages = flat.where("page_url != ''").select(*SITE, N.graph_key("page_url").alias("key"), N.is_root("page_url").alias("root")).groupBy(*SITE, "key").agg(F.max("root").alias("root"))
    links = edges(flat).select(*SITE, N.graph_key("src").alias("src"), "key").join(pages.select(*SITE, "key"), [*SITE, "key"]).distinct()
    links = keep(links)
    seen = pages.where("root").select(*SITE, "key", F.lit(0).alias("depth"))
    front = seen
    for depth in itertools.count(1):
        step = front.select(*SITE, F.col("key").alias("src")).join(links, [*SITE, "src"]).select(*SITE, "key").distinct().join(seen.select(*SITE, "key"), [*SITE, "key"], "left_anti").withColumn("depth", F.lit(depth))
        step = keep(step)
        if step.isEmpty():
            return seen
        seen, front = seen.unionByName(step), step
        if depth % KEEP == 0:
            seen = keep(seen)
