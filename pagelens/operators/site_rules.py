"""Site rules: one plan each over all sites of all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as N
from pagelens.operators.graph import SITE, broken_edges, click_depth, dead_ends, orphans
from pagelens.operators.page_rules import dressed, finding

KEPT = [*SITE, "host", "origin"]


def _rows(df: DataFrame, found: Column, ordinal: Column | None = None) -> DataFrame:
    """Findings of a site; the ordinal orders several of one rule."""
    return df.select(*KEPT, (ordinal if ordinal is not None else F.lit(0)).cast("long").alias("page_id"), F.inline(F.array_compact(F.array(found))))


def listed(df: DataFrame, keys: list[str], value: str, most: int, least: int = 1, order: tuple[str, ...] = ("page_id",), also: tuple[str, ...] = ()) -> DataFrame:
    """keys, n and first (of all rows of a group that has `least` rows) and urls: its first `most` values in this order, each
    with the columns `also` if there are any. No group is ever gathered: rows beyond the limit go before the shuffle."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = df.select(*keys, "page_id", value, *[c for c in {*order, *also} - {*keys, "page_id", value}]).withColumn("_at", place).where(F.col("_at") <= most)
    kept = F.struct(F.col(value).alias("url"), *also) if also else F.col(value)
    top = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", kept.alias("u")))), lambda x: x.u).alias("urls"))
    return groups.join(top, keys)


def _per_site(flat: DataFrame) -> DataFrame:
    return flat.groupBy(*SITE).agg(F.count("*").alias("pages"), F.max(F.size("links_internal") > 0).alias("have_links"))


def sitemap_rules(flat: DataFrame, sites: DataFrame) -> DataFrame:
    origin = F.col("origin")
    out = _rows(sites, F.when(~F.col("robots_present"), finding("robots.txt_missing", origin)))
    out = out.unionByName(_rows(sites, F.when(~F.col("sitemaps_seen"), finding("sitemap.missing", origin))))
    out = out.unionByName(_rows(sites, F.when(F.col("sitemaps_seen") & ~F.col("robots_sitemaps"), finding("sitemap.not_in_robots", origin))))
    p = flat.where("page_url != ''").withColumn("section", N.section("page_url")).withColumn("key", N.rstrip("page_url"))
    known = p.where("source = 'sitemap'").select(*SITE, "key").distinct().withColumn("covered", F.lit(True))
    in_map = p.join(known, [*SITE, "key"], "left").where("covered").select(*SITE, "section").distinct()
    groups = listed(p.where("section != ''").join(in_map, [*SITE, "section"], "left_anti"), [*SITE, "section"], "page_url", 10, 3)
    absent = groups.join(sites.where("sitemaps_seen").select(*KEPT), SITE)
    return out.unionByName(_rows(absent, finding("sitemap.section_absent", F.get("urls", F.lit(0)), section=F.col("section"), count=F.col("n"), urls=F.col("urls")), F.col("first")))


def duplicate_meta(flat: DataFrame, sites: DataFrame) -> DataFrame:
    out = None
    for field in ("title", "description"):
        value = F.lower(T.collapse(field))
        seen = flat.where((F.col("status") == 200) & ~F.col("noindex") & (value != "")).withColumn("value", value)
        groups = listed(seen, [*KEPT, "value"], "page_url", 12, 2)
        part = _rows(groups, finding(f"duplicate.{field}", F.get("urls", F.lit(0)), value=F.substring("value", 1, 160), count=F.col("n"), urls=F.col("urls")), F.col("first"))
        out = part if out is None else out.unionByName(part)
    return out


def canonical_clusters(flat: DataFrame, sites: DataFrame) -> DataFrame:
    canon = N.strip("canonical")
    away = flat.where((F.col("status") == 200) & (canon != "") & (F.col("canon_key") != F.col("page_key")))
    groups = listed(away.withColumn("canon", N.rstrip(canon)), [*KEPT, "canon"], "page_url", 15, 3)
    return _rows(groups, finding("canonical.mass_collapse", F.get("urls", F.lit(0)), canonical=F.col("canon"), count=F.col("n"), urls=F.col("urls")), F.col("first"))


def cache_masking(flat: DataFrame, sites: DataFrame) -> DataFrame:
    hit, stale = F.col("cache_state") == "hit", F.coalesce("cache_stale", F.lit(False))
    s = flat.groupBy(*KEPT).agg(
        F.count_if(hit).alias("hits"), F.count_if(stale).alias("stale"), F.count_if(F.col("status") == 200).alias("ok"),
        F.min_by("page_url", F.when(stale, F.col("page_id"))).alias("stale_url"), F.min_by("page_url", F.when(hit, F.col("page_id"))).alias("hit_url"),
    )
    found = F.when(F.col("stale") > 0, finding("cache.serving_stale", F.col("stale_url"), count=F.col("stale"))).when(
        (F.col("hits") > 0) & (F.col("hits") == F.col("ok")), finding("cache.fully_cached", F.col("hit_url"), count=F.col("hits")))
    return _rows(s, found)


def mixed_scheme(flat: DataFrame, sites: DataFrame) -> DataFrame:
    plain = F.col("final_url").startswith("http://")
    s = flat.groupBy(*KEPT).agg(F.count_if(plain).alias("plain"), F.count_if(F.col("final_url").startswith("https://")).alias("safe"), F.min_by("final_url", F.when(plain, F.col("page_id"))).alias("first"))
    return _rows(s, F.when((F.col("plain") > 0) & (F.col("safe") > 0), finding("security.mixed_scheme", F.col("first"), count=F.col("plain"))))


def orphan_pages(flat: DataFrame, sites: DataFrame) -> DataFrame:
    lost = listed(orphans(flat), KEPT, "page_url", 20).join(_per_site(flat).where("pages >= 4 AND have_links"), SITE)
    n = F.col("n")
    found = F.when(n / F.col("pages") > 0.8, finding("structure.orphan_suspect", F.get("urls", F.lit(0)), orphans=F.slice("urls", 1, 10), count=F.col("pages"))).otherwise(
        finding("structure.orphan_page", F.get("urls", F.lit(0)), urls=F.col("urls"), count=n))
    return _rows(lost, found)


def broken_links(flat: DataFrame, sites: DataFrame) -> DataFrame:
    bad = broken_edges(flat).groupBy(*SITE, "href", "src").agg(F.min("page_id").alias("page_id"))
    targets = listed(bad.groupBy(*SITE, "href").agg(F.min("page_id").alias("page_id")), SITE, "href", 20, order=("href",))
    shown = targets.select(*SITE, F.explode(F.slice("urls", 1, 5)).alias("href")).join(bad, [*SITE, "href"])
    sources = listed(shown, [*SITE, "href"], "src", 5).groupBy(*SITE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("href", "urls")))).alias("examples"))
    s = targets.join(sources, SITE).join(flat.select(*KEPT).distinct(), SITE)
    return _rows(s, finding("structure.broken_internal_link", F.get("urls", F.lit(0)), targets=F.col("urls"), count=F.col("n"), examples=F.col("examples")))


def deep_pages(flat: DataFrame, sites: DataFrame) -> DataFrame:
    keyed = flat.where("page_url != ''").groupBy(*KEPT, N.graph_key("page_url").alias("key")).agg(F.max_by("page_url", "page_id").alias("page_url"), F.min("page_id").alias("page_id"))
    deep = click_depth(flat).where("depth >= 4").join(keyed, [*SITE, "key"]).join(_per_site(flat).where("pages >= 8"), SITE).withColumn("shallow", -F.col("depth"))
    s = listed(deep, KEPT, "page_url", 20, order=("shallow", "page_id"), also=("depth",))
    return _rows(s, finding("structure.deep_page", F.get("urls", F.lit(0)).url, count=F.col("n"), pages=F.col("urls")))


def link_dead_ends(flat: DataFrame, sites: DataFrame) -> DataFrame:
    s = listed(dead_ends(flat), KEPT, "page_url", 20).join(_per_site(flat).where("pages >= 6 AND have_links"), SITE)
    return _rows(s.where(F.col("n") / F.col("pages") <= 0.8), finding("structure.dead_end", F.get("urls", F.lit(0)), urls=F.col("urls"), count=F.col("n")))


SITE_RULES = {
    "sitemap": sitemap_rules, "duplicate_meta": duplicate_meta, "canonical_clusters": canonical_clusters, "cache_masking": cache_masking, "mixed_scheme": mixed_scheme,
    "orphan_pages": orphan_pages, "broken_links": broken_links, "deep_pages": deep_pages, "dead_ends": link_dead_ends,
}


def site_findings(flat: DataFrame, sites: DataFrame, rules: list[str] | None = None) -> DataFrame:
    out = None
    for name in rules or SITE_RULES:
        part = SITE_RULES[name](flat, sites)
        out = part if out is None else out.unionByName(part)
    return dressed(out)
