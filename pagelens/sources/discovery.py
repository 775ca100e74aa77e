"""From sites to the addresses an audit loads: robots.txt, sitemaps, the home page, links; over landed responses (url, status, text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N
from pagelens.sources import files as S


def same_site(url, origin) -> Column:
    """Whether two addresses are of one host, www. aside."""
    return N.bare_netloc(url) == N.bare_netloc(origin)


def wanted(url, origin) -> Column:
    return same_site(url, origin) & N.is_html_candidate(url, D.SKIP_EXTENSIONS)


def path_or_root(url) -> Column:
    path = N.part(url, 3)
    return F.when(path == "", "/").otherwise(path)


def allowed_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (site, url, ...) with allowed: what the site's robots.txt says of the path."""
    paths = urls.select("site", path_or_root("url").alias("path")).distinct()
    told = S.robots_allowed(paths, rules)
    return urls.withColumn("path", path_or_root("url")).join(told, ["site", "path"]).drop("path")


@dataclass
class Discovery:
    """urls (site, no, url, source): what to load, in order. counters: one row a site. lastmod (site, url, lastmod)."""

    urls: DataFrame
    counters: DataFrame
    lastmod: DataFrame


def discover(sites: DataFrame, responses: DataFrame, agent: str = "pagelens", max_urls: int = 2000, max_sitemaps: int = 60, respect_robots: bool = True) -> Discovery:
    """sites: column origin. Sitemaps are those that robots.txt names, else the first of the usual places that holds one."""
    site = sites.select(N.rstrip(N.site_form("origin")).alias("site")).where("site != ''").distinct()
    got = responses.select(N.site_form("url").alias("url"), "status", F.coalesce("text", F.lit("")).alias("text"))
    robots = site.withColumn("url", F.concat("site", F.lit("/robots.txt"))).join(got, "url", "left").select("site", F.col("status").alias("robots_status"), F.coalesce("text", F.lit("")).alias("text"))
    rules = S.robots_rules(robots, agent)
    named = S.robots_sitemaps(robots).withColumn("url", N.site_form("url"))
    places = site.join(named.select("site").distinct(), "site", "left_anti").select("site", F.posexplode(F.array(*map(F.lit, S.GUESSES))).alias("pos", "guess"))
    hits = places.withColumn("url", F.concat("site", "guess")).join(got.where((F.col("status") == 200) & (F.size(S.sitemap_locs(F.col("text"))) > 0)), "url")
    guessed = hits.groupBy("site").agg(F.min_by("url", "pos").alias("url"), F.lit(0).alias("pos"))
    roots = named.select("site", "url", "pos").unionByName(guessed.select("site", "url", "pos"))
    via = named.select("site", F.lit("robots").alias("via")).unionByName(guessed.select("site", F.lit("guess").alias("via"))).distinct()
    maps = got.where("status = 200").select("url", F.col("text").alias("xml"))
    seen, locs = S.walk_sitemaps(maps, roots, max_sitemaps, N.site_form)
    pages = locs.withColumn("url", N.site_form("url")).where((F.col("url") != "") & wanted("url", "site"))
    pages = pages.groupBy("site", "url").agg(F.min(F.struct("no", "pos")).alias("first"))
    home = site.select("site", F.concat("site", F.lit("/")).alias("url"), F.struct(F.lit(0).alias("no"), F.lit(0).alias("pos")).alias("first"))
    every = pages.withColumn("source", F.lit("sitemap")).unionByName(home.withColumn("source", F.lit("seed")))
    every = every.groupBy("site", "url").agg(F.min("first").alias("first"), F.max("source").alias("source"))  # a home page that a sitemap lists counts as listed
    judged = allowed_urls(every, rules) if respect_robots else every.withColumn("allowed", F.lit(True))
    order = Window.partitionBy("site").orderBy("first", "url")
    judged = judged.withColumn("no", F.count_if("allowed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    urls = judged.where(F.col("allowed") & (F.col("no") <= max_urls)).select("site", F.col("no").cast("long").alias("no"), "url", "source")
    count = judged.groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(~F.col("allowed") & (F.col("no") < max_urls)).alias("blocked_by_robots"), F.count_if(F.col("allowed") & (F.col("no") <= max_urls)).alias("url_count"),
        F.max((F.col("first.no") == 0) & (F.col("source") == "sitemap")).alias("sitemap_had_home"),
    )
    broken = seen.join(maps.select("url").distinct(), "url", "left_anti").groupBy("site").agg(F.count("*").alias("sitemap_errors"))
    counters = (
        robots.select("site", "robots_status", (F.col("text") != "").alias("robots_present")).join(S.robots_delays(robots, agent), "site", "left")
        .join(rules.groupBy("site").agg(F.count("*").alias("robots_rules")), "site", "left").join(via, "site", "left").join(seen.groupBy("site").agg(F.count("*").alias("sitemaps_seen")), "site", "left")
        .join(broken, "site", "left").join(pages.groupBy("site").agg(F.count("*").alias("sitemap_url_count")), "site", "left").join(count, "site", "left")
    )
    zero = ["robots_rules", "sitemaps_seen", "sitemap_errors", "sitemap_url_count"]
    counters = counters.select(
        "site", "robots_present", "robots_status", "crawl_delay", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("via", F.lit("none")).alias("sitemap_via"),
        F.col("url_count"), "blocked_by_robots", "sitemap_had_home", (F.col("n") > max_urls).alias("truncated"),
    )
    return Discovery(urls, counters, S.sitemap_lastmod(maps, seen))


def expand_by_links(known: DataFrame, links: DataFrame, rules: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """site, no, url: pages that links (site, page_id, pos, href) lead to and known (site, url) leaves out, in first-seen order."""
    keyed = links.select("site", "page_id", "pos", N.site_form("href").alias("url")).where((F.col("url") != "") & wanted("url", "site"))
    first = keyed.groupBy("site", "url").agg(F.min(F.struct("page_id", "pos")).alias("first"))
    new = first.join(known.select("site", N.site_form("url").alias("url")).distinct(), ["site", "url"], "left_anti")
    if rules is not None:
        new = allowed_urls(new, rules).where("allowed").drop("allowed")
    place = F.row_number().over(Window.partitionBy("site").orderBy("first", "url"))
    return new.withColumn("no", place.cast("long")).where(F.col("no") <= limit).select("site", "no", "url")
