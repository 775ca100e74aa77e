"""Site lists, robots.txt, sitemaps, responses: what a crawl reads besides pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import urls as N
from pagelens.sources.store import stored

# fixed values -----------------------------------------------------------------------------------
GUESSES = ["/sitemap_index.xml", "/sitemap.xml", "/wp-sitemap.xml", "/sitemap-index.xml", "/sitemap1.xml"]
# end of fixed values ----------------------------------------------------------------------------


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """One site a line, # for comments."""
    rows = spark.read.text(path).select(N.strip("value").alias("site")).where("site != '' AND NOT startswith(site, '#')")
    return rows.select(N.with_scheme("site").alias("origin"))


def parse_site_list(raw) -> Column:
    """Sites of a free text (commas, semicolons, lines), in order, each once under its first spelling."""
    items = F.filter(F.transform(F.split(raw, "[,;\n\r]"), lambda x: N.strip(x)), lambda x: N.list_key(x) != "")
    keys = F.transform(items, lambda x: N.list_key(x))
    return F.transform(F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(keys, N.list_key(s.x)) == s.i + 1), lambda s: N.with_scheme(s.x))


def _robots_lines(files: DataFrame) -> DataFrame:
    lines = files.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n|\r")).alias("no", "line"))
    lines = lines.withColumn("line", N.strip(F.regexp_replace("line", "#.*$", ""))).where("instr(line, ':') > 0")
    return lines.select("site", "no", F.lower(N.strip(F.substring_index("line", ":", 1))).alias("field"), N.strip(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))


def _own_group(files: DataFrame, agent: str) -> DataFrame:
    """The lines of the group that holds for the agent: the first that names it, else the first of *.

    A group is a run of User-agent lines and the rules that follow them; lines are numbered, so that group
    membership is a running count over a site's lines.
    """
    lines = _robots_lines(files).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("site").orderBy("no")
    is_agent = F.col("field") == "user-agent"
    lines = lines.withColumn("begins", (is_agent & ~F.coalesce(F.lag(is_agent).over(w), F.lit(False))).cast("int")).withColumn("grp", F.sum("begins").over(w))
    groups = lines.where(is_agent).groupBy("site", "grp").agg(F.max(F.lower("value") == agent.lower()).alias("own"), F.max(F.col("value") == "*").alias("any"))
    best = groups.where("own OR any").groupBy("site").agg(F.min_by("grp", F.struct(~F.col("own"), "grp")).alias("grp"))
    return lines.join(best, ["site", "grp"])


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """site, pattern and allow from robots.txt texts (site, text) for the agent; an empty pattern matches nothing and is left out."""
    rules = _own_group(files, agent).where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("site", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def robots_delays(files: DataFrame, agent: str) -> DataFrame:
    """site and crawl_delay in seconds (the last number that the agent's group gives)."""
    dotted = F.replace("value", F.lit(","), F.lit("."))
    given = F.when(dotted.rlike(r"^[0-9]+[.]?[0-9]*$|^[.][0-9]+$"), dotted.cast("double"))
    lines = _own_group(files, agent).where("field = 'crawl-delay'").withColumn("delay", given).where("delay is not null")
    return lines.groupBy("site").agg(F.max_by("delay", "no").alias("crawl_delay"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """site, pos and url of the sitemaps that robots.txt names, whatever group they stand in."""
    return _robots_lines(files).where("field = 'sitemap' AND value != ''").select("site", F.col("no").alias("pos"), F.col("value").alias("url"))


def pattern_regex(pattern) -> Column:
    """A robots pattern as a regular expression: * is any run, leftmost without going back; $ at the end ends the path."""
    ends = F.endswith(pattern, F.lit("$"))
    bare = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(bare, r"\*"), lambda p, i: F.when(i == 0, F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))).otherwise(F.concat(F.lit(r"(?>.*?\Q"), p, F.lit(r"\E)"))))
    return F.concat(F.lit("^"), F.array_join(parts, ""), F.when(ends, "$").otherwise(""))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """site, path and allowed: the longest pattern that matches decides, allow on ties, allowed without any.

    Rules of a site are few and are carried as one array beside its paths: an equality join, no loop over pairs.
    """
    by = rules.groupBy("site").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", pattern_regex(F.col("pattern")).alias("rx"))).alias("rules"))
    fit = F.filter(F.coalesce("rules", F.array()), lambda r: F.regexp_like(F.col("path"), r.rx))
    return paths.join(by, "site", "left").select("site", "path", F.coalesce(F.array_max(F.transform(fit, lambda r: F.struct(r.n, r.allow))).allow, F.lit(True)).alias("allowed"))


def sitemap_locs(xml) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def is_sitemap_index(xml) -> Column:
    return xml.rlike("(?i)<sitemapindex")


def sitemap_lastmod(files: DataFrame, seen: DataFrame) -> DataFrame:
    """site, url and lastmod from the sitemaps (url, xml) that were seen (site, url) and are no indexes; of several the last map's."""
    entry = F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1)))
    rows = seen.select("site", "url", "no").join(files, "url").where(~is_sitemap_index(F.col("xml"))).select("site", "no", entry.alias("entry"))
    rows = rows.select("site", "no", F.get(sitemap_locs(F.col("entry")), F.lit(0)).alias("url"), F.regexp_extract("entry", r"(?is)<lastmod>\s*([^<\s]+)\s*</lastmod>", 1).alias("lastmod"))
    return rows.where("url is not null AND lastmod != ''").groupBy("site", "url").agg(F.max_by("lastmod", "no").alias("lastmod"))


def walk_sitemaps(files: DataFrame, roots: DataFrame, most: int = 60, form=F.col) -> tuple[DataFrame, DataFrame]:
    """seen (site, url, no) and locs (site, url, no, pos) of pages, from sitemaps (url, xml), from the roots (site, url, perhaps pos)
    through indexes; loops end as seen maps are left out. form: how an index's addresses are written among the files.

    Of every site the first `most` different maps count, over all levels, in the order in which they are first seen: roots by
    pos and url, then the maps that the indexes of a level name, in the order of those indexes and of their lines.
    """
    keep = lambda df: stored(df, "sitemaps")
    in_order = Window.partitionBy("site").orderBy("no", "pos", "url")
    pos = F.min("pos") if "pos" in roots.columns else F.lit(0)
    front = roots.groupBy("site", "url").agg(pos.cast("int").alias("pos")).withColumns({"no": F.lit(0), "before": F.lit(0)})
    seen = found = None
    while True:
        front = keep(front.withColumn("no", F.col("before") + F.row_number().over(in_order)).where(F.col("no") <= most).select("site", "url", "no"))
        if seen is not None and front.isEmpty():
            return seen, found
        seen = front if seen is None else keep(seen.unionByName(front))
        got = front.join(files, "url").select("site", "no", is_sitemap_index(F.col("xml")).alias("index"), F.posexplode(sitemap_locs(F.col("xml"))).alias("pos", "loc"))
        pages = got.where("NOT index").select("site", F.col("loc").alias("url"), "no", "pos")
        found = pages if found is None else found.unionByName(pages)
        named = got.where("index").groupBy("site", form("loc").alias("url")).agg(F.min(F.struct("no", "pos")).alias("first")).select("site", "url", "first.no", "first.pos")
        front = named.join(seen.select("site", "url"), ["site", "url"], "left_anti").join(seen.groupBy("site").agg(F.count("*").cast("int").alias("before")), "site")


def expand_sitemaps(files: DataFrame, roots: DataFrame, most: int = 60) -> DataFrame:
    """site and url of the pages that walk_sitemaps() finds."""
    return walk_sitemaps(files, roots, most)[1].select("site", "url").distinct()


def cache_reading(headers) -> tuple[Column, Column]:
    """hit, miss or the first 20 characters of the first cache header that says something; and whose cache it is."""
    state = layer = None
    for name, whose in D.CACHE_HEADERS.items():
        raw = F.lower(N.strip(F.coalesce(headers[name], F.lit(""))))
        kind = F.when(raw.contains("hit"), "hit").when(raw.rlike("miss|expired|bypass|dynamic"), "miss").when(raw != "", F.substring(raw, 1, 20))
        state = kind if state is None else F.coalesce(state, kind)
        layer = F.when(kind.isNotNull(), whose) if layer is None else F.coalesce(layer, F.when(kind.isNotNull(), whose))
    return F.coalesce(state, F.lit("")), F.coalesce(layer, F.lit(""))


def stale_pages(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pages whose cached title, description or canonical differs from a fresh copy's."""
    from pagelens.functions.text import collapse

    f = fresh.select("page_id", *[F.col(c).alias(f"_{c}") for c in ("title", "description", "canonical")])
    same = (collapse("title") == collapse("_title")) & (collapse("description") == collapse("_description")) & (N.rstrip("canonical") == N.rstrip("_canonical"))
    return cached.join(f, "page_id").where(~same).select("page_id")
