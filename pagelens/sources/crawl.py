"""A crawl with planted defects, made from a table of raw pages by SQL that any engine can run.

Three runs over the sites of the table; which defect a page has follows from its number, so that
what rules have to find can be said without reading HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.head import extract_head

GOOD = "Plain words that say what this page is about, for whom it was written and where to read more about it, with a short note at its end."
LONG = GOOD + " And then it goes on for longer than any list of results would ever show."
SHORT = "A short note."
LONG_TITLE = "A title that goes on and on until no list of results can show it in full "
CYRILLIC = "Страница на другом языке чем заявлено "
CYRILLIC_SHORT = "Короткое описание на другом языке."

#: Every page of every run, raw: url, html and response; {pages} is the table of raw pages.
CRAWL_SQL = f"""
base AS (
  SELECT page_id AS i, coalesce(html, '') AS html0, lower(regexp_extract(url, '://(?:www[.]|m[.]|blog[.])?([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+([^#]*)', 1) AS tail FROM {{pages}} WHERE url LIKE '%://%'),
numbered AS (
  SELECT base.*, row_number() OVER (PARTITION BY host ORDER BY i) AS k, min(i) OVER (PARTITION BY host) AS site_no FROM base),
placed AS (SELECT numbered.*, CASE WHEN k = 1 THEN concat('https://', host, '/') ELSE concat('https://', host, tail) END AS url FROM numbered),
linked AS (
  SELECT p.*, coalesce(a.url, '') AS child_a, coalesce(b.url, '') AS child_b
  FROM placed p LEFT JOIN placed a ON a.host = p.host AND a.k = 2 * p.k LEFT JOIN placed b ON b.host = p.host AND b.k = 2 * p.k + 1),
runs_ AS (SELECT 1 AS run_id UNION ALL SELECT 2 AS run_id UNION ALL SELECT 3 AS run_id),
turned AS (
  SELECT l.*, run_id, i + run_id AS v, i * 10 + run_id AS page_id, site_no * 10 + run_id AS site_id,
         CASE WHEN (i + run_id) % 6 = 5 AND k > 1 THEN replace(url, 'https://', 'http://') ELSE url END AS final_url
  FROM linked l CROSS JOIN runs_ WHERE NOT ((i + run_id) % 19 = 0 AND k > 1)),
headed AS (
  SELECT t.*, CASE v % 5 WHEN 1 THEN CASE WHEN v % 25 = 6 THEN '<meta name="description" content="{CYRILLIC_SHORT}">' ELSE '<meta name="description" content="{SHORT}">' END WHEN 2 THEN '<meta name="description" content="{GOOD}">'
                WHEN 3 THEN '<meta name="description" content="{LONG}">' WHEN 4 THEN '<meta name="description" content="{GOOD}"><meta name="description" content="again">' ELSE '' END AS d1,
         CASE v % 7 WHEN 1 THEN concat('<link rel="canonical" href="', final_url, '">') WHEN 2 THEN '<link rel="canonical" href="https://other.example.org/x">'
                WHEN 3 THEN concat('<link rel="canonical" href="', final_url, '"><link rel="canonical" href="', final_url, '">') WHEN 4 THEN concat('<link rel="canonical" href="https://', host, '/elsewhere">')
                WHEN 5 THEN concat('<link rel="canonical" href="', final_url, '/">') WHEN 6 THEN concat('<link rel="canonical" href="https://', host, '/hub">') ELSE '' END AS d2,
         CASE v % 11 WHEN 0 THEN '<meta name="robots" content="noindex">' WHEN 1 THEN '<meta name="robots" content="index, follow"><meta name="robots" content="NOINDEX">'
                WHEN 2 THEN '<meta name="robots" content="index"><meta name="robots" content="index">' ELSE '' END AS d3,
         CASE v % 6 WHEN 0 THEN '' WHEN 1 THEN '<meta name="viewport" content="width=device-width, user-scalable = no">' WHEN 2 THEN '<meta name="viewport" content="width=device-width, maximum-scale=1">' ELSE '<meta name="viewport" content="width=device-width">' END AS d4,
         CASE v % 4 WHEN 1 THEN '<meta property="og:title" content="T">' WHEN 2 THEN '<meta property="og:title" content="T"><meta property="og:image" content="/i.png">' WHEN 3 THEN '<meta name="og:image" content="/i.png">' ELSE '' END AS d5,
         CASE v % 9 WHEN 1 THEN '<script type="application/ld+json">{{{{"@type":"Article"}}}}</script>' WHEN 2 THEN '<script type="application/ld+json">{{{{"@type":["Thing","Organization"]}}}}</script>'
                WHEN 3 THEN '<script type="application/ld+json">{{{{broken</script>' WHEN 4 THEN '<script type="application/ld+json">{{{{"@graph":[{{{{"@type":"Person"}}}},{{{{"x":{{{{"@type":"LocalBusiness"}}}}}}}}]}}}}</script>'
                WHEN 5 THEN '<script type="application/ld+json">{{{{"@type":"Article"}}}}</script>' ELSE '' END AS d6,
         CASE v % 13 WHEN 0 THEN concat('<link rel="alternate" hreflang="en" href="', final_url, '"><link rel="alternate" hreflang="ru-RU" href="https://', host, '/ru">')
                WHEN 1 THEN concat('<link rel="alternate" hreflang="x-default" href="https://', host, '/"><link rel="alternate" hreflang="de" href="https://', host, '/de">')
                WHEN 2 THEN concat('<link rel="alternate" hreflang="ru" href="https://', host, '/elsewhere">') ELSE '' END AS d7,
         CASE v % 16 WHEN 9 THEN '<title>Second</title>' ELSE '' END AS d8
  FROM turned t),
changed AS (
  SELECT h.*, CASE WHEN v % 15 = 2 THEN replace(html0, '<a href=', '<a data-href=') ELSE html0 END AS h1_,
         concat(CASE WHEN v % 15 <> 2 AND child_a <> '' THEN concat('<a href="', child_a, '">one</a>') ELSE '' END, CASE WHEN v % 15 <> 2 AND child_b <> '' THEN concat('<a href="', child_b, '">two</a>') ELSE '' END,
                CASE v % 8 WHEN 1 THEN '<h4>Deep</h4>' WHEN 2 THEN '<h2>One</h2><h3>Two</h3>' ELSE '' END, CASE v % 9 WHEN 0 THEN '<img src="a"><img src="b" alt=""><img src="c"><img src="d"><img src="e" alt=" ">' WHEN 1 THEN '<img src="a"><img alt="x"><img src="c" alt="y"><img alt="z"><img alt="w">' ELSE '' END,
                CASE WHEN v % 14 = 5 THEN '<h1>Another</h1>' ELSE '' END) AS tail_html
  FROM headed h),
retitled AS (
  SELECT c.*, CASE v % 16 WHEN 10 THEN regexp_replace(h1_, '<title>[^<]*</title>', '<title> </title>') WHEN 11 THEN replace(h1_, '<title>', '<title>{LONG_TITLE}') WHEN 12 THEN replace(h1_, '<title>', '<title>{CYRILLIC}') ELSE h1_ END AS h2_ FROM changed c),
tagged AS (
  SELECT r.*, replace(replace(CASE WHEN v % 14 = 3 THEN replace(replace(h2_, '<h1>', '<div>'), '</h1>', '</div>') ELSE h2_ END, '</head>', concat(d1, d2, d3, d4, d5, d6, d7, d8, '</head>')), '</article>', concat(tail_html, '</article>')) AS h3_ FROM retitled r),
crawl AS (
  SELECT run_id, site_id, host, concat('https://', host) AS origin, page_id, i, k, v, url, final_url, d2, child_a, child_b, html0,
         CASE WHEN v % 12 = 7 THEN replace(h4_, '<html lang=', '<html data-lang=') ELSE h4_ END AS html,
         CASE WHEN v % 3 = 1 THEN 'link' WHEN k = 1 THEN 'seed' ELSE 'sitemap' END AS source,
         CASE WHEN v % 29 = 1 AND k > 1 THEN 'queued' WHEN v % 23 = 0 THEN 'error' ELSE 'done' END AS state,
         CASE WHEN (v % 29 = 1 AND k > 1) OR v % 23 = 0 THEN CAST(NULL AS INT) WHEN v % 17 = 3 THEN 404 WHEN v % 17 = 5 THEN 500 WHEN v % 17 = 7 THEN 403 WHEN v % 17 = 9 THEN 410 ELSE 200 END AS status,
         CAST(v % 5 AS INT) AS redirects, CAST((v * 37) % 7000 AS INT) AS elapsed_ms, CASE WHEN v % 4 = 0 THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type,
         CASE WHEN site_no % 4 = 1 OR v % 3 = 0 THEN 'hit' WHEN v % 3 = 1 THEN 'miss' ELSE '' END AS cache_state, v % 61 = 4 AS cache_stale,
         site_no % 3 <> 0 AS robots_present, site_no % 4 <> 0 AS sitemaps_seen, site_no % 5 <> 0 AS robots_sitemaps
  FROM (SELECT g.*, CASE WHEN v % 10 = 5 THEN replace(h3_, '<meta charset="utf-8">', '') ELSE h3_ END AS h4_ FROM tagged g) AS z)
"""
#: The pages of every host with their numbers and addresses: the beginning of the crawl.
PLACED_SQL = CRAWL_SQL.split("linked AS (")[0].strip().rstrip(",")
COLUMNS = "run_id, site_id, host, origin, page_id, url, final_url, html, source, state, status, redirects, elapsed_ms, content_type, cache_state, cache_stale, robots_present, sitemaps_seen, robots_sitemaps"


def raw_crawl(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return spark.sql(f"WITH {CRAWL_SQL} SELECT {COLUMNS} FROM crawl", pages=pages)


def crawl_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs, sites and pages (with head) of the planted crawl."""
    raw = raw_crawl(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    sites = raw.groupBy("run_id", "site_id").agg(
        *[F.first(c).alias(c) for c in ("host", "origin", "robots_present", "sitemaps_seen", "robots_sitemaps")],
        F.when(F.pmod("site_id", F.lit(17)) == 0, "error").when(F.pmod("site_id", F.lit(13)) == 0, "fetching").otherwise("done").alias("state"),
    )
    pages = raw.withColumn("head", F.when(F.col("state") == "done", extract_head("html", "final_url"))).drop("html", "robots_present", "sitemaps_seen", "robots_sitemaps")
    runs = spark.createDataFrame([(1, 1_785_000_000, "first"), (2, 1_785_086_400, "second"), (3, 1_785_172_800, "third")], "run_id int, started_at long, label string")
    return runs, sites, pages


def planted_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, status and text of robots.txt and sitemaps of the hosts: some are declared, some guessed, one is missing."""
    p = spark.sql(f"WITH {PLACED_SQL} SELECT host, site_no, k, url FROM placed", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    day = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<lastmod>2024-01-0"), (F.col("k") % 9 + 1).cast("string"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), day, F.lit("</url>"))
    listed = lambda rest: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") % 2 == rest, F.struct("k", entry.alias("t"))))), lambda x: x.t), "")
    s = p.groupBy("host", "site_no").agg(listed(0).alias("even"), listed(1).alias("odd"))
    at = F.concat(F.lit("https://"), "host")
    robots = F.concat(F.lit("User-agent: *\nDisallow: /de/\nAllow: /de/1\nCrawl-delay: 1,5\n"), F.when(F.col("site_no") % 2 == 0, F.concat(F.lit("Sitemap: "), at, F.lit("/maps.xml\n"))).otherwise(""))
    index = F.concat(F.lit("<sitemapindex>"), *[x for name in ("m0", "m1", "gone") for x in (F.lit("<sitemap><loc>"), at, F.lit(f"/{name}.xml</loc></sitemap>"))], F.lit("</sitemapindex>"))
    foreign = F.concat(F.lit("<url><loc>https://elsewhere.example.org/x</loc></url><url><loc>"), at, F.lit("/paper.PDF</loc></url>"))
    there = F.col("site_no") % 3 != 0
    files = [
        ("/robots.txt", F.when(there, 200).otherwise(404), F.when(there, robots).otherwise("")), ("/maps.xml", F.lit(200), index), ("/m0.xml", F.lit(200), F.concat("even", foreign)), ("/m1.xml", F.lit(200), F.col("odd")),
        ("/sitemap_index.xml", F.lit(404), F.lit("<urlset><url><loc>https://x/</loc></url></urlset>")), ("/wp-sitemap.xml", F.lit(200), F.col("odd")),
    ]
    return s.select(F.inline(F.array(*[F.struct(F.concat(at, F.lit(path)).alias("url"), status.alias("status"), text.alias("text")) for path, status, text in files])))
