"""Every query of the audit engine: name -> (plan, SQL of the oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import head as H
from pagelens.functions import text as T
from pagelens.functions import urls as N
from pagelens.operators import graph as G
from pagelens.operators.compare import compare_runs, compare_summary, morning_report, previous_runs, top_changes
from pagelens.operators.findings import Audit, audit, health, score_of, touched
from pagelens.operators.fixes import fix_plan, fix_summary, fixes_screen
from pagelens.operators.page_rules import PAGE_RULES
from pagelens.operators.site_rules import SITE_RULES
from pagelens.operators.tasks import build_tasks, numbered, ordered_plan, plan_summary, task_summary, tracker_plan
from pagelens.plans import read as V
from pagelens.plans import reports as R
from pagelens.plans.oracle import GRAPH, collapse, graph_key, part, rank, rstrip, sql, weight
from pagelens.sources import discovery as DS
from pagelens.sources import files as S
from pagelens.sources import http as HT
from pagelens.sources.crawl import PLACED_SQL, planted_responses
from pagelens.streaming import ticks as X

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Plan, str | None]] = {}
SITE = ["run_id", "site_id"]
TODAY = "2026-08-01"


def of_audit(name: str, plan: Callable[[Audit], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = (lambda spark, d: plan(audit(spark, d)), oracle)


def of_table(name: str, tab: str, plan: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = (lambda spark, d: plan(spark.read.parquet(f"{d}/{tab}.parquet")), oracle)


# the flagship: raw pages through the native extractors, three rules, a histogram and a score by host ----------
def host_audit(pages: DataFrame) -> DataFrame:
    p = pages.select(N.host_label(F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)).alias("host"), H.native_title("html").alias("title"), T.word_count(H.native_text(F.col("html"))).alias("words"), F.col("url").startswith("http://").alias("plain"))
    n = F.char_length("title")
    p = p.withColumns({"high": (n == 0).cast("int") + F.col("plain").cast("int"), "medium": ((n > 0) & (n < D.TITLE_MIN)).cast("int") + ((F.col("words") > 0) & (F.col("words") < D.THIN_WORDS)).cast("int"), "low": (n > D.TITLE_MAX).cast("int")})
    g = p.groupBy("host").agg(F.count("*").alias("pages"), *[F.sum(c).cast("long").alias(c) for c in ("high", "medium", "low")])
    penalty = (40 * F.col("high") + 12 * F.col("medium") + 4 * F.col("low")) / F.greatest(F.lit(1.0), F.sqrt("pages"))
    return g.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - penalty / 3))).cast("int"))


_ENT = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TITLE = collapse(_ENT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_PLAIN = _ENT.format("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?i)</(p|div|br|li|tr|td|th|section|article|header|footer|h1|h2|h3|h4|h5|h6|blockquote|pre)>', ' ', 'g'), '<[^>]*>', '', 'g')")
_WORDS = r"len(list_filter(string_split(trim(regexp_replace(" + _PLAIN + r", '[\s\x{00A0}]+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))"
_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '')"
of_table("host_audit", "pages", host_audit, f"""
WITH p AS (SELECT {_HOST} AS host, {_TITLE} AS title, {_WORDS} AS words, url LIKE 'http://%' AS plain FROM pages),
c AS (SELECT host, CAST(length(title) = 0 AS INT) + CAST(plain AS INT) AS h, CAST(length(title) BETWEEN 1 AND 29 AS INT) + CAST(words BETWEEN 1 AND 149 AS INT) AS m, CAST(length(title) > 60 AS INT) AS l FROM p),
g AS (SELECT host, count(*) AS pages, CAST(sum(h) AS BIGINT) AS high, CAST(sum(m) AS BIGINT) AS medium, CAST(sum(l) AS BIGINT) AS low FROM c GROUP BY host)
SELECT host, pages, high, medium, low, CAST(greatest(0, least(100, round_even(100 - (40 * high + 12 * medium + 4 * low) / greatest(1.0, sqrt(pages)) / 3, 0))) AS INT) AS score FROM g""")
of_table("head_native", "pages", lambda p: p.select(
    "page_id", H.native_title("html").alias("title"), H.native_h1("html").alias("h1"), H.native_lang("html").alias("lang"), H.native_charset("html").alias("charset"), F.size(H.native_links("html")).alias("links"), T.word_count(H.native_text(F.col("html"))).alias("words")),
    f"""SELECT page_id, {_TITLE} AS title, {collapse(_ENT.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, CAST(len(regexp_extract_all(html, '(?is)<a\\s[^>]*?\\bhref="([^"]*)"', 1)) AS INT) AS links, CAST({_WORDS} AS INT) AS words FROM pages""")


def head_exact(p: DataFrame) -> DataFrame:
    h = F.when(F.col("html").isNotNull(), H.extract_head(F.col("html"), F.col("url")))
    h1 = F.when(F.col("h").isNotNull(), F.coalesce(F.get("h.h1", F.lit(0)), F.lit("")))
    return p.select("page_id", h.alias("h")).select("page_id", F.col("h.title").alias("title"), h1.alias("h1"), F.col("h.html_lang").alias("lang"), F.col("h.charset").alias("charset"), F.col("h.links_internal_total").alias("links"), F.col("h.word_count").alias("words"))


of_table("head_exact", "pages", head_exact, QUERIES["head_native"][1])

# url and text functions over urls and texts changed by row number ----------------------------------------------
_VARIED = "CASE page_id % 7 WHEN 0 THEN upper(url) WHEN 1 THEN concat('  ', url, ' ') WHEN 2 THEN replace(url, '://', '://user@') WHEN 3 THEN regexp_replace(url, '^(https://[^/?#]*)', '{0}1:443') WHEN 4 THEN concat(url, '///') WHEN 5 THEN substr(url, instr(url, '://') + 3) ELSE url END"


def _of_urls(name: str, column, oracle: str) -> None:
    of_table(name, "pages", lambda p: p.select("page_id", F.expr(_VARIED.format("$")).alias("u")).select("page_id", column(F.col("u")).alias("value")), f"WITH v AS (SELECT page_id, {_VARIED.format(chr(92))} AS u, trim({_VARIED.format(chr(92))}) AS s FROM pages) SELECT page_id, {oracle} AS value FROM v")


_NET = f"regexp_replace({part('s', 2)}, '^.*@', '')"
_PORT = f"regexp_extract({_NET}, ':([0-9]+)$', 1)"
_BARE = f"lower(regexp_replace({_NET}, ':[0-9]*$', ''))"
_SCHEME = f"lower({part('s', 1)})"
_QUERY = f"CASE WHEN {part('s', 4)} <> '' THEN concat('?', {part('s', 4)}) ELSE '' END"
_PATH = f"CASE WHEN {part('s', 3)} = '' THEN '/' ELSE {part('s', 3)} END"
_N1 = f"CASE WHEN {_BARE} = '' THEN s ELSE concat(CASE WHEN {_SCHEME} <> '' THEN concat({_SCHEME}, ':') ELSE '' END, '//', {_BARE}, CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE concat(':', {_PORT}) END, {_PATH}, {_QUERY}) END"
_N3S = f"CASE WHEN {part('s', 1)} = '' THEN 'https' ELSE {_SCHEME} END"
_N3 = f"concat({_N3S}, '://', CASE WHEN {_N3S} = 'https' THEN regexp_replace(lower({part('s', 2)}), ':443$', '') ELSE regexp_replace(lower({part('s', 2)}), ':80$', '') END, {_PATH}, {_QUERY})"
_LOWER = "regexp_replace(lower({}), 'https://|http://|///', '', 'g')"
_of_urls("url_page_form_n1", N.page_form, _N1)
_of_urls("url_same_key_n2", N.same_key, rstrip(_N1))
_of_urls("url_site_form_n3", N.site_form, _N3)
_of_urls("url_graph_key_n4", N.graph_key, graph_key("u"))
_of_urls("url_rstrip_n5", N.rstrip, rstrip("u"))
_of_urls("url_host_label_n6", N.host_label, f"regexp_replace(regexp_replace({_LOWER.format('u')}, '^/+|/+$', '', 'g'), '^www[.]', '')")
_of_urls("url_list_key_n7", N.list_key, "regexp_replace(regexp_replace(regexp_replace(lower(s), '^https://|^http://', ''), '^/+|/+$', '', 'g'), '^www[.]', '')")
_of_urls("url_with_scheme", N.with_scheme, "CASE WHEN s LIKE 'http://%' OR s LIKE 'https://%' THEN s ELSE concat('https://', regexp_replace(s, '^/+', '')) END")
_of_urls("url_section", N.section, f"(SELECT CASE WHEN length(coalesce(x[1], '')) <= 3 AND len(x) > 1 THEN x[2] ELSE coalesce(x[1], '') END FROM (SELECT list_filter(string_split({part('u', 3)}, '/'), lambda y: y <> '') AS x) AS z)")
_of_urls("url_html_candidate", lambda u: N.is_html_candidate(F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("/a.PDF"))).otherwise(u), D.SKIP_EXTENSIONS),
         f"NOT regexp_matches(lower({part('CASE WHEN page_id % 3 = 0 THEN concat(regexp_replace(u, ' + chr(39) + '[?#].*$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '/a.PDF' + chr(39) + ') ELSE u END', 3)}), '[.](?:{'|'.join(D.SKIP_EXTENSIONS)})$')")
_of_urls("url_cache_busted", lambda u: N.cache_busted(u, F.col("page_id") * 54321), "concat(u, CASE WHEN instr(u, '?') > 0 THEN '&' ELSE '?' END, '_ia=', CAST((page_id * 54321) % 100000 AS VARCHAR))")
_SLUG = f"(SELECT array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_extract({part('u', 3)}, '([^/]*)/*$', 1), '(?i)[.](html?|php|aspx?)$', ''), '[-_+]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')), ' '))"
_of_urls("slug_words", T.slug_words, _SLUG)
_of_urls("brand", T.brand, "(SELECT concat(upper(substr(b, 1, 1)), lower(substr(b, 2))) FROM (SELECT string_split(regexp_replace(string_split(CASE WHEN " + part("u", 2) + " <> '' THEN " + part("u", 2) + " ELSE u END, ':')[1], '^www[.]', ''), '.')[1] AS b) AS z)")
of_table("collapse_visible_len", "documents", lambda d: d.select("doc_id", F.length(T.collapse(F.concat(F.lit("  "), "text"))).cast("long").alias("n"), F.sha2(T.collapse("text").cast("binary"), 256).alias("sha")),
         f"SELECT doc_id, CAST(length({collapse('text')}) AS BIGINT) AS n, sha256({collapse('text')}) AS sha FROM documents")
_CYR = "concat(repeat('Привет мир ', CAST(floor(doc_id % 40 * length(text) / 200.0) AS INT)), text)"
of_table("script_guess", "documents", lambda d: d.select("doc_id", T.guess_script(F.expr(_CYR)).alias("got"), T.expected_script(F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit("_XX"))).otherwise(F.col("lang"))).alias("want")),
         f"""SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN '' WHEN c > 2 * l THEN 'cyrillic' WHEN l > 2 * c THEN 'latin' ELSE 'mixed' END AS got, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN 'latin' ELSE '' END AS want
         FROM (SELECT doc_id, lang, length(regexp_replace({_CYR}, '[^а-яёА-ЯЁ]', '', 'g')) AS c, length(regexp_replace({_CYR}, '[^a-zA-Z]', '', 'g')) AS l FROM documents) AS q""")
_CUT = "left(t, 160)"
of_table("trim_to", "documents", lambda d: d.select("doc_id", T.trim_to("text", 160).alias("words"), T.trim_to("text", 160, 120).alias("sentence")),
         f"""WITH t AS (SELECT doc_id, {collapse('text')} AS t FROM documents),
         w AS (SELECT doc_id, t, {_CUT} AS cut, regexp_replace(CASE WHEN instr({_CUT}, ' ') > 0 THEN regexp_extract({_CUT}, '^(.*) [^ ]*$', 1) ELSE {_CUT} END, '[ ,.;:—-]+$', '') AS words,
           greatest(length(regexp_extract({_CUT}, '^(.*[.!?]) ', 1)) - 1, -1) AS inner_, CASE WHEN regexp_matches(rtrim({_CUT}), '[.!?]$') THEN length(rtrim({_CUT})) - 1 ELSE -1 END AS tail FROM t)
         SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE words END AS words, CASE WHEN length(t) <= 160 THEN t WHEN (CASE WHEN inner_ >= 0 THEN inner_ ELSE tail END) >= 120 THEN trim(left(cut, CAST((CASE WHEN inner_ >= 0 THEN inner_ ELSE tail END) + 1 AS INT))) ELSE words END AS sentence FROM w""")

# rules ---------------------------------------------------------------------------------------------------------
_RULES_OF = {
    "status": ["http.unreachable", "http.server_error", "http.404_in_sitemap", "http.client_error", "http.redirect_chain", "sitemap.redirecting_url"], "https": ["security.no_https"],
    "canonical": ["canonical.missing", "canonical.duplicate_tag", "canonical.cross_host", "canonical.cross_language", "canonical.points_elsewhere"], "noindex": ["robots.noindex_in_sitemap", "robots.noindex"],
    "title": ["title.duplicate_tag", "title.missing", "title.too_short", "title.too_long"], "description": ["description.duplicate_tag", "description.missing", "description.too_short", "description.too_long"],
    "h1": ["h1.missing", "h1.multiple"], "thin": ["content.thin"], "images": ["images.missing_alt"], "performance": ["performance.very_slow", "performance.slow"], "lang_declared": ["i18n.lang_missing"],
    "lang_mismatch": ["i18n.title_language_mismatch", "i18n.description_language_mismatch"], "hreflang": ["i18n.hreflang_no_self", "i18n.hreflang_lang_absent"], "robots_conflict": ["robots.conflicting", "robots.duplicate_tag"],
    "viewport": ["mobile.viewport_missing", "mobile.zoom_blocked"], "charset": ["encoding.charset_missing"], "headings": ["structure.heading_skip"], "structured": ["schema.missing", "schema.no_organization"], "open_graph": ["social.og_missing", "social.og_image_missing"],
    "sitemap": ["robots.txt_missing", "sitemap.missing", "sitemap.not_in_robots", "sitemap.section_absent"], "duplicate_meta": ["duplicate.title", "duplicate.description"], "canonical_clusters": ["canonical.mass_collapse"],
    "cache_masking": ["cache.serving_stale", "cache.fully_cached"], "mixed_scheme": ["security.mixed_scheme"], "orphan_pages": ["structure.orphan_suspect", "structure.orphan_page"], "broken_links": ["structure.broken_internal_link"],
    "deep_pages": ["structure.deep_page"], "dead_ends": ["structure.dead_end"],
}
_F = "run_id, site_id, host, rule, layer, severity, effort, fixable, url, message, detail"
_TOUCHED = "list_filter(list_distinct(list_concat([url], list_concat(urls, more))), lambda u: u <> '')"
for _kind, _names in (("rule", PAGE_RULES), ("site_rule", SITE_RULES)):
    for _name in _names:
        _in = ", ".join(f"'{r}'" for r in _RULES_OF[_name])
        of_audit(f"{_kind}_{_name}", lambda a, keys=tuple(_RULES_OF[_name]): a.findings.where(F.col("rule").isin(*keys)).select(*_F.split(", "), F.array_join(F.array_sort(touched()), " ").alias("touches")),
                 sql(f"SELECT {_F}, array_to_string(list_sort({_TOUCHED}), ' ') AS touches FROM found WHERE rule IN ({_in})"))
of_audit("robots_tokens", lambda a: a.flat.select("page_id", F.array_join(F.array_sort("robots_tokens"), ",").alias("tokens"), "noindex"),
         sql("SELECT page_id, CASE WHEN e THEN '' ELSE CASE v % 11 WHEN 0 THEN 'noindex' WHEN 1 THEN 'follow,index,noindex' WHEN 2 THEN 'index' ELSE '' END END AS tokens, noindex FROM flat", upto="flat"))
of_audit("flat_pages", lambda a: a.flat.select("run_id", "site_id", "page_id", "title", "description", "canonical", "html_lang", "word_count", F.size("h1").alias("h1s"), F.col("links_internal_total").alias("links")),
         sql("SELECT run_id, site_id, page_id, title, description, canonical, html_lang, CAST(word_count AS INT) AS word_count, CAST(h1s AS INT) AS h1s, CAST(links AS INT) AS links FROM flat", upto="flat"))

# graph ---------------------------------------------------------------------------------------------------------
of_audit("graph_edges", lambda a: G.edges(a.flat).groupBy(*SITE, "page_id").agg(F.count("*").alias("links"), F.min("key").alias("first_key")), sql("SELECT run_id, site_id, page_id, count(*) AS links, min(key) AS first_key FROM keyed GROUP BY run_id, site_id, page_id", upto="graph"))
of_audit("bfs_depth", lambda a: G.click_depth(a.flat).select(*SITE, "key", F.col("depth").cast("int").alias("depth")), sql("SELECT run_id, site_id, key, CAST(depth AS INT) AS depth FROM depths", upto="graph"))
of_audit("orphans", lambda a: G.orphans(a.flat).select(*SITE, "page_id", "page_url"), sql("SELECT run_id, site_id, page_id, final_url AS page_url FROM orphan", upto="graph"))
of_audit("dead_ends", lambda a: G.dead_ends(a.flat).select(*SITE, "page_id"), sql("SELECT run_id, site_id, page_id FROM flat WHERE NOT noindex AND coalesce(status, 200) < 400 AND links = 0", upto="graph"))
of_audit("broken_links", lambda a: G.broken_edges(a.flat).select(*SITE, "page_id", "href", F.col("target_status").cast("int").alias("status")), sql("SELECT run_id, site_id, page_id, href, status_ AS status FROM (SELECT *, CAST(target_status AS INT) AS status_ FROM broken) AS b", upto="graph"))

# findings and scores -------------------------------------------------------------------------------------------
of_audit("findings_all", lambda a: a.findings.groupBy("run_id", "rule", "layer", "severity").agg(F.count("*").alias("n")), sql("SELECT run_id, rule, layer, severity, count(*) AS n FROM found GROUP BY run_id, rule, layer, severity"))
of_audit("findings_order", lambda a: a.findings.select(*SITE, "finding_no", "rule", "url", F.round(score_of(), 6).alias("score")), sql("SELECT run_id, site_id, finding_no, rule, url, round(CAST(weight_ AS DOUBLE) / greatest(1, effort), 6) AS score FROM found"))
_HEALTH = f"""
n AS (SELECT run_id, site_id, count(*) AS pages FROM crawl GROUP BY run_id, site_id),
h AS (
  SELECT n.run_id AS run_id, n.site_id AS site_id, n.pages AS pages, count(f.rule) AS findings,
         CAST(greatest(0, least(100, round_even(100 - coalesce(sum(f.weight_ / CASE WHEN f.url = '' THEN 1.0 ELSE greatest(1.0, sqrt(n.pages)) END), 0) / 3, 0))) AS INT) AS score
  FROM n LEFT JOIN found f ON f.run_id = n.run_id AND f.site_id = n.site_id GROUP BY n.run_id, n.site_id, n.pages)"""
of_audit("health_score", lambda a: health(a.findings, a.pages), sql("SELECT run_id, site_id, pages, findings, score FROM h", _HEALTH))
_SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in D.SEVERITIES)
of_audit("severity_histogram", lambda a: V.severity_counts(a.findings, *SITE), sql(f"SELECT run_id, site_id, {_SEV} FROM found GROUP BY run_id, site_id"))
of_audit("rule_frequency_top15", lambda a: V.rule_frequency(a, 3), sql("SELECT rule, count(DISTINCT site_id) AS sites, count(*) AS findings FROM found WHERE run_id = 3 GROUP BY rule ORDER BY sites DESC, rule LIMIT 15"))
of_audit("findings_by_layer", V.findings_by_layer, sql("SELECT run_id, layer, CAST(sum(n) AS BIGINT) AS findings, string_agg(rule, ',' ORDER BY rank_, rule) AS rules FROM (SELECT run_id, layer, rule, rank_, count(*) AS n FROM found GROUP BY run_id, layer, rule, rank_) AS q GROUP BY run_id, layer"))
of_audit("run_summary", V.run_summary, sql("""SELECT s.run_id AS run_id, s.sites AS sites, s.sites_done AS sites_done, s.sites_failed AS sites_failed, p.pages_done AS pages_done, p.pages_queued AS pages_queued, f.findings AS findings
  FROM (SELECT run_id, count(*) AS sites, count(*) FILTER (state = 'done') AS sites_done, count(*) FILTER (state = 'error') AS sites_failed FROM sites GROUP BY run_id) AS s
  JOIN (SELECT run_id, count(*) FILTER (state = 'done') AS pages_done, count(*) FILTER (state = 'queued') AS pages_queued FROM crawl GROUP BY run_id) AS p ON p.run_id = s.run_id
  JOIN (SELECT run_id, count(*) AS findings FROM found GROUP BY run_id) AS f ON f.run_id = s.run_id"""))

# tasks, plan, fixes --------------------------------------------------------------------------------------------
_TASKS = f"""
grouped AS (
  SELECT run_id, site_id, host, origin, rule, subject, min(rank_) AS rank_, max(layer) AS layer, max(effort) AS effort, count(*) AS items, min(finding_no) AS first_no, arg_min(message, finding_no) AS message, arg_min(detail, finding_no) AS detail FROM found WHERE rank_ <= 2 GROUP BY run_id, site_id, host, origin, rule, subject),
spread AS (SELECT DISTINCT run_id, site_id, rule, subject, u FROM (SELECT run_id, site_id, rule, subject, unnest(list_append(urls, url)) AS u FROM found WHERE rank_ <= 2) AS q WHERE u <> ''),
tasks AS (
  SELECT g.*, {D.sql_case('g.rank_', dict(enumerate(D.SEVERITIES)))} AS severity, CASE WHEN coalesce(c.n, 0) > 0 THEN c.n ELSE g.items END AS count_, concat('{D.MARK}', substr(sha1(concat(origin, '|', g.rule, '|', g.subject)), 1, 12)) AS fingerprint,
         {D.sql_case('g.rank_', {0: 2, 1: 7, 2: 30, 3: 90}, '30')} AS due_days, g.rule IN ('canonical.cross_language', 'canonical.cross_host', 'canonical.missing') AS autofixable
  FROM grouped g LEFT JOIN (SELECT run_id, site_id, rule, subject, count(*) AS n FROM spread GROUP BY run_id, site_id, rule, subject) AS c ON c.run_id = g.run_id AND c.site_id = g.site_id AND c.rule = g.rule AND c.subject = g.subject)"""
of_audit("tasks_grouped", lambda a: numbered(build_tasks(a.findings)).select(*SITE, "rule", "subject", "severity", "layer", "effort", "count", "due_days", "autofixable", "position"),
         sql("SELECT run_id, site_id, rule, subject, severity, layer, effort, count_ AS count, due_days, autofixable, row_number() OVER (PARTITION BY run_id, site_id ORDER BY rank_, layer, -count_, first_no, rule, subject) AS position FROM tasks", _TASKS))
of_audit("task_fingerprint", lambda a: build_tasks(a.findings, "info").select("host", "rule", "subject", "fingerprint").distinct(), sql("SELECT DISTINCT host, rule, subject, fingerprint FROM tasks", _TASKS.replace("rank_ <= 2", "rank_ <= 4")))
_TITLE_OF = "concat('[', host, '] ', message, CASE WHEN count_ > 1 AND NOT contains(message, 'pages)') THEN concat(' — ', CAST(count_ AS VARCHAR), ' pages') ELSE '' END)"
of_audit("task_titles", lambda a: build_tasks(a.findings).select(*SITE, "rule", "subject", "title", F.array_join("tags", ",").alias("tags")),
         sql(f"SELECT run_id, site_id, rule, subject, {_TITLE_OF} AS title, concat('seo:', {D.sql_case('layer', D.LAYERS)}, ',seo:', severity, ',', host) AS tags FROM tasks", _TASKS))
_BODY = _TASKS + """,
told_ AS (SELECT run_id, site_id, rule, subject, u, min(finding_no * 1000 + pos) AS o FROM (
  SELECT run_id, site_id, rule, subject, finding_no, unnest(list_append(urls, url)) AS u, generate_subscripts(list_append(urls, url), 1) AS pos FROM found WHERE rank_ <= 2) AS q WHERE u <> '' GROUP BY run_id, site_id, rule, subject, u),
listed_ AS (SELECT run_id, site_id, rule, subject, list(u ORDER BY o) AS us FROM told_ GROUP BY run_id, site_id, rule, subject)"""
of_audit("task_body", lambda a: R.task_bodies(a), sql(f"""
SELECT t.run_id AS run_id, t.site_id AS site_id, t.rule AS rule, t.subject AS subject, {_TITLE_OF} AS title, concat('Site: ', origin, '\nLayer: ', {D.sql_case('layer', D.LAYERS)}, ' · Severity: ', severity, ' · Effort: ',
  {D.sql_case('effort', D.EFFORTS)}, '\n\nWhat to do: ', detail, '\n\nPages:\n', array_to_string(list_transform(list_slice(coalesce(us, CAST([] AS VARCHAR[])), 1, 15), lambda u: concat('- ', u)), '\n'),
  CASE WHEN len(us) > 15 THEN concat('\nand ', CAST(len(us) - 15 AS VARCHAR), ' more') ELSE '' END, '\n\n—\nAudit mark: ', fingerprint) AS body
FROM tasks t LEFT JOIN listed_ x ON x.run_id = t.run_id AND x.site_id = t.site_id AND x.rule = t.rule AND x.subject = t.subject""", _BODY))
_LAYERS = ", ".join(f"count(*) FILTER (layer = {k}) AS layer_{k}" for k in D.LAYERS)
of_audit("task_summary", lambda a: task_summary(build_tasks(a.findings)), sql(f"SELECT run_id, site_id, count(*) AS tasks, CAST(sum(count_) AS BIGINT) AS pages_touched, count(*) FILTER (autofixable) AS autofixable, {_SEV}, {_LAYERS} FROM tasks GROUP BY run_id, site_id", _TASKS))
_SECTION = D.sql_case("severity", {"critical": "Critical: now", "high": "High: this week"}, "'Medium: this month'")
of_audit("tracker_plan", lambda a: tracker_plan(build_tasks(a.findings), TODAY).select(*SITE, "rule", "subject", "section", F.col("due").cast("string").alias("due"), "fingerprint"),
         sql(f"SELECT run_id, site_id, rule, subject, {_SECTION} AS section, CAST(DATE '{TODAY}' + CAST(due_days AS INT) AS VARCHAR) AS due, fingerprint FROM tasks", _TASKS))
of_audit("plan_summary", lambda a: plan_summary(tracker_plan(build_tasks(a.findings), TODAY)), sql(f"SELECT run_id, {_SECTION} AS section, count(*) AS tasks, count(DISTINCT host) AS sites, count(*) FILTER (autofixable) AS autofixable, CAST(sum(count_) AS BIGINT) AS pages_touched FROM tasks GROUP BY run_id, section", _TASKS))
_TRIM60 = "CASE WHEN length({x}) <= 60 THEN {x} ELSE regexp_replace(CASE WHEN instr(left({x}, 60), ' ') > 0 THEN regexp_extract(left({x}, 60), '^(.*) [^ ]*$', 1) ELSE left({x}, 60) END, '[ ,.;:—-]+$', '') END"
_FIX = f"""
fx AS (
  SELECT f.*, {rstrip('f.url')} AS key, {D.sql_case('f.rule', D.FIX_FIELD)} AS field FROM found f WHERE f.url <> ''),
fj AS (
  SELECT x.run_id AS run_id, x.site_id AS site_id, x.rule AS rule, x.url AS url, x.key AS key, x.field AS field, x.finding_no AS finding_no, coalesce(p.final_url, '') AS page_url, coalesce(p.description, '') AS description, coalesce(p.canonical, '') AS canonical, coalesce(p.title, '') AS title, coalesce(p.h1_text, '') AS h1_text, coalesce(p.final_url, '') AS u,
         concat(upper(substr(string_split(x.host, '.')[1], 1, 1)), lower(substr(string_split(x.host, '.')[1], 2))) AS brand,
         regexp_replace(left(coalesce(p.description, ''), 160), ' [^ ]*$', '') AS cut FROM fx x LEFT JOIN flat p ON p.run_id = x.run_id AND p.site_id = x.site_id AND {rstrip('p.final_url')} = x.key WHERE x.field IS NOT NULL),
ft AS (
  SELECT *, CASE WHEN ends_with(lower(title), lower(brand)) AND regexp_matches(rtrim(left(title, length(title) - length(brand))), '[|—–-]$') THEN rtrim(regexp_replace(rtrim(left(title, length(title) - length(brand))), '[|—–-]$', '')) ELSE title END AS stripped,
    CASE WHEN h1_text <> '' THEN h1_text ELSE (SELECT concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) FROM (SELECT {_SLUG} AS w) AS z) END AS base FROM fj),
fm AS (SELECT *, CASE WHEN contains(lower(base), lower(brand)) THEN base ELSE concat(base, ' — ', brand) END AS made FROM ft),
fn AS (SELECT *, {_TRIM60.format(x='made')} AS made60, {_TRIM60.format(x='stripped')} AS cut60 FROM fm),
fc AS (
  SELECT *, CASE WHEN field = 'meta_title' THEN CASE WHEN length(title) > 60 THEN CASE WHEN length(stripped) BETWEEN 30 AND 60 THEN stripped ELSE cut60 END WHEN base = '' THEN '' ELSE made60 END WHEN field = 'canonical_url' THEN page_url WHEN length(description) > 160 THEN CASE WHEN instr(left(description, 160), '. ') > 120 THEN left(description, CAST(instr(left(description, 160), '. ') AS INT)) ELSE cut END ELSE '' END AS proposed,
    CASE WHEN rule IN ('duplicate.title', 'title.too_short', 'duplicate.description', 'description.too_short', 'canonical.points_elsewhere') THEN 'needs_review' WHEN field = 'meta_title' THEN CASE WHEN length(title) > 60 THEN 'high' WHEN base = '' OR length(made60) < 30 THEN 'needs_review' ELSE 'high' END WHEN field = 'canonical_url' THEN CASE WHEN page_url = '' THEN 'needs_review' ELSE 'high' END WHEN length(description) > 160 THEN 'high' ELSE 'needs_review' END AS confidence,
    CASE field WHEN 'canonical_url' THEN canonical WHEN 'meta_title' THEN title ELSE description END AS current FROM fn),
fr AS (SELECT *, proposed <> '' AND confidence = 'high' AS ready FROM fc WHERE NOT (proposed <> '' AND proposed = current)),
fixes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, site_id, key, field ORDER BY ready, finding_no) AS n_ FROM fr) AS q WHERE n_ = 1)"""
of_audit("fix_plan", lambda a: fix_plan(a.findings, a.flat).select(*SITE, "url", "field", "rule", "current", "proposed", "confidence", "ready"), sql("SELECT run_id, site_id, url, field, rule, current, proposed, confidence, ready FROM fixes", _FIX))
of_audit("fix_titles", lambda a: fix_plan(a.findings, a.flat).where("field = 'meta_title'").select(*SITE, "url", "rule", "current", "proposed", "confidence", "ready"), sql("SELECT run_id, site_id, url, rule, current, proposed, confidence, ready FROM fixes WHERE field = 'meta_title'", _FIX))
of_audit("fix_summary", lambda a: fix_summary(fix_plan(a.findings, a.flat)), sql("SELECT run_id, site_id, count(*) AS total, count(*) FILTER (ready) AS ready, count(*) FILTER (NOT ready) AS needs_review, count(DISTINCT url) AS pages, count(*) FILTER (field = 'meta_title') AS meta_title, count(*) FILTER (field = 'meta_description') AS meta_description, count(*) FILTER (field = 'canonical_url') AS canonical_url FROM fixes GROUP BY run_id, site_id", _FIX))

# comparisons ---------------------------------------------------------------------------------------------------
_DIFF = f"""
side AS (SELECT run_id, host, rule, {rstrip('url')} AS key, arg_max(url, finding_no) AS url, max(severity) AS severity, max(layer) AS layer FROM found WHERE run_id IN (1, 2) GROUP BY run_id, host, rule, key),
changes AS (
  SELECT coalesce(b.host, a.host) AS host, coalesce(b.rule, a.rule) AS rule, CASE WHEN b.host IS NULL THEN 'appeared' WHEN a.host IS NULL THEN 'fixed' ELSE 'remains' END AS kind, coalesce(b.url, a.url) AS url, coalesce(b.severity, a.severity) AS severity, coalesce(b.layer, a.layer) AS layer
  FROM (SELECT * FROM side WHERE run_id = 1) AS b FULL JOIN (SELECT * FROM side WHERE run_id = 2) AS a ON a.host = b.host AND a.rule = b.rule AND a.key = b.key)"""
of_audit("compare_runs", lambda a: compare_runs(a.findings, 1, 2).drop("message"), sql("SELECT host, rule, kind, url, severity, layer FROM changes", _DIFF))
of_audit("compare_counts_weight", lambda a: compare_runs(a.findings, 1, 2).groupBy("kind").agg(F.count("*").alias("n"), F.sum(D.weight(F.col("severity"))).cast("long").alias("weight")), sql(f"SELECT kind, count(*) AS n, CAST(sum({weight('severity')}) AS BIGINT) AS weight FROM changes GROUP BY kind", _DIFF))


def _scored(a: Audit) -> DataFrame:
    return health(a.findings, a.pages).join(a.sites.select(*SITE, "host"), SITE)


of_audit("compare_coverage", lambda a: compare_summary(compare_runs(a.findings, 1, 2), a.flat, _scored(a), 1, 2).select("host", "fixed", "remains", "appeared", "fixed_weight", "appeared_weight", "before_pages", "after_pages", "before_score", "after_score", "reliable", "summary"),
         sql(f"""SELECT host, fixed, remains, appeared, fixed_weight, appeared_weight, before_pages, after_pages, before_score, after_score, NOT (before_pages > 0 AND after_pages < before_pages * 0.75) AS reliable,
         CASE WHEN fixed = 0 AND appeared = 0 THEN CASE WHEN remains > 0 THEN concat('nothing changed: ', CAST(remains AS VARCHAR), ' findings remain') ELSE 'no changes' END ELSE
           concat(concat_ws(', ', CASE WHEN fixed > 0 THEN concat('fixed ', CAST(fixed AS VARCHAR)) END, CASE WHEN appeared > 0 THEN concat('appeared ', CAST(appeared AS VARCHAR)) END, CASE WHEN remains > 0 THEN concat('remains ', CAST(remains AS VARCHAR)) END), '; ',
             CASE WHEN after_score > before_score THEN concat('score up by ', CAST(after_score - before_score AS VARCHAR)) WHEN after_score < before_score THEN concat('score down by ', CAST(before_score - after_score AS VARCHAR)) ELSE 'score unchanged' END) END AS summary
         FROM (SELECT host, count(*) FILTER (kind = 'fixed') AS fixed, count(*) FILTER (kind = 'remains') AS remains, count(*) FILTER (kind = 'appeared') AS appeared, CAST(coalesce(sum({weight('severity')}) FILTER (kind = 'fixed'), 0) AS BIGINT) AS fixed_weight, CAST(coalesce(sum({weight('severity')}) FILTER (kind = 'appeared'), 0) AS BIGINT) AS appeared_weight FROM changes GROUP BY host) AS c
         JOIN (SELECT host AS ph, count(*) FILTER (run_id = 1) AS before_pages, count(*) FILTER (run_id = 2) AS after_pages FROM flat GROUP BY host) AS p ON p.ph = c.host
         JOIN (SELECT s.host AS sh, max(h.score) FILTER (h.run_id = 1) AS before_score, max(h.score) FILTER (h.run_id = 2) AS after_score FROM h JOIN sites s ON s.run_id = h.run_id AND s.site_id = h.site_id GROUP BY s.host) AS s ON s.sh = c.host""", _DIFF + "," + _HEALTH))
of_audit("previous_run", lambda a: previous_runs(a.sites, a.runs), sql("SELECT host, run_id, lag(run_id) OVER (PARTITION BY host ORDER BY run_id) AS previous_run FROM sites", upto="crawl"))

# read surface --------------------------------------------------------------------------------------------------
_ROWS = _HEALTH + "," + _TASKS + f""",
rows_ AS (
  SELECT s.run_id AS run_id, s.site_id AS site_id, s.host AS host, s.state AS state, h.pages AS pages, h.findings AS findings, h.score AS score, coalesce(t.n, 0) AS tasks, {", ".join(f"coalesce(c.{s}, 0) AS {s}" for s in D.SEVERITIES)}, coalesce(x.top_issue, '') AS top_issue
  FROM sites s JOIN h ON h.run_id = s.run_id AND h.site_id = s.site_id LEFT JOIN (SELECT run_id, site_id, count(*) AS n FROM tasks GROUP BY run_id, site_id) AS t ON t.run_id = s.run_id AND t.site_id = s.site_id
  LEFT JOIN (SELECT run_id, site_id, {_SEV} FROM found GROUP BY run_id, site_id) AS c ON c.run_id = s.run_id AND c.site_id = s.site_id
  LEFT JOIN (SELECT run_id, site_id, arg_min(rule, layer * 1000000 + rank_ * 100000 + finding_no) AS top_issue FROM found WHERE severity IN ('critical', 'high') GROUP BY run_id, site_id) AS x ON x.run_id = s.run_id AND x.site_id = s.site_id)"""
of_audit("list_sites", V.site_rows, sql(f"SELECT run_id, site_id, host, state, pages, findings, score, tasks, {', '.join(D.SEVERITIES)}, top_issue FROM rows_", _ROWS))
of_audit("list_runs", lambda a: V.list_runs(a).drop("started_at", "label"), sql("""SELECT run_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS failed, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high,
  CAST(round_even(avg(score) FILTER (state = 'done'), 0) AS INT) AS average, CAST(floor(avg(score) FILTER (state = 'done')) AS INT) AS average_cut, arg_min(host, score * 10000000 + site_id) FILTER (state = 'done') AS worst FROM rows_ GROUP BY run_id""", _ROWS))
_CONN = """
seen_ AS (SELECT host, site_id, run_id, state, 1784913600 + 86400 * run_id AS started_at, row_number() OVER (PARTITION BY host ORDER BY run_id DESC, site_id DESC) AS rn FROM sites),
conn AS (SELECT host, max(started_at) AS last_seen, count(DISTINCT run_id) AS runs, max(state) FILTER (rn = 1) AS state, max(site_id) FILTER (rn = 1) AS site_id FROM seen_ GROUP BY host),
shown AS (SELECT c.host AS host, CAST(c.last_seen AS BIGINT) AS last_seen, c.runs AS runs, c.state AS state, coalesce(n.pages, 0) AS pages FROM conn c LEFT JOIN (SELECT site_id, count(*) AS pages FROM crawl GROUP BY site_id) AS n ON n.site_id = c.site_id)"""
_CORDER = "ORDER BY state = 'done', last_seen DESC, host"
of_audit("connected_sites_page", lambda a: V.connected_page(a, 10, 5), sql(f"SELECT host, last_seen, runs, state, pages FROM shown {_CORDER} LIMIT 10 OFFSET 5", _CONN, "crawl"))
of_audit("connected_sites_search", lambda a: V.connected_page(a, 200, 0, "EXAMPLE.n"), sql("SELECT host, last_seen, runs, state, pages FROM shown WHERE contains(host, 'example.n')", _CONN, "crawl"))
of_audit("connected_sites_total", lambda a: V.connected(a).agg(F.count("*").alias("hosts")), sql("SELECT count(*) AS hosts FROM conn", _CONN, "crawl"))
of_audit("site_history_top12", lambda a: V.site_history(a), sql("SELECT s.host AS host, s.run_id AS run_id, row_number() OVER (PARTITION BY s.host ORDER BY s.run_id DESC) AS rn, s.state AS state, h.score AS score FROM sites s JOIN h ON h.run_id = s.run_id AND h.site_id = s.site_id", _HEALTH))
_ANY = "https://tionsh.example.net"
of_audit("list_findings", lambda a: V.list_findings(a, 2, "high", limit=100), sql("SELECT site_id, finding_no, rule, severity, url, '' AS matched_via, row_number() OVER (ORDER BY layer, rank_, site_id, finding_no) AS position, count(*) OVER () AS total FROM found WHERE run_id = 2 AND rank_ <= 1 ORDER BY position LIMIT 100"))
_SLICE = f"""
slice_ AS (
  SELECT *, CASE WHEN {rstrip('url')} = '{_ANY}' THEN 'url' WHEN list_contains(list_transform({_TOUCHED}, lambda u: {rstrip('u')}), '{_ANY}') THEN 'evidence' END AS via FROM found)"""
of_audit("list_findings_page_slice", lambda a: V.list_findings(a, 1, "info", f"{_ANY}/", 200).select("site_id", "finding_no", "rule", "severity", "matched_via"),
         sql("SELECT site_id, finding_no, rule, severity, via AS matched_via FROM slice_ WHERE run_id = 1 AND via IS NOT NULL ORDER BY layer, rank_, site_id, finding_no LIMIT 200", _SLICE))
of_audit("list_tasks", lambda a: V.list_tasks(a, 2, limit=60).select("site_id", "rule", "subject", "severity", "count", "fingerprint", "total"), sql("SELECT site_id, rule, subject, severity, count_ AS count, fingerprint, count(*) OVER () AS total FROM tasks WHERE run_id = 2 ORDER BY rank_, host, layer, count_ DESC, first_no, rule, subject LIMIT 60", _TASKS))
of_audit("tasks_page_slice", lambda a: V.list_tasks(a, 1, "info", f"{_ANY}/", 200).select("site_id", "rule", "subject", "severity"), sql(f"SELECT DISTINCT t.site_id AS site_id, t.rule AS rule, t.subject AS subject, t.severity AS severity FROM tasks t JOIN spread s ON s.run_id = t.run_id AND s.site_id = t.site_id AND s.rule = t.rule AND s.subject = t.subject WHERE t.run_id = 1 AND {rstrip('s.u')} = '{_ANY}'", _TASKS.replace("rank_ <= 2", "rank_ <= 4")))
of_audit("tasks_screen_top60", lambda a: numbered(build_tasks(a.findings.where("run_id = 3"))).orderBy(D.rank(F.col("severity")), "origin", "rule", "subject").limit(60).select("origin", "rule", "subject", "severity"), sql("SELECT origin, rule, subject, severity FROM tasks WHERE run_id = 3 ORDER BY rank_, origin, rule, subject LIMIT 60", _TASKS))
of_audit("site_pages_screen", lambda a: V.site_pages(a), sql(f"""
SELECT n.run_id AS run_id, n.site_id AS site_id, n.page_id AS page_id, n.final_url AS page_url, count(finding_no) AS findings, {", ".join(f"count(*) FILTER (t.severity = '{s}') AS {s}" for s in D.SEVERITIES)}, CAST(coalesce(min(rank_), 99) AS INT) AS worst,
  row_number() OVER (PARTITION BY n.run_id, n.site_id ORDER BY coalesce(min(rank_), 99), n.final_url, n.page_id) AS position
FROM flat n LEFT JOIN (SELECT DISTINCT run_id, site_id, finding_no, severity, rank_, {rstrip('u')} AS key FROM (SELECT *, unnest({_TOUCHED}) AS u FROM found) AS q) AS t
  ON t.run_id = n.run_id AND t.site_id = n.site_id AND t.key = {rstrip('n.final_url')} GROUP BY n.run_id, n.site_id, n.page_id, n.final_url"""))
of_audit("only_issues", lambda a: V.site_pages(a, True).groupBy(*SITE).agg(F.count("*").alias("pages")), sql("SELECT n.run_id AS run_id, n.site_id AS site_id, count(DISTINCT n.page_id) AS pages FROM flat n JOIN found f ON f.run_id = n.run_id AND f.site_id = n.site_id AND f.url IN (n.final_url, n.url) GROUP BY n.run_id, n.site_id"))
of_audit("findings_screen_order", lambda a: V.sites_screen(a, 2), sql("SELECT host, critical, high, 10 * critical + high AS pressure FROM rows_ WHERE run_id = 2", _ROWS))
of_audit("find_page", lambda a: V.find_page(a, 1, "HTTPS://Tionsh.Example.NET:443"), sql(f"SELECT site_id, page_id, final_url AS page_url FROM flat WHERE run_id = 1 AND {rstrip('final_url')} = '{_ANY}' ORDER BY page_id LIMIT 1", upto="flat"))
of_audit("portfolio_report_md", R.portfolio_report, sql("""SELECT run_id, concat('# Portfolio\n\n', CAST(sum(tasks) FILTER (state = 'done') AS BIGINT), ' tasks, ', CAST(sum(pages) FILTER (state = 'done') AS BIGINT), ' pages, ', count(*) FILTER (state = 'done' AND critical > 0), ' sites with critical findings\n\n| site | score | tasks |\n|---|---|---|\n',
  string_agg(concat('| ', host, ' | ', score, ' | ', tasks, ' |'), '\n' ORDER BY score, -tasks, host) FILTER (state = 'done'), '\n') AS report FROM rows_ GROUP BY run_id""", _ROWS))
of_audit("site_report_md", R.site_reports, sql(f"""SELECT r.run_id AS run_id, r.site_id AS site_id, r.host AS host, concat('# ', r.host, '\n\nScore ', r.score, ' of 100, ', r.pages, ' pages\n\n', {", ', ', ".join(f"'{s}: ', r.{s}" for s in D.SEVERITIES)}, '\n\n| rule | severity | findings |\n|---|---|---|\n', coalesce(x.t, ''), '\n') AS report
  FROM rows_ r LEFT JOIN (SELECT run_id, site_id, string_agg(concat('| ', rule, ' | ', severity, ' | ', n, ' |'), '\n' ORDER BY rank_, rule) AS t FROM (SELECT run_id, site_id, rule, severity, rank_, count(*) AS n FROM found GROUP BY run_id, site_id, rule, severity, rank_) AS q GROUP BY run_id, site_id) AS x ON x.run_id = r.run_id AND x.site_id = r.site_id""", _ROWS))
of_audit("page_report_md", lambda a: R.page_report(a, 1, f"{_ANY}/"), sql(f"""
SELECT concat('# {_ANY}/\n\n', CAST(count(*) AS VARCHAR), ' findings\n\n', coalesce(string_agg(concat('- ', severity, ' ', rule, ' (', via, '): ', message), '\n' ORDER BY site_id, finding_no), ''), '\n') AS report FROM slice_ WHERE run_id = 1 AND via IS NOT NULL""", _SLICE))

# sources -------------------------------------------------------------------------------------------------------
_ROBOTS = "# robots\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\n\nUser-agent: other\nDisallow: /\n\nUser-agent: pagelens\nUser-agent: second\nDisallow: /fr/*5$\nDisallow: /de\nAllow: /de/4\nSitemap: https://x/s.xml\n"


def robots_match(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    rules = S.robots_rules(spark.createDataFrame([("a", _ROBOTS)], "site string, text string"), "PageLens")
    paths = pages.select(F.lit("a").alias("site"), N.part("url", 3).alias("path")).distinct()
    return S.robots_allowed(paths, rules).select("path", "allowed")


QUERIES["robots_match"] = (robots_match, f"""
WITH p AS (SELECT DISTINCT {part('url', 3)} AS path FROM pages)
SELECT path, CASE WHEN path LIKE '/de/4%' THEN true WHEN path LIKE '/de%' THEN false WHEN regexp_matches(path, '^/fr/.*?5$') AND strpos(substr(path, 5), '5') = length(path) - 4 THEN false ELSE true END AS allowed FROM p""")
of_table("sitemap_locs", "pages", lambda p: p.groupBy(F.pmod("page_id", F.lit(10)).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<url><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "\n").alias("xml")).select("file", F.explode(S.sitemap_locs(F.col("xml"))).alias("url")),
         "SELECT page_id % 10 AS file, url FROM pages")
of_table("site_list_parse", "pages", lambda p: p.groupBy(F.pmod("page_id", F.lit(20)).alias("list")).agg(F.array_join(F.array_sort(F.collect_set(F.regexp_extract("url", "://([^/?#]*)", 1))), " , ").alias("t")).select("list", F.explode(S.parse_site_list(F.concat("t", F.lit(";;"), F.upper("t")))).alias("origin")),
         "SELECT list, concat('https://', min(h)) AS origin FROM (SELECT DISTINCT page_id % 20 AS list, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) AS q GROUP BY list, regexp_replace(h, '^www[.]', '')")


def cache_headers(p: DataFrame) -> DataFrame:
    headers = F.create_map(F.lit("cf-cache-status"), F.when(F.col("page_id") % 3 == 0, "HIT").when(F.col("page_id") % 3 == 1, "EXPIRED").otherwise(""), F.lit("x-cache"), F.when(F.col("page_id") % 2 == 0, "Hit from cloud").otherwise("Some quite unusual value here"))
    state, layer = S.cache_reading(headers)
    return p.select("page_id", state.alias("state"), layer.alias("layer"))


of_table("cache_headers", "pages", cache_headers, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE CASE WHEN page_id % 2 = 0 THEN 'hit' ELSE 'some quite unusual v' END END AS state, CASE WHEN page_id % 3 < 2 THEN 'Cloudflare' ELSE 'CDN' END AS layer FROM pages")

# schedule ------------------------------------------------------------------------------------------------------
of_table("schedule_due", "events", lambda e: e.select("event_id", X.due_reason(F.col("ts").cast("timestamp"), F.col("event_id") % 11 != 0, X.parse_days(F.when(F.col("event_id") % 2 == 0, "1, 4,9").otherwise("")), F.lit(3), F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd"))).alias("reason")),
         "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'disabled' WHEN event_id % 2 = 0 AND isodow(ts) NOT IN (1, 4) THEN 'other_day' WHEN hour(ts) < 3 THEN 'too_early' WHEN event_id % 5 = 0 THEN 'already_today' WHEN hour(ts) = 3 THEN 'on_time' ELSE 'catching_up' END AS reason FROM events")
of_table("schedule_fired", "events", lambda e: X.fired(e.select(F.col("user_id").alias("portfolio"), F.col("ts").cast("timestamp").alias("ts")), 3, "").groupBy("portfolio").agg(F.count("*").alias("runs")),
         "SELECT user_id AS portfolio, count(DISTINCT CAST(ts AS DATE)) AS runs FROM events WHERE hour(ts) >= 3 GROUP BY user_id")
of_table("when_label", "events", lambda e: e.select("event_id", X.when_label(F.col("ts").cast("timestamp"), F.lit("2024-02-10 00:00:00").cast("timestamp")).alias("label")),
         """SELECT event_id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN concat(h, ' h ago') WHEN h < 48 THEN 'yesterday' WHEN h < 720 THEN concat(h // 24, ' days ago') ELSE strftime(ts, '%Y-%m-%d') END AS label
         FROM (SELECT event_id, ts, CAST(floor((epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(ts))) / 3600) AS BIGINT) AS h FROM events) AS q""")
of_table("estimate_minutes", "pages", lambda p: p.select("page_id", X.estimate_minutes(F.col("page_id") + 1, F.col("page_id") % 90 + 1)[0].alias("low"), X.estimate_minutes(F.col("page_id") + 1, F.col("page_id") % 90 + 1)[1].alias("high")),
         "SELECT page_id, low, greatest(low + 1, low * 2) AS high FROM (SELECT page_id, CAST(greatest(1, round_even((page_id + 1) * least(0.5, greatest(0.05, (page_id % 90 + 1) / 100.0)), 0)) AS INT) AS low FROM pages) AS q")
of_audit("incremental_resume", lambda a: X.pending(a.pages.select("run_id", "page_id", "state"), a.pages.where("state IN ('done', 'error')")).select("run_id", "page_id"), sql("SELECT run_id, page_id FROM crawl WHERE state = 'queued'", upto="crawl"))
of_audit("resumable_sites", lambda a: X.resumable_sites(a.sites).select("run_id", "site_id"), sql("SELECT run_id, site_id FROM sites WHERE state = 'fetching'", upto="crawl"))

# orders, positions and totals ----------------------------------------------------------------------------------
of_audit("list_sites_order", lambda a: V.list_sites(a, 2).select("site_id", "host", "position", "state_label", "average"), sql(f"""
SELECT site_id, host, row_number() OVER (ORDER BY state = 'done', score, site_id) AS position, {D.sql_case('state', D.STATES)} AS state_label,
  (SELECT CAST(round_even(avg(score) FILTER (state = 'done'), 0) AS INT) FROM rows_ WHERE run_id = 2) AS average FROM rows_ WHERE run_id = 2""", _ROWS))
of_audit("stored_findings_order", lambda a: V.placed(a.findings, V.stored_order(), tuple(SITE)).select(*SITE, "finding_no", "position"),
         sql("SELECT run_id, site_id, finding_no, row_number() OVER (PARTITION BY run_id, site_id ORDER BY layer, rule, url, finding_no) AS position FROM found"))
of_audit("run_findings_order", lambda a: V.placed(a.findings, V.run_order()).select(*SITE, "finding_no", "position"),
         sql("SELECT run_id, site_id, finding_no, row_number() OVER (PARTITION BY run_id ORDER BY layer, origin, rule, url, site_id, finding_no) AS position FROM found"))
of_audit("plan_order", lambda a: ordered_plan(tracker_plan(build_tasks(a.findings), TODAY)).select(*SITE, "rule", "subject", "position"),
         sql("SELECT run_id, site_id, rule, subject, row_number() OVER (PARTITION BY run_id ORDER BY rank_, host, rule, subject) AS position FROM tasks", _TASKS))
of_audit("fixes_screen_top80", lambda a: fixes_screen(fix_plan(a.findings, a.flat)).select(*SITE, "url", "field", "ready", "position"),
         sql("SELECT run_id, site_id, url, field, ready, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ready DESC, url, field, site_id) AS position FROM fixes) AS q WHERE position <= 80", _FIX))
of_audit("changes_top50", lambda a: top_changes(compare_runs(a.findings, 1, 2)).select("kind", "host", "rule", "url", "position", "total"), sql(f"""
SELECT kind, host, rule, url, position, total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {rank('severity')}, layer, rule, host, url) AS position, count(*) OVER (PARTITION BY kind) AS total FROM changes) AS q WHERE position <= 50""", _DIFF))
of_audit("site_previews_top5", lambda a: V.site_previews(a).select(*SITE, "page_id", "position"), sql(f"""
SELECT run_id, site_id, page_id, position FROM (
  SELECT run_id, site_id, page_id, row_number() OVER (PARTITION BY run_id, site_id ORDER BY worst, -n, page_url, page_id) AS position FROM (
    SELECT n.run_id AS run_id, n.site_id AS site_id, n.page_id AS page_id, n.final_url AS page_url, count(*) AS n, min(rank_) AS worst
    FROM flat n JOIN (SELECT DISTINCT run_id, site_id, finding_no, rank_, {rstrip('u')} AS key FROM (SELECT *, unnest({_TOUCHED}) AS u FROM found) AS q) AS t ON t.run_id = n.run_id AND t.site_id = n.site_id AND t.key = {rstrip('n.final_url')}
    GROUP BY n.run_id, n.site_id, n.page_id, n.final_url) AS p) AS r WHERE position <= 5"""))
of_audit("severity_totals", V.severity_totals, sql(f"SELECT run_id, {', '.join(_SEV.split(', ')[:4])} FROM found GROUP BY run_id"))
of_audit("morning_report", lambda a: morning_report(a.findings, a.flat, _scored(a), 2, 3), None)

# the reader on planted tags ------------------------------------------------------------------------------------
of_audit("head_planted", lambda a: a.pages.where("state = 'done'").select(
    *SITE, "page_id", F.array_join("head.robots_all", "|").alias("robots"), F.array_join("head.canonical_all", "|").alias("canonicals"), "head.viewport", "head.og_title", "head.og_image", "head.charset",
    F.array_join(F.transform("head.hreflang", lambda x: F.concat(x.lang, F.lit("="), x.href)), "|").alias("hreflang"), F.array_join("head.json_ld_types", "|").alias("types"), "head.title_count", "head.description_count"),
    sql("""SELECT run_id, site_id, page_id, CASE v % 11 WHEN 0 THEN 'noindex' WHEN 1 THEN 'index, follow|NOINDEX' WHEN 2 THEN 'index|index' ELSE '' END AS robots,
    CASE v % 7 WHEN 1 THEN final_url WHEN 2 THEN 'https://other.example.org/x' WHEN 3 THEN concat(final_url, '|', final_url) WHEN 4 THEN concat('https://', host, '/elsewhere') WHEN 5 THEN concat(final_url, '/') WHEN 6 THEN concat('https://', host, '/hub') ELSE '' END AS canonicals,
    CASE v % 6 WHEN 0 THEN '' WHEN 1 THEN 'width=device-width, user-scalable = no' WHEN 2 THEN 'width=device-width, maximum-scale=1' ELSE 'width=device-width' END AS viewport,
    CASE WHEN v % 4 IN (1, 2) THEN 'T' ELSE '' END AS og_title, CASE WHEN v % 4 IN (2, 3) THEN '/i.png' ELSE '' END AS og_image, CASE WHEN v % 10 = 5 THEN '' ELSE 'utf-8' END AS charset,
    CASE v % 13 WHEN 0 THEN concat('en=', final_url, '|ru-ru=https://', host, '/ru') WHEN 1 THEN concat('x-default=https://', host, '/|de=https://', host, '/de') WHEN 2 THEN concat('ru=https://', host, '/elsewhere') ELSE '' END AS hreflang,
    CASE v % 9 WHEN 1 THEN 'Article' WHEN 2 THEN 'Thing|Organization' WHEN 4 THEN 'Person|LocalBusiness' WHEN 5 THEN 'Article' ELSE '' END AS types,
    CAST(CASE WHEN v % 16 = 9 THEN 2 ELSE 1 END AS INT) AS title_count, CAST(CASE v % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS INT) AS description_count FROM crawl WHERE state = 'done'""", upto="crawl"))

# discovery -----------------------------------------------------------------------------------------------------
URLS_MOST = 40


def discovered(spark: SparkSession, d: str) -> DS.Discovery:
    got = planted_responses(spark, d)
    sites = got.where("url LIKE '%/robots.txt'").select(F.regexp_replace("url", "/robots.txt$", "").alias("origin"))
    return DS.discover(sites, got, max_urls=URLS_MOST)


_HTML = f"NOT regexp_matches(lower({part('url', 3)}), '[.](?:{'|'.join(D.SKIP_EXTENSIONS)})$')"
_DISCOVERED = "WITH " + PLACED_SQL.format(pages="pages") + f""",
l AS (
  SELECT host, site_no, k, {_N3} AS url, CASE WHEN site_no % 3 <> 0 AND site_no % 2 = 0 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END ELSE 1 END AS map_ FROM (SELECT *, url AS s FROM placed) AS q
  WHERE (site_no % 3 <> 0 AND site_no % 2 = 0) OR k % 2 = 1),
c AS (SELECT host, site_no, url, 'sitemap' AS source, map_ * 10000000 + k AS o FROM l WHERE {_HTML} UNION ALL SELECT DISTINCT host, site_no, concat('https://', host, '/') AS url, 'seed' AS source, 0 AS o FROM placed),
u AS (SELECT host, site_no, url, max(source) AS source, min(o) AS o FROM c GROUP BY host, site_no, url),
j AS (SELECT *, NOT (site_no % 3 <> 0 AND {part('url', 3)} LIKE '/de/%' AND {part('url', 3)} NOT LIKE '/de/1%') AS ok FROM u),
n AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY o, url ROWS UNBOUNDED PRECEDING) AS BIGINT) AS no FROM j)"""
QUERIES["discover_urls"] = (lambda spark, d: discovered(spark, d).urls, _DISCOVERED + f" SELECT concat('https://', host) AS site, no, url, source FROM n WHERE ok AND no <= {URLS_MOST}")
QUERIES["discovery_counters"] = (lambda spark, d: discovered(spark, d).counters, _DISCOVERED + f"""
SELECT concat('https://', host) AS site, site_no % 3 <> 0 AS robots_present, CAST(CASE WHEN site_no % 3 <> 0 THEN 200 ELSE 404 END AS INT) AS robots_status, CASE WHEN site_no % 3 <> 0 THEN 1.5::DOUBLE END AS crawl_delay,
  CAST(CASE WHEN site_no % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS robots_rules, CAST(CASE WHEN site_no % 3 <> 0 AND site_no % 2 = 0 THEN 4 ELSE 1 END AS BIGINT) AS sitemaps_seen,
  CAST(CASE WHEN site_no % 3 <> 0 AND site_no % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sitemap_errors, count(*) FILTER (source = 'sitemap') AS sitemap_url_count,
  CASE WHEN site_no % 3 <> 0 AND site_no % 2 = 0 THEN 'robots' ELSE 'guess' END AS sitemap_via, count(*) FILTER (ok AND no <= {URLS_MOST}) AS url_count, count(*) FILTER (NOT ok AND no < {URLS_MOST}) AS blocked_by_robots,
  bool_or(o = 0 AND source = 'sitemap') AS sitemap_had_home, count(*) > {URLS_MOST} AS truncated FROM n GROUP BY host, site_no""")
QUERIES["sitemap_lastmod"] = (lambda spark, d: discovered(spark, d).lastmod, _DISCOVERED + """
SELECT concat('https://', host) AS site, url, arg_max(concat('2024-01-0', CAST(k % 9 + 1 AS VARCHAR)), map_ * 10000000 + k) AS lastmod FROM (
  SELECT l.host AS host, p.url AS url, l.k AS k, l.map_ AS map_ FROM l JOIN placed p ON p.host = l.host AND p.k = l.k WHERE l.k % 3 = 0) AS q GROUP BY host, url""")


def links_unknown(a: Audit) -> DataFrame:
    flat = a.flat.where("run_id = 1")
    links = G.edges(flat.withColumn("site", F.col("origin"))).select("site_id", "page_id", "pos", "href").join(a.sites.where("run_id = 1").select("site_id", F.col("origin").alias("site")), "site_id")
    return DS.expand_by_links(flat.where("source = 'sitemap'").select(F.col("origin").alias("site"), F.col("page_url").alias("url")), links, limit=1 << 30).select("site", "url")


of_audit("links_unknown", links_unknown, sql(f"""
SELECT DISTINCT site, url FROM (SELECT origin AS site, {_N3} AS url FROM (SELECT origin, href AS s FROM keyed WHERE run_id = 1) AS q) AS r
WHERE {_HTML} AND NOT EXISTS (SELECT 1 FROM (SELECT origin AS o, {_N3} AS known FROM (SELECT origin, final_url AS s FROM flat WHERE run_id = 1 AND source = 'sitemap') AS t) AS w WHERE w.o = r.site AND w.known = r.url)""", upto="graph"))


# fetching, replayed --------------------------------------------------------------------------------------------
def fetch_replayed(pages: DataFrame) -> DataFrame:
    case = F.get(F.array(*map(F.lit, HT.CASES)), (F.col("page_id") % len(HT.CASES)).cast("int"))
    urls = pages.select(F.concat(F.lit("https://r"), (F.col("page_id") % 50).cast("string"), F.lit(".replay.test/"), case, F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    got = HT.fetch_pages(urls, HT.Policy(host_pause=0, retries=1, backoff=0, body_most=1000), HT.replay)
    return got.select("requested_url", "final_url", "ok", "status", "error", "redirects", "content_type", "bytes", "truncated", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), "cache_state")


_CASE = D.sql_case("page_id % 12", dict(enumerate(HT.CASES)))
of_table("fetch_replayed", "pages", fetch_replayed, f"""
WITH p AS (SELECT page_id AS n, {_CASE} AS c, concat('https://r', page_id % 50, '.replay.test/') AS root, concat('<html><head><meta charset="windows-1251"><title>Страница ', page_id, '</title></head></html>') AS page FROM pages),
t AS (SELECT *, CASE WHEN c IN ('page', 'moved', 'hop', 'packed', 'named', 'odd', 'gone') THEN page WHEN c = 'busy' THEN 'busy' WHEN c = 'long' THEN repeat('x', 1000) ELSE '' END AS text FROM p)
SELECT concat(root, c, '/', n) AS requested_url, CASE WHEN c IN ('moved', 'hop') THEN concat('https://replay.test/page/', n) ELSE concat(root, c, '/', n) END AS final_url, c <> 'lost' AS ok,
  CAST(CASE c WHEN 'lost' THEN NULL WHEN 'busy' THEN 503 WHEN 'loop' THEN 302 WHEN 'gone' THEN 404 ELSE 200 END AS INT) AS status, CASE WHEN c = 'lost' THEN 'OSError: no route' ELSE '' END AS error,
  CAST(CASE c WHEN 'loop' THEN 6 WHEN 'moved' THEN 2 WHEN 'hop' THEN 1 ELSE 0 END AS INT) AS redirects,
  CASE c WHEN 'lost' THEN '' WHEN 'loop' THEN '' WHEN 'named' THEN 'text/html; charset=UTF-8' WHEN 'odd' THEN 'text/html; charset=nonsense' WHEN 'picture' THEN 'image/png' ELSE 'text/html' END AS content_type,
  CAST(CASE c WHEN 'named' THEN strlen(text) WHEN 'picture' THEN 4 ELSE length(text) END AS INT) AS bytes, c = 'long' AS truncated, sha256(text) AS text_sha,
  CASE WHEN c IN ('page', 'busy', 'moved', 'hop', 'packed', 'long', 'gone') THEN 'hit' ELSE '' END AS cache_state FROM t""")
of_table("days_label", "events", lambda e: e.select("event_id", X.days_label(F.when(F.col("event_id") % 3 == 0, "1, 4,9").when(F.col("event_id") % 3 == 1, "7").otherwise("*")).alias("label")),
         "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Mon, Thu' WHEN 1 THEN 'Sun' ELSE 'every day' END AS label FROM events")
