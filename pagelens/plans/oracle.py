"""The planted crawl's findings said in SQL, from the numbers that planted them instead of from HTML.

Everything is a chain of common table expressions: a query's SQL is sql(SELECT ...).
"""

from __future__ import annotations

from pagelens.functions import dims as D
from pagelens.functions.advice import ADVICE
from pagelens.sources.crawl import CRAWL_SQL, CYRILLIC, CYRILLIC_SHORT, GOOD, LONG, LONG_TITLE, SHORT

RX = "'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$'"


def part(u: str, k: int) -> str:
    return f"coalesce(regexp_extract({u}, {RX}, {k}), '')"


def rstrip(u: str) -> str:
    return f"regexp_replace({u}, '/+$', '')"


def graph_key(u: str) -> str:
    path = rstrip(part(u, 3))
    return f"lower(concat({part(u, 1)}, '://', {part(u, 2)}, CASE WHEN {path} = '' THEN '/' ELSE {path} END))"


def rank(s: str) -> str:
    return D.sql_case(s, {x: i for i, x in enumerate(D.SEVERITIES)}, "9")


def weight(s: str) -> str:
    return D.sql_case(s, D.WEIGHT, "0")


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


_DECODED = "replace(replace(replace(replace(replace(replace(regexp_extract(html0, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT = (
    "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), "
    "'(?i)</(p|div|br|li|tr|td|th|section|article|header|footer|h1|h2|h3|h4|h5|h6|blockquote|pre)>', ' ', 'g'), '<[^>]*>', '', 'g'), "
    "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)
FLAT = f"""
seen AS (SELECT *, state = 'error' AS e FROM crawl WHERE state IN ('done', 'error')),
said AS (
  SELECT *, CASE WHEN e THEN '' WHEN v % 16 = 10 THEN '' WHEN v % 16 = 11 THEN {collapse(f"concat('{LONG_TITLE}', {_DECODED})")} WHEN v % 16 = 12 THEN {collapse(f"concat('{CYRILLIC}', {_DECODED})")} ELSE {collapse(_DECODED)} END AS title,
    CASE WHEN e THEN 0 WHEN v % 16 = 9 THEN 2 ELSE 1 END AS title_count,
    CASE WHEN e THEN '' WHEN v % 25 = 6 THEN '{CYRILLIC_SHORT}' ELSE CASE v % 5 WHEN 1 THEN '{SHORT}' WHEN 2 THEN '{GOOD}' WHEN 3 THEN '{LONG}' WHEN 4 THEN '{GOOD}' ELSE '' END END AS description,
    CASE WHEN e THEN 0 ELSE CASE v % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END END AS description_count,
    CASE WHEN e THEN '' ELSE CASE v % 7 WHEN 1 THEN final_url WHEN 2 THEN 'https://other.example.org/x' WHEN 3 THEN final_url WHEN 4 THEN concat('https://', host, '/elsewhere') WHEN 5 THEN concat(final_url, '/') WHEN 6 THEN concat('https://', host, '/hub') ELSE '' END END AS canonical,
    CASE WHEN e OR v % 7 = 0 THEN 0 WHEN v % 7 = 3 THEN 2 ELSE 1 END AS canonicals,
    NOT e AND v % 11 IN (0, 1) AS noindex,
    CASE WHEN e OR v % 12 = 7 THEN '' ELSE regexp_extract(html0, '<html lang="([^"]*)"', 1) END AS html_lang,
    CASE WHEN e OR v % 14 = 3 THEN CASE WHEN NOT e AND v % 14 = 5 THEN 1 ELSE 0 END WHEN v % 14 = 5 THEN 2 ELSE 1 END AS h1s,
    CASE WHEN e OR v % 14 = 3 THEN '' ELSE {collapse(_DECODED.replace("<title>", "<h1>").replace("</title>", "</h1>"))} END AS h1_text,
    CASE WHEN e THEN 0 ELSE len(list_filter(string_split(trim(regexp_replace({_TEXT}, '[\\s\\x{{00A0}}]+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) END AS word_count,
    CASE WHEN e OR v % 15 = 2 THEN 0 ELSE len(string_split(html0, '<a href=')) - 1 + CASE WHEN final_url LIKE 'https://%' THEN CASE WHEN child_a <> '' THEN 1 ELSE 0 END + CASE WHEN child_b <> '' THEN 1 ELSE 0 END ELSE 0 END END AS links
  FROM seen),
flat AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, site_id, {rstrip("final_url")} ORDER BY page_id) AS n_ FROM said) AS q WHERE n_ = 1)
"""
_SELF5 = f"({rstrip('canonical')} = {rstrip('final_url')})"
_CROSS = "(NOT e AND v % 7 = 2)"
_AWAY = "(NOT e AND v % 7 IN (4, 6))"
_LANG = "(v % 7 = 4 AND v % 13 = 2 AND html_lang <> '')"
_CYR = "(NOT e AND v % 16 = 12 AND html_lang IN ('en', 'de', 'fr', 'es') AND length(regexp_replace(title, '[^а-яёА-ЯЁ]', '', 'g')) > 2 * length(regexp_replace(title, '[^a-zA-Z]', '', 'g')))"
#: rule: (condition, whose url)
PAGE_CASES = {
    "http.unreachable": ("e", "url"),
    "http.server_error": ("status >= 500", "url"),
    "http.404_in_sitemap": ("status = 404 AND source = 'sitemap'", "url"),
    "http.client_error": ("status = 410 OR (status = 404 AND source <> 'sitemap')", "url"),
    "http.redirect_chain": ("NOT e AND redirects >= 3", "url"),
    "sitemap.redirecting_url": ("NOT e AND source = 'sitemap' AND redirects >= 1", "url"),
    "security.no_https": ("final_url LIKE 'http://%'", "final_url"),
    "canonical.missing": ("canonicals = 0", "final_url"),
    "canonical.duplicate_tag": ("canonicals = 2", "final_url"),
    "canonical.cross_host": (_CROSS, "final_url"),
    "canonical.cross_language": (f"{_AWAY} AND {_LANG}", "final_url"),
    "canonical.points_elsewhere": (f"{_AWAY} AND NOT {_LANG}", "final_url"),
    "robots.noindex_in_sitemap": ("noindex AND source = 'sitemap'", "final_url"),
    "robots.noindex": ("noindex AND source <> 'sitemap'", "final_url"),
    "title.duplicate_tag": ("title_count > 1", "final_url"),
    "title.missing": ("title = ''", "final_url"),
    "title.too_short": ("length(title) BETWEEN 1 AND 29", "final_url"),
    "title.too_long": ("length(title) > 60", "final_url"),
    "description.duplicate_tag": ("description_count > 1", "final_url"),
    "description.missing": ("description = ''", "final_url"),
    "description.too_short": ("length(description) BETWEEN 1 AND 119", "final_url"),
    "description.too_long": ("length(description) > 160", "final_url"),
    "h1.missing": ("h1s = 0", "final_url"),
    "h1.multiple": ("h1s > 1", "final_url"),
    "content.thin": ("word_count BETWEEN 1 AND 149", "final_url"),
    "images.missing_alt": ("NOT e AND v % 9 = 0", "final_url"),
    "performance.very_slow": ("elapsed_ms >= 5000", "final_url"),
    "performance.slow": ("elapsed_ms BETWEEN 2500 AND 4999", "final_url"),
    "i18n.lang_missing": ("html_lang = ''", "final_url"),
    "i18n.title_language_mismatch": (_CYR, "final_url"),
    "i18n.description_language_mismatch": ("NOT e AND v % 25 = 6 AND html_lang IN ('en', 'de', 'fr', 'es')", "final_url"),
    "i18n.hreflang_no_self": (f"NOT e AND (v % 13 = 1 AND {rstrip('final_url')} NOT IN (concat('https://', host), concat('https://', host, '/de')) OR v % 13 = 2 AND {rstrip('final_url')} <> concat('https://', host, '/elsewhere'))", "final_url"),
    "i18n.hreflang_lang_absent": ("NOT e AND html_lang <> '' AND (v % 13 = 0 AND html_lang <> 'en' OR v % 13 = 1 AND html_lang <> 'de' OR v % 13 = 2)", "final_url"),
    "robots.conflicting": ("NOT e AND v % 11 = 1", "final_url"),
    "robots.duplicate_tag": ("NOT e AND v % 11 = 2", "final_url"),
    "mobile.viewport_missing": ("e OR v % 6 = 0", "final_url"),
    "mobile.zoom_blocked": ("NOT e AND v % 6 IN (1, 2)", "final_url"),
    "encoding.charset_missing": ("(e OR v % 10 = 5) AND v % 4 <> 0", "final_url"),
    "structure.heading_skip": ("NOT e AND v % 8 = 1 AND v % 14 <> 3", "final_url"),
    "schema.missing": ("NOT noindex AND (e OR v % 9 IN (0, 3, 6, 7, 8))", "final_url"),
    "schema.no_organization": ("NOT e AND NOT noindex AND v % 9 IN (1, 5) AND k = 1", "final_url"),
    "social.og_missing": ("NOT noindex AND (e OR v % 4 = 0)", "final_url"),
    "social.og_image_missing": ("NOT e AND NOT noindex AND v % 4 = 1", "final_url"),
}
_SITE = "run_id, site_id, host, origin"
_NO = "CAST([] AS VARCHAR[])"
_ROW = f"SELECT {_SITE}, page_id, '{{}}' AS rule, {{}} AS url, '' AS subject, {_NO} AS urls, {_NO} AS more, {{}} AS said FROM flat WHERE {{}}"
_NUMBER = {
    "http.server_error": "status", "title.too_short": "length(title)", "title.too_long": "length(title)", "description.too_short": "length(description)", "description.too_long": "length(description)",
}
SITES = """
sites AS (
  SELECT run_id, site_id, max(host) AS host, max(origin) AS origin, bool_or(robots_present) AS robots_present, bool_or(sitemaps_seen) AS sitemaps_seen, bool_or(robots_sitemaps) AS robots_sitemaps,
         CASE WHEN site_id % 17 = 0 THEN 'error' WHEN site_id % 13 = 0 THEN 'fetching' ELSE 'done' END AS state
  FROM crawl GROUP BY run_id, site_id)
"""
_PATH1 = f"list_filter(string_split({part('final_url', 3)}, '/'), lambda x: x <> '')"
GRAPH = f"""
nodes AS (SELECT *, {graph_key("final_url")} AS key, {part("final_url", 3)} IN ('', '/') AS root FROM flat),
nav AS (SELECT {_SITE}, page_id, final_url AS src, unnest(regexp_extract_all(html0, '<a href="([^"]*)"', 1)) AS href0 FROM nodes WHERE NOT e AND v % 15 <> 2),
edges AS (
  SELECT {_SITE}, page_id, src, concat(CASE WHEN src LIKE 'https://%' THEN 'https://' ELSE 'http://' END, host, href0) AS href FROM nav WHERE href0 LIKE '/%'
  UNION ALL SELECT {_SITE}, page_id, final_url, child_a FROM nodes WHERE NOT e AND v % 15 <> 2 AND child_a <> '' AND final_url LIKE 'https://%'
  UNION ALL SELECT {_SITE}, page_id, final_url, child_b FROM nodes WHERE NOT e AND v % 15 <> 2 AND child_b <> '' AND final_url LIKE 'https://%'),
keyed AS (SELECT *, {graph_key("href")} AS key FROM edges),
per_site AS (SELECT run_id, site_id, count(*) AS pages, bool_or(links > 0) AS have_links FROM flat GROUP BY run_id, site_id),
orphan AS (
  SELECT n.* FROM nodes n WHERE NOT noindex AND coalesce(status, 200) < 400 AND NOT root
    AND NOT EXISTS (SELECT 1 FROM keyed x WHERE x.run_id = n.run_id AND x.site_id = n.site_id AND x.key = n.key)),
last_status AS (SELECT run_id, site_id, key, arg_max(status, page_id) AS status FROM nodes WHERE status IS NOT NULL GROUP BY run_id, site_id, key),
broken AS (SELECT x.*, s.status AS target_status FROM keyed x JOIN last_status s ON s.run_id = x.run_id AND s.site_id = x.site_id AND s.key = x.key WHERE s.status >= 400),
links_ AS (
  SELECT DISTINCT x.run_id AS run_id, x.site_id AS site_id, {graph_key("x.src")} AS src, x.key AS key
  FROM keyed x JOIN (SELECT DISTINCT run_id, site_id, key FROM nodes) AS t ON t.run_id = x.run_id AND t.site_id = x.site_id AND t.key = x.key),
walk AS (
  SELECT run_id, site_id, key, 0 AS depth FROM nodes WHERE root
  UNION SELECT l.run_id, l.site_id, l.key, w.depth + 1 FROM walk w JOIN links_ l ON l.run_id = w.run_id AND l.site_id = w.site_id AND l.src = w.key WHERE w.depth < 12),
depths AS (SELECT run_id, site_id, key, min(depth) AS depth FROM walk GROUP BY run_id, site_id, key),
deep AS (
  SELECT n.run_id AS run_id, n.site_id AS site_id, max(n.host) AS host, max(n.origin) AS origin, n.key AS key, max(d.depth) AS depth, arg_max(n.final_url, n.page_id) AS url, min(n.page_id) AS page_id
  FROM depths d JOIN nodes n ON n.run_id = d.run_id AND n.site_id = d.site_id AND n.key = d.key JOIN per_site p ON p.run_id = n.run_id AND p.site_id = n.site_id WHERE d.depth >= 4 AND p.pages >= 8 GROUP BY n.run_id, n.site_id, n.key),
sectioned AS (
  SELECT *, CASE WHEN length(coalesce(parts_[1], '')) <= 3 AND len(parts_) > 1 THEN parts_[2] ELSE coalesce(parts_[1], '') END AS section FROM (SELECT *, {_PATH1} AS parts_ FROM flat) AS q)
"""


def _group(rule: str, source: str, subject: str, by: str, least: int, slice_: int, extra: str = "") -> str:
    return (
        f"SELECT {_SITE}, min(page_id) AS page_id, '{rule}' AS rule, list_extract(list(final_url ORDER BY page_id), 1) AS url, {subject} AS subject, "
        f"list_slice(list(final_url ORDER BY page_id), 1, {slice_}) AS urls, {_NO} AS more, '' AS said FROM {source} GROUP BY {_SITE}, {by} HAVING count(*) >= {least}{extra}"
    )


def _site(rule: str, where: str) -> str:
    return f"SELECT {_SITE}, 0 AS page_id, '{rule}' AS rule, origin AS url, '' AS subject, {_NO} AS urls, {_NO} AS more, '' AS said FROM sites WHERE {where}"


def _one(rule: str, source: str, urls: str, where: str = "true", url: str = "list_extract(us, 1)", more: str = _NO) -> str:
    return f"SELECT {_SITE}, 0 AS page_id, '{rule}' AS rule, {url} AS url, '' AS subject, {urls} AS urls, {more} AS more, '' AS said FROM {source} WHERE {where}"


_COUNTS = f"""(SELECT {_SITE}, count(*) FILTER (cache_state = 'hit') AS hits, count(*) FILTER (cache_stale) AS stale, count(*) FILTER (status = 200) AS ok, count(*) FILTER (final_url LIKE 'http://%') AS plain,
  count(*) FILTER (final_url LIKE 'https://%') AS safe, arg_min(final_url, page_id) FILTER (cache_stale) AS stale_url, arg_min(final_url, page_id) FILTER (cache_state = 'hit') AS hit_url,
  arg_min(final_url, page_id) FILTER (final_url LIKE 'http://%') AS plain_url FROM flat GROUP BY {_SITE}) AS c"""
_LISTED = "(SELECT o.run_id AS run_id, o.site_id AS site_id, o.host AS host, o.origin AS origin, list(o.final_url ORDER BY o.page_id) AS us, max(p.pages) AS pages FROM {} o JOIN per_site p ON p.run_id = o.run_id AND p.site_id = o.site_id WHERE p.pages >= {} AND p.have_links GROUP BY o.run_id, o.site_id, o.host, o.origin) AS c"
_DEAD = "(SELECT * FROM flat WHERE NOT noindex AND coalesce(status, 200) < 400 AND links = 0)"
SITE_CASES = [
    _site("robots.txt_missing", "NOT robots_present"), _site("sitemap.missing", "NOT sitemaps_seen"), _site("sitemap.not_in_robots", "sitemaps_seen AND NOT robots_sitemaps"),
    _group("sitemap.section_absent", f"(SELECT x.* FROM sectioned x JOIN sites s ON s.run_id = x.run_id AND s.site_id = x.site_id WHERE s.sitemaps_seen AND x.section <> '') AS y", "concat('section=', left(section, 80))", "section", 3, 10, " AND count(*) FILTER (source = 'sitemap') = 0"),
    _group("duplicate.title", "(SELECT *, lower(title) AS val FROM flat WHERE status = 200 AND NOT noindex AND title <> '') AS y", "concat('value=', left(val, 80))", "val", 2, 12),
    _group("duplicate.description", "(SELECT *, lower(description) AS val FROM flat WHERE status = 200 AND NOT noindex AND description <> '') AS y", "concat('value=', left(val, 80))", "val", 2, 12),
    _group("canonical.mass_collapse", "(SELECT * FROM flat WHERE status = 200 AND NOT e AND v % 7 IN (2, 4, 6)) AS y", "''", "canonical", 3, 15),
    _one("cache.serving_stale", _COUNTS, _NO, "stale > 0", "stale_url"), _one("cache.fully_cached", _COUNTS, _NO, "stale = 0 AND hits > 0 AND hits = ok", "hit_url"),
    _one("security.mixed_scheme", _COUNTS, _NO, "plain > 0 AND safe > 0", "plain_url"),
    _one("structure.orphan_suspect", _LISTED.format("orphan", 4), _NO, "len(us) / pages > 0.8", more="list_slice(us, 1, 10)"), _one("structure.orphan_page", _LISTED.format("orphan", 4), "list_slice(us, 1, 20)", "len(us) / pages <= 0.8"),
    f"""SELECT {_SITE}, 0 AS page_id, 'structure.broken_internal_link' AS rule, min(href) AS url, '' AS subject, {_NO} AS urls,
    list_concat(list_slice(list(href ORDER BY href), 1, 20), flatten(list_slice(list(list_slice(sources, 1, 5) ORDER BY href), 1, 5))) AS more, '' AS said
    FROM (SELECT {_SITE}, href, list(src ORDER BY page_id) AS sources FROM (SELECT DISTINCT {_SITE}, href, src, page_id FROM broken) AS q GROUP BY {_SITE}, href) AS r GROUP BY {_SITE}""",
    f"""SELECT run_id, site_id, max(host) AS host, max(origin) AS origin, 0 AS page_id, 'structure.deep_page' AS rule, list_extract(list(url ORDER BY -depth, page_id), 1) AS url, '' AS subject, {_NO} AS urls,
    list_slice(list(url ORDER BY -depth, page_id), 1, 20) AS more, '' AS said FROM deep GROUP BY run_id, site_id""",
    _one("structure.dead_end", _LISTED.format(_DEAD, 6), "list_slice(us, 1, 20)", "len(us) / pages <= 0.8"),
]
_DIM = ", ".join(f"('{r}', {a}, '{s}', {e}, {str(f).lower()})" for r, (a, s, e, f) in D.RULES.items())
FINDINGS = f"""
dim(rule_, layer, severity, effort, fixable) AS (VALUES {_DIM}),
raw_found AS ({" UNION ALL ".join([_ROW.format(r, u, f"CAST({_NUMBER[r]} AS VARCHAR)" if r in _NUMBER else "''", c) for r, (c, u) in PAGE_CASES.items()] + SITE_CASES)}),
found AS (
  SELECT f.*, concat({D.sql_case("rule", {r: m for r, (m, _) in ADVICE.items()})}, CASE WHEN said <> '' THEN concat(': ', said) ELSE '' END) AS message, {D.sql_case("rule", {r: t for r, (_, t) in ADVICE.items()})} AS detail,
         d.layer AS layer, d.severity AS severity, d.effort AS effort, d.fixable AS fixable, {rank("d.severity")} AS rank_, {weight("d.severity")} AS weight_,
         row_number() OVER (PARTITION BY run_id, site_id ORDER BY d.layer, {rank("d.severity")}, -({weight("d.severity")} / d.effort), rule, url, page_id) AS finding_no
  FROM raw_found f JOIN dim d ON d.rule_ = f.rule)
"""


def sql(select: str, more: str = "", upto: str = "found") -> str:
    """WITH the chain (crawl, flat, sites, graph, findings, `more`), then the select."""
    chain = [CRAWL_SQL.format(pages="pages")] + {"crawl": [SITES], "flat": [FLAT, SITES], "graph": [FLAT, SITES, GRAPH], "found": [FLAT, SITES, GRAPH, FINDINGS]}[upto]
    return "WITH RECURSIVE " + ",\n".join([c.strip() for c in chain] + ([more.strip()] if more else [])) + "\n" + select
