"""Severities, layers, efforts, rules and their attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "info"]
WEIGHT = {"critical": 100, "high": 40, "medium": 12, "low": 4, "info": 0}
DUE_DAYS = {"critical": 2, "high": 7, "medium": 30, "low": 90}
LAYERS = {1: "indexability", 2: "technical", 3: "structure", 4: "content", 5: "i18n", 6: "enhancement"}
EFFORTS = {1: "trivial", 2: "small", 4: "medium", 8: "large"}
TITLE_MIN, TITLE_MAX, DESC_MIN, DESC_MAX, THIN_WORDS, SLOW_MS, VERY_SLOW_MS = 30, 60, 120, 160, 150, 2500, 5000

#: rule: (layer, severity, effort, fixable)
RULES = {
    "http.unreachable": (2, "high", 4, False),
    "http.server_error": (2, "critical", 4, False),
    "http.404_in_sitemap": (1, "high", 2, False),
    "http.client_error": (2, "medium", 2, False),
    "http.redirect_chain": (2, "medium", 2, False),
    "sitemap.redirecting_url": (1, "low", 2, False),
    "security.no_https": (2, "high", 4, False),
    "canonical.missing": (1, "medium", 1, True),
    "canonical.duplicate_tag": (1, "high", 2, False),
    "canonical.cross_host": (1, "critical", 2, True),
    "canonical.cross_language": (1, "critical", 1, True),
    "canonical.points_elsewhere": (1, "high", 2, True),
    "robots.noindex_in_sitemap": (1, "critical", 2, False),
    "robots.noindex": (1, "info", 2, False),
    "title.duplicate_tag": (4, "medium", 2, False),
    "title.missing": (4, "high", 1, True),
    "title.too_short": (4, "medium", 1, True),
    "title.too_long": (4, "low", 1, True),
    "description.duplicate_tag": (4, "low", 2, False),
    "description.missing": (4, "medium", 1, True),
    "description.too_short": (4, "low", 1, True),
    "description.too_long": (4, "low", 1, True),
    "h1.missing": (4, "medium", 2, False),
    "h1.multiple": (4, "low", 2, False),
    "content.thin": (4, "medium", 8, False),
    "images.missing_alt": (6, "low", 4, False),
    "performance.very_slow": (2, "high", 4, False),
    "performance.slow": (2, "medium", 4, False),
    "i18n.lang_missing": (5, "low", 2, False),
    "i18n.title_language_mismatch": (5, "high", 1, True),
    "i18n.description_language_mismatch": (5, "high", 1, True),
    "i18n.hreflang_no_self": (5, "medium", 2, False),
    "i18n.hreflang_lang_absent": (5, "low", 2, False),
    "robots.conflicting": (1, "high", 2, False),
    "robots.duplicate_tag": (1, "low", 2, False),
    "mobile.viewport_missing": (2, "high", 2, False),
    "mobile.zoom_blocked": (6, "low", 1, False),
    "encoding.charset_missing": (2, "low", 1, False),
    "structure.heading_skip": (3, "low", 2, False),
    "schema.missing": (6, "low", 4, False),
    "schema.no_organization": (6, "low", 2, False),
    "social.og_missing": (6, "low", 2, False),
    "social.og_image_missing": (6, "low", 2, False),
    "robots.txt_missing": (1, "low", 2, False),
    "sitemap.missing": (1, "high", 2, False),
    "sitemap.not_in_robots": (1, "low", 1, False),
    "sitemap.section_absent": (1, "high", 2, False),
    "duplicate.title": (4, "medium", 1, True),
    "duplicate.description": (4, "low", 1, True),
    "canonical.mass_collapse": (1, "critical", 2, True),
    "cache.serving_stale": (2, "high", 1, False),
    "cache.fully_cached": (2, "info", 1, False),
    "security.mixed_scheme": (2, "high", 4, False),
    "structure.orphan_suspect": (3, "info", 2, False),
    "structure.orphan_page": (3, "medium", 2, False),
    "structure.broken_internal_link": (3, "high", 2, False),
    "structure.deep_page": (3, "low", 4, False),
    "structure.dead_end": (3, "low", 2, False),
}
RESPONSE_RULES = [r for r in RULES if r.startswith("http.") or r in ("sitemap.redirecting_url", "security.no_https")]
SPLIT_BY_SUBJECT = ["sitemap.section_absent", "duplicate.title", "duplicate.description"]
AUTOFIXABLE = ["canonical.cross_language", "canonical.cross_host", "canonical.missing"]
FIX_FIELD = {
    "title.missing": "meta_title", "title.too_short": "meta_title", "title.too_long": "meta_title",
    "description.missing": "meta_description", "description.too_short": "meta_description", "description.too_long": "meta_description",
    "canonical.missing": "canonical_url", "canonical.cross_language": "canonical_url", "canonical.cross_host": "canonical_url", "canonical.points_elsewhere": "canonical_url",
    "duplicate.title": "meta_title", "duplicate.description": "meta_description",
}
NEEDS_HUMAN = ["duplicate.title", "duplicate.description", "title.too_short", "description.too_short"]
CYRILLIC_LANGS = ["ru", "uk", "be", "bg", "sr", "mk", "kk"]
LATIN_LANGS = ["ro", "en", "de", "fr", "it", "es", "pt", "pl", "cs", "sk", "hu", "tr", "nl", "sv", "da", "no", "fi", "et", "lv", "lt"]
ORG_LIKE = ["organization", "localbusiness", "corporation", "store", "website", "professionalservice", "homeandconstruction"]
SKIP_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "avif", "css", "js", "mjs", "map", "pdf", "zip", "gz", "rar", "7z", "tar",
    "mp3", "mp4", "avi", "mov", "webm", "wav", "ogg", "woff", "woff2", "ttf", "eot", "otf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
]
#: header: cache, in the order of their priority
CACHE_HEADERS = {
    "x-litespeed-cache": "LiteSpeed", "x-lsadc-cache": "LiteSpeed", "cf-cache-status": "Cloudflare", "x-cache": "CDN", "x-proxy-cache": "Nginx",
    "x-nginx-cache": "Nginx", "x-fastcgi-cache": "Nginx FastCGI", "x-cache-status": "cache", "x-wp-super-cache": "WP Super Cache", "x-kinsta-cache": "Kinsta", "x-sg-cachehit": "SiteGround",
}
#: how marks in a tracker begin, so that tasks exported before are found again
MARK = "seoaudit-"
COVERAGE_TOLERANCE, PAGE_SIZE, PAGE_MOST, RUNS_MOST = 0.25, 50, 200, 50
#: states of a site, in words
STATES = {"pending": "waiting", "discovering": "looking for pages", "fetching": "loading pages", "done": "done", "error": "failed"}
# end of fixed values ----------------------------------------------------------------------------


def pick(key: Column, values: dict, other=None) -> Column:
    """values[key] as a literal CASE, `other` for unknown keys."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other))


def rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 9 for anything else."""
    return F.coalesce(pick(severity, {s: i for i, s in enumerate(SEVERITIES)}), F.lit(9))


def weight(severity: Column) -> Column:
    return F.coalesce(pick(severity, WEIGHT), F.lit(0))


def sql_case(key: str, values: dict, other: str = "NULL") -> str:
    """The same as SQL text, for oracles."""
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {other} END"
