"""Page rules as columns: one array of findings a page, so that all rules share one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dims as D
from pagelens.functions import text as T
from pagelens.functions import urls as N
from pagelens.functions.advice import ADVICE

_FIELDS = {
    "urls": "array<string>", "orphans": "array<string>", "targets": "array<string>", "dead": "array<string>", "pages": "array<struct<url:string,depth:int>>",
    "section": "string", "post_type": "string", "cluster": "string", "value": "string",
    "canonical": "string", "count": "bigint", "examples": "map<string,array<string>>", "levels": "array<int>", "values": "array<string>",
}


def evidence(**found: Column) -> Column:
    return F.struct(*[found.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()])


def finding(rule: str, url: Column, number: Column | None = None, **found: Column) -> Column:
    """What tells a finding of this rule from others; dressed() adds what the rule says. `number` goes into the message."""
    said = F.lit(None) if number is None else number
    return F.struct(F.lit(rule).alias("rule"), url.alias("url"), said.cast("string").alias("number"), evidence(**found).alias("evidence"))


def dressed(found: DataFrame) -> DataFrame:
    """Findings with their rule's layer, severity, effort, message, detail and fixable, from the table of rules (a fixed, small one)."""
    rows = [(rule, *D.RULES[rule], *ADVICE[rule]) for rule in D.RULES]
    rules = found.sparkSession.createDataFrame(rows, "rule string, layer int, severity string, effort int, fixable boolean, said string, detail string")
    out = found.join(F.broadcast(rules), "rule").withColumn("message", F.when(F.col("number").isNull(), F.col("said")).otherwise(F.concat("said", F.lit(": "), "number")))
    return out.select("run_id", "site_id", "host", "origin", "page_id", "rule", "layer", "severity", "effort", "url", "message", "detail", "fixable", "evidence")


def flat_pages(pages: DataFrame, judge_error_pages: bool = True) -> DataFrame:
    """Analysable pages (done or error) with flat head columns, one a url: the first of equal final urls without trailing slashes.

    judge_error_pages: whether pages that failed to load count as seen, with an empty head.
    """
    p = pages.where(F.col("state").isin("done", "error"))
    head = lambda name, kind, empty: F.coalesce(F.col(f"head.{name}").cast(kind), empty.cast(kind)).alias(name)
    blank, none, zero = F.lit(""), F.array(), F.lit(0)
    out = p.select(
        "run_id", "site_id", "host", "origin", "page_id", "source", "state", "status", "redirects", "elapsed_ms", "content_type", "cache_state", "cache_stale",
        F.coalesce("url", blank).alias("url"), N.strip(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"), blank)).alias("page_url"), F.coalesce("final_url", blank).alias("final_url"),
        *[head(c, "string", blank) for c in ("title", "description", "canonical", "html_lang", "viewport", "charset", "og_title", "og_description", "og_image")],
        *[head(c, "int", zero) for c in ("title_count", "description_count", "word_count", "images_total", "images_no_alt", "links_internal_total")],
        *[head(c, "array<string>", none) for c in ("canonical_all", "robots_all", "h1", "links_internal", "json_ld_types")],
        head("heading_levels", "array<int>", none), head("hreflang", "array<struct<lang:string,href:string>>", none),
    )
    tokens = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("robots_all", lambda r: F.split(r, ","))), lambda t: F.lower(N.strip(t))), lambda t: t != ""))
    out = out.withColumn("robots_tokens", tokens).withColumn("noindex", F.array_contains("robots_tokens", "noindex"))
    # keys that several rules compare are computed once
    out = out.withColumns({
        "page_key": N.same_key("page_url"), "canon_key": N.same_key("canonical"), "page_net": N.bare_netloc("page_url"), "canon_net": N.bare_netloc("canonical"), "lang_base": T.lang_base("html_lang"),
        "alternates": F.transform("hreflang", lambda a: F.struct(N.same_key(a.href).alias("key"), T.lang_base(a.lang).alias("base"))),
    })
    key = N.rstrip("page_url")
    first = F.row_number().over(Window.partitionBy("run_id", "site_id", key).orderBy("page_id"))
    kept = out.withColumn("_n", F.when(key == "", 1).otherwise(first)).where("_n = 1").drop("_n")
    return kept.withColumn("fetched", (F.col("status").isNotNull() | (F.col("state") == "error")) if judge_error_pages else F.col("status").isNotNull())


def with_target_lang(flat: DataFrame) -> DataFrame:
    """Adds target_base: the language that the page at the canonical address declares; its slashes at the end don't matter,
    and where no such page is known the very address is looked for."""
    by = flat.select("run_id", "site_id", N.rstrip("page_url").alias("_key"), F.col("page_url").alias("_exact"), F.col("lang_base").alias("target_base")).where("_key != ''")
    loose = by.select("run_id", "site_id", "_key", "target_base")
    exact = by.where("_exact != _key").groupBy("run_id", "site_id", F.col("_exact").alias("_url")).agg(F.first("target_base").alias("_target"))
    out = flat.withColumn("_key", F.when(F.col("canonical") != "", N.rstrip("canonical"))).join(loose, ["run_id", "site_id", "_key"], "left")
    # an address without its slashes is the key of the page itself, so only an odd one needs the second look
    odd = F.when(F.col("target_base").isNull() & (F.col("canonical") != ""), F.col("canonical"))
    return out.withColumn("_url", odd).join(exact, ["run_id", "site_id", "_url"], "left").withColumn("target_base", F.coalesce("target_base", "_target")).drop("_key", "_url", "_target")


def own() -> Column:
    return F.col("page_url")


def rule_status(p=None) -> list[Column]:
    s, url = F.col("status"), F.col("url")
    lost = (F.col("state") == "error") & s.isNull()
    seen = ~lost
    return [
        F.when(lost, finding("http.unreachable", url)),
        F.when(seen & (s >= 500), finding("http.server_error", url, s)),
        F.when(seen & (s == 404) & (F.col("source") == "sitemap"), finding("http.404_in_sitemap", url)),
        F.when(seen & (s >= 400) & (s < 500) & ~s.isin(401, 403) & ~((s == 404) & (F.col("source") == "sitemap")), finding("http.client_error", url)),
        F.when(seen & (F.col("redirects") >= 3), finding("http.redirect_chain", url)),
        F.when(seen & (F.col("source") == "sitemap") & (F.col("redirects") >= 1), finding("sitemap.redirecting_url", url)),
    ]


def rule_https() -> list[Column]:
    return [F.when(F.col("final_url").startswith("http://"), finding("security.no_https", own()))]


def rule_canonical() -> list[Column]:
    n, c = F.size("canonical_all"), F.col("canonical")
    there = n >= 1
    cross = there & (F.col("canon_net") != "") & (F.col("page_net") != "") & (F.col("canon_net") != F.col("page_net"))
    away = there & ~cross & (F.col("canon_key") != F.col("page_key"))
    other = lambda base: (base != "") & (F.col("lang_base") != "") & (base != F.col("lang_base"))
    language = F.coalesce(other(F.col("target_base")), F.lit(False)) | F.exists("alternates", lambda a: (a.key == F.col("canon_key")) & other(a.base))
    found = {"canonical": c}
    return [
        F.when(n == 0, finding("canonical.missing", own())),
        F.when(n > 1, finding("canonical.duplicate_tag", own(), values=F.slice("canonical_all", 1, 5))),
        F.when(cross, finding("canonical.cross_host", own(), **found)),
        F.when(away & language, finding("canonical.cross_language", own(), **found)),
        F.when(away & ~language, finding("canonical.points_elsewhere", own(), **found)),
    ]


def rule_noindex() -> list[Column]:
    listed = F.col("source") == "sitemap"
    return [F.when(F.col("noindex") & listed, finding("robots.noindex_in_sitemap", own())), F.when(F.col("noindex") & ~listed, finding("robots.noindex", own()))]


def _length_rules(field: str, least: int, most: int) -> list[Column]:
    n = T.visible_len(field)
    return [
        F.when(F.col(f"{field}_count") > 1, finding(f"{field}.duplicate_tag", own(), count=F.col(f"{field}_count"))),
        F.when(n == 0, finding(f"{field}.missing", own())),
        F.when((n > 0) & (n < least), finding(f"{field}.too_short", own(), n, value=F.col(field))),
        F.when(n > most, finding(f"{field}.too_long", own(), n, value=F.col(field))),
    ]


def rule_title() -> list[Column]:
    return _length_rules("title", D.TITLE_MIN, D.TITLE_MAX)


def rule_description() -> list[Column]:
    return _length_rules("description", D.DESC_MIN, D.DESC_MAX)


def rule_h1() -> list[Column]:
    n = F.size("h1")
    return [F.when(n == 0, finding("h1.missing", own())), F.when(n > 1, finding("h1.multiple", own(), count=n, values=F.slice("h1", 1, 5)))]


def rule_thin() -> list[Column]:
    return [F.when((F.col("word_count") > 0) & (F.col("word_count") < D.THIN_WORDS), finding("content.thin", own(), count=F.col("word_count")))]


def rule_images() -> list[Column]:
    total, bare = F.col("images_total"), F.col("images_no_alt")
    return [F.when((total >= 5) & (bare >= F.greatest(F.lit(3), F.floor(total / 2))), finding("images.missing_alt", own(), count=bare))]


def rule_performance() -> list[Column]:
    ms = F.col("elapsed_ms")
    return [F.when(ms >= D.VERY_SLOW_MS, finding("performance.very_slow", own(), count=ms)), F.when((ms >= D.SLOW_MS) & (ms < D.VERY_SLOW_MS), finding("performance.slow", own(), count=ms))]


def rule_lang_declared() -> list[Column]:
    return [F.when(T.collapse("html_lang") == "", finding("i18n.lang_missing", own()))]


def rule_lang_mismatch() -> list[Column]:
    want = T.expected_script("html_lang")
    out = []
    for field in ("title", "description"):
        got = T.guess_script(field)
        out.append(F.when((want != "") & ~got.isin("", "mixed") & (got != want), finding(f"i18n.{field}_language_mismatch", own(), value=F.substring(field, 1, 120))))
    return out


def rule_hreflang() -> list[Column]:
    some = F.size("hreflang") > 0
    lost = ~F.exists("alternates", lambda a: a.key == F.col("page_key"))
    declared = F.filter(F.transform("alternates", lambda a: a.base), lambda b: b != "")
    base = F.col("lang_base")
    return [
        F.when(some & lost, finding("i18n.hreflang_no_self", own(), values=F.slice(F.transform("hreflang", lambda a: a.href), 1, 6))),
        F.when(some & (base != "") & (F.size(declared) > 0) & ~F.array_contains(declared, base), finding("i18n.hreflang_lang_absent", own())),
    ]


def rule_robots_conflict() -> list[Column]:
    both = F.array_contains("robots_tokens", "noindex") & F.array_contains("robots_tokens", "index")
    return [F.when(both, finding("robots.conflicting", own(), values=F.col("robots_all"))), F.when(~both & (F.size("robots_all") > 1), finding("robots.duplicate_tag", own(), values=F.col("robots_all")))]


def rule_viewport() -> list[Column]:
    view = F.replace(F.lower("viewport"), F.lit(" "), F.lit(""))
    return [
        F.when(view == "", finding("mobile.viewport_missing", own())),
        F.when(view.contains("user-scalable=no") | view.contains("maximum-scale=1"), finding("mobile.zoom_blocked", own(), value=F.col("viewport"))),
    ]


def rule_charset() -> list[Column]:
    return [F.when((F.col("charset") == "") & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("charset="), finding("encoding.charset_missing", own()))]


def rule_headings() -> list[Column]:
    levels = F.col("heading_levels")
    jump = F.size(levels) >= 2
    pairs = F.when(jump, F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(1))), F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b - a))
    return [F.when(F.coalesce(F.exists(pairs, lambda d: d >= 2), F.lit(False)), finding("structure.heading_skip", own(), levels=F.slice(levels, 1, 30)))]


def rule_structured() -> list[Column]:
    types = F.transform("json_ld_types", lambda t: F.lower(t))
    open_ = ~F.col("noindex")
    org = F.exists(types, lambda t: t.rlike("|".join(D.ORG_LIKE)))
    return [F.when(open_ & (F.size(types) == 0), finding("schema.missing", own())), F.when(open_ & (F.size(types) > 0) & N.is_root(own()) & ~org, finding("schema.no_organization", own(), values=F.col("json_ld_types")))]


def rule_open_graph() -> list[Column]:
    open_, image = ~F.col("noindex"), F.col("og_image") == ""
    bare = (F.col("og_title") == "") & (F.col("og_description") == "") & image
    return [F.when(open_ & bare, finding("social.og_missing", own())), F.when(open_ & image & ~bare, finding("social.og_image_missing", own()))]


#: name: (rule, whether it judges the response only, and so also pages that were not seen)
PAGE_RULES: dict[str, tuple[Callable[[], list[Column]], bool]] = {
    "status": (rule_status, True), "https": (rule_https, True), "canonical": (rule_canonical, False), "noindex": (rule_noindex, False), "title": (rule_title, False),
    "description": (rule_description, False), "h1": (rule_h1, False), "thin": (rule_thin, False), "images": (rule_images, False), "performance": (rule_performance, False),
    "lang_declared": (rule_lang_declared, False), "lang_mismatch": (rule_lang_mismatch, False), "hreflang": (rule_hreflang, False), "robots_conflict": (rule_robots_conflict, False),
    "viewport": (rule_viewport, False), "charset": (rule_charset, False), "headings": (rule_headings, False), "structured": (rule_structured, False), "open_graph": (rule_open_graph, False),
}


def page_findings(flat: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """run_id, site_id, host, origin, page_id and the finding's columns; `rules` names some of PAGE_RULES."""
    columns = []
    for name in rules or PAGE_RULES:
        rule, response_only = PAGE_RULES[name]
        columns += rule() if response_only else [F.when(F.col("fetched"), c) for c in rule()]
    rows = with_target_lang(flat).withColumn("_found", F.array_compact(F.array(*columns)))
    return dressed(rows.select("run_id", "site_id", "host", "origin", "page_id", F.inline("_found")))
