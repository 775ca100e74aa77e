"""HTML to page metadata: an exact tokeniser as an Arrow UDF, and native column extractors for what needs none.

The tokeniser never raises: what it can't read is left at its default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------------------------
HIDDEN = {"script", "style", "template", "svg", "noscript"}
BLOCKS = {"p", "div", "br", "li", "tr", "td", "th", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
OG = {"og_url", "og_title", "og_description", "og_locale", "og_image", "og_type"}
SAMPLE_MOST, LEVELS_MOST = 1500, 200
# end of fixed values ----------------------------------------------------------------------------

HEAD = (
    "title string, title_count int, description string, description_count int, canonical string, canonical_all array<string>, robots string, robots_all array<string>, "
    "html_lang string, hreflang array<struct<lang:string,href:string>>, h1 array<string>, og_url string, og_title string, og_description string, og_locale string, og_image string, og_type string, "
    "viewport string, charset string, text_sample string, text_len int, word_count int, links_internal array<string>, links_external int, links_internal_total int, heading_levels array<int>, "
    "images_total int, images_no_alt int, json_ld_types array<string>, has_noscript_only boolean, generator string"
)
_TEXT = [x.split()[0] for x in HEAD.split(", ") if x.split()[1] == "string"]
_SPACE = re.compile(r"\s+")


def _squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def _types(node: object, out: list[str]) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            t = x.get("@type")
            out += [t] if isinstance(t, str) else [str(v) for v in t] if isinstance(t, list) else []
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)


class _Reader(HTMLParser):
    """Attribute values are squeezed; of fields that a page may give twice the first that says something counts."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        at = urlsplit(url)
        self.origin = f"{at.scheme}://{at.netloc}" if at.scheme and at.netloc else ""
        self.h: dict = dict.fromkeys(_TEXT, "") | {
            "title_count": 0, "description_count": 0, "canonical_all": [], "robots_all": [], "hreflang": [], "h1": [], "text_len": 0, "word_count": 0, "links_internal": [],
            "links_external": 0, "links_internal_total": 0, "heading_levels": [], "images_total": 0, "images_no_alt": 0, "json_ld_types": [], "has_noscript_only": False,
        }
        self.open: list[str] = []
        self.title: list[str] | None = None
        self.ld: list[str] | None = None
        self.h1: list[str] = []
        self.h1_open = 0
        self.text: list[str] = []

    def first(self, field: str, value: str) -> None:
        if value and not self.h[field]:
            self.h[field] = value

    def handle_starttag(self, tag, attrs):
        a = {k.lower(): v or "" for k, v in attrs}
        h = self.h
        self.open.append(tag)
        if tag == "html":
            self.first("html_lang", _squeeze(a.get("lang", "")))
        elif tag == "title":
            h["title_count"] += 1
            self.title = []
        elif tag == "meta":
            self.meta({k: _squeeze(v) for k, v in a.items()})
        elif tag == "link":
            self.link(a)
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.ld = []
        elif tag == "img":
            h["images_total"] += 1
            h["images_no_alt"] += not _squeeze(a.get("alt", ""))
        elif tag == "a":
            self.anchor(a.get("href", "").strip())
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if tag == "h1":
                self.h1, self.h1_open = [], self.h1_open + 1
            if tag == "h1" or len(h["heading_levels"]) < LEVELS_MOST:
                h["heading_levels"].append(int(tag[1]))

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # <![ with a name that is none of SGML's
            return self.parse_bogus_comment(i)

    def absolute(self, href: str) -> str | None:
        """The address from the page on; none if it can't be split, so that a page is read on after it."""
        try:
            return urljoin(self.url, href)
        except ValueError:
            return None

    def anchor(self, href: str) -> None:
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            return
        full = self.absolute(href)
        if full is None:
            return
        if self.origin and full.startswith(self.origin):
            self.h["links_internal_total"] += 1
            self.h["links_internal"].append(full)
        elif full.startswith(("http://", "https://")):
            self.h["links_external"] += 1

    def meta(self, a: dict[str, str]) -> None:
        name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
        h = self.h
        self.first("charset", a.get("charset", ""))
        if name == "description":
            h["description_count"] += 1
            self.first("description", content)
        elif name == "robots":
            h["robots_all"].append(content)
            self.first("robots", content)
        elif name == "viewport":
            h["viewport"] = content
        elif name == "generator":
            self.first("generator", content)
        for key in (prop, name):
            if key.startswith("og:") and (field := f"og_{key[3:]}") in OG:
                self.first(field, content)
        if a.get("http-equiv", "").lower() == "content-language":
            self.first("html_lang", content)

    def link(self, a: dict[str, str]) -> None:
        rel, href = a.get("rel", "").lower().split(), a.get("href", "").strip()
        if not rel or not href:
            return
        full = self.absolute(href)
        if full is None:
            return
        if "canonical" in rel:
            self.h["canonical_all"].append(full)
            self.first("canonical", full)
        if "alternate" in rel and a.get("hreflang"):
            pair = {"lang": _squeeze(a["hreflang"]).lower(), "href": full}
            if pair not in self.h["hreflang"]:
                self.h["hreflang"].append(pair)

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.first("title", _squeeze("".join(self.title)))
            self.title = None
        elif tag == "h1" and self.h1_open:
            self.h1_open -= 1
            if text := _squeeze("".join(self.h1)):
                self.h["h1"].append(text)
        elif tag == "script" and self.ld is not None:
            raw, self.ld = "".join(self.ld).strip(), None
            try:
                _types(json.loads(raw), self.h["json_ld_types"])
            except (ValueError, RecursionError):
                pass
        if tag in BLOCKS:
            self.text.append(" ")
        while self.open:
            if self.open.pop() == tag:
                break

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.ld is not None:
            self.ld.append(data)
            return
        if self.h1_open:
            self.h1.append(data)
        if not HIDDEN.intersection(self.open[-3:]):
            self.text.append(data)


def read_head(html: str | None, url: str | None) -> dict:
    """HEAD of a page as a dictionary, from its whole text. What the parser can't read ends the reading; what was read until then
    stays. Addresses that can't be split and unknown declarations are passed over."""
    try:
        r = _Reader(url or "")
    except ValueError:  # the address itself can't be split
        r = _Reader("")
    try:
        r.feed(html or "")
        r.close()  # not after a failed feed: it would read the page from its beginning again
    except Exception:  # noqa: BLE001  the parser raises what it likes
        pass
    text = _squeeze("".join(r.text))
    r.h |= {"text_sample": text[:SAMPLE_MOST], "text_len": len(text), "word_count": sum(any(map(str.isalnum, w)) for w in text.split())}
    return r.h


def _heads(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in HEAD.split(", ")]
    for html, url in parts:
        rows = [read_head(*x) for x in zip(html, url, strict=True)]
        yield pd.DataFrame({n: [r[n] for r in rows] for n in names}, columns=names)


def extract_head(html, url) -> Column:
    """HEAD of a page. Not deterministic to the planner, so that no filter makes it run a second time."""
    return F.pandas_udf(_heads, HEAD).asNondeterministic()(html, url)


def _entities(x: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def native_title(html) -> Column:
    return F.trim(F.regexp_replace(_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"(?U)\s+", " "))


def native_h1(html) -> Column:
    return F.trim(F.regexp_replace(_entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), r"(?U)\s+", " "))


def native_lang(html) -> Column:
    return F.regexp_extract(html, r'(?is)<html[^>]*?\slang="([^"]*)"', 1)


def native_charset(html) -> Column:
    return F.regexp_extract(html, r'(?is)<meta[^>]*?\scharset="?([^"\s/>]*)', 1)


def native_links(html) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?\bhref="([^"]*)"'), 1)


def native_text(html) -> Column:
    """Visible text: hidden elements and comments go, ends of blocks part words, other tags vanish."""
    t = F.regexp_replace(html, r"(?is)<(script|style|template|svg|noscript)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    t = F.regexp_replace(t, rf"(?i)</(?:{'|'.join(sorted(BLOCKS))})\s*>", " ")
    return _entities(F.regexp_replace(t, "<[^>]*>", ""))
