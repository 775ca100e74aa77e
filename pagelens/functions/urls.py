"""URL normalisations as column functions, all from one RFC 3986 split; none raises on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


def _c(u) -> Column:
    return F.col(u) if isinstance(u, str) else u


def part(u, k: int) -> Column:
    """1 scheme, 2 netloc, 3 path, 4 query, 5 fragment; '' where absent."""
    return F.coalesce(F.regexp_extract(_c(u), SPLIT, k), F.lit(""))


def rstrip(u, chars: str = "/") -> Column:
    return F.regexp_replace(_c(u), f"[{chars}]+$", "")


def strip(u) -> Column:
    return F.regexp_replace(_c(u), r"(?U)^\s+|\s+$", "")


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.lit("//"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def page_form(u) -> Column:
    """N1: scheme and host lower, userinfo and default port dropped, '/' for no path, fragment dropped; without host the stripped input."""
    s = strip(F.coalesce(_c(u), F.lit("")))
    scheme, path = F.lower(part(s, 1)), part(s, 3)
    netloc = F.regexp_replace(part(s, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(netloc, ":[0-9]*$", ""))
    port = F.regexp_extract(netloc, ":([0-9]+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    full = _unsplit(scheme, F.when(default, host).otherwise(F.concat(host, F.lit(":"), port)), F.when(path == "", "/").otherwise(path), part(s, 4))
    return F.when(host == "", s).otherwise(full)


def same_key(u) -> Column:
    """N2: two urls are the same page when these keys are equal."""
    return rstrip(page_form(u))


def site_form(u) -> Column:
    """N3: scheme lower or https, netloc lower without its default port, '/' for no path, fragment dropped."""
    s = strip(F.coalesce(_c(u), F.lit("")))
    scheme = F.when(part(s, 1) == "", "https").otherwise(F.lower(part(s, 1)))
    netloc = F.lower(part(s, 2))
    netloc = F.when(scheme == "https", F.regexp_replace(netloc, ":443$", "")).when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).otherwise(netloc)
    path = F.when(part(s, 3) == "", "/").otherwise(part(s, 3))
    return F.when(s == "", "").otherwise(_unsplit(scheme, netloc, path, part(s, 4)))


def graph_key(u) -> Column:
    """N4: scheme://netloc/path in lower case, without query, fragment and trailing slashes."""
    path = rstrip(part(u, 3))
    full = F.lower(F.concat(part(u, 1), F.lit("://"), part(u, 2), F.when(path == "", "/").otherwise(path)))
    return F.when(F.coalesce(_c(u), F.lit("")) == "", "").otherwise(full)


def host_label(u) -> Column:
    """N6: what a person calls the site: no scheme, no www., no slashes at the ends, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_c(u)), "https://|http://|///", ""), "^/+|/+$", "")
    return F.regexp_replace(bare, "^www[.]", "")


def list_key(u) -> Column:
    """N7: the key of a site in a hand-written list."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(u)), "^https://|^http://", ""), "^/+|/+$", ""), "^www[.]", "")


def with_scheme(u) -> Column:
    s = strip(u)
    return F.when(s == "", "").when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))


def tracker_host(u) -> Column:
    """netloc without www., case kept; the input where there is none."""
    h = F.when(part(u, 2) != "", part(u, 2)).otherwise(_c(u))
    return F.regexp_replace(h, "^www[.]", "")


def bare_netloc(u) -> Column:
    return F.regexp_replace(F.lower(part(u, 2)), "^www[.]", "")


def section(u) -> Column:
    """First path segment; the second where the first has at most three letters and there are more."""
    parts = F.filter(F.split(part(u, 3), "/"), lambda x: x != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.when((F.length(first) <= 3) & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(first)


def is_html_candidate(u, extensions: list[str]) -> Column:
    return ~F.lower(part(u, 3)).rlike(f"[.](?:{'|'.join(extensions)})$")


def is_root(u) -> Column:
    return part(u, 3).isin("", "/") | (rstrip(part(u, 3)) == "")


def cache_busted(u, stamp) -> Column:
    """The url with one more query parameter, so that a cache has no copy of it."""
    glue = F.when(F.instr(_c(u), "?") > 0, "&").otherwise("?")
    return F.concat(_c(u), glue, F.lit("_ia="), F.pmod(_c(stamp), F.lit(100000)).cast("string"))
