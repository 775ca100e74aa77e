"""Text functions of the rules and fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.dims import CYRILLIC_LANGS, LATIN_LANGS
from pagelens.functions.urls import part


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x) -> Column:
    """Unicode white space runs to one blank, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def visible_len(x) -> Column:
    return F.char_length(collapse(x))


def word_count(x) -> Column:
    """White-space tokens with a letter or digit."""
    return F.size(F.filter(F.split(collapse(x), " "), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def lang_base(x) -> Column:
    c = F.replace(F.lower(collapse(x)), F.lit("_"), F.lit("-"))
    return F.when(c == "x-default", "").otherwise(F.substring_index(c, "-", 1))


def guess_script(x) -> Column:
    s = F.coalesce(_c(x), F.lit(""))
    cyr, lat = F.regexp_count(s, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(s, F.lit("[a-zA-Z]"))
    return F.when((cyr == 0) & (lat == 0), "").when(cyr > lat * 2, "cyrillic").when(lat > cyr * 2, "latin").otherwise("mixed")


def expected_script(lang) -> Column:
    base = lang_base(lang)
    return F.when(base.isin(CYRILLIC_LANGS), "cyrillic").when(base.isin(LATIN_LANGS), "latin").otherwise("")


def slug_words(url) -> Column:
    """The last path segment's words, without file ending and numbers."""
    last = F.regexp_extract(part(url, 3), "([^/]*)/*$", 1)
    last = F.regexp_replace(last, r"(?i)[.](html?|php|aspx?)$", "")
    return F.array_join(F.filter(F.split(last, "[-_+]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$")), " ")


def capitalize(x) -> Column:
    s = _c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def brand(origin) -> Column:
    host = F.when(part(origin, 2) != "", part(origin, 2)).otherwise(_c(origin))
    host = F.regexp_replace(F.substring_index(host, ":", 1), "^www[.]", "")
    return capitalize(F.substring_index(host, ".", 1))


def trim_to(x, limit: int, least: int = 0) -> Column:
    """At most `limit` characters: up to the last sentence end that leaves `least` of them, else whole words."""
    text = collapse(x)
    cut = F.substring(text, 1, limit)
    words = F.regexp_replace(F.when(F.instr(cut, " ") > 0, F.regexp_extract(cut, "^(.*) [^ ]*$", 1)).otherwise(cut), "[ ,.;:—-]+$", "")
    out = words
    if least:
        inner = F.length(F.regexp_extract(cut, "^(.*[.!?]) ", 1)) - 1
        tail = F.when(F.rtrim(cut).rlike("[.!?]$"), F.length(F.rtrim(cut)) - 1).otherwise(-1)
        end = F.when(inner >= 0, inner).otherwise(tail)
        out = F.when(end >= least, F.trim(F.substring(cut, F.lit(1), (end + 1).cast("int")))).otherwise(words)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def shorten_right(x, n: int) -> Column:
    """The first characters and an ellipsis where there are more than n."""
    return F.when(F.length(_c(x)) <= n, _c(x)).otherwise(F.concat(F.rtrim(F.substring(_c(x), 1, n - 1)), F.lit("…")))


def shorten_left(x, n: int) -> Column:
    """An ellipsis and the last characters where there are more than n."""
    return F.when(F.length(_c(x)) <= n, _c(x)).otherwise(F.concat(F.lit("…"), F.right(_c(x), F.lit(n - 1))))
