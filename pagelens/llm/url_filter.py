"""URL filters by a Bloom filter cascade, in DataFrame operations only.

A rule is a host and a path prefix. A url's candidate keys are its host's suffixes at label
boundaries joined with its path's prefixes of the lengths that rules have; a rule fits a url
exactly when the rule's text is one of them. The complete key universe of a cascade is every
candidate key of the corpus. Level 1 encodes the listed keys; level 2 the universe's false
positives of level 1; level 3 the listed keys that level 2 wrongly holds; and so on until a
level has no false positive. A lookup is then exact for every key of the universe, and reads
only literals: no join, no shuffle.

Cases: a null url, or one without "://", has empty host and path and so no key; it gets no
rule and the verdict of the method (not listed: allow). Repeated urls and page_ids are judged
row by row. An empty table gives an empty result; with no rules every key is unlisted. Columns
other than `url` are carried as they are; host, path, rule and verdict replace such columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import stored, table

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a level may have; as a literal it is carried by every task.
MAX_BITS = 1 << 26


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Every key that a rule of this list could have for the url, as an array."""
    deepest = max((h.count(".") + 1 for h, _ in rules), default=1)
    lengths = sorted({len(p) for _, p in rules})
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.bits))
        b = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.bits))
        return [F.pmod(a + b * i, F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit(str(list(self.words))), "array<bigint>")
        return F.lit(True) if not self.hashes else _all(
            F.getbit(F.get(words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key)
        )


def _all(tests) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the levels hold in turn, an odd number of them."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.holds(key) & ~out
        return out


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n keys with about this rate of false positives."""
    bits = 64 * math.ceil(max(64.0, 1.4427 * n * math.log2(1 / rate)) / 64)
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is more than a literal may have ({MAX_BITS}); split the list of rules by host")
    level = Level(seed, bits, max(1, round(bits / max(n, 1) * math.log(2))) if bits / max(n, 1) < 30 else 20, ())
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    bit = F.expr("shiftleft(bigint(1), cast(p % 64 AS int))")
    rows = at.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(seed, bits, level.hashes, tuple(words))


def build_cascade(universe: DataFrame, listed: list[str], seed: int = 0) -> Cascade:
    """A cascade for the listed keys that is exact on `universe` (column key, distinct) and on the list.

    The first level's rate keeps its false positives about as many as the listed keys, so all
    levels together stay in proportion to the list, not to the corpus.
    """
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    n = len(set(listed))
    if n == 0:
        return Cascade(())
    total = universe.count()
    levels = [_level(inside, n, min(0.5, max(2.0**-30, n / max(total, 1))), seed)]
    other = stored(spark, universe.join(inside, "key", "left_anti").where(levels[0].holds(F.col("key"))), "cascade")
    while (m := other.count()) > 0:
        levels.append(_level(other, m, 0.5, seed + len(levels)))
        inside, other = other, inside.where(levels[-1].holds(F.col("key")))
    return Cascade(tuple(levels))


def judge_urls(pages: DataFrame, block: list[tuple[str, str]], allow: list[tuple[str, str]]) -> DataFrame:
    """pages with host, path, rule (text of the longest rule that fits, or null) and verdict.

    block, allow: (host, path prefix). Without a rule the verdict is the cascade's own: the url
    is in no list, so allow.
    """
    rules = block + allow
    text = [h + p for h, p in rules]
    if len(set(text)) < len(text):
        raise ValueError("a rule is listed twice")
    url = F.col("url")
    parts = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    keyed = parts.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    spark = pages.sparkSession
    universe = stored(spark, keyed.select(F.explode("_keys").alias("key")).distinct(), "keys")
    blocked = build_cascade(universe, [h + p for h, p in block], 0)
    allowed = build_cascade(universe, [h + p for h, p in allow], 1000)
    fits = F.filter("_keys", lambda k: blocked.member(k) | allowed.member(k))
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), blocked.member(k).alias("blocked"))))
    return (
        keyed.withColumn("_best", best)
        .withColumns({"rule": F.col("_best.key"), "verdict": F.when(F.col("_best.blocked"), "block").otherwise("allow")})
        .drop("_keys", "_best")
    )


BLOCK, ALLOW = [("net", "/"), ("example.com", "/de/")], [("example.net", "/en/"), ("org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, BLOCK, ALLOW).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
