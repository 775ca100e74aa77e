"""Benchmark decontamination by a distributed positional inverted index.

The training texts' token postings are stored as a table: one row a shard of about SHARD_BYTES
of text, with the shard's documents, its terms and, by term, the ascending positions where the
term occurs. A query window is answered in every shard by taking the list of its rarest term,
adjusted by the term's place in the window, and intersecting it with the other terms' adjusted
lists from rare to frequent; a window with an absent term ends at once. The index is sharded by
document, so neither building nor asking it moves postings between machines.

An index that is made for one benchmark keeps only terms whose hash falls on a bit that a term of
the benchmark sets: TERM_BITS bits whatever the benchmark's size, so the larger the benchmark,
the nearer the index comes to the complete one, and no answer depends on it. The benchmark is
asked in blocks of BLOCK_BYTES bytes of items (a longer item is a block of its own): what is sent
to the tasks at once is bounded, more items take more blocks, and every size takes the same path.

Terms are 64-bit hashes of lower-cased words. Cases: null and empty texts have no words and are
never hit. Items without words match nothing; repeated items match separately, each item_id
counted once. Items with a null item_id hit as others do; together they count as one item, a
null at the end of a document's items, which the joined text of the items leaves out. Rows that
repeat a doc_id are judged on their own. Empty tables give empty or clean results. Other columns
are not read, and the stage carries them under any name; a text of any length is one shard at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import free_name, named, stored, table
from pagelens.llm.words import ALNUM, LOWER, U, Words, blocks, bytes_of

SHARD_BYTES, BLOCK_BYTES, SIZE, TERM_BITS = 1 << 20, 1 << 20, 10, 24
INDEX = "shard string, doc_ids array<long>, first array<int>, terms array<long>, sizes array<int>, positions array<int>"


def in_order(names: set[str | None]) -> list[str | None]:
    """Sorted, a null at the end as array_sort has it."""
    return sorted(names, key=lambda x: (x is None, x or ""))


class Queries:
    """Windows of benchmark items: terms[i, :length[i]] are the hashes of window i; items by window."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = SIZE):
        data, off = bytes_of(pa.array([t for _, t in items], pa.large_string()))
        words = Words(LOWER[data], off, ALNUM)
        h, found = words.hashes(), {}
        for i, (name, _) in enumerate(items):
            own = h[words.first[i] : words.first[i + 1]]
            n = len(own)
            for k in range(n - size + 1) if n >= size else range(min(n, 1)):
                found.setdefault(own[k : k + size].tobytes(), set()).add(name)
        self.length = np.array([len(k) // 8 for k in found], np.int64)
        self.terms = np.zeros((len(found), size), U)
        for i, k in enumerate(found):
            self.terms[i, : self.length[i]] = np.frombuffer(k, U)
        self.items = [in_order(v) for v in found.values()]
        self.vocabulary = np.unique(h)


def term_bits(benchmark: DataFrame) -> np.ndarray:
    """Which hashes' first TERM_BITS bits occur among the benchmark's terms."""
    bits = np.zeros(1 << TERM_BITS, bool)
    for held in item_blocks(benchmark):
        data, off = bytes_of(pa.array([t for _, t in held], pa.large_string()))
        bits[(Words(LOWER[data], off, ALNUM).hashes() >> U(64 - TERM_BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def build_index(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """The index of doc_id and text as a stored table; of all terms, or of those that term_bits() lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).view(bool) if sent else None
        for part in blocks(batches, "text", SHARD_BYTES):
            data, off = bytes_of(part.column(1))
            words = Words(LOWER[data], off, ALNUM)
            h = words.hashes()
            at = np.arange(len(h)) if known is None else np.flatnonzero(known[(h >> U(64 - TERM_BITS)).astype(np.int64)])
            terms, which, sizes = np.unique(h[at], return_inverse=True, return_counts=True)
            at = at[np.argsort(which, kind="stable")]
            # the name is that of the ids and whole texts: shards of one name are copies of each other
            name = hashlib.blake2b(digest_size=16)
            for piece in (repr(part.column(0).to_pylist()).encode(), off.tobytes(), data.tobytes()):
                name.update(len(piece).to_bytes(8, "little") + piece)
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.hexdigest()]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), one(words.first.astype(np.int32), pa.int32()),
                 one(terms.view(np.int64), pa.int64()), one(sizes.astype(np.int32), pa.int32()), one(at.astype(np.int32), pa.int32())],
                ["shard", "doc_ids", "first", "terms", "sizes", "positions"],
            )

    return stored(docs.sparkSession, docs.select("doc_id", "text").mapInArrow(run, INDEX), "postings")


class Shard:
    """One row of the index, with phrase and proximity search."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[i].values
        self.doc_ids = get("doc_ids")
        self.first = get("first").to_numpy().astype(np.int64)
        self.terms = get("terms").to_numpy().view(U)
        sizes = get("sizes").to_numpy().astype(np.int64)
        self.begin = np.append(0, np.cumsum(sizes))
        self.positions = get("positions").to_numpy().astype(np.int64)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term begin and end; empty for absent terms."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        return np.where(here, self.begin[at], 0), np.where(here, self.begin[at + 1], 0)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def phrases(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence."""
        begin, end = self.lists(q.terms)
        inside = np.arange(q.terms.shape[1]) < q.length[:, None]
        count = np.where(inside, end - begin, np.iinfo(np.int64).max)
        windows, starts = [], []
        for w in np.flatnonzero(count.min(1, initial=0 if not len(count) else np.iinfo(np.int64).max) > 0):
            order = np.argsort(count[w, : q.length[w]], kind="stable")
            k = order[0]
            at = self.positions[begin[w, k] : end[w, k]] - k
            at = at[at >= 0]
            for k in order[1:]:
                if not len(at):
                    break
                other = self.positions[begin[w, k] : end[w, k]]
                place = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
                at = at[other[place] == at + k]
            if len(at):
                at = at[self.doc_of(at) == self.doc_of(at + q.length[w] - 1)]
                windows.append(np.full(len(at), w))
                starts.append(at)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *windows]), np.concatenate([empty, *starts])

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Every position of which the `span` words from it on, or as many as its document has left, hold all these terms, in any order."""
        terms = np.unique(terms)
        begin, end = self.lists(terms)
        order = np.argsort(end - begin, kind="stable")
        if not len(terms) or (end == begin).any():
            return np.zeros(0, np.int64)
        rare = self.positions[begin[order[0]] : end[order[0]]]
        back = rare[:, None] - np.arange(span)
        at = np.unique(back[back >= self.first[self.doc_of(rare)][:, None]])
        last = np.minimum(at + span, self.first[self.doc_of(at) + 1])
        for k in order[1:]:
            other = self.positions[begin[k] : end[k]]
            place = np.searchsorted(other, at)
            keep = (place < len(other)) & (other[np.minimum(place, len(other) - 1)] < last)
            at, last = at[keep], last[keep]
        return at


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items, about BLOCK_BYTES of text at a time; the last block may be empty."""
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        held.append((r.i, r.text))
        size += 16 + 4 * len(r.text or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held


def query_blocks(benchmark: DataFrame, size: int = SIZE) -> Iterator[Queries]:
    """The benchmark's windows, a block of items at a time."""
    for held in item_blocks(benchmark):
        yield Queries(held, size)


OUT = "shard string, doc_no int, hit array<int>, items array<string>"


def find_hits(index: DataFrame, q: Queries) -> DataFrame:
    """Of every indexed document that is hit: the numbers of its hit words, and the items whose windows occur."""
    sent = index.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(batch, i)
                w, at = s.phrases(q)
                if not len(w):
                    continue
                cover = np.zeros(s.first[-1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + q.length[w], -1)
                words = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                doc, of = s.doc_of(words), s.doc_of(at)
                docs = np.unique(of)
                hit = [(words[doc == d] - s.first[d]).astype(np.int32) for d in docs]
                items = [in_order({x for j in w[of == d] for x in q.items[j]}) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(docs), pa.string()), pa.array(docs.astype(np.int32)), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["shard", "doc_no", "hit", "items"],
                )

    return index.mapInArrow(run, OUT)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) of every document, for windows of SIZE words of all items."""
    benchmark = benchmark.select("item_id", "text")
    index, all_hits = build_index(docs, term_bits(benchmark)), None
    for q in query_blocks(benchmark):
        part = stored(index.sparkSession, find_hits(index, q), "hits")
        all_hits = part if all_hits is None else all_hits.unionByName(part)
    merged = all_hits.groupBy("shard", "doc_no").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    every = index.select("shard", "first", F.posexplode("doc_ids").alias("doc_no", "doc_id"))
    every = every.select("shard", "doc_no", "doc_id", (F.get("first", F.col("doc_no") + 1) - F.get("first", "doc_no")).cast("long").alias("n_words"))
    out = every.join(merged, ["shard", "doc_no"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


NEAR = "shard string, doc_no int, doc_id long, item_id string, at array<int>"


def find_near(index: DataFrame, asked: list[tuple[str | None, np.ndarray]], span: int) -> DataFrame:
    """A row for every indexed document and item (item_id, terms) whose terms all meet within `span` words: where such stretches begin."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(batch, i)
                docs: list[int] = []
                items: list[str | None] = []
                places: list[np.ndarray] = []
                for name, terms in sent.value:
                    at = s.near(terms, span)
                    of = s.doc_of(at)
                    for d in np.unique(of):
                        docs.append(int(d))
                        items.append(name)
                        places.append((at[of == d] - s.first[d]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(docs), pa.string()), pa.array(docs, pa.int32()), s.doc_ids.take(pa.array(docs, pa.int64())), pa.array(items, pa.string()), pa.array(places, pa.list_(pa.int32()))],
                    ["shard", "doc_no", "doc_id", "item_id", "at"],
                )

    return index.mapInArrow(run, NEAR)


def proximity(docs: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    """doc_id, item_id and at (ascending) of every document and item whose words all occur within `span` words, in any order.

    A stretch begins at any word and ends with its document, so that texts shorter than `span` match too. A word that an item
    repeats is asked for once; items without words match nothing; of rows that repeat an item each gives its own match.
    """
    if span < 1:
        raise ValueError("span must be 1 at least")
    index, out = build_index(docs), None
    for held in item_blocks(benchmark):
        data, off = bytes_of(pa.array([t for _, t in held], pa.large_string()))
        words = Words(LOWER[data], off, ALNUM)
        h = words.hashes()
        part = find_near(index, [(name, np.unique(h[words.first[i] : words.first[i + 1]])) for i, (name, _) in enumerate(held)], span)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "item_id", "at")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window, with their columns. A repeated doc_id goes if any of its rows is hit."""
    name = free_name(docs.columns, "_hit")
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    hit = stored(spark, hit.withColumnRenamed("doc_id", name), "hit-ids")
    return docs.join(hit, docs["doc_id"].eqNullSafe(named(name)), "left_anti")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS_SQL = f"""
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
bs AS (SELECT item_id, ws, CASE WHEN len(ws) >= 10 THEN 10 ELSE len(ws) END AS k FROM bw WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM bs) AS x),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM dw JOIN ks ON len(ws) >= k),
hits AS (SELECT d.doc_id AS doc_id, d.p AS p, d.k AS k, iw.item_id AS item_id FROM (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM dp) AS d JOIN iw ON d.win = iw.win AND d.k = iw.k)
"""
OP9_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
{HITS_SQL},
n AS (SELECT doc_id, CAST(count(DISTINCT q) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) AS y GROUP BY doc_id),
i AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) AS z GROUP BY doc_id)
SELECT dw.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id
"""
