"""Substring dedup: every word inside a window of WINDOW words that also starts in a document with a smaller id goes.

Every window owns an anchor: its least GRAM-word sequence by hash, the leftmost of equal ones.
Equal windows own equal anchors at equal places, so an anchor is a shard key that brings equal
windows together without sending every window. Consecutive windows with the same anchor form a
run; a run's region is the text of its windows.

1. Runs (document, anchor, hash of the region, place) are made from every text; a region that one
   text repeats is told once.
2. Anchors of one document only are dropped by an aggregate and a semi-join. What is left is stored.
3. Equal regions of an anchor are merged to one, with the smallest document, before any text moves;
   so a group of copies of any size weighs as much as one document.
4. The regions' words are fetched from the smallest document and dealt out by anchor. Each shard
   builds a compressed FM-index of its regions and streams the regions through it; backward search
   gives every window's matching statistic, and at the threshold the smallest document of all
   occurrences in the shard.
5. Windows with a smaller document go back to the runs of every document, and to its words.

An anchor with more than HOT distinct regions (a very large group of near copies) would grow one
shard; its runs are split into single windows that are keyed by their own hash, so that equal
windows are one region and no key holds more than one.

Cases: words are split at ASCII white space; a null text has none. Rows that share a doc_id are
one document to each other: none has a smaller id. Rows with a null doc_id are neither changed
nor compared. Empty tables give empty results; other columns are carried by the stage only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import stored, table
from pagelens.llm.fm_index import FMIndex
from pagelens.llm.words import SPACED, U, Words, blocks, bytes_of, mix, spans_of, sums_of, take_spans

WINDOW, GRAM, HOT, SHARD_WORDS = 50, 8, 20_000, 1_000_000
_TAG = 41  # the tag keeps 23 bits of a text's hash


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each start: where the least of the next `width` grams is, the leftmost of equal ones."""
    best, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        have += step
    return best


def _tags(sums: np.ndarray, words: Words) -> np.ndarray:
    return spans_of(sums, words.first[:-1], words.first[1:]) >> U(_TAG)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        data, off = bytes_of(part.column(1))
        words = Words(data, off, SPACED)
        h = words.hashes()
        if len(h) < WINDOW:
            continue
        sums = sums_of(h)
        at = np.arange(len(h) - GRAM + 1)
        grams = spans_of(sums, at, at + GRAM)
        owner = least_grams(grams, WINDOW - GRAM + 1)
        known = ~part.column(0).is_null().to_numpy(zero_copy_only=False)
        p = np.flatnonzero((words.row[: len(owner)] == words.row[WINDOW - 1 :]) & known[words.row[: len(owner)]])
        if not len(p):
            continue
        q = owner[p]
        new = np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(p)))
        p0, q0 = p[begin], q[begin]
        row = words.row[p0]
        region = mix(spans_of(sums, p0, p0 + n + WINDOW - 1) + (q0 - p0).astype(U))
        # a region that a text repeats is told once: covered() finds its other places in the text
        once = np.sort(np.unique(mix(region + mix(grams[q0] + row.astype(U))), return_index=True)[1])
        p0, q0, n, row, region = p0[once], q0[once], n[once], row[once], region[once]
        place = (_tags(sums, words)[row] << U(40)) | (n.astype(U) << U(32)) | (p0 - words.first[row]).astype(U)
        ids = part.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in (grams[q0], region, place))], ["doc_id", "anchor", "region", "place"])


RUN = "doc_id long, anchor long, region long, place long"


def window_runs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_runs, RUN)


def shared(runs: DataFrame) -> DataFrame:
    """The runs whose anchor occurs in two documents at least."""
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    anchors = stored(runs.sparkSession, anchors, "anchors")  # so that the join can split the runs of one anchor
    return runs.join(anchors, "anchor", "left_semi").select("doc_id", "anchor", "region", "place")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, int, list[dict]]]:
    """Of each row with columns text and spans: its words, hashes and prefix sums, tag, and the spans of this very text."""
    for part in blocks(iter([batch])):
        text, spans = part.schema.get_field_index("text"), part.column(part.schema.get_field_index("spans"))
        for i in range(part.num_rows):
            one = part.slice(i, 1)
            data, off = bytes_of(one.column(text))
            words = Words(data, off, SPACED)
            h = words.hashes()
            sums = sums_of(h)
            tag = int(_tags(sums, words)[0])
            yield words, h, sums, i, [s for s in spans[i].as_py() or [] if s["place"] >> 40 == tag]


def single_windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs cut into windows of their own, each keyed by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for k, (_, _, sums, _, spans) in enumerate(_rows(batch)):
                if not spans:
                    continue
                p = np.concatenate([np.arange(s["place"] & 0xFFFFFFFF, (s["place"] & 0xFFFFFFFF) + (s["place"] >> 32 & 0xFF)) for s in spans])
                key = spans_of(sums, p, p + WINDOW)
                place = (U(spans[0]["place"] >> 40) << U(40)) | (U(1) << U(32)) | p.astype(U)
                columns = [pa.array(x.view(np.int64)) for x in (key, mix(key + U(1)), place)]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 1).take(pa.array(np.zeros(len(p), int))), *columns], ["doc_id", "anchor", "region", "place"])

    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("place")).alias("spans"))
    return docs.select("doc_id", "text").join(by_doc, "doc_id").mapInArrow(run, RUN)


def region_words(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """anchor, region, doc_id and the region's words as hashes, taken from the smallest document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for k, (_, h, _, _, spans) in enumerate(_rows(batch)):
                for s in spans:
                    p, n = s["place"] & 0xFFFFFFFF, s["place"] >> 32 & 0xFF
                    for x, y in zip(out, (s["anchor"], s["region"], ids[k], h[p : p + n + WINDOW - 1].tobytes()), strict=True):
                        x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "region", "low", "words"])

    by_doc = regions.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "region", "place")).alias("spans"))
    return docs.select("doc_id", "text").join(by_doc, "doc_id").mapInArrow(run, "anchor long, region long, low long, words binary")


def smallest_documents(regions: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each region and each of its windows: the smallest document of any region that has the window."""
    length = np.array([len(r) // 8 for r in regions], np.int64)
    words = np.frombuffer(b"".join(regions), U)
    numbers = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    before = np.cumsum(length) - length
    start = before + np.arange(len(regions))  # one separator behind each region
    text, owner = np.zeros(len(words) + len(regions), np.int64), np.repeat(low, length + 1)
    text[np.repeat(start - before, length) + np.arange(len(words))] = numbers
    index = FMIndex(text, owner, WINDOW)
    _, least = index.matching_statistics(text, start, length)
    return np.split(take_spans(least, start, length - WINDOW + 1), np.cumsum(length - WINDOW + 1)[:-1])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of about SHARD_WORDS words, cut between anchors, from rows sorted by anchor."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        found = smallest_documents([r[3] for r in rows], np.array([r[2] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(found, pa.list_(pa.int64()))], ["anchor", "region", "least"])

    held, size, seen = [], 0, set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[-1][0]:
                seen = set()
                if size >= SHARD_WORDS:
                    yield shard(held)
                    held, size = [], 0
            if row[1] not in seen:  # rows that repeat a document repeat its regions
                seen.add(row[1])
                held.append(row)
                size += len(row[3]) // 8
    if held:
        yield shard(held)


def repeated_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id and spans (place of a run, and by window the smallest document that has it) of every
    document with a window that also starts in a document with a smaller id."""
    spark = docs.sparkSession
    runs = stored(spark, shared(window_runs(docs)), "runs")
    merged = lambda r: r.groupBy("anchor", "region").agg(F.min("doc_id").alias("low"), F.min_by("place", "doc_id").alias("place"))
    regions = stored(spark, merged(runs), "regions")
    large = regions.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    large = stored(spark, large, "large")
    if not large.isEmpty():
        windows = shared(single_windows(docs, runs.join(large, "anchor", "left_semi")))
        runs = stored(spark, runs.join(large, "anchor", "left_anti").unionByName(windows), "runs")
        regions = stored(spark, merged(runs), "regions")
    words = region_words(docs, regions)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = words.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_search, "anchor long, region long, least array<long>")
    found = stored(spark, found, "found")  # so that the join can split the runs of one region
    hits = runs.join(found, ["anchor", "region"]).where("exists(least, x -> x < doc_id)")
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("place", "least")).alias("spans"))


def covered(sums: np.ndarray, doc_id: int, spans: list[dict]) -> np.ndarray:
    """Which words of a text (by the prefix sums of its words) a window of a smaller document covers."""
    n = len(sums) - 1
    edge = np.zeros(n + 1, np.int64)
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for s in spans:
        by.setdefault(s["place"] >> 32 & 0xFF, []).append((s["place"] & 0xFFFFFFFF, np.flatnonzero(np.array(s["least"]) < doc_id)))
    for many, found in by.items():
        at = np.arange(n - (many + WINDOW - 1) + 1)
        keys = spans_of(sums, at, at + many + WINDOW - 1)
        order = np.argsort(keys, kind="stable")
        first, last = (np.searchsorted(keys[order], keys[[p for p, _ in found]], side) for side in ("left", "right"))
        for (_, inside), a, b in zip(found, first, last, strict=True):
            p = (order[a:b, None] + inside).ravel()  # every place that has the region's words
            np.add.at(edge, p, 1)
            np.add.at(edge, p + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(batch: pa.RecordBatch, text_at: int, id_at: int, spans_at: int) -> Iterator[tuple[int, int, bytes | None]]:
    """n_words, n_removed and the kept words of each row (None where nothing is removed)."""
    ids = batch.column(id_at).to_pylist()
    found = batch.column(spans_at)
    data, off = bytes_of(batch.column(text_at))
    raw = data.tobytes()
    for i, doc_id in enumerate(ids):
        words = raw[off[i] : off[i + 1]].split()
        gone = None
        if found[i].is_valid and doc_id is not None:
            one = Words(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), SPACED)
            sums = sums_of(one.hashes())
            tag = int(_tags(sums, one)[0])
            gone = covered(sums, doc_id, [s for s in found[i].as_py() if s["place"] >> 40 == tag])
        if gone is None or not gone.any():
            yield len(words), 0, b" ".join(words)
        else:
            yield len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone, strict=True) if not g])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            n, gone, kept = zip(*_kept(part, 1, 0, 2), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    spans = repeated_windows(docs, hot)
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            n, gone, kept = zip(*_kept(part, 1, 0, 2), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = repeated_windows(docs)
    return docs.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated words removed; texts without any stay as they are, and a document
    of which no word is left goes. n_chars follows the text."""
    columns = docs.columns
    at = columns.index("text"), columns.index("doc_id"), len(columns)
    # the tasks see numbers for names, so that columns may have any
    plain = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    spans = repeated_windows(docs).toDF("id", "spans")
    joined = plain.join(spans, plain[f"c{at[1]}"] == spans["id"], "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, f"c{at[0]}"):
            texts, keep = part.column(at[0]).to_pylist(), []
            for i, (n, gone, kept) in enumerate(_kept(part, *at)):
                keep.append(not gone or gone < n)
                if gone:
                    texts[i] = kept.decode()
            arrays = [pa.array(texts, part.column(k).type) if k == at[0] else part.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, part.schema.names[:-1]).filter(pa.array(keep))

    out = joined.mapInArrow(run, plain.schema).toDF(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS low FROM w GROUP BY h),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT w.doc_id AS doc_id, unnest(range(w.p, w.p + 50)) AS q FROM w JOIN f ON f.h = w.h WHERE f.low < w.doc_id) AS x),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM d WHERE len(ws) > 0),
k AS (SELECT e.doc_id AS doc_id, count(r.q) AS gone, coalesce(string_agg(e.ws[e.q], ' ' ORDER BY e.q) FILTER (WHERE r.q IS NULL), '') AS kept
      FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.q = e.q GROUP BY e.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
