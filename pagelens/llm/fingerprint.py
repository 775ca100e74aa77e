"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (its pieces between line feeds). Every paragraph is
hashed to a wide vector, and the fingerprint is the sum of these vectors modulo 2**32 in each
lane. So the order of paragraphs doesn't matter, equal multisets have equal fingerprints, and
inserting or deleting a paragraph adds or subtracts its vector.

A paragraph's vector has two parts: DENSE lanes from a cryptographic hash of the whole paragraph,
which tell multisets apart, and SKETCH lanes that hold a signed count of its byte n-grams, so
that the difference of two fingerprints measures how much of two texts differs. The likeness of
two fingerprints is 1 - |a - b|^2 / (|a|^2 + |b|^2) over the sketch lanes, read as signed
numbers, held within 0 and 1; equal fingerprints have likeness 1. It estimates the share of
n-grams in common, with a standard error of about 1 / sqrt(SKETCH). A lane of a single text
can't reach half the modulus, as a text has fewer than 2**31 bytes.

Cases: a null text is the empty text, one empty paragraph. Rows are paired with the next row in
ascending doc_id (nulls first; equal ids in the order of their texts), the last with the first;
a single row is its own next. Rows are dealt out by ranges of doc_id of about RANGE_BYTES, so
rows that share one doc_id (or have none) are streamed by one task. Texts of any length are
fingerprinted whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import table
from pagelens.llm.words import BASE, U, Words, blocks, bytes_of, mix, powers

DENSE, SKETCH, GRAM_BYTES = 16, 256, 8
#: Bytes of text of a range of doc_id.
RANGE_BYTES = 128 << 20
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sketch lanes of each text (int64 before the modulus), summed over its paragraphs."""
    n = len(off) - 1
    out = np.zeros((n, SKETCH), np.int64)
    if not len(data):
        return out
    lines = Words(data, off, _LINE)
    length = lines.end - lines.start
    grams = np.maximum(length - GRAM_BYTES + 1, 1)
    up, down = powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    first = np.cumsum(grams) - grams
    at = np.arange(int(grams.sum())) + np.repeat(lines.start - first, grams)
    to = np.minimum(at + GRAM_BYTES, np.repeat(lines.end, grams))
    h = mix((sums[to] - sums[at]) * down[at])
    lane = (h >> U(56)).astype(np.int64)
    row = np.repeat(lines.row, grams)
    plus = (h & U(1)) == 1
    key = row * SKETCH + lane
    return (np.bincount(key[plus], minlength=n * SKETCH) - np.bincount(key[~plus], minlength=n * SKETCH)).reshape(n, SKETCH)


def dense(paragraphs: list[bytes]) -> np.ndarray:
    """The sum of the paragraphs' dense lanes modulo 2**32."""
    raw = b"".join([hashlib.blake2b(p).digest() for p in paragraphs])
    return np.frombuffer(raw, "<u4").reshape(-1, DENSE).sum(0, dtype=np.uint64).astype(np.uint32)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint32 lanes (texts, DENSE + SKETCH)."""
    data, off = bytes_of(pa.array(texts, pa.large_binary()))
    out = np.empty((len(texts), DENSE + SKETCH), np.uint32)
    out[:, DENSE:] = sketches(data, off).astype(np.uint32)
    for i, t in enumerate(texts):
        out[i, :DENSE] = dense(t.split(b"\n"))
    return out


def edited(whole: np.ndarray, gone: list[bytes], come: list[bytes]) -> np.ndarray:
    """The fingerprints after deleting `gone` paragraphs (joined by line feeds) and inserting `come`."""
    return whole - fingerprints(gone) + fingerprints(come)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a[:, DENSE:].view(np.int32).astype(np.float64), b[:, DENSE:].view(np.int32).astype(np.float64)
    far = (a[:, DENSE:] - b[:, DENSE:]).view(np.int32).astype(np.float64)
    size = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(1 - (far * far).sum(1) / np.maximum(size, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, np.where(size > 0, out, 0.0))


def text_form(lanes: np.ndarray) -> list[str]:
    return [base64.b64encode(row.astype("<u4").tobytes()).decode() for row in lanes]


def with_next(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and text in sorted blocks (column b) of about equal size; the first row of a block is
    also sent, flagged `ahead`, to the end of the block before it, that of the first block to the last.

    The blocks' bounds are quantiles of doc_id that occur in the table, so they are few and exact.
    """
    stats = docs.agg(
        F.percentile_approx("doc_id", [i / width for i in range(1, width)] or [0.5], max(10_000, 10 * width)).alias("q"),
        F.min("doc_id").alias("low"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"),
    ).first()
    low = stats.low
    bounds = sorted(set(stats.q or []) - {low})
    # how many bounds a doc_id has reached: among every step-th of them, then among those that follow
    step = max(1, round(len(bounds) ** 0.5))
    reached = lambda these: F.size(F.filter(these, lambda x: x <= F.col("doc_id")))
    coarse = F.greatest(reached(F.lit(bounds[::step]).cast("array<bigint>")) - 1, F.lit(0)) * step
    own = F.coalesce(coarse + reached(F.slice(F.lit(bounds).cast("array<bigint>"), coarse + 1, step)), F.lit(0)) if bounds else F.lit(0)
    start = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    start = F.coalesce(start, F.lit(False))
    begins = F.col("doc_id").isNull() if stats.nulls else F.coalesce(F.col("doc_id") == F.lit(low), F.lit(False))
    last = len(bounds)
    places = F.when(begins, F.array(F.struct(own.alias("b"), F.lit(False).alias("ahead")), F.struct(F.lit(last).alias("b"), F.lit(True).alias("ahead")))).when(
        start, F.array(F.struct(own.alias("b"), F.lit(False).alias("ahead")), F.struct((own - 1).alias("b"), F.lit(True).alias("ahead")))
    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("ahead"))))
    spread = docs.select("doc_id", "text", F.explode(places).alias("p")).select("p.b", "p.ahead", "doc_id", "text")
    return spread.repartition(max(1, last + 1), "b").sortWithinPartitions("b", "ahead", F.asc_nulls_first("doc_id"), "text")


def edit_of(text: str, after: str) -> tuple[str, int]:
    """The text whose last quarter is replaced by as much of the next text's beginning, and the point of change."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q], len(text) - q


def compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Results of (doc_id, text, next text)."""
    texts, heads = [t.encode() for _, t, _ in rows], []
    changed, gone, come = [], [], []
    for _, t, after in rows:
        new, at = edit_of(t, after)
        cut = t.rfind("\n", 0, at) + 1  # paragraphs before the one that changes stay
        changed.append(new)
        gone.append(t[cut:].encode())
        come.append(new[cut:].encode())
        heads.append(after.encode())
    mine = fingerprints(texts)
    other = np.vstack([mine[1:], fingerprints(heads[-1:])])
    new = edited(mine, gone, come)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, *_ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array(text_form(mine), pa.string()), pa.array(text_form(new), pa.string()), pa.array(likeness(mine, new)), pa.array(likeness(mine, other)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_edits(docs: DataFrame, width: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done, ready, size = None, None, [], 0
        for batch in blocks(batches):
            for b, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and done == b:
                    continue  # another row that shares the bound's doc_id
                text = text or ""
                if waiting is not None:
                    ready.append((*waiting, text))
                    size += len(text)
                waiting = None if ahead else (doc_id, text)
                if ahead:
                    done = b
                if ready and (ahead or size > 1 << 20):
                    yield compare(ready)
                    ready, size = [], 0

    return with_next(docs, width).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return fingerprint_edits(docs, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-size // RANGE_BYTES)))
