"""Quality by a compression classifier.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is
cut into chunks of `chunk` bytes, all of which are compressed with either dictionary; chunks
keep a long text from becoming its own dictionary. The difference of the two compressed sizes,
normalised by their sum, is calibrated into a probability by a logistic fit on labelled rows
that the dictionaries have not seen.

The fit is one task over a stated, bounded sample: at most `per_class` labelled rows of each
class, those with the smallest hash of doc_id, and of these as many as hold FIT_CHARS characters of text.
Every document is scored over its whole text.

Cases: null and empty texts have difference 0 and so the calibration's score at 0. Without
labels of both classes (an empty table of documents or labels too) every score is the share of
label 1 (0.5 without labels). Repeated rows score alike. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import crc_mod, table, with_results
from pagelens.llm.words import blocks, bytes_of

CHUNK, LEVEL, DICTIONARY = 2048, 1, 64 << 10
#: Characters of text that a fit holds at most.
FIT_CHARS = 64 << 20


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of x should be 1."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good) of the compressed sizes of all chunks."""
        good = bad = 0
        view = memoryview(text)
        g, b = self.pair[0].compress, self.pair[1].compress
        for i in range(0, len(text), CHUNK):
            part = view[i : i + CHUNK]
            good += len(g(part))
            bad += len(b(part))
        return (bad - good) / (bad + good) if text else 0.0


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold, per_class: int) -> DataFrame:
    """doc_id, text, y of at most per_class documents of each class outside the held-out fold, smallest hash first."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold)
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * per_class ids at most
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit_in_task[M](rows: DataFrame, fit: Callable[[list[tuple[int, str, int]]], M], most: int = FIT_CHARS) -> M:
    """fit() over (doc_id, text, y) in the order of doc_id, in one task: the rows whose texts, in the order of the hash of
    doc_id, hold `most` characters together. Rows beyond are left as soon as they are met, so the task's memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str, int]] = []  # the largest hash on top
        size, ceiling = 0, float("inf")
        for part in blocks(batches):
            for doc_id, text, y, order in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if order < ceiling:
                    heapq.heappush(held, (-order, doc_id, text or "", y))
                    size += len(text or "")
                while size > most:
                    worst, _, text, _ = heapq.heappop(held)
                    size, ceiling = size - len(text), min(ceiling, -worst)
        sample = sorted((d, t, y) for order, d, t, y in held if -order < ceiling)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], ["model"])

    told = rows.select("doc_id", "text", F.col("y").cast("long"), F.xxhash64("doc_id").alias("order"))
    row = told.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit([])


def fit_quality(sample: list[tuple[int, str, int]]) -> tuple[bytes, bytes, list[float]]:
    """The two dictionaries and the calibration [slope, intercept]; empty dictionaries where a class is missing."""
    of = {y: [t.encode() for _, t, v in sample if v == y] for y in (0, 1)}
    share = (len(of[1]) / len(sample)) if sample else 0.5
    flat = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if min(len(of[0]), len(of[1])) < 8:
        return b"", b"", [0.0, flat]
    books, held = {}, []
    for y, texts in of.items():
        learn = [t for i, t in enumerate(texts) if i % 5 < 3]
        held += [(t, y) for i, t in enumerate(texts) if i % 5 >= 3]
        pieces = [t[i : i + CHUNK] for t in learn for i in range(0, len(t), CHUNK)]
        pieces = [p for p in pieces if len(p) >= 8]
        # both books see the same amount of text
        books[y] = pieces
    size = min(sum(map(len, p)) for p in books.values())
    made = []
    for y in (1, 0):
        rng, kept, total = np.random.default_rng(7), [], 0
        for i in rng.permutation(len(books[y])):
            if total >= size:
                break
            kept.append(books[y][i])
            total += len(books[y][i])
        try:
            made.append(zstandard.train_dictionary(min(DICTIONARY, max(1024, total // 4)), kept).as_bytes())
        except zstandard.ZstdError:  # too little text to select from: the text itself is the dictionary
            made.append(b"".join(kept)[-DICTIONARY:])
    z = Compressors(*made)
    x = np.array([[z.difference(t), 1.0] for t, _ in held])
    w = logistic(np.column_stack([x[:, 0] * 100, x[:, 1]]), np.array([y for _, y in held], float))
    # the sample holds classes in other shares than the table only where per_class cut one; the caller corrects that
    return made[0], made[1], [float(w[0] * 100), float(w[1])]


def score_quality(docs: DataFrame, model: tuple[bytes, bytes, list[float]], keep: list[str]) -> DataFrame:
    """`keep` columns and score of every row."""
    good, bad, (slope, intercept) = model

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        z = Compressors(good, bad) if good else None
        for part in parts:
            data, off = bytes_of(part.column(len(keep)))
            raw = data.tobytes()
            d = np.array([z.difference(raw[a:b]) if z else 0.0 for a, b in zip(off[:-1], off[1:], strict=True)])
            yield [*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(slope * d + intercept, -30, 30))))]

    return with_results(docs, keep, "text", [("score", T.DoubleType())], run)


#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 4000


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[bytes, bytes, list[float]]:
    learn = crc_mod("doc_id", 4) != 2
    model = fit_in_task(labelled_rows(docs, labels, "quality", learn, per_class), fit_quality)
    counts = {r.quality: r.n for r in labels.where(learn).where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # classes that the bound cut are weighed back to their shares in the labels
    zero, one = counts.get(0, 0), counts.get(1, 0)
    if zero and one and model[0]:
        model[2][1] += float(np.log(one / min(one, per_class)) - np.log(zero / min(zero, per_class)))
    return model


def op3_quality(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, quality_model(docs, labels, per_class), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
