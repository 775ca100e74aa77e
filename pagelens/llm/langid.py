"""Language identification by multilingual mixture inference.

Each learned language has a distribution over hashed byte trigrams of words, counted over all
documents that may be learned from. A word's likelihood in a language is that of its trigrams;
a document is a mixture of languages over its words. Expectation-maximisation estimates the
proportions; languages are then added in order of proportion, each set refitted, and the set
with the best penalised log-likelihood (PENALTY units of half the logarithm of the number of
words for each further language) is kept. The predicted language is the largest of the kept
set; the score is its proportion times the share of likelihood that it takes from the others.

Cases: null texts and texts without a letter get `und` and score 0. A table without learnable
rows gives `und` everywhere. One learned language gets every text with a letter. Repeated rows
are predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import crc_mod, table, with_results
from pagelens.llm.words import LOWER, Words, blocks, bytes_of

BITS, PENALTY = 15, 4.0
#: Bytes of words: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z, and the second bytes of the upper-case Latin letters U+00C0 to U+00DE, which follow 0xC3.
_AFTER_C3 = np.arange(256, dtype=np.uint8)
_AFTER_C3[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    out = LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[wide] = _AFTER_C3[out[wide]]
    return out


def trigrams(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word byte with its neighbours (0 beyond the word), and where each word begins among them."""
    length = words.end - words.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(words.start - first, length)
    mid = data[at].astype(np.uint32)
    left, right = np.zeros_like(mid), np.zeros_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[first] = 0
    right[first + length - 1] = 0
    code = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), first


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the whole texts of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in blocks(batches):
            data, off = bytes_of(part.column(1))
            data = lowered(data)
            words = Words(data, off, LETTERS)
            if not len(words):
                continue
            bucket, first = trigrams(data, words)
            names = part.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(code[words.row], np.diff(np.append(first, len(bucket))))
            n = np.bincount(row << BITS | bucket, minlength=len(names.dictionary) << BITS).reshape(-1, 1 << BITS)
            for k, name in enumerate(names.dictionary.to_pylist()):
                counts[name] = counts.get(name, 0) + n[k]
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, most: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (buckets, languages); the table holds 2**BITS counts a language at most."""
    known = docs.where("lang is not null and text is not null")
    if known.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages; raise `most`, at {4 << BITS} bytes of the driver's and each task's memory a language")
    rows = count_trigrams(known).toPandas()
    langs = sorted(rows["lang"].unique())
    table_ = np.full((1 << BITS, len(langs)), 0.05)
    table_[rows["bucket"].to_numpy(dtype=np.int64), np.searchsorted(langs, rows["lang"].to_numpy()) if len(langs) else np.zeros(0, int)] += rows["n"].to_numpy(dtype=float)
    return langs, np.log(table_ / table_.sum(0)).astype(np.float32) if langs else table_.astype(np.float32)


def _em(like: np.ndarray, allowed: np.ndarray, start: np.ndarray, first: np.ndarray, count: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document over its allowed languages, and its log-likelihood (without the words' own scale)."""
    share = np.where(allowed, np.maximum(start, 1e-6), 0).astype(np.float32)
    share /= share.sum(1, keepdims=True)
    total = None
    for k in range(rounds + 1):
        joint = like * np.repeat(share, count, axis=0)
        total = joint.sum(1)
        np.maximum(total, 1e-30, out=total)
        if k < rounds:
            joint /= total[:, None]
            share = np.add.reduceat(joint, first, axis=0) / count[:, None].astype(np.float32)
    return share, np.add.reduceat(np.log(total.astype(np.float64)), first)


def infer(data: np.ndarray, off: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the language's number (-1 without words), its score, and the kept proportions."""
    data = lowered(data)
    words, k = Words(data, off, LETTERS), logp.shape[1]
    best, score, mixture = np.full(len(off) - 1, -1), np.zeros(len(off) - 1), np.zeros((len(off) - 1, k))
    some = np.flatnonzero(words.count)
    if not len(some) or not k:
        return best, score, mixture
    bucket, begin = trigrams(data, words)
    log_like = np.add.reduceat(logp[bucket], begin, axis=0)
    scale = log_like.max(1, keepdims=True)
    like = np.exp(np.maximum(log_like - scale, -60))
    first, count = words.first[some], words.count[some]
    full, _ = _em(like, np.ones((len(some), k), bool), np.ones((len(some), k)), first, count, 8)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    kept, top = np.zeros_like(full), np.full(len(some), -np.inf)
    penalty = PENALTY * 0.5 * np.log(np.maximum(count, 2))
    live = np.arange(len(some))
    for size in range(1, k + 1):
        # documents whose next language takes part go on; a smaller share than one word can't pay its penalty
        if size > 1:
            live = live[np.take_along_axis(full[live], np.argsort(rank[live], axis=1)[:, size - 1 : size], 1)[:, 0] * count[live] > 0.5]
        if not len(live):
            break
        inside = np.repeat(np.isin(np.arange(len(some)), live), count)
        n = count[live]
        share, value = _em(like[inside], rank[live] < size, full[live], np.cumsum(n) - n, n, 0 if size == 1 else 5)
        value = value - penalty[live] * (size - 1)
        better = value > top[live] + 1e-9
        kept[live[better]], top[live[better]] = share[better], value[better]
    best[some] = kept.argmax(1)
    mixture[some] = kept
    # the winner's proportion, less what the other languages could claim of the document as a whole
    whole = np.add.reduceat(log_like.astype(np.float64), first, axis=0)
    whole = np.exp(np.maximum(whole - whole.max(1, keepdims=True), -60))
    score[some] = kept.max(1) * (np.take_along_axis(whole, best[some][:, None], 1)[:, 0] / whole.sum(1)) ** 0.1
    return best, np.clip(score, 0, 1), mixture


def predict_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """`keep` columns, lang_pred, score, and languages: the kept set with proportions."""
    langs, logp = model
    sent = docs.sparkSession.sparkContext.broadcast(logp)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        # words hold ASCII letters or something beyond ASCII, which need not be a letter
        plain = LETTERS & (np.arange(256) < 0x80)
        for part in parts:
            column = part.column(len(keep))
            data, off = bytes_of(column)
            best, score, mixture = infer(data, off, sent.value)
            has = np.append(0, np.cumsum(plain[data]))
            doubtful = np.flatnonzero((best >= 0) & (has[off[1:]] == has[off[:-1]]))
            for i in doubtful:
                if not any(map(str.isalpha, column[int(i)].as_py())):
                    best[i], score[i] = -1, 0
            names = [langs[b] if b >= 0 else "und" for b in best]
            sets = [",".join(f"{langs[j]}:{m[j]:.3f}" for j in np.argsort(-m, kind="stable") if m[j] > 0) if b >= 0 else "" for m, b in zip(mixture, best, strict=True)]
            yield [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(sets, pa.string())]

    return with_results(docs, keep, "text", [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("languages", T.StringType())], run)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(crc_mod("doc_id", 3) != 1))
    out = predict_languages(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages")
