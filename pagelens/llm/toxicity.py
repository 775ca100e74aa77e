"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (lower-cased; letters, digits and everything beyond ASCII) are cut into windows
of WINDOW words that overlap by half and cover the whole text. Each word enters as a word input
and a character input: the learned vector of its hash and the mean of those of all its byte
n-grams, each beside the smoothed log-odds of that hash (for characters: the largest over the
n-grams) between toxic and other labelled documents. Two gated recurrent units read a window in
both directions, attention pools their states, and a logistic unit scores the window. A document
scores as its highest window (multiple-instance learning: a label holds for the document, not
for a window).

The fit is one task over a stated, bounded sample: at most `per_class` labelled rows of each class
outside the held-out fold, those with the smallest hash of doc_id, and of these as many as hold
FIT_CHARS characters of text. Of the windows of its non-toxic documents the network trains, in each epoch, on
the highest of every document and about `windows` others at random (all, where there are no more).
Scoring covers every word of every document, in windows STRIDE words apart.

Cases: a null, empty or wordless text is one window of padding; its score is the network's at
no input, below one half unless nearly all labelled rows are toxic. Without eight labelled rows
of each class (an empty table of documents or labels too) every score is the share of toxic rows
(0.25 without labels). Repeated rows score alike; an empty table gives an empty result; the query
reads no other columns, and the stage carries them under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.common import crc_mod, free_name, named, table, with_results
from pagelens.llm.quality import fit_in_task, labelled_rows, logistic
from pagelens.llm.words import ALNUM, BASE, GRAM, LOWER, U, Words, blocks, bytes_of, mix, powers, take_spans

WINDOW, STRIDE, HIDDEN, VEC = 24, 12, 8, 4
WORD_BITS, CHAR_BITS, GRAMS = 18, 18, (3, 5, 7)
F32 = np.float32


def inputs_of(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each picked word its bucket; for each of its byte n-grams (with both ends marked) a bucket; n-grams of each word."""
    data, n = words.data, len(pick)
    bucket = (words.hashes()[pick] >> U(64 - WORD_BITS)).astype(np.int32)
    if n == 0:
        return bucket, np.zeros(0, np.int32), np.zeros(0, np.int64)
    up, down = powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    start, end = words.start[pick], words.end[pick]
    counts = [np.maximum(end - start - g + 1, 1) for g in GRAMS]
    total = sum(counts)
    out = np.empty(int(total.sum()), np.int32)
    base = np.cumsum(total) - total
    done = np.zeros(n, np.int64)
    for g, c in zip(GRAMS, counts, strict=True):
        before = np.cumsum(c) - c
        inner = np.arange(int(c.sum())) - np.repeat(before, c)
        at = np.repeat(start, c) + inner
        to = np.minimum(at + g, np.repeat(end, c))
        h = mix((sums[to] - sums[at]) * down[at] + U(g * GRAM % (1 << 64)))
        out[np.repeat(base + done, c) + inner] = (h >> U(64 - CHAR_BITS)).astype(np.int32)
        done += c
    return bucket, out, total


def log_odds(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By bucket: shrunk log-odds that a toxic document holds it, from the numbers of documents that do."""
    z = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    # a bucket seen in few documents says little: the value goes one and a half standard errors towards 0
    error = 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return (np.sign(z) * np.clip(np.abs(z) - error, 0, 4)).astype(F32)


class Net:
    """Parameters and passes of the network; x has shape (windows, WINDOW, inputs)."""

    def __init__(self, rng: np.random.Generator):
        self.d = 2 * (1 + VEC)
        r = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(max(s[0], 1) / 4)).astype(F32)
        self.p = {"word": (rng.standard_normal((1 << 12, VEC)) * 0.05).astype(F32), "char": (rng.standard_normal((1 << 12, VEC)) * 0.05).astype(F32)}
        for side in "fb":
            self.p |= {f"W{side}": r(self.d, 3 * HIDDEN), f"U{side}": r(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, F32)}
        self.p |= {"A": r(2 * HIDDEN, 2 * HIDDEN), "a": r(2 * HIDDEN), "o": r(2 * HIDDEN), "c": np.full(1, -1.0, F32)}

    def gru(self, gates: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, HIDDEN) from input gates (steps, windows, 3 HIDDEN)."""
        p, h = self.p, np.zeros((gates.shape[1], HIDDEN), F32)
        out = np.empty((len(gates), gates.shape[1], HIDDEN), F32)
        order = range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1)
        mine, other = p[f"U{side}"][:, : 2 * HIDDEN], p[f"U{side}"][:, 2 * HIDDEN :]
        for t in order:
            zr = gates[t, :, : 2 * HIDDEN] + h @ mine
            zr *= F32(0.5)
            np.tanh(zr, out=zr)
            zr += F32(1)
            zr *= F32(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = gates[t, :, 2 * HIDDEN :] + rh @ other
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, z.copy(), r.copy(), c.copy(), h, rh))
            h = h + z * (c - h)
            out[t] = h
        return out

    def score(self, gf: np.ndarray, gb: np.ndarray) -> np.ndarray:
        """Logits of windows from their input gates of both directions."""
        s = np.concatenate([self.gru(gf, "f"), self.gru(gb, "b")], axis=2)
        e = np.tanh(s @ self.p["A"]) @ self.p["a"]
        e = np.exp(e - e.max(0))
        return ((s * (e / e.sum(0))[:, :, None]).sum(0)) @ self.p["o"] + self.p["c"][0]

    def train_step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the weighted log loss, that of x, and the logits."""
        p, xt = self.p, x.transpose(1, 0, 2)
        kept = {"f": [], "b": []}
        sides = {k: self.gru(xt @ p[f"W{k}"] + p[f"b{k}"], k, kept[k]) for k in "fb"}
        s = np.concatenate([sides["f"], sides["b"]], axis=2)
        u = np.tanh(s @ p["A"])
        e = u @ p["a"]
        e = np.exp(e - e.max(0))
        att = e / e.sum(0)
        pooled = (s * att[:, :, None]).sum(0)
        logit = pooled @ p["o"] + p["c"][0]
        g = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(F32)
        grads = {"o": pooled.T @ g, "c": np.array([g.sum()], F32)}
        dp = g[:, None] * p["o"]
        ds = att[:, :, None] * dp
        da = (s * dp).sum(2)
        de = att * (da - (att * da).sum(0))
        grads["a"] = np.einsum("tnk,tn->k", u, de)
        du = de[:, :, None] * p["a"] * (1 - u * u)
        grads["A"] = np.einsum("tni,tnj->ij", s, du)
        ds += du @ p["A"].T
        dx = np.zeros_like(xt)
        for k, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
            m, o = p[f"U{k}"][:, : 2 * HIDDEN], p[f"U{k}"][:, 2 * HIDDEN :]
            gu, gw, gb = np.zeros_like(p[f"U{k}"]), np.zeros_like(p[f"W{k}"]), np.zeros_like(p[f"b{k}"])
            dh = np.zeros((x.shape[0], HIDDEN), F32)
            for t, z, r, c, h, rh in reversed(kept[k]):
                dh = dh + part[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ o.T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                gu[:, : 2 * HIDDEN] += h.T @ dg[:, : 2 * HIDDEN]
                gu[:, 2 * HIDDEN :] += rh.T @ dc
                gw += xt[t].T @ dg
                gb += dg.sum(0)
                dx[t] = dg @ p[f"W{k}"].T
                dh = dh * (1 - z) + drh * r + dg[:, : 2 * HIDDEN] @ m.T
            grads |= {f"U{k}": gu, f"W{k}": gw, f"b{k}": gb}
        return grads, dx.transpose(1, 0, 2), logit


class Lexicon:
    """Distinct words: of each its bucket and the buckets of its n-grams, first[i] .. first[i + 1] for word i."""

    def __init__(self, bucket: np.ndarray, gram: np.ndarray, total: np.ndarray):
        self.bucket, self.gram, self.total = bucket, gram, total
        self.first = np.cumsum(total) - total

    def grams_of(self, word: np.ndarray) -> np.ndarray:
        """The n-grams of these words, joined."""
        return take_spans(self.gram, self.first[word], self.total[word])

    def char_z(self, table_: np.ndarray) -> np.ndarray:
        """The largest log-odds of any n-gram of each word."""
        return np.maximum.reduceat(table_[self.gram], self.first) if len(self.first) else np.zeros(0, F32)

    def inputs(self, net: Net, word_z: np.ndarray, char_z: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The inputs of these words, from the log-odds of each of them."""
        out = np.empty((len(word), net.d), F32)
        if not len(word):
            return out
        out[:, 0], out[:, 1 + VEC] = word_z, char_z
        out[:, 1 : 1 + VEC] = net.p["word"][self.bucket[word] >> (WORD_BITS - 12)]
        many = self.total[word]
        out[:, 2 + VEC :] = np.add.reduceat(net.p["char"][self.grams_of(word) >> (CHAR_BITS - 12)], np.cumsum(many) - many, axis=0) / many[:, None]
        return out


def distinct(words: Words) -> tuple[Lexicon, np.ndarray]:
    """The distinct words, and which of them each word is."""
    _, example, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return Lexicon(*inputs_of(words, example)), which


class Model:
    """log-odds tables and network; scores blocks of texts."""

    def __init__(self, word_z: np.ndarray, char_z: np.ndarray, net: Net):
        self.word_z, self.char_z, self.net = word_z, char_z, net

    @staticmethod
    def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window and its row, from the first word of each row; one window a row at least."""
        per = np.maximum(1, -(-(np.diff(first) - (WINDOW - STRIDE)) // STRIDE))
        row = np.repeat(np.arange(len(per)), per)
        return first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE, row

    @staticmethod
    def members(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """Word numbers (windows, WINDOW); n is padding."""
        at = start[:, None] + np.arange(WINDOW)
        return np.where(at < end[:, None], at, n)

    def logits(self, words: Words) -> np.ndarray:
        """The highest window's logit of each row."""
        lexicon, which = distinct(words)
        every = np.arange(len(lexicon.bucket))
        x = np.zeros((len(every) + 1, self.net.d), F32)  # the last is padding
        x[:-1] = lexicon.inputs(self.net, self.word_z[lexicon.bucket], lexicon.char_z(self.char_z), every)
        gates = {k: x @ self.net.p[f"W{k}"] + self.net.p[f"b{k}"] for k in "fb"}
        which = np.append(which, len(every))
        start, row = self.windows(words.first)
        out = np.full(len(words.count), -np.inf, F32)
        for i in range(0, len(start), 2048):
            own = row[i : i + 2048]
            at = which[self.members(start[i : i + 2048], words.first[own + 1], len(words)).T]
            np.maximum.at(out, own, self.net.score(gates["f"][at], gates["b"][at]))
        return out


def fit_toxicity(sample: list[tuple[int, str, int]], windows: int = 10_000, seed: int = 11) -> tuple[Model | None, list[float]]:
    """The model and [slope, intercept] of its calibration on documents."""
    y = np.array([v for *_, v in sample], np.int64)
    share = y.mean() if len(y) else 0.25
    flat = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if min((y == 0).sum(), (y == 1).sum()) < 8:
        return None, [0.0, flat]
    rng = np.random.default_rng(seed)
    folds = rng.integers(0, 4, len(y))
    # the sample's words as numbers of its distinct words, some documents at a time
    seen: dict[int, int] = {}
    parts, pieces, first = [], [], [np.zeros(1, np.int64)]
    for part in blocks(iter([pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in sample], pa.large_string())], ["text"])])):
        data, off = bytes_of(part.column(0))
        words = Words(LOWER[data], off, ALNUM)
        h, example, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        new = np.array([i for i, x in enumerate(h.tolist()) if x not in seen], np.int64)
        seen |= {int(h[i]): len(seen) + k for k, i in enumerate(new)}
        parts.append(inputs_of(words, example[new]))
        pieces.append(np.array([seen[x] for x in h.tolist()], np.int32)[which])
        first.append(first[-1][-1] + words.first[1:])
    lexicon = Lexicon(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    word, first, n = np.append(np.concatenate(pieces), np.int32(0)), np.concatenate(first), sum(map(len, pieces))
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    del parts, pieces, seen
    # documents that hold a bucket, by fold and label
    held = [np.zeros((8, 1 << bits), np.int32) for bits in (WORD_BITS, CHAR_BITS)]
    cuts = np.searchsorted(doc, np.arange(0, len(y) + 500, 500))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        many = lexicon.total[word[a:b]]
        for count, bucket, row in ((held[0], lexicon.bucket[word[a:b]], doc[a:b]), (held[1], lexicon.grams_of(word[a:b]), np.repeat(doc[a:b], many))):
            pairs = np.unique(row << 18 | bucket)
            np.add.at(count, (folds[pairs >> 18] * 2 + y[pairs >> 18], pairs & ((1 << 18) - 1)), 1)
    size = np.bincount(folds * 2 + y, minlength=8)
    # log-odds for a document come from the other folds, else the network would trust its own rare words
    tables = []
    for count in held:
        one, all_one = count[1::2], count[1::2].sum(0)
        zero, all_zero = count[0::2], count[0::2].sum(0)
        n1, n0 = size[1::2].sum(), size[0::2].sum()
        tables.append(np.stack([log_odds(all_one - one[f], all_zero - zero[f], n1 - size[2 * f + 1], n0 - size[2 * f]) for f in range(4)] + [log_odds(all_one, all_zero, n1, n0)]))
    net = Net(rng)
    final = Model(tables[0][4], tables[1][4], net)
    word_z, char_z = tables[0][:4, lexicon.bucket], np.stack([lexicon.char_z(t) for t in tables[1][:4]])  # by fold and word
    del held, tables
    fold = folds[doc] if n else np.zeros(0, np.int64)

    def learned(words: np.ndarray) -> np.ndarray:
        return lexicon.inputs(net, np.zeros(len(words), F32), np.zeros(len(words), F32), words)

    def vectors(at: np.ndarray, every: np.ndarray | None = None) -> np.ndarray:
        """The inputs of the sample's words of these numbers; n is padding, all zeros. every: learned() of all words, if there."""
        out = np.zeros((*at.shape, net.d), F32)
        real = at < n
        w, f = word[at[real]], fold[at[real]]
        if every is not None:
            x = every[w]
        else:
            one, which = np.unique(w, return_inverse=True)
            x = learned(one)[which]
        x[:, 0], x[:, 1 + VEC] = word_z[f, w], char_z[f, w]
        out[real] = x
        return out

    start, row = Model.windows(first)
    end = first[row + 1]
    label = y[row]
    both = np.append(np.maximum(word_z[fold, word[:n]], char_z[fold, word[:n]]), F32(0))
    best = np.concatenate([both[Model.members(start[i : i + 4096], end[i : i + 4096], n)].max(1) for i in range(0, len(start), 4096)]).astype(np.float64)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(5):
        # of a toxic document the highest window teaches toxicity; of others the highest and some at random
        order = np.lexsort((-best, row))
        top = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        more = rng.random(len(row)) < min(1.0, windows / max(1, len(row)))
        use = np.unique(np.concatenate([top, np.flatnonzero((label == 0) & more)]))
        rng.shuffle(use)
        weigh = np.where(label[use] == 1, (label[use] == 0).sum() / max(1, (label[use] == 1).sum()) / 3, 1.0).astype(F32)
        rate = 0.01 if epoch < 3 else 0.003
        for i in range(0, len(use), 256):
            pick = use[i : i + 256]
            at = Model.members(start[pick], end[pick], n)
            grads, dx, _ = net.train_step(vectors(at), label[pick].astype(F32), weigh[i : i + 256])
            real = at < n
            who, dx = word[at[real]], dx[real]
            many = lexicon.total[who]
            grams, share = lexicon.grams_of(who) >> (CHAR_BITS - 12), dx[:, 2 + VEC :] / many[:, None]
            spread = lambda key, rows: np.stack([np.bincount(key, rows[:, j], minlength=1 << 12) for j in range(VEC)], axis=1).astype(F32)
            grads["word"] = spread(lexicon.bucket[who] >> (WORD_BITS - 12), dx[:, 1 : 1 + VEC])
            grads["char"] = spread(grams, np.repeat(share, many, axis=0))
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6) + rate * 0.002 * net.p[k]).astype(F32)
        every = learned(np.arange(len(lexicon.bucket)))
        for i in range(0, len(start), 4096):
            x = vectors(Model.members(start[i : i + 4096], end[i : i + 4096], n).T, every)
            best[i : i + 4096] = net.score(x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"])
    highest = np.full(len(y), -np.inf)
    np.maximum.at(highest, row, best)
    weights = logistic(np.column_stack([highest, np.ones(len(y))]), y.astype(float), 0.1)
    return final, [float(max(weights[0], 1e-3)), float(weights[1])]


def score_toxicity(docs: DataFrame, fitted: tuple[Model | None, list[float]], keep: list[str], score: str = "score") -> DataFrame:
    """The `keep` columns and the score of every row."""
    model, (slope, intercept) = fitted
    sent = docs.sparkSession.sparkContext.broadcast((model.word_z, model.char_z, model.net) if model else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        net = Model(*sent.value) if sent.value else None
        for part in parts:
            data, off = bytes_of(part.column(len(keep)))
            high = net.logits(Words(LOWER[data], off, ALNUM)) if net else np.zeros(part.num_rows)
            yield [*part.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(slope * high.astype(np.float64) + intercept, -30, 30))))]

    return with_results(docs, keep, "text", [(score, T.DoubleType())], run)


#: Labelled rows of each class that the fit takes at most, and windows of non-toxic documents that an epoch draws.
PER_CLASS, WINDOWS = 2500, 10_000


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, windows: int = WINDOWS) -> tuple[Model | None, list[float]]:
    learn = crc_mod("doc_id", 5) != 0
    fitted = fit_in_task(labelled_rows(docs, labels, "toxic", learn, per_class), lambda sample: fit_toxicity(sample, windows))
    counts = {r.toxic: r.n for r in labels.where(learn).where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    zero, one = counts.get(0, 0), counts.get(1, 0)
    if fitted[0] and zero and one:  # classes that the bound cut are weighed back
        fitted[1][1] += float(np.log(one / min(one, per_class)) - np.log(zero / min(zero, per_class)))
    return fitted


def op2_toxicity(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS, windows: int = WINDOWS) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, toxicity_model(docs, labels, per_class, windows), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with their columns. Labels and the texts they
    belong to are those of the input folder, so every run of the stage fits the same model."""
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_score")
    return score_toxicity(docs, model, docs.columns, score).where(named(score) < 0.5).select(*map(named, docs.columns))
