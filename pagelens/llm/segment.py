"""SentencePiece encoding and decoding with Gumbel top-k segmentations without replacement.

A vocabulary file of a public tokenizer gives the pieces; its path is a parameter, and the
driver reads it and sends the pieces to the tasks. As the vocabulary is one of merges, which
carries ranks and no probabilities, a piece's weight in the lattice is -THETA * log(2 + rank).
A text is escaped as the library does it: one blank in front, blanks as part of the pieces, and
characters that are no piece as their bytes, so that decoding gives the text back exactly.

The lattice of a text is a chain of the lattices of its units (a run of blanks and what follows
it, or a line feed), as no piece holds a blank behind another character or a line feed. A
backward pass gives the mass of all completions of every node. Sampling is a perturbed A-star
search over the tree of segmentations: a set of segmentations with mass m has a Gumbel maximum
with location log m; the best perturbed leaf below a node is reached by following children in
proportion to their masses, and the siblings that are left behind at each step form a set with a
Gumbel maximum truncated at that of their parent. The set with the largest maximum holds the
next sample. So the first k leaves are k distinct segmentations, drawn without replacement, and
the largest maximum that is left is the threshold of the inclusion scores:
log(1 - exp(-exp(log p - threshold))).

Every random number is a hash of the row's key, the sample's rank and the place in the text, so
results don't depend on how rows are dealt out; rows with equal key and text get equal samples.

Cases: a null or empty text has one segmentation, without pieces, of probability 1. A text with
fewer than k segmentations gets them all, with inclusion 1. A null key is a key of its own. An
empty table gives an empty result. Texts of any length are segmented whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelens.llm.common import table
from pagelens.llm.words import BASE, U, blocks, bytes_of, mix, powers, take_spans

MODEL, THETA, K = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 2
#: Bytes of text sampled at once, and edges of units that a task keeps between blocks.
BLOCK, MOST_EDGES = 1 << 18, 600_000


@dataclass
class Vocabulary:
    """Pieces in UTF-8, with blanks for their marks: bytes with offsets, weights, ids of bytes; hashes in order."""

    data: np.ndarray
    offsets: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    hashes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, usable, byte_ids = [], [], np.full(256, -1, np.int32)
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            else:
                raw = piece.replace("▁", " ")
                texts.append(b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else raw.encode())
                if texts[-1]:
                    if " " in raw.lstrip(" ") or "\n" in raw:
                        raise ValueError(f"piece {i} crosses the bounds of units")
                    usable.append(i)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary can't express every byte")
        data, off = bytes_of(pa.array(texts, pa.large_binary()))
        rank = -np.array([sp.get_score(i) for i in range(len(texts))])
        ids = np.array(usable, np.int32)
        h = span_hashes(data, off[ids], off[ids + 1])
        order = np.argsort(h)
        size = np.diff(off)
        return cls(data, off, -THETA * np.log(2 + np.maximum(rank, 0)), byte_ids, -THETA * float(np.log(2 + len(texts))), h[order], ids[order], np.unique(size[ids]))

    def short(self, data: np.ndarray, length: int) -> np.ndarray:
        """The piece of one or two bytes that begins at each byte, -1 for none."""
        if not hasattr(self, "_short"):
            size = self.offsets[self.ids + 1] - self.offsets[self.ids]
            self._short = {l: np.full(1 << 8 * l, -1, np.int32) for l in (1, 2)}
            for l, ids in self._short.items():
                own, at = self.ids[size == l], self.offsets[self.ids[size == l]]
                ids[self.data[at] if l == 1 else self.data[at].astype(np.int32) << 8 | self.data[at + 1]] = own
        if length == 1:
            return self._short[1][data]
        wide = np.append(data, np.uint8(0)).astype(np.int32)
        return self._short[2][wide[:-1] << 8 | wide[1:]]

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By code of three bytes: the lengths from 3 on of the pieces that begin with it, and of those that end with it (bit
        l for length l, the last bit for all longer ones), and the longest of the former."""
        if not hasattr(self, "_ends"):
            code, size = prefix_codes(self.data), self.offsets[self.ids + 1] - self.offsets[self.ids]
            self._ends = np.zeros(1 << 18, U), np.zeros(1 << 18, U), np.zeros(1 << 18, np.int32)
            for l in self.lengths[self.lengths >= 3].tolist():
                at = self.offsets[self.ids[size == l]]
                for table, codes in zip(self._ends, (code[at], code[at + l - 3]), strict=False):
                    table[codes] |= U(1 << min(l, 63))
                self._ends[2][code[at]] = l
        return self._ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes: pieces joined, without the blank in front."""
        return take_spans(self.data, self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]).tobytes()[1:]


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """A code of 18 bits of each byte and the two behind it."""
    wide = np.zeros(len(data) + 2, np.uint32)
    wide[: len(data)] = data
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(BASE, len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    sums = _sums(data) if sums is None else sums
    _, down = powers(BASE, len(data))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


class Lattice:
    """Of distinct units: nodes (unit, byte), edges in the order of their starts with log-probabilities given their
    start, the log of what their start's other edges have, and the share of the start's edges up to this one."""

    ARRAYS = ("length", "piece", "start", "logp", "rest", "share")

    def __init__(self, vocab: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        n = len(data)
        unit = np.repeat(np.arange(len(size)), size)
        left = np.repeat(start + size, size) - np.arange(n)  # bytes to the unit's end
        self.root = start + np.arange(len(size))
        node = (np.arange(n) + unit).astype(np.int32)
        sums, lead = _sums(data), (data & 0xC0) != 0x80
        char = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        bare, begin, length, piece = lead.copy(), [], [], []
        head = prefix_codes(data)
        rest = np.flatnonzero(lead)
        opens, closes, longest = vocab.ends()
        reach = np.minimum(longest[head[rest]], left[rest])
        for l in vocab.lengths[::-1].tolist():  # long pieces first, as they are mostly the likely ones
            if l < 3:
                k = vocab.short(data, l)
                at = np.flatnonzero((k >= 0) & lead & (left >= l))
                found = k[at]
            else:
                at, bit = rest[reach >= l], U(1 << min(l, 63))
                at = at[(opens[head[at]] & bit) > 0]
                at = at[(closes[head[at + l - 3]] & bit) > 0]
                h = span_hashes(data, at, at + l, sums)
                k = np.minimum(np.searchsorted(vocab.hashes, h), len(vocab.hashes) - 1)
                hit = vocab.hashes[k] == h
                at, found = at[hit], vocab.ids[k[hit]]
            if len(at):
                bare[at[char[at] == l]] = False
                begin.append(at)
                length.append(np.full(len(at), l))
                piece.append(found)
        at = np.flatnonzero(bare)  # characters that are no piece
        begin, length, piece = np.concatenate([*begin, at]), np.concatenate([*length, char[at]]), np.concatenate([*piece, np.full(len(at), -1, np.int32)])
        order = np.argsort(begin, kind="stable")
        begin, self.length, self.piece = begin[order], length[order].astype(np.int32), piece[order]
        self.start = node[begin]
        end = self.start + self.length
        weight = np.where(self.piece < 0, vocab.byte_weight * self.length, vocab.weight[self.piece])
        nodes = n + len(size)
        degree = np.bincount(self.start, minlength=nodes)
        self.first = np.append(0, np.cumsum(degree))
        # completion masses, all units at once, from their ends: edges by the bytes to the unit's end
        mass = np.full(nodes, -np.inf)
        mass[self.root + size] = 0
        to_end = left[begin]
        if n and left.max() < 1 << 16:
            to_end = to_end.astype(np.uint16)  # sorted by digits, not by comparisons
        by = np.argsort(to_end, kind="stable")
        cuts = np.flatnonzero(np.r_[True, to_end[by][1:] != to_end[by][:-1]]) if len(by) else np.zeros(0, int)
        for a, b in zip(cuts, np.append(cuts, len(by))[1:], strict=True):
            e = by[a:b]
            x, s = weight[e] + mass[end[e]], self.start[e]
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            top = np.maximum.reduceat(x, new)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                mass[s[new]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(new, len(e))))), new))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.logp = weight + mass[end] - mass[self.start]
            self.logp[np.isnan(self.logp)] = -np.inf
            p = np.exp(self.logp)
            self.rest = np.log(np.where(degree[self.start] == 1, 0, np.maximum(1 - p, 0)))
        total = np.cumsum(p)
        before = np.append(0, total)[self.first[self.start]]
        # the share of a node's edges up to this one
        self.share = np.minimum(total - before, 1)
        self.share[self.first[1:][degree > 0] - 1] = 2
        self.stop = np.zeros(nodes, bool)
        self.stop[self.root + size] = True

    def with_units(self, other: Lattice) -> Lattice:
        """This lattice with the units of another one behind its own."""
        out, nodes, edges = object.__new__(Lattice), len(self.stop), len(self.piece)
        for name in self.ARRAYS:
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name) + (np.int32(nodes) if name == "start" else 0)]))
        out.root = np.concatenate([self.root, other.root + nodes])
        out.first = np.concatenate([self.first, other.first[1:] + edges])
        out.stop = np.concatenate([self.stop, other.stop])
        return out

    def walk(self, node: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its unit's end, drawn by their masses, and how many of each walker.
        key: the walker's random key; place: where in the text it begins."""
        steps, who = [], np.flatnonzero(~self.stop[node])
        at, where, count = node[who], place[who], np.zeros(len(node), np.int64)
        while len(who):
            u = uniform(key[who], where)
            e = self.first[at]
            on = np.flatnonzero(self.share[e] < u)
            while len(on):
                e[on] += 1
                on = on[self.share[e[on]] < u[on]]
            steps.append((who, e))
            count[who] += 1
            at, where = self.start[e] + self.length[e], where + self.length[e]
            going = ~self.stop[at]
            who, at, where = who[going], at[going], where[going]
        out = np.empty(int(count.sum()), np.int32)
        base = np.cumsum(count) - count
        for k, (w, e) in enumerate(steps):
            out[base[w] + k] = e
        return out, count


class Units:
    """The lattices of the units that a task has met so far, up to `most` edges; those of other units are made for a block and dropped."""

    def __init__(self, vocab: Vocabulary, most: int = MOST_EDGES):
        self.vocab, self.most = vocab, most
        self.lattice = Lattice(vocab, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.hashes, self.numbers = np.zeros(0, U), np.zeros(0, np.int64)

    def lattice_of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice that holds all these units, and the number of each in it."""
        h, example, kind, seen = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True, return_counts=True)
        number = np.full(len(h), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            number = np.where(self.hashes[at] == h, self.numbers[at], -1)
        lattice, fresh = self.lattice, number < 0
        for again in (True, False):  # units that a block repeats are worth keeping
            new = np.flatnonzero(fresh & ((seen > 1) == again))
            if not len(new):
                continue
            number[new] = len(lattice.root) + np.arange(len(new))
            length = (end - begin)[example[new]]
            lattice = lattice.with_units(Lattice(self.vocab, take_spans(data, begin[example[new]], length), np.cumsum(length) - length, length))
            if again and len(lattice.piece) <= self.most:
                self.lattice, hashes = lattice, np.concatenate([self.hashes, h[new]])
                order = np.argsort(hashes)
                self.hashes, self.numbers = hashes[order], np.concatenate([self.numbers, number[new]])[order]
        return lattice, number[kind]


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In (0, 1), by key and place."""
    return ((mix(key ^ (place.astype(U) * U(0xD6E8FEB86659FD93))) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def truncated(location: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with these locations, given that they are below the bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (length[i] numbers) for all i, joined."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


@dataclass
class Paths:
    """The r-th samples of a block: steps bounds[i] .. bounds[i + 1] are text i's, none where it has no such sample.

    Of each step its edge, the log mass before it, and the Gumbel maximum of its siblings; steps that a path shares with the
    one it left have none, as their siblings stay with that one. value: the perturbed log p of each text's sample."""

    edges: np.ndarray
    bounds: np.ndarray
    prefix: np.ndarray
    z: np.ndarray
    value: np.ndarray

    def settle(self) -> None:
        """The largest maximum of each text (top) and its first step (at)."""
        many = np.diff(self.bounds)
        some = np.flatnonzero(many)
        self.top, self.at = np.full(len(many), -np.inf), np.zeros(len(many), np.int64)
        if len(some):
            self.top[some] = np.maximum.reduceat(self.z, self.bounds[some])
            hit = np.flatnonzero(self.z == np.repeat(self.top, many))[::-1]
            self.at[np.searchsorted(self.bounds, hit, "right") - 1] = hit


class Sampler:
    """Samples of a block of texts (bytes with offsets)."""

    def __init__(self, units: Units, data: np.ndarray, off: np.ndarray):
        self.vocab, size = units.vocab, np.diff(off)
        self.some = np.flatnonzero(size)
        size = size[self.some] + 1
        self.off = np.append(0, np.cumsum(size))
        self.data = d = np.full(int(self.off[-1]), 0x20, np.uint8)
        inside = np.ones(len(d), bool)
        inside[self.off[:-1]] = False
        d[inside] = data
        begins = np.zeros(len(d), bool)
        if len(d):
            before = np.r_[np.uint8(0x0A), d[:-1]]
            begins = ((d == 0x20) & (before != 0x20)) | (d == 0x0A) | (before == 0x0A)
            begins[self.off[:-1]] = True
        self.unit = np.flatnonzero(begins)
        self.lattice, self.kind = units.lattice_of(d, self.unit, np.append(self.unit[1:], len(d)))
        self.first = np.searchsorted(self.unit, self.off)  # first unit of each text
        self.unit_row = np.repeat(np.arange(len(self.some)), np.diff(self.first))

    def run(self, seeds: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
        """The first to k-th samples of the texts with bytes, and each text's threshold of inclusion."""
        lat, n = self.lattice, len(self.some)
        seeds = seeds[self.some]
        key = lambda r, use: mix(seeds + U(2 * r + use))
        edges, count = lat.walk(lat.root[self.kind], key(0, 0)[self.unit_row], self.unit - self.off[self.unit_row])
        bounds = np.append(0, np.cumsum(count))[self.first]
        best = -np.log(-np.log(uniform(key(0, 1), np.zeros(n, np.int64))))
        paths = [Paths(edges, bounds, *self.siblings(edges, bounds, np.zeros(n), best, key(0, 1)), best)]
        paths[0].settle()
        used: list[dict[int, list[int]]] = [{}]  # by path and step: edges of earlier samples, the path's own apart
        for r in range(1, k):
            tops = np.stack([p.top for p in paths])
            chosen = np.argmax(tops, axis=0)
            value = tops[chosen, np.arange(n)]
            live = np.flatnonzero(np.isfinite(value))
            if not len(live):
                break
            old = [live[chosen[live] == j] for j in range(r)]  # the texts whose next sample leaves path j
            own = [paths[j].at[x] for j, x in enumerate(old)]
            order = np.argsort(np.concatenate(old), kind="stable")
            joined = lambda parts: np.concatenate(parts)[order]
            step, base = joined(own), joined([paths[j].bounds[x] for j, x in enumerate(old)])
            path_of = joined([np.full(len(x), j) for j, x in enumerate(old)])
            left = joined([paths[j].edges[x] for j, x in enumerate(own)])
            before = joined([paths[j].prefix[x] for j, x in enumerate(own)])
            # the sibling that leads to the next sample: one row a text, its node's edges that no sample took
            a = lat.first[lat.start[left]]
            degree = lat.first[lat.start[left] + 1] - a
            edge = a[:, None] + np.arange(int(degree.max()))
            inside = edge < (a + degree)[:, None]
            mass = np.where(inside & (edge != left[:, None]), np.exp(lat.logp[np.where(inside, edge, a[:, None])]), 0)
            taken = np.ones(len(live), np.int64)
            for j in range(r):
                for x in np.flatnonzero(path_of == j) if used[j] else ():
                    gone = used[j].get(int(step[x]), [])
                    mass[x, np.array(gone, np.int64) - a[x]] = 0
                    taken[x] += len(gone)
            total = np.cumsum(mass, axis=1)
            u = uniform(key(r, 0)[live], np.full(len(live), -1))
            last = mass.shape[1] - 1 - np.argmax(mass[:, ::-1] > 0, axis=1)
            fresh = np.minimum((total <= (u * total[:, -1])[:, None]).sum(1), last)
            rest = mass.sum(1) - mass[np.arange(len(live)), fresh]
            fresh += a
            again = uniform(key(r, 1)[live], np.full(len(live), -2))
            with np.errstate(divide="ignore"):
                z = truncated(before + np.log(rest), value[live], again)
            z[(taken + 1 >= degree) | (rest <= 0)] = -np.inf
            for j in range(r):
                x = np.flatnonzero(path_of == j)
                if len(x):
                    paths[j].z[step[x]] = z[x]
                    paths[j].settle()
                    if r + 1 < k:
                        for t, e in zip(step[x].tolist(), fresh[x].tolist(), strict=True):
                            used[j].setdefault(t, []).append(e)
            # walkers: the rest of the unit, then the units behind it
            kept = step - base
            heads = [ragged(paths[j].bounds[x], y - paths[j].bounds[x]) for j, (x, y) in enumerate(zip(old, own, strict=True))]
            shared = np.concatenate([paths[j].edges[x] for j, x in enumerate(heads)])
            rows = np.repeat(np.argsort(order), kept[np.argsort(order)])  # of `shared`, which is in the order of `old`
            where = np.bincount(rows, lat.length[shared], minlength=len(live)).astype(np.int64)
            at = self.off[live] + where
            unit = np.searchsorted(self.unit, at, "right") - 1
            many = self.first[live + 1] - unit
            walker = ragged(unit, many)
            node, place = lat.root[self.kind[walker]], self.unit[walker] - np.repeat(self.off[live], many)
            front = np.cumsum(many) - many
            node[front], place[front] = lat.start[fresh] + lat.length[fresh], where + lat.length[fresh]
            new, count = lat.walk(node, np.repeat(key(r, 0)[live], many), place)
            ends = np.append(0, np.cumsum(count))[np.append(front, len(walker))]
            # the new steps' siblings: their prefix begins behind the chosen one
            prefix, z = self.siblings(new, ends, before + lat.logp[fresh], value[live], key(r, 1)[live])
            size = np.zeros(n, np.int64)
            size[live] = kept + 1 + np.diff(ends)
            bounds = np.append(0, np.cumsum(size))
            path = Paths(np.empty(bounds[-1], np.int32), bounds, np.full(bounds[-1], -np.inf), np.full(bounds[-1], -np.inf), np.where(np.isfinite(value), value, np.nan))
            begin = bounds[live]
            path.edges[ragged(begin, kept)] = shared[np.argsort(rows, kind="stable")]
            path.edges[begin + kept] = fresh
            tail = ragged(begin + kept + 1, np.diff(ends))
            path.edges[tail], path.prefix[tail], path.z[tail] = new, prefix, z
            path.settle()
            paths.append(path)
            used.append({})
        return paths, np.max(np.stack([p.top for p in paths]), axis=0) if n else np.zeros(0)

    def siblings(self, edges: np.ndarray, bounds: np.ndarray, start: np.ndarray, bound: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text's steps: the log mass before them and their siblings' Gumbel maxima."""
        many = np.diff(bounds)
        logp = self.lattice.logp[edges]
        total = np.cumsum(logp)
        origin = np.append(0, total)[bounds[:-1]]
        prefix = total - logp - np.repeat(origin - start, many)
        step = np.arange(len(edges)) - np.repeat(bounds[:-1], many)
        z = np.full(len(edges), -np.inf)
        some = np.flatnonzero(np.isfinite(rest := self.lattice.rest[edges]))
        row = np.repeat(np.arange(len(many)), many)[some]
        z[some] = truncated(prefix[some] + rest[some], bound[row], uniform(key[row], step[some] + 1))
        return prefix, z

    def ids(self, path: Paths) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of the paths, and their bounds."""
        lat, text = self.lattice, np.repeat(np.arange(len(path.bounds) - 1), np.diff(path.bounds))
        piece, length = lat.piece[path.edges], lat.length[path.edges]
        raw = np.flatnonzero(piece < 0)
        if not len(raw):
            return piece, path.bounds
        size = np.ones(len(piece), np.int64)
        size[raw] = length[raw]
        ends = np.append(0, np.cumsum(length))
        where = ends[raw] - ends[path.bounds[text[raw]]] + self.off[text[raw]]
        out = np.repeat(piece, size)
        out[out < 0] = self.vocab.byte_ids[take_spans(self.data, where, size[raw])]
        return out, np.append(0, np.cumsum(size))[path.bounds]

    def exact(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether decoding gives each text back (true for texts without such a sample)."""
        begin, size = self.vocab.offsets[ids], self.vocab.offsets[ids + 1] - self.vocab.offsets[ids]
        ends = np.append(0, np.cumsum(size))[bounds]
        there = np.diff(bounds) > 0
        same = ~there | (np.diff(ends) == np.diff(self.off))
        # the bytes of texts whose lengths agree are compared
        text = np.flatnonzero(there & same)
        got = take_spans(self.vocab.data, begin, size)
        length = np.diff(self.off)[text]
        differ = take_spans(got, ends[text], length) != take_spans(self.data, self.off[text], length)
        same[np.repeat(text, length)[differ]] = False
        return same


def log_inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log P(perturbed log p > threshold)."""
    x = np.where(np.isfinite(threshold), logp - threshold, np.inf)
    rate = np.exp(np.minimum(x, 700.0))
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(threshold), np.where(rate > 1e-12, np.log(-np.expm1(-rate)), x), 0.0)


def sample_block(units: Units, keys: np.ndarray, column: pa.Array, k: int) -> dict[str, np.ndarray | list[np.ndarray]]:
    """Of every sample, by row and rank: row, rank, ids, log_prob, perturbed, log_inclusion and exact (decoding gives the text back)."""
    data, off = bytes_of(column)
    empty = np.flatnonzero(np.diff(off) == 0)
    s = Sampler(units, data, off)
    paths, threshold = s.run(keys, k)
    first = -np.log(-np.log(uniform(keys[empty], np.zeros(len(empty), np.int64))))
    parts = [(empty, np.ones(len(empty), np.int32), np.zeros(len(empty)), first, np.zeros(len(empty)), np.ones(len(empty), bool))]
    ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(empty)
    for rank, path in enumerate(paths, 1):
        has = np.flatnonzero(np.diff(path.bounds))
        own, bounds = s.ids(path)
        logp = np.add.reduceat(s.lattice.logp[path.edges], path.bounds[has]) if len(has) else np.zeros(0)
        parts.append((s.some[has], np.full(len(has), rank, np.int32), logp, path.value[has], log_inclusion(logp, threshold[has]), s.exact(own, bounds)[has]))
        ids += [own[a:b] for a, b in zip(bounds[has].tolist(), bounds[has + 1].tolist(), strict=True)]
    row, rank, logp, perturbed, inclusion, exact = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((rank, row))
    return {
        "row": row[order], "rank": rank[order], "ids": [ids[i] for i in order.tolist()], "log_prob": logp[order], "perturbed": perturbed[order],
        "log_inclusion": inclusion[order], "exact": exact[order],
    }


def seeds_of(ids: pa.Array) -> np.ndarray:
    """A random key by row key."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U) * U(2) + known.astype(U))


def segmentations(docs: DataFrame, vocab: Vocabulary, k: int = K, digest: bool = False) -> DataFrame:
    """doc_id, rank, n_pieces, ids (array<int>; with `digest` their SHA-256 as little-endian 32-bit numbers instead),
    log_prob, perturbed, log_inclusion and exact (decoding gives the text back)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    name, kind = ("pieces_sha256", "string") if digest else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(sent.value)
        for part in blocks(batches, "text", BLOCK):
            found = sample_block(units, seeds_of(part.column(0)), part.column(1), k)
            ids = found["ids"]
            if digest:
                out = pa.array([hashlib.sha256(x.astype("<i4", copy=False)).hexdigest() for x in ids], pa.string())
            else:
                out = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(found["row"])), pa.array(found["rank"]), pa.array([len(x) for x in ids], pa.int64()), out,
                 *(pa.array(found[c]) for c in ("log_prob", "perturbed", "log_inclusion", "exact"))],
                ["doc_id", "rank", "n_pieces", name, "log_prob", "perturbed", "log_inclusion", "exact"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, rank int, n_pieces long, {name} {kind}, log_prob double, perturbed double, log_inclusion double, exact boolean")


def op10_segmentations(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return segmentations(table(spark, sf_dir, "documents"), Vocabulary.load(model), K, digest=True)


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The segmentations of every document, as operator 10 returns them."""
    return segmentations(docs, Vocabulary.load(MODEL), K, digest=True)
