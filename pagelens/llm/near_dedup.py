"""MinHash near-dedup over word multisets by BagMinHash.

A text is the multiset of its five-word shingles (a text of one to four words is one shingle).
Weights are the counts, discretised in unit levels. For every shingle, Poisson processes run over
dyadic blocks of levels [0,1), [1,2), [2,4), [4,8) ...: a block of size 2^j has points of that
rate in every one of M slots; a point falls on one level of its block and counts when the text's
weight is above that level. A slot's signature is the first point of all shingles that counts. So two texts
agree in a slot with probability equal to their weighted Jaccard likeness, and a text of n
shingles needs about M log M + n points, not M n.

1. Sketches of every text: a hash of the multiset, its size, and BANDS bands of ROWS slots.
2. Texts with equal multisets are one class at once, by an aggregate; only the one with the
   smallest id goes on. So groups of exact copies have no weight below.
3. Bands that hold one text are dropped. In each other band the text whose bands are the fullest
   (the least edited one of a group) is the hub; all texts of the hub's bands are compared with it.
   Texts whose sizes rule out a likeness of 0.8 are left out first, which loses nothing.
4. Components of these links are found by label passing. A band of three texts or more that still
   holds several components has pairs that nobody compared: the texts outside its largest component
   are queries against all texts of the band. Bands with the same largest component are one group,
   so a text is sent once however many bands it shares.
5. A group's queries are dealt out in blocks of QUERY_SHINGLES and its texts in chunks of
   CHUNK_SHINGLES, by block and chunk; each task holds one block in an inverted index and streams
   the chunk past it, so no task grows with a group, nothing passes through the driver, and
   pairs exist only as counts in a task. Overlaps of multisets are exact.

A link needs a weighted Jaccard likeness of 0.8 at least; texts at 0.8 share a band with
probability 1 - (1 - 0.8^ROWS)^BANDS = 0.99997, and every pair that shares a band is compared
unless it is already in one component. Classes are components of links; class_id is the
smallest doc_id in it.

Cases: null and empty texts have the empty multiset and are copies of each other. Rows that
share a doc_id are one document, linked by any of its texts; each row has the class of its
own text. A row with a null doc_id is its own class (class_id null, kept). Ties between equal
texts are broken by the smallest id. Empty tables give empty results; other columns are
carried by the stage only, under any name. Long texts are sketched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import free_name, named, stored, table
from pagelens.llm.words import GRAM, SPACED, U, Words, blocks, bytes_of, mix, spans_of, sums_of

SHINGLE, ROWS, BANDS = 5, 4, 20
M = ROWS * BANDS
#: The least likeness of a link, as a fraction.
LIKE = 4, 5
#: Shingles of a block of queries and of a chunk of texts.
QUERY_SHINGLES, CHUNK_SHINGLES = 400_000, 4_000_000


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle."""
    h = words.hashes()
    sums = sums_of(h)
    many = np.where(words.count >= SHINGLE, words.count - SHINGLE + 1, np.minimum(words.count, 1))
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + words.first[row]
    return row, spans_of(sums, at, np.minimum(at + SHINGLE, words.first[row + 1]))


def multisets(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of distinct shingles, by row."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, h = row[order], h[order]
    begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, int)
    return row[begin], h[begin], np.diff(np.append(begin, len(h)))


def bag_signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """(rows, M) ids of the first points; zeros for rows without shingles."""
    # one process for each shingle and dyadic block of levels below its count
    part, who, floor, size = [h], [np.arange(len(h))], [np.zeros(len(h), np.int64)], [np.ones(len(h), np.int64)]
    low = 1
    while len(more := np.flatnonzero(count > low)):
        part.append(mix(h[more] + U(low * GRAM % (1 << 64))))
        who.append(more)
        floor.append(np.full(len(more), low))
        size.append(np.full(len(more), low))
        low *= 2
    part, who, floor, size = (np.concatenate(x) for x in (part, who, floor, size))
    owner, weight = row[who], count[who]
    total = np.bincount(row, count, minlength=rows)
    limit = (np.log(M) + 4) / np.maximum(total, 1)
    first, ids = np.full(rows * M, np.inf), np.zeros(rows * M, U)
    need = total > 0
    while need.any():
        on = np.flatnonzero(need[owner])
        times, keys, names = [], [], []
        t, k = np.zeros(len(on)), 0
        while len(on):
            name = mix(part[on] + U(k * 0xA0761D6478BD642F % (1 << 64)))
            t = t - np.log(((name >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / (M * size[on])
            here = t <= limit[owner[on]]
            on, t, name = on[here], t[here], name[here]
            spot = mix(name + U(1))
            level = floor[on] + ((spot >> U(40)).astype(np.int64) * size[on] >> 24)
            counts = level < weight[on]
            times.append(t[counts])
            keys.append(owner[on[counts]] * M + (spot[counts] & U(0xFFFFFFFF)).astype(np.int64) % M)
            names.append(name[counts])
            k += 1
        times, keys, names = (np.concatenate(x) for x in (times, keys, names))
        np.minimum.at(first, keys, times)
        winner = times == first[keys]
        ids[keys[winner]] = names[winner]
        need &= np.isinf(first.reshape(rows, M)).any(1)
        limit = np.where(need, limit * 4, limit)
    return ids.reshape(rows, M)


SKETCH = "doc_id long, h1 long, h2 long, n long, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """A sketch of every row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            words, n = Words(*bytes_of(part.column(1)), SPACED), part.num_rows
            row, h, count = multisets(*shingles_of(words))
            sig = bag_signatures(row, h, count, n)
            sums = np.zeros((2, n), U)
            for k in range(2):
                np.add.at(sums[k], row, mix(h + U(k + 7)) * count.astype(U))
            band = np.zeros((n, BANDS), U)
            for k in range(ROWS):
                band = mix(band + sig[:, k::ROWS] + U(k))
            band = mix(band + np.arange(BANDS, dtype=U) * U(GRAM))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
            size = np.bincount(row, count, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(size), lists], ["doc_id", "h1", "h2", "n", "bands"]
            )

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set: sorted hashes of (shingle, occurrence), whose plain Jaccard likeness is that of the multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            words = Words(*bytes_of(part.column(1)), SPACED)
            row, h, count = multisets(*shingles_of(words))
            again = np.repeat(np.arange(len(h)), count)
            k = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
            items, row = mix(h[again] + k.astype(U) * U(GRAM)), row[again]
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.sort(items[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "set"])

    # both sides are dealt by doc_id at any size: the ids are a share of the corpus, which no broadcast may hold
    texts = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return texts.mapInArrow(run, "doc_id long, set binary")


class Block:
    """Sets of queries in an inverted index."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.docs, self.labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.size = np.array([len(r[2]) // 8 for r in rows])
        items = np.frombuffer(b"".join(r[2] for r in rows), U)
        order = np.argsort(items, kind="stable")
        self.items, self.owner = items[order], np.repeat(np.arange(len(rows)), self.size)[order]

    def overlaps(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries that are alike enough to a sorted set, and how many items each has in common with it."""
        a, b = np.searchsorted(self.items, own, "left"), np.searchsorted(self.items, own, "right")
        many = b - a
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.docs))
        found = np.flatnonzero((LIKE[1] * both >= LIKE[0] * (self.size + len(own) - both)) & (both > 0))
        return found, both[found]


LINK = "x long, y long, both long, either long, label_x long, label_y long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between queries and texts from rows (key, query, doc_id, label, set) in the order of key, queries first. Of links
    between the same components a key keeps those that join them for the first time."""
    key, held, index, root = None, [], None, {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    for batch in batches:
        out: list[list[int]] = [[] for _ in range(6)]
        for own_key, query, doc_id, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_key != key:
                key, held, index, root = own_key, [], None, {}
            if query:
                held.append((doc_id, label, raw))
                continue
            if index is None:
                index = Block(held)
            own = np.frombuffer(raw, U)
            for i, both in zip(*index.overlaps(own), strict=True):
                other = int(index.labels[i])
                p, q = find(label), find(other)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    for column, value in zip(out, (doc_id, int(index.docs[i]), int(both), int(index.size[i] + len(own) - both), label, other), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["x", "y", "both", "either", "label_x", "label_y"])


def links_of(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the queries of a group and any text of it that is in another component.
    groups: g, doc_id, label, n (shingles), query; a query is a text of the group too."""
    spark = groups.sparkSession
    parts = groups.groupBy("g").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("query"), F.col("n"))).alias("asked"))
    parts = parts.select("g", F.ceil((F.col("all") + 1) / CHUNK_SHINGLES).cast("int").alias("chunks"), F.ceil((F.col("asked") + 1) / QUERY_SHINGLES).cast("int").alias("blocks"))
    parts = stored(spark, parts, "parts")
    told = groups.join(parts, "g")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = told.select("g", "doc_id", "label", F.lit(False).alias("query"), spot("chunks").alias("chunk"), F.explode(every("blocks")).alias("block"))
    asked = told.where("query").select("g", "doc_id", "label", "query", F.explode(every("chunks")).alias("chunk"), spot("blocks").alias("block"))
    both = rows.unionByName(asked).join(sets, "doc_id")
    keyed = both.select(F.concat_ws("/", "g", "chunk", "block").alias("key"), "query", "doc_id", "label", "set")
    return keyed.repartition("key").sortWithinPartitions("key", F.desc("query"), "doc_id").mapInArrow(_search, LINK)


def components(links: DataFrame) -> DataFrame:
    """v and label, the smallest vertex of its component, of every vertex of the links (x, y)."""
    spark = links.sparkSession
    both = stored(spark, links.select(F.col("x").alias("v"), F.col("y").alias("w")).unionByName(links.select(F.col("y").alias("v"), F.col("x").alias("w"))), "edges")
    labels = stored(spark, both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("l")), "w").groupBy("v").agg(F.min("l").alias("l"))
        near = labels.join(heard, "v").select("v", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # a label's own label is nearer to the root still
        jump = near.join(labels.select(F.col("v").alias("label"), F.col("label").alias("up")), "label", "left")
        new = stored(spark, jump.select("v", "old", F.coalesce(F.least("label", "up"), "label").alias("label")), "labels")
        if new.where("label < old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def hub_groups(members: DataFrame) -> DataFrame:
    """A group for each hub, from members (band, doc_id, n, texts in the band): the hub, and every text of its bands whose size allows a link."""
    central = members.groupBy("doc_id").agg(F.sum(F.log("texts")).alias("central"))
    best = F.max(F.struct("central", (-F.col("doc_id")).alias("low"), "n"))
    hubs = members.join(central, "doc_id").groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.low")).alias("g"), F.col("best.n").alias("hub_n"))
    hubs = stored(members.sparkSession, hubs, "hubs")
    near = members.join(hubs, "band").where(F.least("n", "hub_n") * LIKE[1] >= F.greatest("n", "hub_n") * LIKE[0])
    return near.select("g", "doc_id", F.col("doc_id").alias("label"), "n", (F.col("doc_id") == F.col("g")).alias("query")).distinct()


def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of bands with several components: queries are the texts outside the band's largest component, whose label is the group."""
    told = members.where("texts > 2").join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left")
    told = stored(members.sparkSession, told.select("band", "doc_id", "n", F.coalesce("label", "doc_id").alias("label")), "told")
    mains = told.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("g"), F.count("*").alias("labels"))
    mains = stored(members.sparkSession, mains.where("labels > 1").select("band", "g"), "mains")
    return told.join(mains, "band").select("g", "doc_id", "label", "n", (F.col("label") != F.col("g")).alias("query")).distinct()


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What near-duplicates are made of, as stored tables: every row's class of equal texts (doc_id, first), the verified links
    between first documents of such classes (x, y, both, either: shingles in common and in all), and labels (v, label) of these."""
    spark = docs.sparkSession
    sketches = stored(spark, sketch(docs), "sketches")
    copies = stored(spark, sketches.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "copies")
    one = sketches.join(copies.withColumnRenamed("first", "doc_id"), ["h1", "h2", "doc_id"], "left_semi")
    bands = one.select("doc_id", "n", F.explode("bands").alias("band"))
    shared = stored(spark, bands.groupBy("band").agg(F.count("*").alias("texts"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("band", "texts"), "shared")
    members = stored(spark, bands.join(shared, "band"), "members")
    sets = stored(spark, shingle_sets(docs, members.select("doc_id").distinct()), "sets")
    links = stored(spark, links_of(stored(spark, hub_groups(members), "hub-groups"), sets), "links")
    labels = components(links)
    more = stored(spark, links_of(stored(spark, open_groups(members, labels), "open-groups"), sets), "links")
    # components of components; a text without a link so far is one of its own
    joined = components(more.select(F.col("label_x").alias("x"), F.col("label_y").alias("y"))).toDF("old", "new")
    labels = labels.join(joined, labels["label"] == joined["old"], "full_outer").select(F.coalesce("v", "old").alias("v"), F.coalesce("new", "label").alias("label"))
    classes = sketches.select("doc_id", "h1", "h2").join(copies, ["h1", "h2"]).select("doc_id", "first")
    return classes, links.unionByName(more).select("x", "y", "both", "either"), stored(spark, labels, "labels")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row with a doc_id."""
    classes, _, labels = near_links(docs)
    return classes.join(labels.withColumnRenamed("v", "first"), "first", "left").select("doc_id", F.coalesce("label", "first").alias("class_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept, n_links (verified links of the document's text) and least_like (the least likeness among these, null without)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes, links, labels = near_links(docs)
    like = F.col("both") / F.col("either")
    ends = links.select(F.col("x").alias("first"), like.alias("like")).unionByName(links.select(F.col("y").alias("first"), like.alias("like")))
    linked = ends.groupBy("first").agg(F.count("*").alias("n_links"), F.min("like").alias("least_like"))
    told = stored(spark, labels.withColumnRenamed("v", "first").join(linked, "first", "left"), "linked")
    found = classes.join(told, "first", "left").select("doc_id", F.coalesce("label", "first").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "least_like")
    alone = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("least_like"))
    out = found.unionByName(alone)
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "n_links", "least_like")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id, with its columns."""
    name = free_name(docs.columns, "_gone")
    gone = near_classes(docs).where("doc_id != class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stored(spark, gone, "gone"), docs["doc_id"] == named(name), "left_anti")
