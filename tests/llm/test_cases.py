"""Nulls in any column, repeated ids, empty and very long texts, ties, empty tables and clashing names, through every query and stage."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import common, near_dedup, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `odd name` string, `a.b` string, _spans string, _id long, _hit long, _gone long, _score double, score double, spans string, least long, label long, text_ string, _text string"
LABELS = "doc_id long, quality int, toxic int, note string"
PAGES = "page_id long, url string, html string, host string, rule string, `a.b` string"
ITEMS = "item_id long, text string, doc_id long"
WORDS = ["alpha", "beta", "gamma", "delta", "épée", "straße", "naïve", "river", "stone", "cloud", "table", "seven"]


def some(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def texts():
    rng = random.Random(9)
    rows = [(i, some(rng, rng.randrange(2, 120))) for i in range(40)]
    passage, item = some(rng, 70), some(rng, 14)
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, some(rng, 9) + " " + passage), (43, passage + "\n" + some(rng, 4)), (44, some(rng, 20) + " " + item)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "x" * 3000), (54, "same line\n" * 2000), (55, some(rng, 60_000)), (56, "漢字 ☃ ▁ \U0001f600"), (57, "?!")]
    rows += [(60, some(rng, 80)), (60, some(rng, 80)), (60, rows[5][1]), (61, rows[6][1]), (61, rows[6][1]), (None, some(rng, 80)), (None, rows[7][1]), (None, None)]
    return rows, item


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows, item = texts()
    rng = random.Random(2)
    wide = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", None]), rng.choice([5, None]), "o", None, "s", 1, 2, 3, 0.5, 0.25, None, 7, 8, "t", None) for i, t in rows]
    labels = [(i, rng.choice([0, 1]), int(i % 3 == 0), None) for i in range(45)] + [(None, 1, 0, None), (3, None, None, None), (3, 1, 1, None), (999, 1, 1, None)]
    body = "<p>long enough to be a payload of more than a hundred bytes, so that copies of it are told once and referred to</p>"
    pages = [(1, "https://a.net/x", body, "h", "r", None), (2, None, body, None, None, None), (2, None, body, None, None, None), (3, "nothing", None, None, None, None), (4, "http://", "", None, None, None)]
    pages += [(None, "https://example.net/en/1?q", body, None, None, None), (None, None, "short", None, None, None), (5, "ftp://X.ORG/fr/", "y" * 400_000, None, None, None), (0, "z://b.org/fr/z", "short", None, None, None)]
    items = [(1, item, 5), (1, item, 5), (None, "alpha1 beta2", None), (2, None, None), (3, "", None)]
    out = {}
    for name, keep in (("full", True), ("empty", False)):
        d = out[name] = str(tmp_path_factory.mktemp(name))
        for table, data, schema in (("documents", wide, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("benchmark", items, ITEMS)):
            spark.createDataFrame(data if keep else [], schema).write.parquet(f"{d}/{table}.parquet")
    return out


def key(name):
    return "page_id" if name in ("op5_url_filter", "op6_warc") else "doc_id"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_row_has_a_result(spark, folders, name):
    got = queries.QUERIES[name](spark, folders["full"])
    table = spark.read.parquet(f"{folders['full']}/{'pages' if key(name) == 'page_id' else 'documents'}.parquet")
    want = collections.Counter(r[0] for r in table.select(key(name)).collect())
    found = collections.Counter(r[0] for r in (got.where("rank = 1") if "rank" in got.columns else got).select(key(name)).collect())
    assert found == want


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_all_columns(spark, folders, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    got = stage(spark, docs, folders["full"])
    if name != "segmentation":
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all((r["odd name"], r["a.b"], r["_spans"], r["_id"], r["_hit"], r["_gone"], r["_score"], r["score"], r["label"]) == ("o", None, "s", 1, 2, 3, 0.5, 0.25, 8) for r in rows)
        assert sum(r.doc_id is None for r in rows) in (2, 3)  # a row without id goes only for what its own text holds
    empty = stage(spark, docs.limit(0), folders["full"])
    assert empty.count() == 0 and empty.columns == got.columns


# what SQL can't express, through the queries themselves -------------------------------------------
def test_near_dedup_query(spark, folders):
    got = queries.QUERIES["op4_near_dedup"](spark, folders["full"]).collect()
    rows, _ = texts()
    by_text = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            by_text[tuple((t or "").split())].append(i)
    classes = {(r.doc_id, r.class_id) for r in got if r.doc_id is not None}
    for ids in by_text.values():  # copies share a class
        assert {c for i, c in classes if i == ids[0]} & {c for i, c in classes if i == ids[-1]}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) and r.n_links >= 0 for r in got)
    assert all((r.least_like is None) == (r.n_links == 0) and (r.least_like is None or 0.8 <= r.least_like <= 1) for r in got)


def test_near_links_reach_nearly_all_pairs_just_above_the_threshold(spark):
    rng = random.Random(3)
    common.ship(spark)
    rows, pairs = [], []
    for k in range(150):
        base = [f"w{k}x{i}" for i in range(104)]
        other = list(base)
        for at in rng.sample(range(8, 100, 8), rng.choice([1, 2])):
            other[at] = f"new{k}y{at}"
        a, b = ({tuple(t[i : i + 5]) for i in range(100)} for t in (base, other))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append((len(a & b) / len(a | b), 2 * k))
    _, links, _ = near_dedup.near_links(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {min(r.x, r.y): (r.both, r.either) for r in links.collect()}
    close = [i for like, i in pairs if 0.8 <= like < 0.9]
    assert len(close) > 30 and sum(i in found for i in close) >= 0.99 * len(close)
    assert all(abs(found[i][0] / found[i][1] - like) < 1e-9 for like, i in pairs if i in found)
    assert set(found) == {i for like, i in pairs if like >= 0.8} & set(found)


def test_a_large_group_is_searched_in_blocks_and_chunks(spark):
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(60)], []
    for k in range(90):  # a chain: neighbours are alike, ends are not
        t = list(base)
        for at in range(k % 12):
            t[5 * at] = f"n{at}"
        t[-1] = f"own{rng.randrange(30)}"
        rows.append((k, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()}
    old = near_dedup.QUERY_SHINGLES, near_dedup.CHUNK_SHINGLES
    near_dedup.QUERY_SHINGLES, near_dedup.CHUNK_SHINGLES = 150, 400
    try:
        assert {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()} == want
    finally:
        near_dedup.QUERY_SHINGLES, near_dedup.CHUNK_SHINGLES = old


@pytest.mark.parametrize(("name", "modulus", "rest", "least"), [("op2_toxicity", 5, 0, 0.5), ("op3_quality", 4, 2, 0.7)])
def test_scores_and_folds(spark, folders, name, modulus, rest, least):
    for r in queries.QUERIES[name](spark, folders["full"]).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_language_query(spark, folders):
    by = collections.defaultdict(list)
    for r in queries.QUERIES["op8_language"](spark, folders["full"]).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1
        by[r.doc_id].append(r.lang_pred)
    assert all(by[i] == ["und"] for i in (50, 51, 52, 57)) and set(sum(by.values(), [])) <= {"en", "de", "und"}


def test_fingerprint_query(spark, folders):
    rows, _ = texts()
    got = queries.QUERIES["op7_fingerprint"](spark, folders["full"]).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = collections.Counter()
    for k, (known, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        q = len(t) // 4
        want[i if known else None, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_of_texts_of_one_letter():
    from pagelens.llm.fingerprint import fingerprints, likeness

    a, b, c = (fingerprints([b"a" * n]) for n in (65_543, 65_544, 65_000))
    assert likeness(a, b)[0] > 0.99 and likeness(a, c)[0] > 0.99


def test_segmentations_decode_through_the_query(spark, folders):
    rows = queries.QUERIES["op10_segmentations"](spark, folders["full"]).collect()
    assert all(r.exact for r in rows) and max(r["rank"] for r in rows) == 2


def test_warc_copies(spark, folders):
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in queries.QUERIES["op6_warc"](spark, folders["full"]).collect())
    assert got[1, "response", None] == 1 and got[2, "revisit", 1] == 2 and got[None, "revisit", 1] == 1 and got[None, "response", None] == 1 and got[0, "response", None] == 1


def test_toxicity_fit_is_bounded_and_its_own_words_do_not_decide(spark):
    from pagelens.llm.quality import fit_in_task

    common.ship(spark)
    rows = spark.createDataFrame([(i, "w" * 10, i % 2) for i in range(100)], "doc_id long, text string, y int").repartition(7)
    kept = fit_in_task(rows, lambda sample: sample, 300)
    order = {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert [d for d, *_ in kept] == sorted(sorted(order, key=order.get)[:30])
    assert toxicity.fit_toxicity([])[0] is None


# the pipeline, stage by stage against plain Python --------------------------------------------------
def test_pipeline_against_brute_force(spark, folders):
    rng = random.Random(4)
    plain = [(i, some(rng, 90), "en", "s", 1) for i in range(40)]
    passage, item = some(rng, 60), some(rng, 12)
    plain[10] = (10, plain[9][1], "en", "s", 1)
    plain[20] = (20, plain[20][1] + " " + passage, "en", "s", 1)
    plain[21] = (21, some(rng, 30) + " " + passage + " " + some(rng, 30), "en", "s", 1)
    plain[30] = (30, some(rng, 40) + ", " + "".join(c.upper() if c.isascii() else c for c in item) + "!", "en", "s", 1)
    plain[31] = (31, passage, "en", "s", 1)
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    folder = folders["empty"] + "-items"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item, 0)], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    # no labels: no document is toxic; 10 is a copy of 9; 31 is all passage of 20 and 21 loses it; 30 holds an item
    out = corpus_pipeline.run(spark, folder).collect()
    left = {i: t for i, t, *_ in plain if i not in (10, 30, 31)}
    words = plain[21][1].split()
    left[21] = " ".join(words[:30] + words[90:])
    assert {r.doc_id for r in out} == set(left)
    from pagelens.llm import segment

    v = segment.Vocabulary.load()
    again = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    want = {(r.doc_id, r["rank"]): r.pieces_sha256 for r in segment.segmentations(again, v, digest=True).collect()}
    assert {(r.doc_id, r["rank"]): r.pieces_sha256 for r in out} == want
