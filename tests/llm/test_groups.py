"""Joins and deduplication against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from llm_corpus import corpus
from tidewheel.llm import op3_jaccard, op4_substrings, op5_digest, op6_embeddings
from tidewheel.llm.components import components


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def split(text):
    return (text or "").encode().split()


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("chunk", [500_000, 30, 2])
def test_components(spark, monkeypatch, chunk):
    from tidewheel.llm import components as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    r = random.Random(2)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(50)], [(3, 3)], []):
        got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = closure({n for e in edges for n in e}, edges)
        assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (2, 6, 10)])
def test_jaccard_join(spark, documents, width, num, den):
    texts = corpus(width, 90)
    got = {r["doc_id"]: r for r in op3_jaccard.clusters(documents(texts), width=width, num=num, den=den).collect()}
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    assert {i: (len(s), want[i]) for i, s in enumerate(sets)} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def jaccard_links(texts, width=3, num=90, den=100):
    sets = [shingles(t, width) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]


def edited(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell, edits", [(8, 1), (8, 2), (4, 3), (2048, 2)])
def test_jaccard_large_group(spark, documents, monkeypatch, cell, edits):
    """Near copies in buckets and groups that are cut, some of which link through others only, or not at all."""
    monkeypatch.setattr(op3_jaccard, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(op3_jaccard, "CELL_BLOCK", cell)
    monkeypatch.setattr(op3_jaccard, "SHARED", 2)
    monkeypatch.setattr(op3_jaccard, "HELD", 40)
    r = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = edited(r, base, 70, edits) + edited(r, base[:40] + [f"c{i}" for i in range(40)], 30, edits)
    got = op3_jaccard.clusters(documents(texts)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == closure(range(100), jaccard_links(texts))


def test_jaccard_rows_of_buckets_grow_with_the_group(spark, documents):
    """Twice the near copies, about twice the rows of buckets."""
    base, rows = " ".join(f"b{i}" for i in range(60)), {}
    for n in (1500, 3000, 6000):
        docs = op3_jaccard.identified(documents([f"{base} x{i}" for i in range(n)]))
        rows[n] = op3_jaccard._buckets(op3_jaccard._meetings(docs, 3, op3_jaccard.Threshold(90, 100), 4), 4).count()
    assert rows[6000] < 2.2 * rows[3000] < 2.2 * 2.2 * rows[1500]


def test_jaccard_ids_that_are_null_or_shared(spark, documents):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    texts = [a, a + " z", b, b, c, None, "", c + " z", a, "z"]
    ids = [None, 4, 4, 9, None, None, 4, 4, None, None]
    got = [tuple(r) for r in op3_jaccard.clusters(documents(texts, ids)).collect()]
    want = [(None, 38, 4), (4, 39, 4), (4, 38, 4), (9, 38, 4), (None, 38, 4), (None, 0, None), (4, 0, 4), (4, 39, 4), (None, 38, 4), (None, 1, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op3_jaccard.clusters(documents([])).count() == 0


def test_threshold_parts_are_enough():
    for num, den in ((90, 100), (8, 10), (1, 2)):
        t = op3_jaccard.Threshold(num, den)
        for k in range(15):
            low, high, parts, spare = t.class_at(k)
            most = 2 * high * (den - num) // (den + num)
            assert parts - spare > most and t.class_at(k + 1)[0] == high + 1
            assert t.class_at(k + 2)[0] * num > high * den  # no link skips a class
        assert t.classes(np.array([1, 2, 9, 10, 500])).tolist() == sorted(t.classes(np.array([1, 2, 9, 10, 500])).tolist())


def test_count_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(4)
    v = rng.poisson(3, (300, op3_jaccard.GROUPS))
    v[150:] = np.maximum(0, v[:150] + rng.integers(-1, 2, (150, op3_jaccard.GROUPS)) * (rng.random((150, op3_jaccard.GROUPS)) < 0.1))
    sizes, t = v.sum(axis=1), op3_jaccard.Threshold(90, 100)
    got = {tuple(sorted((int(a), int(b)))) for i, j in op3_jaccard.CountTree(v, sizes).pairs(t) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if t.holds(int(np.minimum(v[i], v[j]).sum()), int(sizes[i] + sizes[j]))}
    assert got == want and len(want) > 50


def repeats(rows, window=20):
    """Words kept and numbers removed, by all windows; rows: (order, words)."""
    first, out = {}, {}
    for order, w in sorted(rows):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (order, i)) != (order, i):
                gone[i : i + window] = [True] * window
        out[order] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def test_substrings(spark, documents):
    texts = corpus(7, 120) + ["x " * 100, "y z " * 45, " ".join(f"q{i % 37}" for i in range(400))]
    got = {r["doc_id"]: r for r in op4_substrings.digests(documents(texts)).collect()}
    want = repeats([(i, split(t)) for i, t in enumerate(texts)])
    assert any(len(want[i]) < len(split(t)) for i, t in enumerate(texts))
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(split(t)), len(split(t)) - len(want[i]))
        assert got[i]["kept_sha256"] == hashlib.sha256(b" ".join(want[i])).hexdigest()


def test_substrings_at_any_alignment(spark, documents):
    r = random.Random(5)
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join([f"{k}a{r.random()}" for _ in range(k)] + passage + [f"{k}b"]) for k in range(40)]
    got = op4_substrings.digests(documents(texts)).collect()
    assert sorted(x["n_removed"] for x in got) == [0] + [20] * 39


def test_substrings_ties_and_nulls(spark, documents):
    a, b = " ".join(f"a{i}" for i in range(25)), " ".join(f"b{i}" for i in range(25))
    rows = op4_substrings.remove_repeats(documents([a, a, b, a + " c", None, b], [5, None, 1, 5, 9, 1]))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"], r["text"]) for r in rows.collect())
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed"]
    assert [x[2] for x in got] == [0, 0, 0, 25, 25, 0] and (True, 1, 0, b) in got  # the null id is first; equal rows are one document
    assert op4_substrings.digests(documents([])).count() == 0
    with pytest.raises(ValueError):
        op4_substrings.remove_repeats(documents([a]), window=12)


def test_substrings_of_shared_ids_and_odd_columns(spark, documents):
    """Rows of one id or none are documents of their own; columns with dots and names of the operator's own stay."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    passages = [" ".join(f"p{k}_{i}" for i in range(25)) for k in range(6)]
    texts = [" ".join([f"u{k}{i}" for i in range(r.randint(0, 30))] + [r.choice(passages)]) for k in range(60)]
    ids = [r.choice([None, None, 4, k]) for k in range(60)]
    docs = documents(texts, ids).withColumn("meta.url", F.lit("u")).withColumn("key", F.col("doc_id")).withColumn("bucket", F.lit("b"))
    rows = op4_substrings.remove_repeats(docs)
    assert rows.columns == [*docs.columns, "n_words", "n_removed"]
    order = sorted((x["key"], x["sub"], x["text"]) for x in op3_jaccard.identified(docs).collect())
    kept = repeats([((key, sub), split(t)) for key, sub, t in order])
    want = sorted(b" ".join(kept[key, sub]).decode() for key, sub, _ in order)
    assert sorted(x["text"] for x in rows.collect()) == want


def test_digests_and_edits(spark, documents):
    texts = corpus(9, 80)
    ids = random.Random(1).sample(range(-1000, 1000), 80)
    got = {r["doc_id"]: r for r in op5_digest.fingerprints(documents(texts, ids)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    prints = {}
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        d = op5_digest.digests([text.encode(), edited.encode(), after.encode()])
        assert r["fingerprint"] == d[0].tobytes().hex() and r["edited_fingerprint"] == d[1].tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == pytest.approx((op5_digest.likeness(d[:1], d[1:2])[0], op5_digest.likeness(d[:1], d[2:])[0]))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_digests_of_ids_that_are_null_or_shared(spark, documents):
    """Every document's edited text takes from the next one, whatever order rows of one id have."""
    texts = [f"{k} text {k * 7} of some length" for k in range(60)] + [None, "", "x", "x"]
    ids = [None if k % 3 else k % 5 for k in range(60)] + [None, None, 3, 3]
    rows = op5_digest.fingerprints(documents(texts, ids)).collect()
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for t in texts)
    order = sorted(op5_digest.identified(documents(texts, ids)).collect(), key=lambda r: (r["key"], r["sub"], r["sub2"]))
    want = []
    for k, r in enumerate(order):
        t, after = r["text"], order[(k + 1) % len(order)]["text"]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((None if r["key"] == op5_digest.LEAST else r["key"], len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str)


@pytest.mark.parametrize("ids", [[*range(4999), 10**18], [None] * 5000, [5] * 5000])
def test_digest_ranges_are_even(spark, documents, ids):
    rows = op5_digest.with_next(documents([f"text {i}" for i in range(5000)], ids)).groupBy("range").count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 2 * 5000 / 4


@pytest.mark.parametrize("texts, ids", [([], []), (["abc"], [3]), ([None, "a", "bb"], [None, -(1 << 62), (1 << 62)]), (["x", "y", "z"], [1, 1, 1]), (["x"] * 9, [None] * 9)])
def test_digests_of_few(spark, documents, texts, ids):
    rows = op5_digest.fingerprints(documents(texts, ids)).collect()
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for t in texts)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))


def test_digest_bounds():
    rng = np.random.default_rng(1)
    d = op5_digest.digests([bytes(rng.integers(0, 256, n).tolist()) for n in (0, 1, 2, 3, 50, 5000)])
    for a in d:
        for b in d:
            x = op5_digest.likeness(a[None], b[None])[0]
            assert 0 <= x <= 1 and x == op5_digest.likeness(b[None], a[None])[0]
    assert (op5_digest.likeness(d, d) == 1).all()


def vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    v = [(centers[rng.integers(12)] * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.uniform(0, 0.6)).astype(np.float32).tolist() for _ in range(n)]
    v[5], v[7] = v[2], v[2]
    return v


def brute_links(v, cosine=0.9):
    def fine(x):
        return x and all(c is not None and math.isfinite(c) for c in x) and any(x)

    out = []
    for i, a in enumerate(v):
        for j in range(i):
            b = v[j]
            if fine(a) and fine(b) and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                out.append((i, j))
    return out


@pytest.mark.parametrize("cell, tree, bundle", [(10, 15, 40), (512, 2048, 8192), (60, 1000, 20)])
def test_embeddings(spark, monkeypatch, cell, tree, bundle):
    monkeypatch.setattr(op6_embeddings, "CELL", cell)
    monkeypatch.setattr(op6_embeddings, "TREE", tree)
    monkeypatch.setattr(op6_embeddings, "BUNDLE", bundle)
    v = vectors(3) + [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0], [3.0, 1.0]]
    got = {r["vec_id"]: r for r in op6_embeddings.clusters(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")).collect()}
    links = brute_links(v)
    want, numbers = closure(range(len(v)), links), np.bincount(np.array(links).ravel(), minlength=len(v))
    assert len(links) > 500
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (numbers[i], want[i], want[i] == i)


def test_embeddings_that_share_ids(spark):
    """Rows are vectors of their own; a shared id links nothing."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (5, [-1.0, 0.0]), (5, [0.0, -1.0]), (5, [0.0, -1.0]), (None, [1.0, 0.0])]
    got = [tuple(r) for r in op6_embeddings.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings_of_more_lengths_than_pivots(spark, monkeypatch):
    monkeypatch.setattr(op6_embeddings, "PIVOTS", 3)
    rows = [(i, [1.0] * (2 + i // 3)) for i in range(24)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op6_embeddings.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (2, i // 3 * 3) for i in range(24)}


def test_levels_go_down_to_the_distance_of_a_link():
    assert op6_embeddings.radii(0.9) == (1.0, 0.5, 0.25, 0.125)
    assert op6_embeddings.radii(0.9999)[-1] <= 2 * math.sqrt(2e-4) / 4


def test_no_embeddings(spark):
    assert op6_embeddings.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert op6_embeddings.clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


def test_cover_tree_invariants():
    p = op6_embeddings.unit(np.array(vectors(8, 200)))
    t = op6_embeddings.CoverTree.build(p)
    assert sorted(t.order.tolist()) == list(range(200))
    for i in range(len(t.begin)):
        mine = t.points(i)
        d = op6_embeddings._distance(p[mine] @ p[t.center[i]])
        assert t.center[i] in mine and d.max() <= t.radius[i] + 1e-7
        kids = t.children(i)
        if kids:
            assert t.center[kids[0]] == t.center[i] and sum(t.end[k] - t.begin[k] for k in kids) == len(mine)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3).filter(any), min_size=1, max_size=25))
def test_traversal(v):
    p = op6_embeddings.unit(np.array(v, float))
    t, f = op6_embeddings.CoverTree.build(p), op6_embeddings.Found(np.arange(len(p)), np.ones(len(p), np.int64))
    op6_embeddings.traverse(t, t, p, (0, 0), 0.9, f)
    linked = p @ p.T >= 0.9
    np.fill_diagonal(linked, False)
    assert f.links.tolist() == linked.sum(axis=1).tolist()


def test_pipeline_near_duplicate_stage(spark, documents):
    texts = corpus(11, 100)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(texts), "").collect())
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i in range(100) for j in range(i) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert kept == sorted(i for i, c in closure(range(100), links).items() if i == c)


def test_pipeline_near_duplicates_of_null_and_shared_ids(spark, documents):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        *((None, text(x)) for x in "abc"), (None, ""), (None, None), (None, ""),  # null ids: all differ, or have no words
        (5, text("d")), (5, text("e")), (6, text("d") + " z"), (7, text("e")), (5, ""),  # one id, two texts and an empty one; copies of both
        (3, text("f")), (4, text("g")), (9, text("f")), (9, text("g") + " z"),  # the texts of 9 link with two documents apart
        (11, text("h")), (11, text("h")), (12, text("i")), (12, text("i") + " z"), (1, text("c")),  # the same row, and near copies, of one id
    ]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, documents([t for _, t in rows], [i for i, _ in rows]), "").collect()]
    twelve = [r for r in got if r[0] == 12]
    assert len(twelve) == 1 and twelve[0] in rows
    want = [*rows[:6], (5, text("d")), (5, text("e")), (5, ""), (3, text("f")), (4, text("g")), (11, text("h")), *twelve]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", ["near_duplicates", "repeated_passages", "personal_data"])
def test_pipeline_stages_keep_odd_columns_and_take_empty_tables(spark, documents, stage):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcab"] + [None, ""]
    docs = documents(texts, [3, None, 1, 4, None, None, 7])
    docs = docs.withColumn("meta.url", F.concat(F.lit("u"), "n_chars")).withColumn("_key", F.lit(1)).withColumn("key", F.lit("k")).withColumn("row", F.create_map(F.lit("a"), F.lit(1)))
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == {"near_duplicates": 5, "repeated_passages": 6, "personal_data": 7}[stage]
    assert all(r["_key"] == 1 and r["key"] == "k" and r["meta.url"].startswith("u") and r["row"] == {"a": 1} for r in rows)
    empty = run(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_pipeline_passage_stage(spark, documents):
    texts = corpus(13, 80)
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, documents(texts), "").collect()}
    want = repeats([(i, split(t)) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        if want[i] == split(t):
            assert rows[i] == (t or "")
        elif want[i]:
            assert rows[i] == b" ".join(want[i]).decode()
        else:
            assert i not in rows
