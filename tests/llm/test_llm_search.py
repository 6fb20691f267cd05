"""Graph search, leak search, quality votes and sharding against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlens.llm import bm25_leaks, common, hash_ring, hnsw, knn_quality

SF = "/root/testdata/sf0.01"


def nearest_by_brute_force(rows, query, k):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if query(i):
            near = sorted({(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v)})
            out[i] = near[:k]
    return out


def test_nearest_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one vector very often
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None] + [0.0] * 6), (2300, [math.nan] * 8),
             (2400, [math.inf] * 8), (None, rows[0][1]), (2500, []), (2600, [1.0, 2.0]), (2700, [1.0, 3.0]),
             (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = nearest_by_brute_force(rows, lambda i: i % 100 == 0, 10)
    assert set(got) == set(q for q, n in want.items() if n)
    hits = sum(len(set(got[q]) & set(want[q])) for q in got)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert got[2600] == want[2600] and got[1000] == want[1000]


def test_nearest_on_the_given_vectors(spark):
    df = common.read_table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = nearest_by_brute_force(rows, lambda i: i % 100 == 0, 10)
    got = hnsw.op1_hnsw(spark, SF).collect()
    hits = sum((r.score, r.vec_id) in set(want[r.query_id]) for r in got)
    assert len(got) == sum(map(len, want.values())) and hits >= 0.95 * len(got)


def test_nearest_of_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(df, F.lit(True)).count() == 0


def test_graph_recall_on_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32)) * 3
    x = np.concatenate([c + rng.normal(size=(150, 32)) * 0.01 for c in centres] + [rng.normal(size=(1000, 32))])
    x = x[rng.permutation(len(x))]
    graph = hnsw.Graph.build(x, [4000, 250, 15])
    ids, _ = graph.search(x[:300], 10)
    want = np.argsort(((x[:300, None] - x[None]) ** 2).sum(2), 1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), want.tolist(), strict=True)]) >= 9.5


def leaks_by_brute_force(docs, items):
    index = bm25_leaks.Index.build(items)
    out = set()
    for i, text in docs:
        w = bm25_leaks.words_of(text)
        for lo in range(0, max(1, len(w)), index.span):
            passage = w[lo:lo + 2 * index.span]
            scores = np.zeros(len(index.items))
            for t in set(passage):
                if t in index.terms:
                    at, impact = index.postings[index.terms[t]]
                    scores[at] += impact
            for k in np.flatnonzero(scores >= bm25_leaks.THRESHOLD):
                if min(bm25_leaks.overlap(p, passage) for p in index.parts[k]) >= bm25_leaks.OVERLAP:
                    out.add((i, index.items[k][0]))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 100_000)
    docs = [(r.doc_id, r.text) for r in common.read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.read_table(spark, SF, "benchmark").collect()]
    rng = random.Random(1)
    for k in range(20):  # planted: whole, in a long text, with other case and marks, and a third of an item
        words = items[k][1].split()
        noise = " ".join(rng.choices(docs[k][1].split(), k=400))
        docs += [(50_000 + k, noise + "\n" + items[k][1] + " " + noise), (51_000 + k, items[k][1].upper().replace(",", " ; ")),
                 (52_000 + k, " ".join(words[:len(words) // 3]))]
    docs += [(60_000, None), (60_001, ""), (60_002, "..."), (None, items[0][1]), (60_003, items[1][1]), (60_003, items[1][1])]
    more = [(900, None), (901, ""), (None, "some item text"), (902, "!!")]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame([(i, t, "x") for i, t in items + more], "item_id long, text string, doc_id string")
    got = bm25_leaks.find_leaks(d, b).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == leaks_by_brute_force(docs, items)
    assert all({(50_000 + k, k), (51_000 + k, k)} <= found and (52_000 + k, k) not in found for k in range(20))
    assert Counter((r.doc_id, r.item_id) for r in got)[60_003, 1] == 2
    kept = bm25_leaks.drop_leaks(d, b)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 1
    assert kept.count() == sum(i is None or i not in {x for x, _ in found} for i, _ in docs)
    monkeypatch.setattr(bm25_leaks, "INDEX_BYTES", 2000)  # several indexes
    again = {(r.doc_id, r.item_id) for r in bm25_leaks.find_leaks(d, b).collect()}
    assert {(50_000 + k, k) for k in range(20)} <= again
    empty = spark.createDataFrame([], b.schema)
    assert bm25_leaks.find_leaks(d, empty).count() == 0 and bm25_leaks.find_leaks(d.limit(0), b).count() == 0


def test_leaks_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    items = [(r.item_id, r.text) for r in common.read_table(spark, SF, "benchmark").collect()][:40]
    items.append((999, " ".join(t for _, t in items[:3])))  # the longest: every index has its span
    noise = [r.text.split() for r in common.read_table(spark, SF, "documents").limit(40).collect()]
    docs = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        for share in (50, 55, 60, 65, 70, 75, 80, 90, 100):  # scores on both sides of the thresholds
            docs.append((k * 1000 + share, " ".join(noise[k % 40][:60] + words[-(len(words) * share // 100):] + noise[k % 40][:60])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, bm25_leaks.find_leaks(d, b).collect()))
    assert {r[0] % 1000 for r in one} > {100} and len(one) < len(docs)
    monkeypatch.setattr(bm25_leaks, "INDEX_BYTES", 2000)
    assert sorted(map(tuple, bm25_leaks.find_leaks(d, b).collect())) == one


def test_block_sums_in_small_chunks(monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 12)))) for k in range(50)]
    texts = pa.array([" ".join(rng.choices(words, k=n)) for n in (0, 5, 100, 0, 0, 300, 1)] + [items[7][1]])
    want = bm25_leaks.Index.build(items)
    want = list(want.retrieve(*want.numbers(texts), 0.6))
    monkeypatch.setattr(bm25_leaks, "CELLS", 30)
    got = bm25_leaks.Index.build(items)
    assert list(got.retrieve(*got.numbers(texts), 0.6)) == want and any(k == 7 for *_, k, _ in want)


def test_quality_votes_on_held_out_rows(spark):
    rows = knn_quality.op5_knn_quality(spark, SF).join(common.read_table(spark, SF, "labels"), "doc_id")
    held = rows.where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.collect())
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_quality_of_odd_rows(spark):
    docs = [(i, ("Fine words stand here, and more of them. " if i % 2 else "BAD!! TEXT!! HERE!! ") * (1 + i % 7)) for i in range(60)]
    odd = [(100, None), (101, ""), (None, "Fine words stand here."), (102, "x " * 40_000), (103, "퟿😀"), (1, docs[1][1])]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs + odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (2, None, 0), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = knn_quality.fit(df, labels)
    got = knn_quality.score(df, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(docs) + len(odd)
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id < 60)
    none = knn_quality.fit(df, labels.limit(0))
    assert {r.score for r in knn_quality.score(df, none).collect()} == {0.5}
    assert knn_quality.score(df.limit(0), model).count() == 0 and knn_quality.fit(df.limit(0), labels).labels.size == 0


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.3, (30, knn_quality.TERMS)).astype(np.float32)
    model = knn_quality.Model(np.ones(knn_quality.TERMS, np.float32), rng.normal(size=(knn_quality.TERMS, 8)).astype(np.float32),
                              np.empty((0, 8)), rng.integers(0, 2, 200).astype(float))
    model.vectors = model.embed(rng.poisson(0.3, (200, knn_quality.TERMS)).astype(np.float32))
    unit = model.embed(counts)
    for row, got in zip(unit, model.score(counts), strict=True):
        cosine = model.vectors @ row
        near = np.argsort(-cosine)[:knn_quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** knn_quality.SHARPNESS
        assert abs(got - (weight * model.labels[near]).sum() / weight.sum()) < 1e-5


def test_shards_are_even_and_whole(spark):
    df = common.read_table(spark, SF, "documents")
    rows = hash_ring.assign_shards(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in count.items())


def test_shards_of_odd_tables(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, None, 4), (None, "", 5), (7, "x" * 100_000, 6)] + [(8, "t", 0)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, cell int")
    got = hash_ring.assign_shards(df, shards=5).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert hash_ring.assign_shards(df.limit(0)).count() == 0


def test_ring_moves_little():
    rng = random.Random(2)
    counts = Counter(rng.randrange(4096) for _ in range(40_000))

    def home(shards):
        found = {}
        for cell, lo, hi, shard, _ in hash_ring.ring_plan(counts, shards, cells=4096):
            for k in range(lo, hi):
                assert (cell, k) not in found
                found[cell, k] = shard
        return found

    a, b = home(16), home(17)
    assert len(a) == len(b) == 40_000
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)  # a modulo would move 94 of 100


def test_quality_model_is_learnt_off_the_driver(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("on the driver")

    monkeypatch.setattr(np.linalg, "eigh", fail)
    docs, labels = (common.read_table(spark, SF, t) for t in ("documents", "labels"))
    model = knn_quality.fit(docs, labels)
    assert len(model.vectors) == len(model.labels) > 0 and np.isfinite(model.axes).all()
    norms = np.linalg.norm(model.vectors, axis=1)
    assert np.allclose(norms[norms > 0], 1, atol=1e-5)
