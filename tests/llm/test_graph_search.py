"""Recall against brute force, and vectors that take no part."""

import math

import numpy as np

from faultline.llm import common, graph_search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, query, k):
    a = np.array(query, dtype=np.float64)
    found = []
    for i, v in rows:
        v = np.array(v, dtype=np.float64)
        found.append((-(a @ v) / (np.linalg.norm(a) * np.linalg.norm(v)), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def test_recall_over_several_shards(spark):
    common.prepare(spark)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    vectors = [(i, (centres[i % 8] + rng.normal(size=24)).tolist()) for i in range(2500)]
    df = spark.createDataFrame(vectors, SCHEMA)
    got = graph_search.nearest(df, df.where("vec_id % 50 = 0"), shard_size=700).collect()
    assert len(got) == 50 * 5
    hits = 0
    for q in range(0, 2500, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(a.score >= b.score for a, b in zip(own, own[1:]))
        want = brute([v for v in vectors if v[0] != q], vectors[q][1], 5)
        hits += len({r.vec_id for r in own} & {i for i, _ in want})
        for r in own:
            assert math.isclose(r.score, brute([vectors[r.vec_id]], vectors[q][1], 1)[0][1], abs_tol=1e-6)
    assert hits >= 0.9 * 250


def test_recall_on_the_table(spark):
    common.prepare(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = graph_search.nearest(table, table.where("vec_id % 50 = 0")).collect()
    pairs = {(r.query_id, r.vec_id) for r in got}
    want = {(q, i) for q, v in rows if q % 50 == 0 for i, _ in brute([x for x in rows if x[0] != q], v, 5)}
    assert len(pairs & want) >= 0.9 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    common.prepare(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(20, 60)] + [(60, [2.0, 4.0]), (1, [2.0, -1.0]), (2, [0.0, 0.0]),
            (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, None), (7, []), (None, [1.0, 2.0]),
            (30, [1.0, 2.0]), (8, [1e30, 2e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_search.nearest(df, df.where("vec_id in (2, 3, 6, 20, 60) or vec_id is null")).orderBy("query_id", "rank").collect()
    found = {q: [r.vec_id for r in got if r.query_id == q] for q in (20, 60)}
    assert {r.query_id for r in got} == {20, 60}
    assert found[20] == [8, 21, 22, 23, 24] and found[60] == [8, 20, 21, 22, 23]
    assert all(math.isclose(r.score, 1.0) for r in got)


def test_fewer_candidates_and_other_lengths(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in graph_search.nearest(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)]


def test_empty_table(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], SCHEMA + ", rank string, score string")
    assert graph_search.nearest(df, df).count() == 0


def test_pruning_keeps_diverse_edges():
    # Two near points on one side and one on the other: the second of the pair is covered by the first.
    points = np.array([[1, 0], [0.99, 0.14], [0.96, 0.28], [0.97, -0.24]], dtype=np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    kept = graph_search.robust_prune(points, np.array([0]), np.array([[1, 2, 3]]), 3, 1.0)
    assert kept.tolist() == [[1, 3, -1]]
