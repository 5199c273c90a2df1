"""Held-out accuracy, exact neighbours and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import common, quality, queries


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    common.prepare(spark)
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.fit_quality(docs, labels)
    held = docs.join(labels, "doc_id").where(common.fold(F.col("doc_id"), 5) == 0)
    rows = quality.score_column(held, model).select("score", "quality").collect()
    scores, truth = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert auc(scores, truth) > 0.99
    assert (scores[truth == 1] >= 0.3).mean() > 0.99 and (scores[truth == 0] < 0.3).mean() > 0.97


def test_votes_are_those_of_the_nearest():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(50, 6)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 50).astype(float)
    model = quality.Neighbours(None, None, None, unit, labels, 7)
    asked = unit[:20]
    got = model.votes(asked)
    for i, a in enumerate(asked):
        near = np.argsort(-(unit @ a))[:7]
        weight = np.maximum(unit[near] @ a, 0) ** quality.POWER
        assert got[i] == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-6)


SCHEMA = "doc_id long, text string, label int"


def test_odd_rows(spark):
    common.prepare(spark)
    train = [(i, "plain words in a row. " * (i % 4 + 1), 1) for i in range(30)]
    train += [(100 + i, "BUY!! NOW!! " * (i % 5 + 1), 0) for i in range(30)]
    train += [(200, None, 1), (201, "", 0), (202, "plain words", None), (203, "plain", 7), (None, "plain", 1)]
    labelled = spark.createDataFrame(train, SCHEMA)
    labels = labelled.select("doc_id", "label").union(labelled.where("doc_id = 1").select("doc_id", "label"))
    model = quality.fit_neighbours(labelled.select("doc_id", "text", "label"), labels.union(labels.limit(0)))
    assert len(model.labels) == 63
    assert len(quality.fit_neighbours(labelled, labels, bound=20).labels) in range(18, 21)
    docs = spark.createDataFrame([(1, "other plain words in a row.", "s"), (2, "SELL!! NOW!!", "s"), (3, None, "s"), (3, None, "s"),
                                  (4, "", "s"), (None, "z" * 300000, "s")], "doc_id long, text string, weights string")
    got = quality.score_column(docs, model)
    assert got.columns == [*docs.columns, "score"]
    scores = {}
    for r in got.collect():
        assert 0 <= r.score <= 1
        scores.setdefault(r.doc_id, []).append(r.score)
    assert scores[1][0] > 0.7 and scores[2][0] < 0.3
    assert scores[3] == scores[4] * 2


def test_nothing_labelled_and_nothing_to_score(spark):
    common.prepare(spark)
    empty = spark.createDataFrame([], SCHEMA)
    model = quality.fit_neighbours(empty, empty)
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert quality.score_column(docs, model).first().score == 0.5
    assert quality.score_column(docs.limit(0), model).count() == 0


def test_ties_go_to_the_first_positions():
    """Equal cosines beyond the k-th place are left out from the end, against sorting."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (40, 3)).astype(np.float32)
    labels = rng.integers(0, 2, 40).astype(np.float64)
    one = np.ones(quality.WIDTH, np.float32)
    model = quality.Neighbours(one, one, np.zeros((quality.WIDTH, 3), np.float32), vectors, labels, 7)
    z = rng.integers(-1, 2, (30, 3)).astype(np.float32)
    for row, got in zip(z, model.votes(z)):
        cosine = vectors @ row
        near = sorted(range(40), key=lambda i: (-cosine[i], i))[:7]
        weight = np.maximum(cosine[near], 0) ** quality.POWER
        expected = (weight * labels[near]).sum() / weight.sum() if weight.sum() else labels.mean()
        assert abs(got - expected) < 1e-6


def test_repeated_rows_of_a_labelled_document_are_bounded(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([(1, f"text {i % 50} of one id") for i in range(400)] + [(2, "other text")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert len(quality.fit_neighbours(docs, known).labels) == 51
    assert len(quality.fit_neighbours(docs, known, bound=20).labels) == 20
