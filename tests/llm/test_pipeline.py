"""The pipeline stage by stage, and the registered query."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from faultline.llm import common, decontaminate, queries, secrets, simhash
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


def test_stages_on_the_table(spark):
    """Each stage against what its operator says of the same input."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept")).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = {d for d, q in known.items() if q == 1}
    assert len(good & kept["quality"]) > 0.98 * len(good)
    assert sum(q == 0 for d, q in known.items() if d in kept["quality"]) < 0.05 * sum(q == 0 for q in known.values())
    # No two equal texts are left after the second stage.
    stage2 = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(*kept["near_dedup"]))
    assert stage2.select("text").distinct().count() == len(kept["near_dedup"])
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    marked = decontaminate.mark_contaminated(stage2, benchmark).select("doc_id", "benchmark_hits.contaminated").collect()
    assert kept["decontaminate"] == {r.doc_id for r in marked if not r.contaminated}
    assert kept["secrets"] == kept["decontaminate"]
    for r in docs.collect():
        assert not secrets.pattern_spans(r.text) and r.n_chars == len(r.text) and r.extra == "kept"


def test_odd_rows_pass_all_stages(spark):
    common.prepare(spark)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words " * 9, "en", "s", 108), (3, "plain words " * 9, "en", "s", 108),
            (None, "something else entirely, without an id", None, "s", None), (None, "another text that has no id of its own", None, "s", None),
            (5, "password=abcdefghijkl0 is here " * 3, "en", "s", 93)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    got = {(r.doc_id, r.text): r.n_chars for r in docs.collect()}
    assert sum(1 for d, _ in got if d == 3) <= 1 and sum(1 for d, _ in got if d is None) == 2
    secret = next(t for d, t in got if d == 5)
    assert "abcdefghijkl0" not in secret and got[5, secret] == len(secret)
    assert corpus_pipeline.pack_documents(spark, docs, SF).count() >= len(got)


def test_each_group_keeps_one_row(spark):
    """Repeated ids with unrelated texts, planted copies, near copies and equal rows against brute force."""
    common.prepare(spark)
    rng = random.Random(11)

    def text(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    rows = []
    for i in range(60):
        words = text(400).split()
        rows.append((rng.randrange(40), " ".join(words)))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((rng.randrange(40), " ".join(copy)))
    rows += [(7, "same row twice " * 5)] * 3 + [(None, text(30)), (None, text(30)), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, least string")
    prints = [simhash.fingerprint((t or "").encode(), 4) for _, t in rows]
    links = simhash.pairs_by_force(np.array(prints, dtype=np.uint64), 4)
    groups = {p: {p} for p in prints}
    for a, b in links:
        merged = groups[a] | groups[b]
        for p in merged:
            groups[p] = merged
    stays = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert docs.columns == list(stays[0].asDict())
    of = {(d, t): min(groups[p]) for (d, t), p in zip(rows, prints)}
    assert sorted(of[r.doc_id, r.text] for r in stays) == sorted({min(groups[p]) for p in prints})
    least = {}
    for (d, _), p in zip(rows, prints):
        key = min(groups[p])
        least[key] = min(least.get(key, 1 << 62), -1 if d is None else d)
    assert all((-1 if r.doc_id is None else r.doc_id) == least[of[r.doc_id, r.text]] for r in stays)


def test_empty_documents(spark):
    common.prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(entry.queries()[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
