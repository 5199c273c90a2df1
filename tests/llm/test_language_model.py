"""Sequences, trie and scores against plain dictionaries."""

import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import common, language_model
from faultline.llm.elias_fano import MonotoneSequence, Trie

SCHEMA = "doc_id long, text string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=80), st.lists(st.integers(0, 2 * 10**9), max_size=20))
def test_successor_search(values, wanted):
    values = np.sort(np.array(values, dtype=np.int64))
    sequence = MonotoneSequence.of(values)
    assert (sequence.values() == values).all()
    wanted = np.concatenate([np.array(wanted, dtype=np.int64), values])
    assert (sequence.find(wanted) == np.searchsorted(values, wanted)).all()


def test_a_mapped_trie_answers_like_a_dictionary():
    rng = np.random.default_rng(2)
    key = np.unique(rng.zipf(1.4, 20000).clip(max=5000).astype(np.int64) << 32 | rng.integers(0, 9000, 20000))
    chance = -6 * rng.random(len(key))
    with tempfile.TemporaryFile() as file:
        Trie.of(key >> 32, key & 0xFFFFFFFF, chance).write(file)
        assert file.tell() < 8 * len(key)
        trie = Trie.map(file)
    found = trie.look_up(key >> 32, key & 0xFFFFFFFF)
    assert np.abs(found - chance).max() <= 6 / 256
    asked = rng.integers(1, 6000, 5000) << 32 | rng.integers(0, 9500, 5000)
    known = set(key.tolist())
    assert [not math.isnan(x) for x in trie.look_up(asked >> 32, asked & 0xFFFFFFFF)] == [k in known for k in asked.tolist()]


def by_force(rows, held, mass):
    """doc position -> (n_tokens, n_known, N, base, score)."""
    tokens = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
    words, pairs = Counter(), Counter()
    for t, out in zip(tokens, held):
        if not out:
            words.update(t)
            pairs.update(zip([b" ", *t], t))
    n, v = sum(words.values()), len(words)

    def p(w):
        return (words[w] + 0.1) / (n + 0.1 * (v + 1))

    def log_p(a, w):
        return math.log10((pairs[a, w] + mass * p(w)) / (words[a] + mass) if words[a] else p(w))

    return [(len(t), sum(words[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t),
             sum(log_p(a, w) for a, w in zip([b" ", *t], t))) for t in tokens]


def check(spark, rows, held, **settings_):
    common.prepare(spark)
    df = spark.createDataFrame([(i, *r, h) for i, (r, h) in enumerate(zip(rows, held))],
                               "place long, doc_id long, text string, out boolean")
    # The place goes in as the id, so that null and repeated ids can be told apart here.
    got = language_model.score_texts(df, F.col("out"), key="place", **settings_).collect()
    want = by_force(rows, held, settings_.get("mass", 100.0))
    assert len(got) == len(rows)
    for r in got:
        tokens, known, n, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 0.03 * tokens


ODD = [(1, "The cat sat on the mat"), (2, "the CAT ran\n\tfar"), (3, None), (4, ""), (5, "the the the cat"),
       (None, "a dog"), (5, "the the the cat"), (6, "É é É"), (7, "x" * 50000), (8, " \x0b\x0c ")]


def test_odd_texts(spark):
    check(spark, ODD, [False, True, False, True, False, False, True, False, False, True])


def test_nothing_to_learn_from(spark):
    check(spark, ODD, [True] * len(ODD))


def test_whole_table_in_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 5_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows, [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows], mass=20.0)


def test_empty_table(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string, score string, block string")
    assert language_model.score_texts(df, common.fold(F.col("doc_id"), 10) == 0).count() == 0


def test_fold_is_the_checksum_of_the_id(spark):
    ids = [0, 7, 123456789, -5]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = [r.f for r in df.select(common.fold(F.col("doc_id"), 10).alias("f")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 10 for i in ids]


@pytest.mark.parametrize("width", [2, 4])
def test_squeezed_numbers_come_back(width):
    values = np.random.default_rng(1).integers(0, 256**width, 1000)
    assert (language_model.unsqueeze(language_model.squeeze(values, width), width) == values).all()
