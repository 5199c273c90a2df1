"""Fingerprints, the trie join and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import common, simhash


def fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    n = min(shingle, len(words))
    grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if words else []
    bits = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, c in bits.items() if 2 * c > len(grams))


def roots_of(nodes, edges):
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in nodes}


def near_values(rng, centres, copies, flips):
    values = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(copies):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            values.append(value)
    return np.unique(np.array(values, dtype=np.uint64))


@pytest.mark.parametrize("seed", range(6))
def test_the_trie_join_spans_all_links(seed):
    values = near_values(random.Random(seed), 30, 25, 8)
    nodes = values.tolist()
    links = simhash.pairs_by_force(values, 4)
    edges = simhash.trie_links(values, None, 4)
    assert len(edges) < len(nodes) and all((a ^ b).bit_count() <= 4 for a, b in edges)
    assert roots_of(nodes, edges) == roots_of(nodes, links)
    side = np.array([v % 3 == 0 for v in nodes])
    across = [(a, b) for a, b in links if (a % 3 == 0) != (b % 3 == 0)]
    assert roots_of(nodes, simhash.trie_links(values[side], values[~side], 4)) == roots_of(nodes, across)


def test_blocks_cover_all_bits_and_turn_back():
    values = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567], dtype=np.uint64)
    bounds = simhash.blocks(4)
    assert sum(w for _, w in bounds) == 64
    for low, width in bounds:
        turned = simhash.rotate(values, low, width)
        assert (turned >> np.uint64(64 - width) == (values >> np.uint64(low)) & np.uint64(2**width - 1)).all()
        assert (simhash._back(turned, low, width) == values).all()


def check(spark, rows):
    common.prepare(spark)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, bits int, root string")
    found = simhash.near_duplicates(df)
    got = Counter((r.doc_id, r.f, r.component_id) for r in found.select("doc_id", simhash.as_hex(F.col("bits")).alias("f"), "component_id").collect())
    prints = [fingerprint(t) for _, t in rows]
    root = roots_of(set(prints), simhash.pairs_by_force(np.array(prints, dtype=np.uint64), 4))
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[root[p]] = min(doc, least.get(root[p], doc))
    assert got == Counter((doc, f"{p:016x}", least.get(root[p])) for (doc, _), p in zip(rows, prints))


def test_documents_of_the_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def edited(rng, n):
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
        rows.append((5000 - i, " ".join(own)))
    return rows


def test_hot_nodes_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 20)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rng = random.Random(3)
    check(spark, edited(rng, 150) + edited(rng, 60)[:60])


def test_odd_texts(spark):
    check(spark, [(3, None), (2, ""), (9, " \n\t"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "alone here now and then"),
                  (7, "É é"), (7, "É é"), (8, "long " * 20000)])


def test_empty_table(spark):
    common.prepare(spark)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    common.prepare(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}
