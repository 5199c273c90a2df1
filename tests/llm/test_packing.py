"""Round trips of pieces and sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from faultline.llm import common, packing
from faultline.llm.vocabulary import byte_pair_encoder


def test_ids_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts += ["", " ", "\n\n  x", "it's 123abc!!", "日本語 😀 é", "a" * 3000, "<|endoftext|>", "tab\there \r\n"]
    for text in texts:
        assert byte_pair_encoder().encode_ordinary(text) == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, want", [
    (1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (11, [(0, 3), (3, 4), (7, 4)])])
def test_only_the_first_piece_is_shorter(n, want):
    assert packing.cut(n, 4) == want


def test_plans_use_every_piece_once():
    rng = random.Random(5)
    for trial in range(60):
        size = rng.choice([1, 2, 7, 32, 128])
        counts = {rng.randint(1, size): rng.randint(1, 400) for _ in range(rng.randint(0, 40))}
        used = defaultdict(int)
        total = 0
        for lengths, times in packing.plan(counts, size):
            assert sum(lengths) <= size and times > 0
            total += times
            for length in lengths:
                used[length] += times
        assert dict(used) == counts
        assert packing.Places(packing.plan(counts, size)).sequences == total


def test_exact_complements_leave_no_gap():
    assert sorted(packing.plan({7: 3, 3: 3}, 10)) == [((7, 3), 3)]
    assert sorted(packing.plan({6: 2, 3: 2, 1: 2}, 10)) == [((6, 3, 1), 2)]
    assert sorted(packing.plan({5: 1, 2: 2, 1: 1}, 10)) == [((5, 2, 2, 1), 1)]


def check(rows, found, size):
    ids = {}
    for doc, text in rows:
        ids[doc] = [*byte_pair_encoder().encode_ordinary(text or ""), packing.END_ID]
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids[doc]), size)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_round_trip_over_the_table(spark):
    common.prepare(spark)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    found = packing.pack(table).collect()
    least = -(-sum(r.length for r in found) // 1024)
    assert check(rows, found, 1024) <= 1.02 * least + 2


def test_odd_rows(spark):
    common.prepare(spark)
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "b"), (None, "c d e")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, length int, rank string")
    check(rows, packing.pack(df, 64).collect(), 64)
    twice = df.where("doc_id = 4").union(df.where("doc_id = 4"))
    assert packing.pack(twice, 64).count() == 2
    assert packing.pack(df.where("doc_id = 99")).count() == 0
