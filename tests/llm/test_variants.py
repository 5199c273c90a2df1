"""Words, node numbers, near words and roots against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import common, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows, every=199, shortest=6, fewest=5):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= fewest}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def judge(words, factor=5):
    """Candidates share the text around a skipped code point; `one_edit` decides."""
    buckets = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            buckets[w[:i], w[i + 1:]].add(w)
        for i in range(len(w) + 1):
            buckets[w[:i], w[i:]].add(w)
    near = defaultdict(set)
    for group in buckets.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return rows


def judged(spark, words, **kw):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    return {tuple(r) for r in variants.variants(df, **kw).collect()}


@pytest.fixture(autouse=True)
def settings(spark):
    common.prepare(spark)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = words_of([(r.doc_id, r.text) for r in docs.collect()])
    df = variants.count_words(docs)
    assert {r.word: r.n for r in df.collect()} == words
    found = {tuple(r) for r in variants.variants(df).collect()}
    expected = judge(words)
    assert found == expected and any(r[3] for r in expected) and any(r[2] > 1 for r in expected)


@pytest.mark.parametrize("seed", range(3))
def test_random_words_over_few_letters(spark, seed):
    """Short words over two letters: repeated letters, words that extend others, many near words."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 5, 9, 60, 400]) for _ in range(400)}
    assert judged(spark, words, factor=3) == judge(words, 3)


def test_near_words_by_comparing_all_pairs():
    words = {"".join(w): 1 for w in ("aab", "ab", "aaab", "abb", "b", "ba", "aabb")}
    by_all = {w: sum(one_edit(w, v) for v in words) for w in words}
    assert {r[0]: r[2] for r in judge(words)} == by_all


def test_chains_lead_to_the_last_form(spark):
    words = {"abcdefgh"[:i + 1]: 6 ** (7 - i) for i in range(8)}
    found = judged(spark, words)
    assert found == judge(words)
    assert {r[5] for r in found} == {"a"}


def test_equal_prefixes_share_a_number_across_ranges(spark):
    rng = random.Random(7)
    words = sorted({"shared" * 3 + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))) for _ in range(300)} | {"a", "shar"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = variants.trie_paths(df, "word").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    number = {}
    for r in rows:
        assert len(r.path) == len(r.word) + 1
        for i, x in enumerate(r.path):
            assert number.setdefault(r.word[:i], x) == x
    assert len(set(number.values())) == len(number)
    assert [r.word for r in sorted(rows, key=lambda r: r.path[-1])] == words


def test_odd_texts(spark):
    long_run = "q" * 3000
    rows = [(1, None), (2, ""), (3, "…漢字Ābcdef ××××××× ÷÷÷÷÷÷÷"), (None, "Ünicode éclair 12 \U0001F600smiley"), (None, None)]
    rows += [(i, f"{long_run} {long_run}r hello-world HELLO Straße straßen × Éclair éclair") for i in range(6)]
    rows += [(9, "Repeated repeated")] * 4
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    words = variants.count_words(df, every=3)
    assert {r.word: r.n for r in words.collect()} == words_of(rows, every=3)
    assert {tuple(r) for r in variants.variants(words).collect()} == judge(words_of(rows, every=3))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.count_words(docs)).count() == 0
    assert variants.variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect() == [("alone", 3, 0, None, None, "alone")]
