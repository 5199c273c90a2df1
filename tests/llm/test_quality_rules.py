"""Measures against plain counting, cutoffs against exact binomial sums, risk on held-out rows."""

import math
import random
import re
from fractions import Fraction

import pytest

from faultline.llm import common, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def settings(spark):
    common.prepare(spark)


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
    )


ODD = [None, "", " \n\t\v\f\r ", "a b a b a b a b a b", "x " * 40, "\n\nsame\nsame\n same\nsame", "#* <|> é漢\U0001F600    x\x1cy",
       "one two three four five six one two three four five", "a\r\nb\r\na\r\n", "word " * 3000 + "end"]


def test_measures_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "q", 5) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, n_words int")
    rows = quality_rules.measured(df, ["doc_id"]).collect()
    got = {r.doc_id: tuple(r.measured)[:5] for r in rows}
    assert got == {i: counted(t) for i, t in enumerate(ODD)}


def test_measures_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.where("length(text) < 3000")
    rows = queries.QUERIES["op13_quality_rules"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    for r in short.collect():
        own = got[r.doc_id]
        found = (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words)
        assert found == counted(r.text)
        assert own.base_failed == (own.n_words < 10 or 100 * own.n_repeat_words > 20 * own.n_words)
        assert not (own.base_failed and own.kept)


def tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)))


def test_cutoffs_follow_the_fixed_sequence(spark):
    """Exact sums, the stop at the first failure, and the choice by gain."""
    rng = random.Random(5)
    rows = []
    for s in ("a", None):
        for rule in ("r1", "r2"):
            out, bad_out = 0, 0
            for place in range(6):
                out, bad_out = out + rng.randint(0, 4), bad_out + rng.randint(0, 30)
                rows.append((s, rule, place, 10.0 - place, 600, 200, out, bad_out))
    df = spark.createDataFrame(rows, "s string, rule string, place int, cutoff double, good long, bad long, good_out long, bad_out long")
    found = {(r.s, r.rule): r.place for r in quality_rules.certified(df, "s", 2, 0.05, 0.05, 10.0).collect()}
    expected = {}
    for key in {r[:2] for r in rows}:
        best = None
        for _, _, place, _, good, bad, out, bad_out in sorted(r for r in rows if r[:2] == key):
            if tail(out, good, 0.025) > 0.05 / 4:
                break
            gain = bad_out / bad - 10 * out / good
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, place)
        if best:
            expected[key] = best[1]
    assert found == expected and expected


def corpus(rng, n, strata=("x", "y")):
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [f"w{rng.randrange(5000)}" for _ in range(30)]
        if not good and rng.random() < 0.9:
            words = [w + "#|" for w in words]
        elif good and rng.random() < 0.004:
            words[3] = "#"
        docs.append((i, " ".join(words), strata[i % len(strata)], 1))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def test_good_documents_stay_and_junk_goes(spark):
    docs, labels = corpus(random.Random(1), 12000)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, measured int")
    known = spark.createDataFrame(labels, "doc_id long, label int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.judge(df, known).collect()}
    held = {i: q for i, q, _ in labels}
    for s in ("x", "y"):
        good = [r for i, r in rows.items() if held.get(i) == 1 and r.lang == s]
        junk = [r for r in rows.values() if r.measured.n_symbols > 20 and r.lang == s]
        assert sum(not r.kept for r in good) / len(good) <= 0.05
        assert all(not r.kept for r in junk) and all("symbols" in r.rejected_by for r in junk)


def test_a_stratum_with_few_labels_keeps_its_documents(spark):
    docs, labels = corpus(random.Random(2), 400)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n int")
    known = spark.createDataFrame(labels, "doc_id long, label int, toxic int")
    assert all(r.kept for r in quality_rules.judge(df, known).collect())


def test_odd_rows(spark):
    docs = [(1, None, None, "x"), (1, None, None, "x"), (None, "a " * 30, "en", "x"), (2, " ".join(f"w{i}" for i in range(40)), None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string")
    known = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (9, 1)], "doc_id long, label int")
    rows = sorted(((r.doc_id or 0, r.base_failed, r.kept) for r in quality_rules.judge(df, known).collect()))
    assert rows == [(0, True, False), (1, True, False), (1, True, False), (2, False, True)]
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality_rules.judge(df, none).count() == 4
    assert quality_rules.judge(df.limit(0), known).count() == 0
