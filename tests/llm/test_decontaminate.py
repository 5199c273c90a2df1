"""Window search against a plain comparison of all windows."""

import random
import re

from faultline.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_force(text, items, window):
    ws = words(text)
    hit, ids = set(), set()
    for item, body in items:
        own = words(body)
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            for i in range(len(ws) - size + 1):
                if ws[i:i + size] == own[at:at + size]:
                    hit.update(range(i, i + size))
                    ids.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(ws)


def check(spark, texts, items, window, **settings):
    common.prepare(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' spans", "1 n_words")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.mark_contaminated(docs, benchmark, window, **settings)
    assert marked.columns == [*docs.columns, "benchmark_hits"]
    got = {r.doc_id: tuple(r.benchmark_hits) for r in marked.collect()}
    for i, text in enumerate(texts):
        n, hit, ids, bad = by_force(text, items, window)
        assert got[i] == (n, hit, ids, bad), (i, text)


def corpus(rng):
    names = ["alpha", "beta", "Gamma", "7", "é", "ÀB", "delta-x"]
    items = [(i, " ".join(rng.choices(names, k=rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)]
    texts = [" ".join(rng.choices(names, k=rng.randrange(0, 40))) for _ in range(60)]
    texts += [f"{rng.choice(texts)}. {rng.choice(items)[1].upper()}! {rng.choice(texts)}" for _ in range(30)]
    return texts + [None, "", "...", "alpha " * 2000], items + [(None, "beta 7 7 beta"), (3, None), (4, "--"), items[0]]


def test_equal_to_all_windows(spark):
    texts, items = corpus(random.Random(7))
    check(spark, texts, items, 3)


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TABLE_CHARS", 60)
    texts, items = corpus(random.Random(8))
    check(spark, texts, items, 4)


def test_no_items_and_no_documents(spark):
    check(spark, ["alpha beta"], [], 13)
    common.prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.mark_contaminated(docs, benchmark).count() == 0


def test_the_share_is_of_all_words(spark):
    item = " ".join(f"w{i}" for i in range(13))
    common.prepare(spark)
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    docs = spark.createDataFrame([(n, item + " z" * (n - 13)) for n in (13, 260, 261)], "doc_id long, text string")
    got = {r.doc_id: r.benchmark_hits.contaminated for r in decontaminate.mark_contaminated(docs, benchmark).collect()}
    assert got == {13: True, 260: True, 261: False}


def test_any_share_is_compared_in_whole_numbers(spark):
    """13 hit words of n: contaminated up to n = 13 / share exactly."""
    common.prepare(spark)
    window = " ".join(f"b{i}" for i in range(13))
    sizes = [40, 42, 43, 44, 300, 325, 326]
    docs = spark.createDataFrame([(n, window + " x" * (n - 13)) for n in sizes], "doc_id long, text string")
    items = spark.createDataFrame([("i", window)], "item_id string, text string")
    for share in (0.3, 0.04):
        marked = decontaminate.mark_contaminated(docs, items, share=share)
        got = {r.doc_id for r in marked.collect() if r.benchmark_hits.contaminated}
        assert got == {n for n in sizes if 13 * 100 >= n * round(share * 100)}
