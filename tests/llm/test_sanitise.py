"""Native patterns against Python's, and disclosure by co-occurrence."""

import random
import re

from pyspark.sql import functions as F

from faultline.llm import common, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_force(text):
    text = text or ""
    digits = [re.sub("[^0-9]", "", m[0]) for m in CARD.finditer(text)]
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m, d in zip(CARD.finditer(text), digits) if 12 <= len(d) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_patterns_equal_the_contract(spark):
    common.prepare(spark)
    rng = random.Random(5)
    parts = [*"ab.@-_+ 19", "4111111111111111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", "é", "\n", "😀", "256.1.1.1",
             "a@b.c_d@e.f.g", "0001.2.3.255", "5500-0000 0000-0004"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(2500)]
    texts += [None, "", "a" * 30000 + "@b", "1 " * 30000, "a@" + "b." * 30000 + "c", "1.2" * 20000, "@" * 1000, "+1" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", sanitise.written(sanitise.pattern_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for r in got:
        assert r.s == by_force(texts[r.doc_id]), texts[r.doc_id][:200]


COMMON = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro", "su", "ti") for b in ("ban", "den", "fin", "gor", "hal", "jut")]


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = rng.choices(COMMON, k=40)
        text = " ".join(words)
        if i % 20 == 0:
            text += " Zorblat 4477 wrote from jo@x.org " + " ".join(rng.choices(COMMON, k=8))
        rows.append((i, text))
    # Copies of one text, exact and near: many rows, one context and some like it.
    copy = "unique words beside this card 4111111111111111 in one place"
    rows += [(1000 + i, copy) for i in range(30)]
    rows += [(1100 + i, copy.replace("words", f"word{i}").replace("card", "mail") .replace("4111111111111111", "z@y.org")) for i in range(12)]
    return rows + [(2000, "zorblat was seen"), (2000, "zorblat was seen"), (None, None), (2001, "")]


def test_terms_that_reveal_an_entity(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus()], "doc_id long, text string, hash int, base string")
    found = sanitise.find_personal_data(df).select("doc_id", sanitise.written(F.col("spans")).alias("s")).collect()
    assert len(found) == df.count()
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append(r.s)
    assert spans[2000] == ["term:0:7"] * 2
    assert all("term" in s and "email" in s for i in range(0, 300, 20) for s in spans[i])
    assert all(s == [""] for i, s in spans.items() if i in range(1, 300) and i % 20)
    assert spans[1000] == ["card:30:46"] and "term" not in spans[1100][0]
    assert spans[None] == [""] and spans[2001] == [""]
    clean = sanitise.sanitise(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[2000] == "[removed] was seen" and texts[None] is None
    assert "[removed] [number] [removed]" in texts[0] and "[email]" in texts[0]
    assert texts[1] == dict(corpus())[1]


def test_stereotyped_surroundings_and_few_words_reveal(spark):
    """Terms of an entity whose contexts are alike, of one with two texts, and in a corpus of few words."""
    common.prepare(spark)
    rng = random.Random(4)
    few = "the house green river walks slowly over many hills and sings loud songs about winter rain".split()
    rows = [(i, " ".join(rng.choices(few, k=40))) for i in range(300)]
    for i in range(0, 300, 20):
        rows[i] = (i, rows[i][1] + " Zorblat 4477 wrote from jo@x.org " + " ".join(rng.choices(few, k=8)))
    letter = "quarterly greetings from your friends reply always to Marlowe at pat@q.org before the closing of our offices in spring "
    rows += [(1000 + i, letter + " ".join(rng.choices(few, k=30))) for i in range(9)]
    rows += [(1100, "Brimsel told kim@w.org " + rows[1][1]), (1101, rows[2][1] + " kim@w.org met Brimsel " + rows[3][1])]
    rows += [(1200 + i, f"copy {i} of Tarnow for lee@v.org") for i in range(5)]
    df = spark.createDataFrame(rows + [(2000, "marlowe and brimsel and zorblat but no tarnow")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert texts[2000] == "[removed] and [removed] and [removed] but no tarnow"
    assert all("[removed] [number] [removed] [removed] [email]" in texts[i] for i in range(0, 300, 20))
    assert all("Marlowe" not in texts[1000 + i] for i in range(9)) and "Brimsel" not in texts[1100] + texts[1101]
    assert all(texts[i] == rows[i][1] for i in range(1, 300) if i % 20)


def test_empty_table(spark):
    common.prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sanitise.find_personal_data(df).count() == 0 and sanitise.sanitise(df).count() == 0


def test_no_python_runs_on_the_executors(spark):
    common.prepare(spark)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = sanitise.find_personal_data(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonSQL", ""))
