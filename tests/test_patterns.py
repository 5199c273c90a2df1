"""The gram index of LIKE patterns, and audits by bucket digests, against plain comparison."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import audit as A
from faultline.operators import evidence as E


def matches(value, pattern, ignore_case):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    value, out = (value.lower(), out.lower()) if ignore_case else (value, out)
    return re.fullmatch(out, value, re.S) is not None


def check(spark, patterns, values):
    rows = [(i, "c", p, ic, t) for i, (p, ic, t) in enumerate(patterns)]
    df = spark.createDataFrame(rows, "pattern_id int, column string, pattern string, ignore_case boolean, target string")
    domain = spark.createDataFrame([("c", v) for v in values] + [("other", "elsewhere")], "column string, value string")
    got = {r.pattern_id: (r.matches, r.binds) for r in E.pattern_bindings(df, domain).collect()}
    for i, (pattern, ignore_case, target) in enumerate(patterns):
        hits = [v for v in values if v is not None and pattern is not None and matches(v, pattern, ignore_case)]
        assert got[i] == (len(hits), len(hits) == 1 and hits[0] == target), (pattern, ignore_case, hits[:3])


@pytest.mark.parametrize("seed", range(2))
def test_random_patterns(spark, monkeypatch, seed):
    monkeypatch.setattr(E, "POSTINGS", 7)
    rng = random.Random(seed)
    values = sorted({"".join(rng.choice("abAB_%\\é") for _ in range(rng.randint(0, 7))) for _ in range(250)})
    patterns = []
    for _ in range(250):
        text = "".join(rng.choice(["a", "b", "A", "B", "%", "%", "_", "\\%", "\\_", "\\\\", "é"]) for _ in range(rng.randint(0, 6)))
        patterns.append((text, rng.random() < 0.5, rng.choice(values)))
    check(spark, patterns, values)


def test_odd_patterns(spark):
    values = ["", "pod-1", "Pod-1", "pod-22", "svc", "a\nb", "%", None, "\x02x", "x\x03"]
    texts = ["", "%", "_", "%_", "__", "___%", "pod-1", "pod-%", "%22", "%d-2%", "s_c", "\\%", "a%b", "%x", "x%", "nothing like it", None]
    check(spark, [(p, ic, "pod-1") for p in texts for ic in (False, True)], values)


def test_a_telling_literal_meets_few_values(spark):
    values = spark.range(20_000).select(F.lit("c").alias("column"), F.concat(F.lit("node-"), F.col("id")).alias("value"))
    rows = [(0, "c", "%node-%77%", False, "t"), (1, "c", "%-19999", True, "node-19999"), (2, "c", "node-4%", False, "t")]
    patterns = spark.createDataFrame(rows, "pattern_id int, column string, pattern string, ignore_case boolean, target string")
    asked = E._pattern_grams(patterns)
    visited = Counter(r.pattern for r in E.pattern_candidates(asked, values).collect())
    # Anchored text and rare grams decide; nothing compares the whole domain but what is in all of it.
    assert visited["%-19999"] < 60 and visited["%node-%77%"] < 6_000 and visited["node-4%"] < 20_000
    found = {r.pattern_id: (r.matches, r.binds) for r in E.pattern_bindings(patterns, values).collect()}
    assert found[1] == (1, True) and found[2] == (1 + 10 + 100 + 1000, False)


def record(rng):
    return (rng.choice([None, 0, 1, 2]), rng.choice([None, "", "a", "b"]), rng.choice([0.0, -0.0, 1.5, float("nan")]))


def test_audits_equal_counting(spark):
    rng = random.Random(4)
    source = [record(rng) for _ in range(300)]
    stored = source[:280] + [record(rng) for _ in range(15)]
    kinds = "a long, b string, v double"
    left, right = spark.createDataFrame(source, kinds), spark.createDataFrame(stored, "a int, b string, v double")

    def key(r):
        return r[0], r[1], "nan" if r[2] != r[2] else r[2] + 0.0

    s, t = Counter(map(key, source)), Counter(map(key, stored))
    for buckets in (1, 7, 1024):
        row = A.multiset_difference(left, right, ["a", "b", "v"], buckets).first()
        assert (row.source_rows, row.stored_rows) == (300, 295)
        assert (row.missing_rows, row.extra_rows) == ((s - t).total(), (t - s).total())
        same = A.multiset_difference(left, left, ["a", "b", "v"], buckets).first()
        assert same.equal and same.source_rows == 300
    row = A.presence_difference(left, right, ["a", "b", "v"]).first()
    assert row.distinct_source_records == len(s) and row.missing_records == len(set(s) - set(t))
    assert row.extra_records == (t - s).total()
    empty = left.limit(0)
    assert A.multiset_difference(empty, empty, ["a", "b", "v"]).first().equal
    assert A.multiset_difference(empty, left, ["a", "b", "v"]).first().extra_rows == 300


def test_null_and_its_place_count(spark):
    one = spark.createDataFrame([(None, "a")], "x string, y string")
    two = spark.createDataFrame([("a", None)], "x string, y string")
    assert not A.multiset_difference(one, two, ["x", "y"]).first().equal
    assert A.presence_difference(one, two, ["x", "y"]).first().missing_records == 1


def test_shared_gates_take_one_pass(spark):
    rows = [("0" * 31 + "1", "0" * 15 + "1", "", "svc", 2, 0), ("0" * 31 + "1", "0" * 15 + "2", "", "unknown", 2, 0)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service_name string, kind int, status int")
    gates = {r.gate: r.passed for r in A.gate_table({}, [A.span_gates(spans)]).collect()}
    assert gates == {"spans_unique": True, "source_trace_identity_valid": True, "service_names_declared": False,
                     "ids_fit_the_protocol": True, "all_passed": False}
