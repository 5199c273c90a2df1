"""Fixed patterns against the contract's patterns, and what counts as random."""

import random
import re
import string

import pytest

from faultline.llm import common, secrets

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def by_force(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_patterns_equal_the_contract():
    rng = random.Random(3)
    parts = ["password", "PassWD", "api_key", "APIKEY", "Token", "secret", "=", ":", " ", '"', "'", "AKIA", "0123456789abcdef",
             "deadbeef", "XYZ", "é", "😀", "\n", "Kk", "ſecret=abcdefghijklmnop", "a.b-c/d+e=f_g", "toKen = hello"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 12)))
        assert secrets.pattern_spans(text) == by_force(text), text


@pytest.mark.parametrize("run, found", [
    ("qX7zR2vLk9TbW4mNs8PjHd3", True),
    ("ghp_9fK2mQ7xZ1vB8nL4rT6wY3cD5", True),
    ("theInternationalOrganisation2024", False),
    ("configuration_file_name_of_project", False),
    ("d41d8cd98f00b204e9800998ecf8427e", False),
    ("D41D8CD98F00B204E9800998ECF8427E", False),
    ("123e4567-e89b-12d3-a456-426614174000", False),
    ("2024-01-01-12-30-59-000000", False),
    ("short9Zx", False)])
def test_random_runs(run, found):
    text = f"see {run} here"
    base = secrets.pattern_spans(text)
    spans = secrets.random_spans(text, base, 2.2, None)
    assert (spans == [(4, 3, 4 + len(run))]) is found


@pytest.mark.parametrize("alphabet, size, least", [
    ("letters", 20, 0.99), ("letters", 24, 0.99), ("letters", 32, 0.99), ("letters", 40, 0.99), ("letters", 16, 0.95),
    ("both", 16, 0.95), ("both", 20, 0.99), ("both", 12, 0.9), ("both", 8, 0.5)])
def test_random_strings_without_digits_and_short_ones_are_judged(alphabet, size, least):
    rng = random.Random(size)
    signs = string.ascii_letters + (string.digits if alphabet == "both" else "")
    runs = ["".join(rng.choices(signs, k=size)) for _ in range(500)]
    found = [bool(secrets.random_spans(r, secrets.pattern_spans(r), 2.2, None)) for r in runs]
    assert sum(found) >= least * len(runs)


def test_words_and_identifiers_are_no_secrets():
    words = "international understanding configuration organisationally getElementById parseHttpResponse snake_case_name HTTPServer2 " \
            "camelCaseIdentifierNames some/path/to/file2024 well-known-words 20240101 2024-01-01".split()
    assert [w for w in words if secrets.random_spans(w, [], 2.2, None)] == []


def test_base_spans_stay_and_nothing_overlaps():
    text = "token = qX7zR2vLk9TbW4mNs8PjHd3 and qX7zR2vLk9TbW4mNs8PjHd3"
    *counts, digest, written, spans = secrets.scan_text(text, 2.2)
    assert counts == [1, 0, 0, 1] and written == "assign:0:31,random:36:59"
    assert secrets.redacted(text, spans, "[x]") == "[x] and [x]"
    assert secrets.redacted("abcdef", [(1, 0, 4), (2, 2, 5)], "-") == "a-f"


def test_tables(spark):
    common.prepare(spark)
    rows = [(1, None), (2, ""), (3, "password=abcdefghijkl"), (3, "password=abcdefghijkl"), (None, "x" * 200000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = secrets.scan(df)
    assert got.columns == ["doc_id", "text", "spans", "secrets"]
    found = sorted((r.doc_id or 0, r.secrets.n_assign, r.secrets.spans) for r in got.collect())
    assert found == [(0, 0, ""), (1, 0, ""), (2, 0, ""), (3, 1, "assign:0:21"), (3, 1, "assign:0:21")]
    assert secrets.scan(df.limit(0)).count() == 0
