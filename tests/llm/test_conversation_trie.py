"""Nodes of the prefix trie against a trie of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from faultline.llm import common, conversation_trie, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def settings(spark):
    common.prepare(spark)


def rebuilt(rows):
    """conv_id -> turns; turns with one number in the order of their ids."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    return built


def nodes_of(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    below = {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        kids = [below[k] for k in children[key]]
        below[key] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
    return sorted(
        (min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children[key]), *below[key],
         hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest())
        for key, m in members.items()
    )


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


SCHEMA = "conv_id long, turn long, role string, text string, place int, id string, node string"


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 3, "x", None) for r in rows], SCHEMA).repartition(4)
    turns, convs = conversation_trie.share_heads(conversation_trie.ordered_turns(df))
    found = as_rows(conversation_trie.prefix_trie(turns, convs, **kw))
    assert found == nodes_of(rebuilt(rows))
    return found


def random_rows(rng, convs, longest, words="ab"):
    rows = []
    for c in rng.sample(range(350), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(words) * 2))
    return rows


@pytest.mark.parametrize("segment, container", [(1024, 100_000), (3, 4), (1, 1), (4, 10)])
def test_random_conversations(spark, segment, container):
    """Small bounds make containers burst and conversations span many segments."""
    rows = random_rows(random.Random(segment), 60, 9)
    # Copies that end at, before and after a segment's border.
    for c, size in ((401, 8), (402, 8), (403, 6), (404, 6), (405, 7), (406, 12), (407, 12)):
        rows += [(c, i, "user", f"t{i}") for i in range(size)]
    check(spark, rows, segment=segment, container=container)


def test_odd_rows(spark):
    rows = [
        (7, None, None, None), (7, 0, "user", None), (7, 0, "user", "hé"), (7, 0, "user", "hé"), (None, 1, "user", "lost"),
        (8, 5, "", ""), (8, None, "a", "long " * 5000), (-3, 1, "user", "x"), (-103, 1, "user", "x"), (-100, 0, "user", "\U0001F600"),
        (9, 1, "1:", "x"), (10, 1, "1", ":x"), (2**62, 0, "user", "far"), (200, 1, "user", "base"), (200, 2, "user", "base"),
    ]
    rows += [(c, 1, "user", "only one") for c in range(201, 240)]
    found = check(spark, rows, segment=2, container=3)
    assert found[0][1] == 0 and found[0][2] is None


def test_many_copies_fold_before_anything_bursts(spark):
    """Long common beginnings: containers lose them at once, in few rounds."""
    rows = [(c, i, "user", f"t{i}") for c in range(120, 180) for i in range(20 + c % 3)]
    check(spark, rows, container=30)
    df = spark.createDataFrame([(*r, 3, "x", None) for r in rows], SCHEMA)
    turns = conversation_trie.ordered_turns(df)
    sizes = turns.groupBy("conv_id").count().withColumnRenamed("count", "size")
    parts = conversation_trie.segments(turns, sizes, 1024)
    suffixes = conversation_trie.folded_suffixes(parts, 1024)
    assert suffixes.count() == 3
    _, bursts = conversation_trie.burst(suffixes, 30)
    assert len(bursts) == 1 and bursts[0].first()["common"] == 20


def test_one_container_of_many_copies_gives_one_digest(spark):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    ended = spark.createDataFrame([(b"k", r[0]) for r in rows] + [(b"j", 5)], "key binary, conv_id long")
    found = {bytes(r.key): (r.n, r.least, r.ends) for r in conversation_trie.end_digests(ended).collect()}
    listed = ",".join(str(c) for c in range(3000))
    assert found == {b"k": (3000, 0, hashlib.sha256(listed.encode()).hexdigest()), b"j": (1, 5, hashlib.sha256(b"5").hexdigest())}


def test_empty_table(spark):
    turns, convs = conversation_trie.share_heads(conversation_trie.ordered_turns(spark.createDataFrame([], SCHEMA)))
    assert conversation_trie.prefix_trie(turns, convs).count() == 0


def test_query_equals_its_twin(spark):
    problem = compare(queries.QUERIES["op12_conversation_trie"](spark, SF), connect(SF), queries.ORACLES["op12_conversation_trie"])
    assert problem is None, problem
