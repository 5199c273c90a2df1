"""Benchmark decontamination: Wu-Manber search for the word windows of test items.

Texts become words; every window of `window` consecutive item words is a pattern (an item with
fewer words is one pattern). Patterns of one length share a shift table over word pairs: the pair
at the end of the current place says how far the search may skip without missing a match, and only
a shift of zero leads to the bucket of patterns that end in this pair, whose words are compared.

Null and wordless texts have no words and no hits. Items without words have no pattern; repeated
items and equal windows are one pattern with all their ids; an item without id counts with the
empty text as id. An empty benchmark finds nothing.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import common

#: Characters of items whose tables go to the tasks together; more items make more tables.
TABLE_CHARS = 16 << 20
#: A-Z lower-cased; what is no digit, no letter and not beyond ASCII becomes a blank.
_WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32
    for i in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class ShiftTable:
    """Wu-Manber tables for patterns of `length` words."""

    def __init__(self, length: int, patterns: dict[tuple, tuple]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.skip), length - end)
            self.bucket[words[-self.block:]].append((list(words), items))

    def search(self, words: list[bytes]):
        """(first word, items) of every occurrence."""
        length, skip, shift, block = self.length, self.skip, self.shift, self.block
        end, n = length, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.bucket[key]:
                if words[start] == pattern[0] and words[start:end] == pattern:
                    yield start, items
            end += 1


def build_tables(items: list[tuple[str, bytes]], window: int) -> list[ShiftTable]:
    """One table per pattern length, from (item id, text)."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            by_length[size][tuple(words[at:at + size])].add(item)
    return [
        ShiftTable(size, {w: tuple(sorted(ids)) for w, ids in patterns.items()})
        for size, patterns in sorted(by_length.items())
    ]


def hits(text: bytes, tables: list[ShiftTable]) -> tuple[int, list[int], set[str]]:
    """Number of words, hit words as merged start/end pairs, ids of the items found."""
    words = words_of(text)
    found, ids = [], set()
    for table in tables:
        for start, items in table.search(words):
            found.append((start, start + table.length))
            ids.update(items)
    return len(words), merged(found), ids


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _search_column(text: Column, items: list[tuple[str, bytes]], window: int) -> Column:
    tables: list[ShiftTable] = []

    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def search(column: pd.Series) -> pd.DataFrame:
        if not tables:
            tables.extend(build_tables(items, window))
        rows = [hits(t, tables) for t in common.utf8(pa.array(column, pa.string()))]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "spans": [r[1] for r in rows],
                             "items": [sorted(r[2]) for r in rows]})

    return search(text)


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: float = 0.05,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "benchmark_hits",
) -> DataFrame:
    """Adds a struct (n_words, n_hit, items, contaminated) to every row; other columns stay.

    A document is contaminated if words are hit and these are at least `share` of its words.
    The benchmark is read in groups of about TABLE_CHARS characters, one table set each. Its items are
    collected and shipped with the functions that search them, so driver and workers hold a benchmark
    as a whole; it is a fixed test set and does not grow with the documents.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(item_text), F.lit("")).alias("body"),
    )
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = -(-size // TABLE_CHARS) or 1
    found = []
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(groups)) == group)
        rows = sorted({(r["id"], r["body"].encode()) for r in part.collect()})
        name = f"{into}_{group}"
        docs = docs.withColumn(name, _search_column(F.col(text), rows, window))
        found.append(name)

    least = Fraction(str(share))
    @F.pandas_udf("long")
    def covered(spans: pd.Series) -> pd.Series:
        # Groups overlap; merging counts a word once.
        out = []
        for flat in spans:
            pairs = merged([(flat[i], flat[i + 1]) for i in range(0, len(flat), 2)])
            out.append(sum(pairs[1::2]) - sum(pairs[::2]))
        return pd.Series(out, dtype="int64")

    spans = F.concat(*(F.col(f"`{n}`.spans") for n in found))
    if groups == 1:  # already merged: ends minus starts
        n_hit = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("sign")),
                            lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")),
                            lambda a: a["sum"])
    else:
        n_hit = covered(spans)
    n_words = F.col(f"`{found[0]}`.n_words")
    listed = F.array_sort(F.array_distinct(F.concat(*(F.col(f"`{n}`.items") for n in found))))
    return docs.withColumn(
        into,
        F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), listed.alias("items"),
                 ((n_hit > 0) & (n_hit * least.denominator >= n_words * least.numerator)).alias("contaminated")),
    ).drop(*found)


def digest_of(items: Column) -> Column:
    """sha256 of the item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
