"""Best-fit packing by exact complements.

Documents become token ids with an end id; longer ones are cut, the first piece taking the
remainder. Only the number of pieces of each length (at most `size` numbers) is needed to plan:
from the longest length down, single, pair and triple sums of other lengths that fill the gap
exactly are looked up and used as often as their counts allow; what is left goes by best fit.
The plan says which ranks of a length go to which sequences, so each piece finds its place from its
length and its rank, and no task or driver sees all pieces.

A null text is empty and has the end id only. Repeated rows are packed as often as they occur.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.vocabulary import byte_pair_encoder
from faultline.session import cut_lineage

END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces_of(docs: DataFrame, size: int, vocabulary: str | None = None) -> DataFrame:
    """Tokenizes whole texts; one row per piece with the checksum of its ids."""

    def run(batch: pa.RecordBatch) -> dict:
        encode = byte_pair_encoder(vocabulary).encode_ordinary
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch.column("text"))):
            ids = np.array([*encode(text), END_ID], dtype="<u4")
            for k, (start, length) in enumerate(cut(len(ids), size)):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(ids[start:start + length].tobytes()))
        return out

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def _fits(parts: tuple[int, ...], left: np.ndarray) -> int:
    """How many times the parts can be taken."""
    need: dict[int, int] = defaultdict(int)
    for p in parts:
        need[p] += 1
    return min(int(left[p]) // k for p, k in need.items())


def _complements(gap: int, most: int, left: np.ndarray):
    """Parts of at most `most` each, one to three of them, that sum to `gap`; longest first."""
    if 0 < gap <= most and left[gap]:
        yield (gap,)
    lengths = np.flatnonzero(left[:min(most, gap - 1) + 1])[::-1] if gap > 1 else []
    for a in map(int, lengths):
        if 0 < gap - a <= a and left[a] and left[gap - a]:
            yield a, gap - a
    for a in map(int, lengths):
        if 3 * a < gap:
            break
        rest = gap - a
        for b in map(int, lengths[np.searchsorted(-lengths, -a):]):
            if 2 * b < rest:
                break
            c = rest - b
            if 0 < c <= b and left[a] and left[b] and left[c]:
                yield a, b, c


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); uses every piece once.

    Each exact step uses up a length, and each best-fit step a length or a gap, so the plan has a
    few entries per length at any number of pieces.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    for length in range(size - 1, 0, -1):
        if not left[length]:
            continue
        for parts in _complements(size - length, length, left):
            whole = (length, *parts)
            times = _fits(whole, left)
            if times:
                for p in whole:
                    left[p] -= times
                out.append((whole, times))
            if not left[length]:
                break
    # Best fit of the rest: open sequences by gap.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length and open_[g]), default=None)
            if gap is None:
                each = size // length
                bins, body, gap = -(-n // each), (), size
            else:
                body, bins = open_[gap].pop()
                each = gap // length
            filled = min(bins, n // each)
            if filled:
                open_[gap - each * length].append((body + (length,) * each, filled))
                n -= filled * each
                bins -= filled
            if bins and n:
                open_[gap - n * length].append((body + (length,) * n, 1))
                n, bins = 0, bins - 1
            if bins and body:
                open_[gap].append((body, bins))
    out += [entry for entries in open_.values() for entry in entries]
    return out


class Places:
    """The plan turned around: for each length, which ranks go to which sequence and offset."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in planned:
            offset = 0
            for length in lengths:
                slots[length].append((ranks[length], sequence, offset))
                ranks[length] += times
                offset += length
            sequence += times
        self.sequences = sequence
        self.slots = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for own in np.unique(length):
            rows = length == own
            table = self.slots[int(own)]
            at = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
            offset[rows] = table[at, 2]
        return sequence, offset


def pack(docs: DataFrame, size: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens; one row per piece."""
    pieces = cut_lineage(pieces_of(docs, size, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan(counts, size))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = common.ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece"])
    found = found.withColumn("place", place("length", "rank"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32",
                        F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))
