"""Elias-Fano sequences and an n-gram trie of them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import mmap
import struct
from typing import BinaryIO

import numpy as np

_ZEROS = np.array([8 - bin(i).count("1") for i in range(256)], dtype=np.int64)


class MonotoneSequence:
    """A sequence of non-decreasing numbers: low bits packed, high bits unary.

    Element i sits in the unary part as the (i + 1)-th one, its high part being the number of zeros
    before it. `directory` holds the zeros before each stretch of 8 bytes.
    """

    STRETCH = 8  # bytes of the unary part between directory entries

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> MonotoneSequence:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = _pack(values & np.uint64((1 << low_bits) - 1), low_bits)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(ones[-1]) if n else 0) // 8 + 1 + 7) // 8 * 8, dtype=np.uint8)
        np.bitwise_or.at(bits, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        zeros = _ZEROS[bits]
        before = np.concatenate([[0], np.cumsum(zeros)])[:-1]
        return cls(n, low_bits, low, bits, before[::cls.STRETCH].astype(np.uint32))

    def _zeros_end(self, k: np.ndarray) -> np.ndarray:
        """The bit position right after the k-th zero (k from 1); 0 for k = 0. Beyond all: the end."""
        start = np.maximum(np.searchsorted(self.directory, k, side="left") - 1, 0)
        byte = start * self.STRETCH
        rest = k - self.directory[start].astype(np.int64)
        last = len(self.high)
        out = np.zeros_like(k)
        rows = np.flatnonzero(k > 0)
        byte, rest = byte[rows], rest[rows]
        while len(rows):  # byte by byte, at most STRETCH of them
            here = _ZEROS[self.high[np.minimum(byte, last - 1)]]
            over = byte >= last
            ends = over | (here >= rest)
            done, at = rows[ends], byte[ends]
            found = 8 * at + _NTH_ZERO[self.high[np.minimum(at, last - 1)], np.minimum(rest[ends], 8)] + 1
            out[done] = np.where(over[ends], 8 * last + rest[ends], found)
            rows, rest, byte = rows[~ends], (rest - here)[~ends], byte[~ends] + 1
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Successor search: the position of the first element >= each wanted number (n if none)."""
        wanted = np.asarray(wanted, dtype=np.int64)
        if not self.n:
            return np.zeros(len(wanted), dtype=np.int64)
        high = wanted >> self.low_bits
        low = wanted & ((1 << self.low_bits) - 1)
        # Elements with the same high part stand between two zeros; their low parts are sorted.
        start = np.minimum(self._zeros_end(high) - high, self.n)
        stop = np.minimum(self._zeros_end(high + 1) - 1 - high, self.n)
        rows = np.flatnonzero(start < stop)
        while len(rows):
            middle = (start[rows] + stop[rows]) >> 1
            less = self._low(middle) < low[rows]
            start[rows[less]] = middle[less] + 1
            stop[rows[~less]] = middle[~less]
            rows = rows[start[rows] < stop[rows]]
        return start

    def _low(self, at: np.ndarray) -> np.ndarray:
        return _unpack(self.low, self.low_bits, np.minimum(at, max(self.n - 1, 0)))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        high = ones - np.arange(self.n)
        return (high << self.low_bits) | self._low(np.arange(self.n))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Elements at positions; by the decoded high parts of the whole sequence, kept once."""
        if not hasattr(self, "_decoded"):
            self._decoded = self.values()
        return self._decoded[at]

    def write(self, out: BinaryIO) -> None:
        out.write(struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.directory)))
        for part in (self.low, self.high, self.directory):
            raw = part.tobytes()
            out.write(raw + bytes(-len(raw) % 8))

    @classmethod
    def read(cls, buffer, at: int) -> tuple[MonotoneSequence, int]:
        n, low_bits, n_low, n_high, n_dir = struct.unpack_from("<qqqqq", buffer, at)
        at += 40
        parts = []
        for count, kind in ((n_low, np.uint8), (n_high, np.uint8), (n_dir, np.uint32)):
            parts.append(np.frombuffer(buffer, kind, count, at))
            at += -(-count * np.dtype(kind).itemsize // 8) * 8
        return cls(n, low_bits, *parts), at


def _nth_zero_table() -> np.ndarray:
    table = np.zeros((256, 9), dtype=np.int64)
    for value in range(256):
        zeros = [b for b in range(8) if not value >> b & 1]
        for k, b in enumerate(zeros):
            table[value, k + 1] = b
    return table


_NTH_ZERO = _nth_zero_table()


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(0, dtype=np.uint8)
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.ravel(), bitorder="little")
    return np.concatenate([packed, np.zeros(8, dtype=np.uint8)])  # a word can be read at any place


def _unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=np.int64)
    bit = at * width
    byte = bit >> 3
    word = np.zeros(len(at), dtype=np.uint64)
    for k in range((width + 7) // 8 + 1):
        word |= packed[np.minimum(byte + k, len(packed) - 1)].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


class Trie:
    """Contexts with their successors and one quantised probability per successor.

    Level 1 is the sorted context ids, with pointers to where their successors start in level 2.
    Successor ids only grow within a context; each is stored as its id plus the running offset of
    its context, so that the whole level is one monotone sequence. A search for a successor adds
    the context's offset and looks for the first element that is as large.
    """

    def __init__(self, contexts: MonotoneSequence, pointers: MonotoneSequence, offsets: MonotoneSequence,
                 successors: MonotoneSequence, codes: np.ndarray, book: np.ndarray):
        self.contexts, self.pointers, self.offsets = contexts, pointers, offsets
        self.successors, self.codes, self.book = successors, codes, book

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, log_probability: np.ndarray, levels: int = 256) -> Trie:
        """From pairs sorted by context and successor, each once."""
        ids, start, count = np.unique(context, return_index=True, return_counts=True)
        largest = np.maximum.reduceat(successor, start) if len(ids) else np.zeros(0, np.int64)
        # The next context begins above the last successor of this one.
        offsets = np.concatenate([[0], np.cumsum(largest + 1)]).astype(np.int64)
        book, codes = quantise(log_probability, levels)
        return cls(
            MonotoneSequence.of(ids), MonotoneSequence.of(np.concatenate([start, [len(context)]])),
            MonotoneSequence.of(offsets), MonotoneSequence.of(successor + np.repeat(offsets[:-1], count)),
            codes, book,
        )

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """log10 probability of each pair; NaN where the trie does not have it."""
        out = np.full(len(context), np.nan)
        if not self.contexts.n or not len(context):
            return out
        place = self.contexts.find(context)
        known = place < self.contexts.n
        known[known] = self.contexts[place[known]] == context[known]
        rows = np.flatnonzero(known)
        if not len(rows):
            return out
        place = place[rows]
        target = successor[rows] + self.offsets[place]
        at = self.successors.find(target)
        # Within this context's range, and equal.
        good = (target < self.offsets[place + 1]) & (at < self.pointers[place + 1])
        good[good] = self.successors[at[good]] == target[good]
        out[rows[good]] = self.book[self.codes[at[good]]]
        return out

    def write(self, out: BinaryIO) -> None:
        for part in (self.contexts, self.pointers, self.offsets, self.successors):
            part.write(out)
        out.write(struct.pack("<qq", len(self.codes), len(self.book)))
        out.write(self.book.astype("<f8").tobytes())
        out.write(self.codes.tobytes())

    @classmethod
    def map(cls, file: BinaryIO) -> Trie:
        """The trie in a file, read through a memory map."""
        file.flush()
        buffer = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at, parts = 0, []
        for _ in range(4):
            part, at = MonotoneSequence.read(buffer, at)
            parts.append(part)
        n_codes, n_book = struct.unpack_from("<qq", buffer, at)
        book = np.frombuffer(buffer, "<f8", n_book, at + 16)
        codes = np.frombuffer(buffer, np.uint8, n_codes, at + 16 + 8 * n_book)
        return cls(*parts, codes, book)


def quantise(values: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """A code book of at most `levels` numbers and a code per value: steps of equal height between
    the extremes, each with the mean of its values, so no value is off by more than a step."""
    if not len(values):
        return np.zeros(1), np.zeros(0, dtype=np.uint8)
    distinct = np.unique(values)
    if len(distinct) <= levels:
        return distinct, np.searchsorted(distinct, values).astype(np.uint8)
    edges = np.linspace(distinct[0], distinct[-1], levels + 1)[1:-1]
    codes = np.searchsorted(edges, values, side="right")
    total = np.bincount(codes, values, minlength=len(edges) + 1)
    number = np.bincount(codes, minlength=len(edges) + 1)
    return total / np.maximum(number, 1), codes.astype(np.uint8)
