"""Language-model scores from a sharded Elias-Fano bigram trie.

Texts are cut into words, A-Z lower-cased, and an end token. The model is a bigram model with
Dirichlet smoothing: p(w|v) = (c(v,w) + mass * p(w)) / (c(v) + mass), where p(w) is the unigram
estimate (c(w) + ADD) / (N + ADD * (V + 1)); the end token stands before the first word.

Nothing grows in one place. Documents are tokenized into blocks with a vocabulary of their own;
the words of all blocks are counted by a shuffle, and words get ids in order of falling counts, so
that the ids of equal counts are a range and the count of any id follows from the ranges (there
are at most sqrt(2 N) different counts, which bounds what is broadcast). Each block sends its
bigrams, sorted and compressed, to shards by a hash of the pair, so a common context is spread
over all shards. A shard merges the training counts of all blocks, writes its trie with quantised
smoothed probabilities to a scratch file, maps it, and answers each block's pairs by successor
search; it returns one partial sum per document.

Null and empty texts are a single end token. Rows with a null doc_id are scored as well. Repeated
rows count as often as they occur. Without training rows every token is unknown.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.elias_fano import Trie
from faultline.session import cut_lineage

#: Added to every count of a token.
ADD = 0.1
#: Text of one block and tokens of one shard: they bound a task's memory, not what is counted.
BLOCK_BYTES = 20 << 20
SHARD_TOKENS = 2_000_000
#: The end token, which no word can be.
END = " "


def squeeze(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers below 256**width, compressed byte plane by byte plane."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


class _Block:
    """Documents whose tokens share a vocabulary."""

    def __init__(self):
        self.size = 0
        self.ids: dict[bytes, int] = {END.encode(): 0}
        self.docs: list = []
        self.held: list[bool] = []
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id, held: bool, text: bytes) -> None:
        ids = self.ids
        words = text.lower().split()
        known = [ids.setdefault(w, len(ids)) for w in words]
        known.append(0)
        self.size += len(text) + 64
        self.docs.append(doc_id)
        self.held.append(held)
        self.tokens.append(np.array(known, dtype=np.uint32))

    def row(self, block: int) -> dict:
        lengths = np.array([len(t) for t in self.tokens])
        tokens = np.concatenate(self.tokens)
        train = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(tokens[train], minlength=len(self.ids))
        return {
            "block": block, "n_tokens": len(tokens),
            "words": [w.decode("utf-8", "replace") for w in self.ids], "counts": counts.tolist(),
            "docs": pickle.dumps((self.docs, self.held, lengths)), "tokens": squeeze(tokens),
        }


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block, from doc_id, held_out and text."""
    schema = pa.schema([
        ("block", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())), ("docs", pa.binary()), ("tokens", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        open_ = _Block()
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                           common.utf8(batch.column("text"))):
                open_.add(*row)
                if open_.size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([open_.row(block)], schema)
                    block, open_ = block + 1, _Block()
        if open_.docs:
            yield pa.RecordBatch.from_pylist([open_.row(block)], schema)

    return docs.mapInArrow(
        run, "block long, n_tokens long, words array<string>, counts array<long>, docs binary, tokens binary")


class Counts:
    """Counts of words by id: ids of one count are a range, the highest count first."""

    def __init__(self, classes: list[tuple[int, int]], tokens: int):
        """`classes` has (count, number of words with it)."""
        classes = sorted(classes, reverse=True)
        self.count = np.array([c for c, _ in classes], dtype=np.int64)
        sizes = np.array([n for _, n in classes], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.words, self.tokens = int(sizes.sum()), tokens
        self.floor = tokens + ADD * (self.words + 1)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The count of each id; 0 for unknown words, whose id is negative."""
        if not len(self.first):
            return np.zeros(len(ids), dtype=np.int64)
        found = self.count[np.searchsorted(self.first, ids, side="right") - 1]
        return np.where(ids < 0, 0, found)

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        return (self.of(ids) + ADD) / self.floor


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _send(block: int, docs: bytes, tokens: bytes, named: np.ndarray,
          counts: Counts, shards: int, mass: float) -> Iterator[tuple[int, int, bytes]]:
    """(part, block, payload): what a block knows itself, and its bigrams for each shard.

    `named` has the ids of the block's words: id in the high half, place in the low half.
    """
    names, held, lengths = pickle.loads(docs)
    local = unsqueeze(tokens)
    known = np.full(int(local.max()) + 1, -1, dtype=np.int32)
    known[named & 0xFFFFFFFF] = named >> 32
    word = known[local]
    del local
    doc = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
    before = np.concatenate([known[:1], word[:-1]])
    before[np.cumsum(lengths) - lengths] = known[0]  # the end token stands before a text
    chance = counts.unigram(word)
    base = np.bincount(doc, np.log10(chance), minlength=len(names))
    n_known = np.bincount(doc, word >= 0, minlength=len(names)).astype(np.int64)
    # Pairs with an unknown word are in no trie.
    plain = (word < 0) | (before < 0)
    seen = counts.of(before[plain])
    direct = np.log10(chance[plain]) + np.where(before[plain] < 0, 0.0, np.log10(mass / (seen + mass)))
    score = np.bincount(doc[plain], direct, minlength=len(names))
    yield -1 - block % shards, block, pickle.dumps((names, held, lengths, n_known, base, score))
    key = before[~plain].astype(np.int64) << 32 | word[~plain]
    doc = doc[~plain]
    del word, before, chance, plain, seen, direct
    shard = _shard_of(key, shards).astype(np.int32)
    order = np.lexsort((key, shard))
    key, doc, shard = key[order], doc[order], shard[order]
    del order
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    flags = np.packbits(held).tobytes()
    for a, b in zip(edges[:-1], edges[1:]):
        contexts = key[a:b] >> 32
        payload = (
            len(names), flags, squeeze(np.diff(contexts, prepend=0)), squeeze(key[a:b] & 0xFFFFFFFF),
            squeeze(doc[a:b], 2 if len(names) <= 1 << 16 else 4),
        )
        yield int(shard[a]), block, pickle.dumps(payload)


def _received(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of documents, keys, documents and whether each occurrence is for training."""
    n, flags, contexts, words, doc = pickle.loads(payload)
    key = np.cumsum(unsqueeze(contexts)) << 32 | unsqueeze(words)
    doc = unsqueeze(doc, 2 if n <= 1 << 16 else 4)
    train = np.unpackbits(np.frombuffer(flags, np.uint8), count=n) == 0
    return n, key, doc, train[doc]


def _answer(payloads: list[bytes], counts: Counts, mass: float) -> Iterator[np.ndarray]:
    """One shard: builds and maps its trie, then yields each block's sums by document."""
    learned = []
    for payload in payloads:
        _, key, _, train = _received(payload)
        learned.append(key[train])
    pairs, number = np.unique(np.concatenate(learned), return_counts=True)
    context, word = pairs >> 32, pairs & 0xFFFFFFFF
    smoothed = (number + mass * counts.unigram(word)) / (counts.of(context) + mass)
    with tempfile.TemporaryFile() as scratch:  # unlinked at once: only this task maps it
        Trie.of(context, word, np.log10(smoothed)).write(scratch)
        trie = Trie.map(scratch)
        for payload in payloads:
            n, key, doc, _ = _received(payload)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            context, word = key[starts] >> 32, key[starts] & 0xFFFFFFFF
            found = trie.look_up(context, word)
            lost = np.isnan(found)
            found[lost] = np.log10(mass * counts.unigram(word[lost]) / (counts.of(context[lost]) + mass))
            every = np.repeat(found, np.diff(np.concatenate([starts, [len(key)]])))
            yield np.bincount(doc, every, minlength=n)


def score_texts(docs: DataFrame, held_out: Column, mass: float = 100.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the rows where `held_out` is false and scores all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    blocks = cut_lineage(_blocks(named), "blocks")

    # Words of all blocks, counted in training texts.
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select(
        "block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = cut_lineage(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    classes = [(r["n"], r["words"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()]
    tokens = sum(c * n for c, n in classes)
    if sum(n for _, n in classes) >= 1 << 31:
        raise ValueError("word ids have 31 bits; raise their width for larger vocabularies")
    counts = Counts(classes, tokens)
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(common.parts(spark), math.ceil(total / SHARD_TOKENS))
    first = spark.createDataFrame(
        [(int(c), int(f)) for c, f in zip(counts.count, counts.first)], "n long, first long")
    vocabulary = cut_lineage(
        common.ranked(counted, "n", ["word"], ["word"]).join(first, "n")
        .select("word", (F.col("first") + F.col("rank")).alias("id")),
        "vocabulary",
    )
    packed = F.shiftleft("id", 32).bitwiseOR(F.col("pos").cast("long"))
    named_words = words.join(vocabulary, "word").select(F.col("block").alias("home"), packed.alias("named"))
    shared = spark.sparkContext.broadcast(counts)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            rows += _send(row["block"], row["docs"], row["tokens"], right.column("named").to_numpy(),
                          shared.value, shards, mass)
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()),
                         "block": pa.array([r[1] for r in rows], pa.int64()),
                         "payload": pa.array([r[2] for r in rows], pa.binary())})

    sent = (
        blocks.select("block", "docs", "tokens").groupBy("block")
        .cogroup(named_words.groupBy("home"))
        .applyInArrow(send, "part long, block long, payload binary")
    )

    def answer(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(["block", "part", "payload"])
        payloads = table.column("payload").to_pylist()
        sums = [s.tobytes() for s in _answer(payloads, shared.value, mass)]
        return pa.table({"block": table.column("block"), "part": table.column("part"),
                         "payload": pa.array(sums, pa.binary())})

    answered = sent.groupBy("part").applyInArrow(answer, "block long, part long, payload binary")

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending")])  # the block's own row, then shards in order
        own, *sums = table.column("payload").to_pylist()
        names, held, lengths, n_known, base, score = pickle.loads(own)
        for part in sums:
            score = score + np.frombuffer(part, np.float64)
        return pa.table({
            "doc_id": pa.array(names, pa.int64()), "held_out": pa.array(held, pa.bool_()),
            "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(names), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return answered.groupBy("block").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
                " base_score double, score double")
