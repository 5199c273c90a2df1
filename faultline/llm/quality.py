"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

A text becomes a tf-idf vector of hashed byte trigrams, of trigrams of its character shapes
(a for lower case, A for upper case, 0 for digits, other signs as they are) and of the number of
words that repeat the one before. Latent-semantic
analysis of a bounded sample of labelled documents gives the projection; the labelled vectors are
broadcast and every document is compared with all of them by exact cosine products, block by
block. The `neighbours` most similar vote for their label, weighted by a power of their cosine.

Nulls count as empty texts. An empty text has a zero vector, no neighbour, and the share of
label 1 in the sample as its score; without any label the score is 0.5. Repeated labelled rows
vote as often as they occur; ties among neighbours fall to the smaller position in the sample,
which is ordered by a hash of the id and the label. Labels that are null or not 0 or 1 are left out.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import common

#: Hash buckets of raw trigrams, and of shape trigrams.
RAW, SHAPE = 1024, 1024
#: Equal places for the number of words that repeat the one before, so that it weighs enough.
REPEAT = 64
WIDTH = RAW + SHAPE + REPEAT
#: Of the cosine as a vote's weight: where one label is rare, its nearest votes must not drown.
POWER = 8
#: Fixed shapes of bytes: letters by case, digits as 0, bytes of other letters as b.
_SHAPES = bytes(
    ord("a") if 97 <= i <= 122 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57
    else ord("b") if i >= 128 else i
    for i in range(256)
)


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of the whole text; a blank stands on either side."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    for at, size, body in ((0, RAW, text.lower()), (RAW, SHAPE, text.translate(_SHAPES))):
        codes = np.frombuffer(b" " + body + b" ", dtype=np.uint8).astype(np.uint32)
        grams = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
        slots = (grams * np.uint32(2654435761)) >> np.uint32(22)
        out[at:at + size] = np.bincount(slots, minlength=size)
    words = text.split()
    out[RAW + SHAPE:] = sum(map(operator.eq, words, words[1:]))
    return out


def trigram_matrix(column: list[bytes]) -> np.ndarray:
    """One row per text: log-scaled counts."""
    rows = np.stack([trigram_counts(t) for t in column]) if column else np.zeros((0, WIDTH), np.float32)
    return np.log1p(rows)


@dataclass(frozen=True)
class Neighbours:
    """A fitted model. Its size is bounded by the sample bound: sample x dimensions."""

    weights: np.ndarray  # idf by bucket
    centre: np.ndarray
    basis: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    neighbours: int

    def embed(self, grams: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length; zero for empty texts."""
        filled = grams.any(axis=1)
        x = grams * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = (x - self.centre) @ self.basis
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        z[~filled] = 0
        return z

    def votes(self, z: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled vectors."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(z), prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        cosines = z @ self.vectors.T
        # The k largest; of those equal to the smallest of them, the first positions.
        last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1:k]
        above, level = cosines > last, cosines == last
        wanted = k - above.sum(axis=1, keepdims=True)
        near = np.nonzero(above | (level & (level.cumsum(axis=1) <= wanted)))[1].reshape(len(z), k)
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** POWER
        total = weight.sum(axis=1)
        some = total > 0
        out[some] = (weight * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit_neighbours(
    docs: DataFrame,
    labels: DataFrame,
    bound: int = 4000,
    dimensions: int = 16,
    neighbours: int = 15,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
) -> Neighbours:
    """Fits on the documents of at most `bound` label rows, those with the smallest hash.

    The bound is what keeps the broadcast model small; it is the only sample taken. The chosen
    label rows are few, so they go to the documents, and only chosen texts are shuffled. Equal rows of
    a document count once for each of its label rows; where chosen ids have many texts, the bound holds for their rows too.
    """
    usable = labels.select(
        F.col(key).alias("labelled"), F.col(label).cast("int").alias("label"),
        F.xxhash64(F.col(key), F.col(label)).alias("place"),
    ).where(F.col("label").isin(0, 1) & F.col("labelled").isNotNull())
    chosen = common.smallest(usable, "place", ["label"], bound).withColumn("copy", F.monotonically_increasing_id())
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("key") == F.col("labelled")).select("text", "label", "place", F.xxhash64("text").alias("body"), "copy")
    order = ["place", "label", "body", "copy"]
    sample = sample.dropDuplicates(order).orderBy(*order).limit(bound).repartition(common.parts(docs.sparkSession))
    rows = common.map_batches(
        sample,
        lambda b: {
            "label": b.column("label").to_pylist(),
            "place": b.column("place").to_pylist(),
            "grams": [r.tobytes() for r in trigram_matrix(common.utf8(b.column("text"))).astype(np.float16)],
        },
        "label int, place long, grams binary",
    ).collect()
    rows.sort(key=lambda r: (r["place"], r["label"], bytes(r["grams"])))
    labels = np.array([r["label"] for r in rows], dtype=np.float64)
    grams = np.array([np.frombuffer(r["grams"], np.float16) for r in rows], dtype=np.float32).reshape(-1, WIDTH)
    if not len(rows):
        zero = np.zeros((WIDTH, 1), np.float32)
        return Neighbours(np.ones(WIDTH, np.float32), zero[:, 0], zero, np.zeros((0, 1), np.float32), labels, neighbours)
    frequency = (grams > 0).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + frequency)).astype(np.float32) + 0.1
    x = grams * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = x.mean(axis=0)
    x -= centre
    _, turned = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = turned[:, ::-1][:, :dimensions].astype(np.float32)
    model = Neighbours(weights, centre, basis, np.zeros((0, 1), np.float32), labels, neighbours)
    return Neighbours(weights, centre, basis, model.embed(grams), labels, neighbours)


def score_column(docs: DataFrame, model: Neighbours, column: str = "score", text: str = "text") -> DataFrame:
    """Adds the score to every row; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        blocks = common.utf8(pa.array(texts, pa.string()))
        out = [own.votes(own.embed(trigram_matrix(blocks[i:i + 256]))) for i in range(0, len(blocks), 256)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn(column, score(F.col(text)))
