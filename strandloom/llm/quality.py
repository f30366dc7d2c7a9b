"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words, its pairs of neighbouring words, and the same for the words' shapes (letters, capitals,
digits and other characters as classes, runs squeezed); a pair of equal words is one feature of its own, whatever the
word. Each is hashed to one of ``2**bits`` weights and counted; the counts are scaled to length one. A score is the
sigmoid of the sparse dot product with the weights, so it depends on the text alone.

Training takes at most ``train_rows`` labelled rows, those with the smallest hash of their identifier and then of their
text: a documented, bounded sample, in one task. Rows with equal identifier and text are one. The weights (``8 * 2**bits`` bytes at most) are broadcast; scoring is a single pass over all
rows.

Defined results: a null text counts as empty and gets the bias's score; a null label is not used; several labels of one
document count as the largest; without any training row every score is 1, so nothing is rejected; null identifiers are
never held out; repeated rows each give a row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandloom.llm.common import small_batches, tidied, whole_text
from strandloom.llm.tokens import Memo

BITS = 18
#: Labelled rows that training takes at most.
TRAIN_ROWS = 4000
EPOCHS = 4
THRESHOLD = 0.7

_CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _hashes(words: list[bytes]) -> list[int]:
    """The word's 32-bit hash, and above it its shape's."""
    short = xxhash.xxh32_intdigest
    return [short(word, 1) | short(_RUN.sub(rb"\1", word.translate(_CLASSES)), 2) << 32 for word in words]


_memo = Memo(_hashes, 100_000)


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's sparse feature vector, of length one."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.array(_memo.of(words), np.uint64)
    own, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pairs = own[:-1] * np.uint64(0x9E3779B1) + own[1:] * np.uint64(0x85EBCA77)
    pairs[own[:-1] == own[1:]] = np.uint64(7 << 60)
    shapes = shape[:-1] * np.uint64(0xC2B2AE3D) + shape[1:] * np.uint64(0x27D4EB2F) + np.uint64(1)
    hashed = np.concatenate([own * np.uint64(0x9E3779B97F4A7C15), pairs * np.uint64(0xBF58476D1CE4E5B9), shape * np.uint64(0x94D049BB133111EB), shapes * np.uint64(0xD6E8FEB86659FD93)])
    places = np.sort((hashed >> np.uint64(64 - bits)).astype(np.uint32))
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    counts = np.diff(np.concatenate([first, [len(places)]])).astype(np.float64)
    return places[first].astype(np.int64), counts / np.sqrt((counts * counts).sum())


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


class FollowTheLeader:
    """FTRL-proximal logistic regression (McMahan et al., 2013); the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ values) - label) * values
        was = self.n[at]
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.alpha * w
        self.n[at] = was + g * g


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the held-out quarter; training never sees it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bits: int = BITS, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Weights and bias, or None without training rows."""
    small_batches(docs.sparkSession)
    marked = labels.select(labels["doc_id"].cast("long").alias("of_id"), labels[label_col].cast("int").alias("label")).filter("of_id IS NOT NULL AND label IS NOT NULL")
    marked = marked.filter(~held_out(F.col("of_id"))).groupBy("of_id").agg(F.max("label").alias("label"))
    text = whole_text(docs[text_col])
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hashed"), text.cast("binary").alias("text"))
    met = own.select("doc_id", "hashed").join(marked, F.col("doc_id") == F.col("of_id")).select("of_id", F.col("hashed").alias("of_hashed"), "label").distinct()
    chosen = met.orderBy(F.xxhash64("of_id"), "of_id", "of_hashed").limit(train_rows)
    sample = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("of_id")) & (F.col("hashed") == F.col("of_hashed"))).dropDuplicates(["doc_id", "hashed"])
    sample = sample.select(F.xxhash64("doc_id").alias("turn"), "doc_id", "label", "text", "hashed").repartition(1).sortWithinPartitions("turn", "doc_id", "hashed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*features(text, bits), label) for batch in batches for label, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        if rows:
            model = FollowTheLeader(bits)
            for epoch in range(epochs):
                for k in np.random.default_rng(epoch).permutation(len(rows)).tolist():
                    model.learn(*rows[k])
            yield pa.record_batch([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    found = sample.mapInArrow(tidied(run), "weights binary").collect()
    return np.frombuffer(found[0]["weights"], "<f4").astype(np.float64) if found else None


def scored(docs: DataFrame, weights: np.ndarray | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; with ``carry`` also ``row``, all columns of the input as a struct."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(None if weights is None else weights.astype("<f4"))
    bits = BITS if weights is None else int(np.log2(len(weights) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = []
            for text in batch.column(0).to_pylist():
                if w is None:
                    scores.append(1.0)
                    continue
                at, values = features(text, bits)
                scores.append(sigmoid(float(w[at] @ values) + float(w[-1])))
            yield pa.record_batch([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

    text = whole_text(docs[text_col]).cast("binary").alias("text")
    own = docs.select(text, docs[id_col].cast("long").alias("doc_id"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    found = own.mapInArrow(tidied(run), StructType([*own.schema.fields[1:], StructField("score", DoubleType())]))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row"] if carry else []))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    return scored(docs, train(docs, labels, **options), threshold, carry=True).filter("predicted = 1").select("row.*")
