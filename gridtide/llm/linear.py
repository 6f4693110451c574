"""Linear text classifier over hashed features: follow-the-regularised-leader training, sparse dot products for scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: features(data, offsets) -> (row of each feature, 64-bit hash of each feature), rows ascending
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def row_features(features: Features, data: np.ndarray, offsets: np.ndarray, bits: int, presence: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): distinct slots of each row. Presence gives 1; else a count over the root of the row's number of features."""
    row, h = features(data, offsets)
    key = (row.astype(np.uint64) << np.uint64(bits)) | (h & np.uint64((1 << bits) - 1))
    key, n = np.unique(key, return_counts=True)
    row, slot = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    if presence:
        return row, slot, np.ones(len(slot))
    total = np.bincount(row, weights=n, minlength=len(offsets) - 1)
    return row, slot, n / np.sqrt(total[row])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last weight is the intercept, without a penalty."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        l1 = np.where(np.asarray(slots) == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, slots: np.ndarray, values: np.ndarray, target: float, weight: float = 1.0) -> None:
        slots, values = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(slots)
        g = weight * (sigmoid(float(w @ values)) - target) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def train(sample: DataFrame, features: Features, *, bits: int, presence: bool, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (2^bits slots and the intercept) from a bounded sample with columns text, target (0 to 1), weight, turn (order of the updates).

    The updates are sequential, so one task sees the sample; the caller bounds it. An empty sample gives zero weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for first, rows, data, offsets in shared.text_slices(batch.column(0)):
                row, slot, value = row_features(features, data, offsets, bits, presence)
                edge = np.searchsorted(row, np.arange(rows + 1))
                for i in range(rows):
                    examples.append((slot[edge[i] : edge[i + 1]], value[edge[i] : edge[i + 1]], batch.column(1)[first + i].as_py(), batch.column(2)[first + i].as_py()))
        model = Ftrl(bits, alpha, beta, l1, l2)
        for _ in range(epochs):
            for example in examples:
                model.step(*example)
        w = model.weights(np.arange(len(model.z))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    ordered = sample.repartition(1).sortWithinPartitions("turn").select("text", "target", "weight")
    found = ordered.mapInArrow(run, "w binary").first()
    return np.frombuffer(found["w"], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, features: Features, bits: int, presence: bool, carried: list[str], keep_text: bool = False, name: str = "score") -> DataFrame:
    """The carried columns (and text) and score, under the given name, of each row of docs: the weights go to the executors (fixed size), a text is one sparse dot product."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    carried = [c for c in carried if c != "text"]
    out = [*carried, *["text"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, rows, data, offsets in shared.text_slices(batch.column(len(carried))):
                if presence:
                    row, slot, value = row_features(features, data, offsets, bits, True)
                    dot = np.bincount(row, weights=w[slot] * value, minlength=rows)
                else:  # counts add up, so equal features need not be found
                    row, h = features(data, offsets)
                    dot = np.bincount(row, weights=w[h & np.uint64((1 << bits) - 1)], minlength=rows)
                    dot /= np.sqrt(np.maximum(1, np.bincount(row, minlength=rows)))
                score[first : first + rows] = sigmoid(dot + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(score)], names=[*out, name])

    return docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(run, shared.schema_of(docs, out, f"{name} double"))


def labelled_sample(labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """doc_id, target of at most per_class ids of each label (0 or 1) among the rows where `learn` holds, in the order of a hash of the id.

    An id with several labels counts as 1 if any is 1. NULL ids and labels take no part.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("target"))
    take = lambda y: known.where(F.col("target") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return take(0.0).unionAll(take(1.0))


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample with one text for each id (the smallest, if an id repeats). The sample is bounded, so it may be broadcast."""
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    others = [c for c in sample.columns if c != "doc_id"]
    return found.groupBy("doc_id", *others).agg(F.min("text").alias("text"))
