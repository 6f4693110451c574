"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of other marks, so that junk marks glued to words count. Features are single words and pairs of
neighbours, hashed to 2^BITS slots; pairs of equal words also share a slot, whatever the word. Training takes at most SAMPLE_PER_LABEL labelled rows of each label (a fixed bound); scores are sparse dot
products over all whole texts. Only the text is an input of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, shared

BITS = 20
SAMPLE_PER_LABEL = 4000
TRAINING = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": 0.05, "l2": 0.1}
THRESHOLD = 0.5

#: Distance of two equal words, and the feature that stands for it.
_REPEATS = [(1, np.uint64(0x5EED0001)), (2, np.uint64(0x5EED0002))]
_MARKS = shared.byte_classes(symbols=True)


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and of every pair of neighbouring words within a row; a pair of equal words counts once more, under a name that is
    common to all such pairs, and so does a word that comes again after one other word."""
    h, starts = shared.hashed_words(data, offsets, _MARKS)
    row = shared.per_row(offsets, starts)
    same = row[1:] == row[:-1]
    pairs = shared.mixed(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[same]
    rows, hashes = [row, row[1:][same]], [h, pairs]
    for gap, name in _REPEATS:
        again = row[gap:][(row[gap:] == row[:-gap]) & (h[gap:] == h[:-gap])]
        rows.append(again)
        hashes.append(np.full(len(again), name))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate(hashes)[order]


def held_out() -> F.col:
    return F.coalesce(shared.remainder("doc_id", 3) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    sample = linear.labelled_sample(labels, "quality", ~held_out(), SAMPLE_PER_LABEL)
    # the sample holds up to as many rows of either label; weights bring back the share that the labels have
    share = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("quality").count().where("quality IN (0, 1)")
    counts = {r["quality"]: r["count"] for r in share.collect()}
    kept = {y: min(n, SAMPLE_PER_LABEL) for y, n in counts.items()}
    weight = {y: counts[y] / kept[y] * sum(kept.values()) / sum(counts.values()) for y in counts}
    sample = sample.withColumn("weight", F.when(F.col("target") == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0)))
    rows = linear.with_texts(docs, sample).withColumn("turn", F.xxhash64("doc_id", F.lit(3)))
    return linear.train(rows, word_pairs, bits=BITS, presence=False, **TRAINING)


def scores(docs: DataFrame, labels: DataFrame, carried: list[str], keep_text: bool = False, name: str = "score") -> DataFrame:
    """The carried columns (and text) and score (0 to 1; higher: better), under the given name, of each row.

    NULL and empty texts get the score of no words (the intercept's). Repeated rows stay. Without labels every score is 0.5. Extra columns of either
    table are ignored unless carried.
    """
    return linear.scored(docs, fit(docs, labels), word_pairs, BITS, False, carried, keep_text, name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
