"""Toxicity by weak supervision: a generative model of many voters gives posterior labels, on which a linear classifier is trained.

Voters say 1 or abstain (0) on each text: fixed lexicons of insults, surface patterns, and lexicons of word stems found in the labelled sample.
The votes of all documents are counted by pattern (2^voters x gold label at most, so the count table is of bounded size). Expectation
maximisation on the counts estimates each voter's rate under either class; voter pairs whose votes stay correlated within a class become joint
factors, and the model is fitted again. Known labels (learning rows only) are clamped while the model is fitted. A linear classifier over words and
word beginnings is then trained on the known labels and posteriors of a bounded sample, drawn from labelled and unlabelled rows alike. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, shared

# Lexicons of insults and threats.
LEXICONS = {
    "intellect": ["idiot", "moron", "stupid", "dumb", "imbecile", "fool", "retard", "halfwit", "dimwit"],
    "worth": ["loser", "worthless", "pathetic", "useless", "failure", "nobody", "miserable"],
    "disgust": ["scum", "trash", "garbage", "filth", "vermin", "disgusting", "vile", "gross", "pig"],
    "ridicule": ["clown", "joke", "laughable", "ridiculous", "buffoon"],
    "threat": ["kill", "die", "hang", "shoot", "murder", "destroy"],
    "foreign": ["arschloch", "schlampe", "wichser", "connard", "salope", "merde", "puta", "pendejo", "cabron", "gilipollas"],
}

BITS = 20
SAMPLE_PER_LABEL = 6000
STEM_VOTERS = 6
STEM_MIN_DOCS = 3
TRAINING = {"epochs": 3, "alpha": 0.3, "beta": 1.0, "l1": 1.5, "l2": 0.01}
THRESHOLD = 0.3
PAIR_LIMIT = 0.1
_WORDS = shared.byte_classes(symbols=False)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out():
    return F.coalesce(shared.remainder("doc_id", 4) == 2, F.lit(False))


def stems(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word (A-Z lowered) and of its first 4, 5 and 6 bytes, if longer."""
    data = _FOLD[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, starts = shared.hashed_words(data, offsets, _WORDS)
    row = shared.per_row(offsets, starts)
    rows, hashes = [row], [h]
    # a beginning of n bytes: n bytes from the word's start, all of them in the word
    kind = np.concatenate((_WORDS[data], np.zeros(8, np.uint8)))
    padded = np.concatenate((data.astype(np.uint64), np.zeros(8, np.uint64)))
    ends = offsets[row + 1]
    inside = np.ones(len(starts), bool)
    value = np.zeros(len(starts), np.uint64)
    for n in range(7):
        if n in (4, 5, 6):
            long = inside & (kind[starts + n] > 0) & (starts + n < ends)
            rows.append(row[long])
            hashes.append(shared.mixed(value[long] * np.uint64(8) + np.uint64(n)))
        value = value * np.uint64(257) + padded[starts + n]
        inside &= (kind[starts + n] > 0) & (starts + n < ends)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return shared.hashed_words(data, np.array([0, len(data)]), _WORDS)[0]


def found_stems(sample: DataFrame) -> np.ndarray:
    """Hashes of stems that mark label 1 in the bounded sample (text, target): in STEM_MIN_DOCS texts of label 1 at least and, by rate, 30 times
    as often as in label 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = ([], []), [0, 0]
        for batch in batches:
            target = np.array(batch.column(1).to_pylist(), float)
            for first, n, data, offsets in shared.text_slices(batch.column(0)):
                row, h = stems(data, offsets)
                for y in (0, 1):
                    mine = target[first : first + n] == y
                    rows[y] += int(mine.sum())
                    pick = mine[row]
                    pairs = np.unique(np.stack((row[pick].astype(np.uint64), h[pick])), axis=1)
                    seen[y].append(pairs[1])
        (h0, n0), (h1, n1) = (np.unique(np.concatenate(s) if s else np.zeros(0, np.uint64), return_counts=True) for s in seen)
        at = np.searchsorted(h0, h1)
        other = np.where((at < len(h0)) & (h0[np.minimum(at, max(0, len(h0) - 1))] == h1), n0[np.minimum(at, max(0, len(h0) - 1))], 0) if len(h0) else np.zeros(len(h1))
        lift = ((n1 + 0.1) / (rows[1] + 1)) / ((other + 0.5) / (rows[0] + 1))
        yield pa.RecordBatch.from_arrays([pa.array([h1[(n1 >= STEM_MIN_DOCS) & (lift >= 30)].tobytes()], pa.binary())], names=["stems"])

    found = sample.select("text", "target").repartition(1).mapInArrow(run, "stems binary").first()
    return np.frombuffer(found[0], np.uint64) if found else np.zeros(0, np.uint64)


VOTERS = [*LEXICONS, "shout", "address", *(f"stems{i}" for i in range(STEM_VOTERS))]
_ADDRESS = [b"you are", b"you're", b"shut up", b"hate you", b"go away"]


def votes(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """doc_id, text_hash, votes (one bit for each of VOTERS) of each row."""
    sets = [_word_hashes(words) for words in LEXICONS.values()]
    stem_sets = [marks[(marks >> np.uint64(40)) % np.uint64(STEM_VOTERS) == np.uint64(i)] for i in range(STEM_VOTERS)]
    sets = [np.sort(s) for s in [*sets, *stem_sets]]
    bits = [VOTERS.index(v) for v in [*LEXICONS, *(f"stems{i}" for i in range(STEM_VOTERS))]]
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bit_of = np.concatenate([np.full(len(s), b) for s, b in zip(sets, bits)]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((every[order], bit_of[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, bit_of = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for first, rows, data, offsets in shared.text_slices(batch.column(2)):
                row, h = stems(data, offsets)
                at = np.minimum(np.searchsorted(every, h), len(every) - 1)
                hit = every[at] == h
                np.bitwise_or.at(out, first + row[hit], np.int64(1) << bit_of[at[hit]])
                raw = data.tobytes()
                low = _FOLD[data].tobytes()
                upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))[offsets]
                lower = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))[offsets]
                for i in range(rows):
                    text = slice(int(offsets[i]), int(offsets[i + 1]))
                    if upper[i + 1] - upper[i] > lower[i + 1] - lower[i] and raw.find(b"!", text.start, text.stop) >= 0:
                        out[first + i] |= 1 << VOTERS.index("shout")
                    if any(low.find(p, text.start, text.stop) >= 0 for p in _ADDRESS):
                        out[first + i] |= 1 << VOTERS.index("address")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["doc_id", "text_hash", "votes"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, votes long")


class LabelModel:
    """Naive factors P(vote | class), with joint factors for correlated pairs of voters."""

    def __init__(self, voters: int):
        self.voters, self.pairs, self.prior, self.factors = voters, [], 0.1, []

    def _cells(self, patterns: np.ndarray) -> list[tuple[np.ndarray, int]]:
        bit = lambda j: (patterns >> j) & 1
        joined = {j for p in self.pairs for j in p}
        return [(bit(j), 2) for j in range(self.voters) if j not in joined] + [(2 * bit(i) + bit(j), 4) for i, j in self.pairs]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for (cell, _), factor in zip(self._cells(patterns), self.factors):
            odds += np.log(factor[1][cell] / factor[0][cell])
        return linear.sigmoid(odds)

    def _maximise(self, patterns, counts, q) -> None:
        self.prior = float(np.clip((counts @ q) / counts.sum(), 1e-4, 1 - 1e-4))
        self.factors = []
        for cell, size in self._cells(patterns):
            rates = [np.bincount(cell, weights=counts * w, minlength=size) + 0.1 for w in (1 - q, q)]
            self.factors.append([r / r.sum() for r in rates])

    def fit(self, patterns: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
        """gold: 0, 1 or -1 (unknown) of each pattern row."""
        votes = np.array([int(p).bit_count() for p in patterns])
        start = np.clip(votes / 3, 0.02, 0.98)
        for step in range(2):
            q = np.where(gold >= 0, gold, start)
            for _ in range(rounds):
                self._maximise(patterns, counts, q)
                q = np.where(gold >= 0, gold, self.posterior(patterns))
            if step == 0:
                self.pairs = self._correlated(patterns, counts, q)
                start = q
        return self

    def _correlated(self, patterns, counts, q) -> list[tuple[int, int]]:
        """Disjoint pairs of voters with the largest correlation left within a class."""
        left = []
        for w in (counts * (1 - q), counts * q):
            bits = ((patterns[:, None] >> np.arange(self.voters)) & 1).astype(float)
            mean = (w @ bits) / max(w.sum(), 1e-9)
            cov = (bits - mean).T @ ((bits - mean) * w[:, None]) / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            left.append(np.abs(cov / np.outer(sd, sd)))
        strength = np.maximum(*left)
        ranked = sorted(((strength[i, j], i, j) for i in range(self.voters) for j in range(i)), reverse=True)
        used, pairs = set(), []
        for s, i, j in ranked:
            if s >= PAIR_LIMIT and not {i, j} & used:
                used |= {i, j}
                pairs.append((i, j))
        return pairs

    def accuracy(self, j: int) -> tuple[float, float]:
        """(rate of voter j on class 0, on class 1) as the fitted factors have it; voters in a pair by their margin."""
        joined = [x for p in self.pairs for x in p]
        single = [x for x in range(self.voters) if x not in joined]
        if j in single:
            return tuple(float(f[1]) for f in self.factors[single.index(j)])
        k = next(k for k, p in enumerate(self.pairs) if j in p)
        cells = (2, 3) if self.pairs[k][0] == j else (1, 3)
        return tuple(float(f[cells[0]] + f[cells[1]]) for f in self.factors[len(single) + k])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    learn = ~held_out()
    gold = linear.labelled_sample(labels, "toxic", learn, SAMPLE_PER_LABEL)
    marks = found_stems(linear.with_texts(docs, gold))
    voted = shared.checkpointed(votes(docs, marks))
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("gold"))
    joined = voted.where(learn).join(known, "doc_id", "left").withColumn("gold", F.coalesce("gold", F.lit(-1)))
    table = joined.groupBy("votes", "gold").count().toPandas()  # at most 3 * 2^len(VOTERS) rows
    patterns, seen, counts = table["votes"].to_numpy(np.int64), table["gold"].to_numpy(np.int64), table["count"].to_numpy(float)
    model = LabelModel(len(VOTERS))
    if len(patterns):
        model.fit(patterns, seen, counts)
        post = np.where(seen >= 0, seen, model.posterior(patterns))
    else:
        post = np.zeros(0)
    spark = docs.sparkSession
    rows = [(int(p), int(g), float(q)) for p, g, q in zip(patterns, seen, post)]
    posterior = spark.createDataFrame(rows, "votes long, gold int, target double")
    # training texts: labelled and unlabelled rows alike in the order of a hash, so that posteriors reach the classifier at every size
    priced = joined.where("doc_id IS NOT NULL").join(F.broadcast(posterior), ["votes", "gold"])
    side = lambda c: priced.where(c).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(SAMPLE_PER_LABEL)
    sample = side("target >= 0.5").unionAll(side("target < 0.5")).groupBy("doc_id").agg(F.max("target").alias("target"))
    share = float((counts * post).sum() / max(1.0, counts.sum())) if len(post) else 0.5
    sample = sample.withColumn("weight", F.when(F.col("target") >= 0.5, F.lit(min(1.0, 3 * share))).otherwise(1.0))
    texts = linear.with_texts(docs, sample).withColumn("turn", F.xxhash64("doc_id", F.lit(5)))
    return linear.train(texts, stems, bits=BITS, presence=True, **TRAINING)


def scores(docs: DataFrame, labels: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns and score (0 to 1; higher: likelier toxic) of each row.

    NULL and empty texts get the score of no words. Repeated rows stay. Without labels the label model rests on the votes alone. Extra columns of either
    table are ignored unless carried.
    """
    return linear.scored(docs, fit(docs, labels), stems, BITS, True, carried)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
