"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Method. Every text gets a SimHash of its 3-word shingles. Distinct fingerprints are dealt to shards that share two of four 16-bit blocks (two
fingerprints within 2 bits always share two blocks), a shard's BK-tree has children keyed by their Hamming distance to the parent, and a
query follows only the edges d-2..d+2. Links become components.

Each shard's tree is built where its fingerprints meet after the shuffle and is not sent to all executors: all trees together grow with the
corpus, so they have no size bound that would permit a broadcast. A shard above SHARD_LIMIT distinct fingerprints is dealt in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHINGLE = 3
RADIUS = 2
SEED = 42
SHARD_LIMIT = 4000
#: Pairs of the four 16-bit blocks; at most two differing bits leave at least two blocks equal.
BLOCK_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: max(1, len(words) - SHINGLE + 1)].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 4096):
        part = hashes[first : first + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "text_hash", "fp"])


class BkTree:
    """Distinct 64-bit values; a child's key is its Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield self.values[at]
            edges = self.children[at]
            if edges:
                stack.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << 64) - 1
    left, right = [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    for run in shared.grouped_runs(batches, ["shard", "tile"], ["fp"]):
        tree = BkTree()
        for (fp,) in run:
            for other in tree.within(fp & mask, RADIUS):
                other -= (other >> 63) << 64
                if other != fp:
                    left.append(max(fp, other))
                    right.append(min(fp, other))
            tree.add(fp & mask)
        if len(left) > 50_000:
            yield out()
            left, right = [], []
    yield out()


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in at most RADIUS bits."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    shards = F.array(*[(F.lit(k).cast("long") * (1 << 32) + block(i) * (1 << 16) + block(j)) for k, (i, j) in enumerate(BLOCK_PAIRS)])
    dealt = shared.tiled(prints.select(F.explode(shards).alias("shard"), "fp"), "shard", "fp", SHARD_LIMIT)
    dealt = dealt.repartition(shared.shuffle_partitions(prints.sparkSession), "shard", "tile")
    return dealt.select("shard", "tile", "fp").sortWithinPartitions("shard", "tile", "fp").mapInArrow(_linked, "a long, b long").distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component (smallest fingerprint reachable), component_id of each row."""
    prints = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = shared.checkpointed(prints.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    found = shared.connected_components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "component")
    rooted = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = rooted.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = rooted.select("fp", "component").join(ids, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable) for each row of docs.

    NULL and empty texts have fingerprint 0 and link like any other. Repeated rows stay, each with its component. A NULL doc_id never becomes a
    component_id (NULL only where all ids of the component are NULL). Other columns of docs are ignored. An empty table gives no rows.
    """
    return _placed(docs).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs, one of each near-duplicate component, columns unchanged: the row with the smallest doc_id, NULL ids last.

    Rows of one doc_id with different texts are told apart by the text's hash; of rows that repeat both, the smallest stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
    kept = _placed(docs).groupBy("component").agg(first).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    own_hash, i, none, h = shared.own_names(docs, "text_hash", "id", "none", "hash")
    kept = kept.select(F.coalesce("_id", F.lit(0)).alias(i), F.col("_id").isNull().alias(none), F.col("_hash").alias(h))
    rows = docs.withColumn(own_hash, F.xxhash64("text"))
    match = (F.coalesce("doc_id", F.lit(0)) == F.col(i)) & (F.col("doc_id").isNull() == F.col(none)) & (F.col(own_hash) == F.col(h))
    rows = rows.join(kept, match)
    rows = rows.groupBy(i, none, h).agg(F.min(F.struct(*shared.columns_of(docs))).alias("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
