"""Helpers that several text operators share: lineage cuts, bounded groups, components, byte-level word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage  # noqa: F401

#: Rows of a table of two numbers that may be broadcast, once counted.
BROADCAST_ROWS = 100_000
#: Bits of a key filter (2 MB); its table of words is broadcast.
FILTER_BITS = 1 << 24
#: Bytes of text that one vectorised step takes at once (a longer single text is one step).
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later reads survive the loss of executors."""
    return cut_lineage(df)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list:
    """All columns of df by quoted name."""
    return [F.col(f"`{c}`") for c in df.columns]


def schema_of(df: DataFrame, names: list[str], *more: str) -> str:
    """Schema text of df's columns `names`, then further fields."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{c}` {types[c]}" for c in names), *more])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- bounded groups


def tiled(rows: DataFrame, key: str, id_column: str, limit: int) -> DataFrame:
    """Give each row the tiles of its key, so that every two rows of a key meet in a tile of at most about 4 * limit rows.

    A key with up to about `limit` rows has the one tile 0. A larger key is dealt over s = ceil(rows / limit) parts by a hash of the id;
    part i goes to the tiles of all unordered pairs of parts that contain i. Nothing is dropped; no task has to hold a whole hot key.

    Which keys are large is read off one row in `limit // 20` by a hash of the id, so that no count of all keys is shuffled. The estimate decides
    only how a key is dealt, not what meets. The few large keys are broadcast behind a check of their number; beyond it they are joined.
    """
    one_in = max(1, limit // 20)
    seen = rows.where(F.pmod(F.xxhash64(id_column, F.lit(13)), F.lit(one_in)) == 0).groupBy(key).agg((F.count("*") * one_in).alias("_rows"))
    hot = checkpointed(seen.where(F.col("_rows") > limit).select(key, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_parts")))
    few = hot.count()
    if few == 0:
        return rows.withColumn("tile", F.lit(0))
    dealt = rows.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, key, "left")
    part = F.pmod(F.xxhash64(id_column, F.lit(7)), F.col("_parts")).cast("int")
    tiles = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("_parts") - 1),
            lambda j: F.least(j, F.col("_part")) * F.col("_parts") + F.greatest(j, F.col("_part")),
        )
    )
    return dealt.withColumn("_part", part).withColumn("tile", F.explode(tiles)).drop("_part", "_parts")


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of FILTER_BITS bits of the keys (long hashes) as a table of words: at most FILTER_BITS / 64 rows, whatever the number of keys."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = keys.select(F.floor(bit / 64).cast("int").alias("_word"), (bit % 64).cast("int").alias("_bit"))
    return checkpointed(words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))


def may_hold(rows: DataFrame, hashed, bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a flag: false means that the bitmap's keys certainly lack the hash; true may be a coincidence, so a join decides."""
    bit = F.pmod(hashed, F.lit(FILTER_BITS))
    word, bits = own_names(rows, "_word", "_bits")
    found = rows.join(F.broadcast(bitmap.select(F.col("_word").alias(word), F.col("_bits").alias(bits))), F.floor(bit / 64).cast("int") == F.col(word), "left")
    flag = F.coalesce(F.getbit(bits, (bit % 64).cast("int")) == 1, F.lit(False))
    return found.withColumn(name, flag).drop(word, bits)


def grouped_runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of sorted Arrow batches, one list for each run of equal keys."""
    current, run = None, []
    for batch in batches:
        key_lists = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        value_lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        for key, value in zip(zip(*key_lists), zip(*value_lists)):
            if key != current:
                if len(run) > 1:
                    yield run
                current, run = key, []
            run.append(value)
    if len(run) > 1:
        yield run


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Component of every node that has an edge: columns node, component (the smallest node reachable).

    Alternating large-star and small-star steps over the edge table (columns a, b). Each step is a map-side combined minimum per node and a
    join; a hub's edges are dealt by the skew join. Edges are checkpointed each round; the driver sees only a count and a checksum.
    Loops and NULL ends are ignored; no edges give an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    edges = checkpointed(edges.distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        edges = checkpointed(moved.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over the few members of one bounded group."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


# ---------------------------------------------------------------- words of many texts at once


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, byte offsets of the rows) of runs of texts of at most `most` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))
#: Powers of the base by place in a slice of up to so many bytes, and of its inverse.
_AHEAD = np.cumprod(np.full(1 << 18, _BASE, np.uint64))
_BACK = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << 18) - 1, pow(int(_BASE), -1, 1 << 64), np.uint64))))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def byte_classes(symbols: bool) -> np.ndarray:
    """Class of each byte: 0 separates, 1 is a letter, digit or part of a non-ASCII character, 2 (with symbols) is any other mark."""
    classes = np.zeros(256, np.uint8)
    classes[128:] = 1
    for span in (b"09", b"AZ", b"az"):
        classes[span[0] : span[1] + 1] = 1
    if symbols:
        classes[(classes == 0) & (np.arange(256) > 32) & (np.arange(256) != 127)] = 2
    return classes


def hashed_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, alone: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start byte) of each maximal run of one class that is not 0; runs end at a text's end and before each byte of `alone` or more. One pass of
    array operations."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = classes[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    if alone < 256:
        begins |= data >= alone
    runs = np.flatnonzero(begins)
    length = np.diff(runs, append=len(data))
    word = kind[runs] > 0
    value = data.astype(np.uint64)
    value += np.uint64(1)
    if len(data) <= len(_AHEAD) and length.max() <= len(_POWERS):  # the same sums, with powers by place in the slice taken back to the run's start
        value *= _AHEAD[: len(data)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        starts = runs[word]
        return mixed((total[starts + length[word]] - total[starts]) * _BACK[starts]), starts
    place = np.arange(len(data), dtype=np.int64) - np.repeat(runs, length)
    value *= _POWERS[place & 4095]
    return mixed(np.add.reduceat(value, runs)[word]), runs[word]


def per_row(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of each start byte."""
    return np.searchsorted(offsets, starts, "right") - 1
