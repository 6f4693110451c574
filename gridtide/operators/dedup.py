"""Keyed last-write-wins as a partially aggregated ``max_by``.

No window and no per-key sort: every map task already reduces a key to one
row, so a key with very many versions never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column], count: str | None = None) -> DataFrame:
    """The newest row per key in ``order`` (never NULL, unique inside a key); optionally with the key's row count."""
    rest = [c for c in df.columns if c not in keys]
    by = order[0] if len(order) == 1 else F.struct(*order)
    aggs = [F.max_by(F.struct(*rest), by).alias("_row")]
    if count:
        aggs.append(F.count("*").alias(count))
    kept = [F.col(f"_row.{c}").alias(c) for c in rest]
    return df.groupBy(*keys).agg(*aggs).select(*keys, *kept, *([count] if count else []))


def keep_last_non_null(df: DataFrame, keys: list[str], order: Column, cols: list[str]) -> DataFrame:
    """Per key and column the newest value that is not NULL."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Base plus batch, the later ``seq`` wins per key; ``seq`` must be unique inside a key."""
    return keep_last(base.unionByName(batch), keys, [F.col(seq)])


def first_source_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of keyed frames where an earlier list entry overrides later ones."""
    tagged = None
    for rank, src in enumerate(sources):
        one = src.withColumn("_prio", F.lit(-rank))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    return keep_last(tagged, keys, [F.col("_prio")]).drop("_prio")
