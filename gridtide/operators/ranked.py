"""Prefix scans and ranks over raw rows, without one task per key.

A running total over an unbounded key is done in two levels.  Rows are put in
chunks of the ordering column; chunk totals (small: one row per chunk) are
prefix-summed; rows then only need a window inside their own chunk plus the
chunk's offset.  A key that owns a third of the table is spread over as many
tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .fill import with_one_row


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums / maxima / last non-NULL values per key.

    ``chunk`` must be monotone in ``order`` (e.g. the hour of a timestamp, a
    score bucket) and equal rows must fall in one chunk; ``descending`` means
    the order runs from high chunks to low ones.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    src = df.withColumn("_chunk", chunk)
    for name, c in {**sums, **maxes, **lasts}.items():
        src = src.withColumn(f"_v_{name}", c)
    chunk_order = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy(chunk_order).rowsBetween(W.unboundedPreceding, -1)

    aggs = [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums]
    aggs += [F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxes]
    totals_src = src
    if lasts:
        # position inside the chunk decides the last value, so it is ranked first
        totals_src = src.withColumn("_pos", F.row_number().over(inside))
        aggs += [
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_pos"))).alias(f"_c_{n}")
            for n in lasts
        ]
    chunks = totals_src.groupBy(*keys, "_chunk").agg(*aggs)
    carried = [F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    carried += [F.max(f"_c_{n}").over(earlier).alias(f"_o_{n}") for n in maxes]
    carried += [F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_o_{n}") for n in lasts]
    offsets = chunks.select(*keys, "_chunk", *carried)

    out = src
    for n in sums:
        out = out.withColumn(f"_r_{n}", F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)))
    for n in maxes:
        out = out.withColumn(f"_r_{n}", F.max(f"_v_{n}").over(upto))
    for n in lasts:
        out = out.withColumn(f"_r_{n}", F.last(f"_v_{n}", ignorenulls=True).over(upto))
    out = out.join(offsets, [*keys, "_chunk"], "left")
    results = [(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    results += [F.greatest(f"_r_{n}", f"_o_{n}").alias(n) for n in maxes]
    results += [F.coalesce(f"_r_{n}", f"_o_{n}").alias(n) for n in lasts]
    kept = [c for c in df.columns if c not in {*sums, *maxes, *lasts}]
    return out.select(*kept, *results)


def value_chunks(df: DataFrame, col: str, chunks: int | None = None) -> tuple[DataFrame, Column]:
    """(df with the limits of its own value ranges, chunk number by value): ranges of about equal row counts, whatever the distribution.

    The number of ranges follows the session's shuffle partitions. The limits are one array, held by every row. NULL values are in chunk 0.
    """
    n = chunks or min(1000, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = df.agg(F.coalesce(F.percentile_approx(col, [i / n for i in range(1, n)] or [0.5], 20 * n), F.array()).alias("_limits"))
    return with_one_row(df, limits), F.size(F.filter("_limits", lambda x: x <= F.col(col)))


def row_index(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str = "rn", descending: bool = False
) -> DataFrame:
    """1-based row number per key over all rows, computed chunk by chunk."""
    return prefix_scan(df, keys, chunk, order, sums={name: F.lit(1).cast("long")}, descending=descending)


def with_halo(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], before: int, after: int = 0, rows: int = 4096
) -> tuple[DataFrame, "W"]:
    """Split a raw series into blocks of ``rows`` rows plus the rows a frame can reach.

    Returns the block table and the window to use on it.  Frames of at most
    ``before`` preceding and ``after`` following rows are exact on rows with
    ``_own``; drop the others afterwards with ``own_rows``.
    """
    indexed = row_index(df, keys, chunk, order, name="_rn").withColumn("_rn", F.col("_rn") - 1)
    low = F.greatest(F.lit(0), F.floor((F.col("_rn") - after) / rows)).cast("long")
    high = F.floor((F.col("_rn") + before) / rows).cast("long")
    blocks = indexed.withColumn("_blk", F.explode(F.sequence(low, high))).withColumn(
        "_own", F.col("_blk") == F.floor(F.col("_rn") / rows).cast("long")
    )
    return blocks, W.partitionBy(*keys, "_blk").orderBy("_rn")


def in_blocks(df: DataFrame, keys: list[str], t: str, build, before: int, after: int = 0) -> DataFrame:
    """``build(blocks, window)`` over a series cut into blocks with the rows its frames can reach, so one long series is many tasks."""
    blocks, w = with_halo(df, keys, F.to_date(t), [F.col(t)], before, after, max(4096, 2 * (before + after)))
    return own_rows(build(blocks, w))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_blk", "_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Top-k rows per key. The rank filter is pushed below the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ordered_splits(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], ratio: float = 0.8, folds: int = 5
) -> DataFrame:
    """First ``ratio`` of the rows as train, and ``folds`` contiguous blocks (sizes as ntile), from chunked row numbers."""
    numbered = row_index(df, keys, chunk, order)
    if keys:
        sized = numbered.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    else:
        sized = with_one_row(numbered, df.agg(F.count("*").alias("_n")))
    n, rn = F.col("_n"), F.col("rn")
    small, extra = F.floor(n / folds), n % folds
    fold = F.when(rn <= extra * (small + 1), F.floor((rn - 1) / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(rn - 1 - extra * (small + 1), small))
    )
    return sized.withColumns(
        {"ratio_split": F.when(rn <= F.floor(n * ratio), "train").otherwise("test"), "fold": (fold + 1).cast("int")}
    ).drop("_n", "rn")


def exact_quantiles(df: DataFrame, keys: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per key without holding a key's values in one task.

    Equal values are merged by a partial aggregate, ranked by a scan in value
    ranges of about equal size, and the two order statistics of each quantile picked by a last
    aggregate.
    """
    x = F.col("_x")
    ties = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_x")).agg(F.count("*").alias("_n"))
    ranged, chunk = value_chunks(ties, "_x")
    cum = prefix_scan(ranged, keys, chunk, [x], sums={"_cum": F.col("_n")}).drop("_limits")
    total = ties.groupBy(*keys).agg(F.sum("_n").alias("_tot"))
    j = cum.join(total, keys) if keys else with_one_row(cum, total)
    picks = []
    for name, p in ps.items():
        k = F.floor((F.col("_tot") - 1) * F.lit(p))
        for side, at in (("lo", k), ("hi", F.least(k + 1, F.col("_tot") - 1))):
            picks.append(F.max(F.when((at >= F.col("_cum") - F.col("_n")) & (at < F.col("_cum")), x)).alias(f"_{side}_{name}"))
    agg = j.groupBy(*keys).agg(F.first("_tot").alias("_tot"), *picks)

    def value(name: str, p: float) -> Column:
        h = (F.col("_tot") - 1) * F.lit(p)
        return F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))

    return agg.select(*keys, *[value(n, p).alias(n) for n, p in ps.items()])
