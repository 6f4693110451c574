"""Sinks: keyed upsert tables, partitioned Parquet, sorted CSV, JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import floor_time
from ..operators.dedup import keep_last, upsert
from ..session import checkpoint_dir, cut_lineage


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of one output file, about.
ROWS_PER_FILE = 1_000_000


def _status(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def is_folder(spark: SparkSession, path: str) -> bool:
    status = _status(spark, path)
    return status is not None and status.isDirectory()


def _spread(df: DataFrame, by: list[str], salt: Column) -> DataFrame:
    """Rows dealt by the columns `by` and, where one value has more than ROWS_PER_FILE rows, over several writers by a hash of salt."""
    writers = df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(ROWS_PER_FILE)).alias("_writers")).where("_writers > 1")
    same = None
    for c in by:
        term = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = term if same is None else same & term
    joined = df.withColumn("_salt", salt).alias("l").join(writers.alias("r"), same, "left")
    slot = F.pmod("l._salt", F.coalesce("r._writers", F.lit(1)))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], slot.alias("_slot")).repartition(*by, "_slot").drop("_slot")


def upsert_parquet(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], partition: str, seq: str) -> None:
    """Merge a batch into a partitioned Parquet table; only touched partitions are read and rewritten.

    Re-running the same batch leaves the same rows, also after a first write that did not end. The stored table is read with the batch's
    schema, so a partition value keeps its type (text such as 0017 stays text).
    """
    if path_exists(spark, path):
        touched = batch.select(partition).distinct()
        base = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi")
        merged = upsert(base.select(batch.columns), batch, keys, seq)
    else:
        merged = keep_last(batch, keys, [F.col(seq)])
    merged = cut_lineage(merged)
    out = _spread(merged, [partition], F.xxhash64(*keys))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def floor_5min_ingest(df: DataFrame, seq: str, names: dict[str, list[str]]) -> DataFrame:
    """Raw feed rows to (time, point, lmp): alternative field names, 5-minute floor, missing numbers zero, last write wins."""

    def pick(target: str) -> Column:
        present = [F.col(c) for c in names[target] if c in df.columns]
        return F.coalesce(*present)

    rows = df.select(
        floor_time(pick("time"), 5).alias("time"),
        pick("settlement_point").alias("settlement_point"),
        F.coalesce(pick("lmp").try_cast("double"), F.lit(0.0)).alias("lmp"),
        F.col(seq),
    )
    return keep_last(rows, ["time", "settlement_point"], [F.col(seq)])


def export_partitioned(df: DataFrame, path: str, by: list[str], salt: Column | None = None) -> None:
    """One folder per partition value. Rows of a large value are spread over writers, one for each ROWS_PER_FILE rows; the spread is a
    hash of the row, hence the same when a lost task runs again."""
    hashed = F.xxhash64(salt) if salt is not None else F.xxhash64(*df.columns)
    _spread(df, by, hashed).write.mode("overwrite").partitionBy(*by).parquet(path)


def export_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
