"""Embedding whitening with distributed block matrices: centred rows in blocks, scatter by transpose-multiply, local eigh, rows by one more product.

1. Vectors become whole numbers (fixed point), so equal vectors, their number and the sums of each dimension are exact.
2. The distinct vectors, less their mean, are indexed into a BlockMatrix A of ROWS_BYTES a block; A' A is the scatter. The inner dimension is split, so
   products of block rows are summed by many tasks and only d x d matrices meet. d x d is all that the driver sees.
3. eigh of the covariance gives unit components by falling eigenvalue; the whitening matrix W has them over the roots of their eigenvalues.
4. Every row, less the mean, goes into a BlockMatrix B by its own index; B W are the whitened rows. They are joined back by the index, which no two rows
   share, so a vector that very many rows repeat makes no hot key.

Centring comes before any product: with entries near a million and deviations of tens, products of raw entries would lose the covariance's digits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Bytes of a block of rows, about.
ROWS_BYTES = 1 << 19
#: Block rows whose products one task sums.
BLOCKS_A_TASK = 16
#: Eigenvalues below this share of the largest, times the dimensions, are rounding: such components have no variance and are left out.
NO_VARIANCE = 1e-15
#: Entries up to this size become whole numbers exactly.
LARGEST = float(1 << 50)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension; components (columns) by falling eigenvalue; all of fixed size."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def _stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of computing it again."""
    path = f"{shared.checkpoint_dir(df.sparkSession)}/whitening-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fixed_point(rows: DataFrame, vector: str, name: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """rows whose vector has entries, all of them finite and at most LARGEST / scale in size, with those as whole numbers floor(scale * c) + offset."""
    entry = lambda c: c.cast("double")
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(entry(c)) <= LARGEST / scale), F.lit(False)))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(usable)
    return kept.withColumn(name, F.transform(vector, lambda c: F.floor(entry(c) * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long")))


def same_length(rows: DataFrame, x: str) -> DataFrame:
    """The rows whose vector has the most common length (the greater, if two are); vectors of other lengths have no place in one matrix."""
    length = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(x) == (length["d"] if length else 0))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """rows, stored, with numbers 0, 1, 2, ... without a gap: a row's place in its partition, after the rows of the partitions before."""
    (place,) = shared.own_names(rows, "_place")
    stored = _stored(rows.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33).cast("int")
    counts = sorted((r["p"], r["count"]) for r in stored.groupBy(part.alias("p")).count().collect())  # one row a partition
    starts, total = [], 0
    for p, count in counts:
        starts.append((p, total))
        total += count
    part_of, start_of = shared.own_names(stored, "_part", "_first")
    first = rows.sparkSession.createDataFrame(starts, f"{part_of} int, {start_of} long")
    joined = stored.join(F.broadcast(first), part == F.col(part_of))
    return joined.withColumn(name, F.col(start_of) + F.col(place).bitwiseAND((1 << 33) - 1)).drop(place, part_of, start_of)


def _centred(x: str, n: int, sums: list[int]):
    """Entries less their mean sum / n: whole parts are taken off exactly, then the fraction."""
    whole = F.array(*[F.lit(s // n).cast("long") for s in sums])
    fraction = F.array(*[F.lit((s % n) / n) for s in sums])
    return F.zip_with(F.zip_with(x, whole, lambda a, b: (a - b).cast("double")), fraction, lambda a, b: a - b)


def _blocks(rows: DataFrame, index: str, values, d: int) -> BlockMatrix:
    """Rows of doubles as a BlockMatrix with one column of blocks."""
    table = rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(table, "vector")).toBlockMatrix(max(64, ROWS_BYTES // (8 * d)), d)


def _gram(a: BlockMatrix) -> np.ndarray:
    """a' a, as a local matrix. The inner dimension (rows) is dealt over tasks, an argument that only the JVM's multiply has."""
    splits = max(1, -(-a.numRows() // (a.rowsPerBlock * BLOCKS_A_TASK)))
    left, right = a.transpose(), a
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def _times(spark: SparkSession, a: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """a times a small local matrix."""
    block = DenseMatrix(*matrix.shape, matrix.ravel(order="F"))
    return a.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *matrix.shape))


def fit(rows: DataFrame, x: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of column x (whole numbers, all of one length); None without rows or without variance."""
    spark = rows.sparkSession
    distinct = indexed(rows.select(F.col(x).alias("x")).distinct(), "index")
    n = distinct.count()
    if n == 0:
        return None
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()  # one row a dimension
    sums = [int(r["s"]) for r in sums]
    a = _blocks(distinct, "index", _centred("x", n, sums), len(sums))
    covariance = _gram(a) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    keep = min(components, int((values > max(values[0], 0.0) * len(sums) * NO_VARIANCE).sum()))
    if keep == 0:
        return None
    made = Whitening(n, sums, values[:keep], vectors[:, :keep], float(np.trace(covariance)), 0.0)
    white = _gram(_times(spark, a, made.matrix)) / n
    return Whitening(n, sums, values[:keep], vectors[:, :keep], made.trace, float(np.abs(white - np.eye(keep)).max()))


def project(rows: DataFrame, x: str, model: Whitening, whitened: str) -> DataFrame:
    """rows with the whitened vector of column x (array of doubles, one entry a component)."""
    spark = rows.sparkSession
    (index,) = shared.own_names(rows, "_index")
    numbered = indexed(rows, index)
    product = _times(spark, _blocks(numbered, index, _centred(x, model.n, model.sums), len(model.sums)), model.matrix)
    high = product.rowsPerBlock

    def rows_of(block):
        (i, _), values = block
        return [(i * high + r, row) for r, row in enumerate(values.toArray().tolist())]

    table = spark.createDataFrame(product.blocks.flatMap(rows_of), f"`{index}` long, `{whitened}` array<double>")
    return numbered.join(table, index).drop(index)


def deviation(x: str, model: Whitening):
    """Sum over dimensions of (n * x - sum)^2, exact; NULL where that is beyond a long."""
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums])
    apart = F.zip_with(x, sums, lambda a, s: F.try_subtract(F.try_multiply(a, F.lit(model.n).cast("long")), s))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda acc, a: F.try_add(acc, F.try_multiply(a, a)))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened rows of every usable embedding, one row a component.

    Vectors that are NULL, empty, or hold NULL, non-finite or enormous entries take no part, nor do vectors of an uncommon length. Rows with a NULL or
    repeated vec_id stay, each by itself. No rows, or vectors that are all equal: an empty table. Fewer dimensions with variance: fewer components.
    """
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = same_length(fixed_point(rows, "embedding", "x").drop("embedding"), "x")
    model = fit(rows, "x")
    if model is None:
        return spark.createDataFrame([], OUT)
    out = project(rows, "x", model, "whitened").withColumn("deviation", deviation("x", model))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        F.col("vec_id").cast("long"),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
