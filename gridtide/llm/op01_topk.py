"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. Global histograms per query narrow the range that holds its k-th largest score
until it is one value; a last pass keeps what lies above it and, of the ties with it, the smallest ids.

Queries and candidates are packed into blocks of bounded size. A cell is one query block against one candidate block; both sides are dealt on
the cell's pair of numbers, so nothing is broadcast and no cell is larger than another. What leaves a cell is one histogram row for each query
(first passes) or at most its k best rows (last pass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

K = 5
SCALE = 256
BINS = 512
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024


def _packed(vectors: DataFrame, per_block: int, prefix: str) -> tuple[DataFrame, int]:
    """Blocks of about per_block vectors (expected size; ids are dealt by hash): number, ids, components one after the other."""
    blocks = max(1, math.ceil(vectors.count() / per_block))
    block = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)).cast("int").alias(f"{prefix}_block")
    rows = F.sort_array(F.collect_list(F.struct("vec_id", "v")))
    packed = vectors.groupBy(block).agg(rows.alias("r"))
    return packed.select(f"{prefix}_block", F.col("r.vec_id").alias(f"{prefix}_ids"), F.flatten("r.v").alias(f"{prefix}_v")), blocks


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, integer scores and, where a candidate is the query itself, True."""
    q_ids, c_ids = np.asarray(row.q_ids, np.int64), np.asarray(row.c_ids, np.int64)
    q, c = np.asarray(row.q_v, np.float64).reshape(len(q_ids), -1), np.asarray(row.c_v, np.float64).reshape(len(c_ids), -1)
    return q_ids, c_ids, np.rint(q @ c.T).astype(np.int64), q_ids[:, None] == c_ids[None, :]


def _histograms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query of a cell: counts of its scores from low up to low + span, in bins of its width."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            q_ids, _, scores, own = _scores(row)
            low, span, width = (np.asarray(x, np.int64)[:, None] for x in (row.low, row.span, row.width))
            bins = (scores - low) // width
            bins[own | (scores < low) | (scores >= low + span)] = BINS
            flat = np.bincount((bins + np.arange(len(q_ids))[:, None] * (BINS + 1)).ravel(), minlength=len(q_ids) * (BINS + 1))
            counts = flat.reshape(len(q_ids), BINS + 1)[:, :BINS]
            at, b = np.nonzero(counts)
            yield pd.DataFrame({"query_id": q_ids[at], "bin": b.astype(np.int32), "n": counts[at, b]})


def _best(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q_ids, c_ids, scores, own = _scores(row)
                limit = np.asarray(row.low, np.int64)
                at, j = np.nonzero((scores >= limit[:, None]) & ~own)
                score, ids = scores[at, j], c_ids[j]
                order = np.lexsort((ids, -score, at))
                at, score, ids = at[order], score[order], ids[order]
                begin = np.searchsorted(at, np.arange(len(q_ids)))
                keep = np.arange(len(at)) - begin[at] < k
                yield pd.DataFrame({"query_id": q_ids[at[keep]], "vec_id": ids[keep], "score": score[keep]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k candidates of highest integer inner product, ties to the smaller vec_id.

    vectors and queries have vec_id long and v array<long>; shorter vectors count as ending in zeros. A candidate with the query's own vec_id takes no part; fewer than
    k candidates give all of them; no candidate gives no row. Of rows that share a vec_id, that with the smallest vector counts. NULL ids or
    vectors take no part. Inner products must stay below 2^53 (they are summed exactly as doubles).
    """
    clean = lambda df: df.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors, queries = clean(vectors), clean(queries)
    dim = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
    vectors, queries = (shared.checkpointed(df.select("vec_id", pad)) for df in (vectors, queries))
    c_blocks, n_c = _packed(vectors, CANDIDATES_PER_BLOCK, "c")
    q_blocks, n_q = _packed(queries, QUERIES_PER_BLOCK, "q")
    cells = min(n_c * n_q, 20 * shared.shuffle_partitions(vectors.sparkSession))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = vectors.agg(F.coalesce(F.max(norm), F.lit(0.0))).first()[0]
    # Cauchy-Schwarz: no score of a query lies outside +- its norm times the longest candidate's
    bound = (F.ceil(norm * F.lit(longest)) + 1).cast("long")
    ranges = queries.select("vec_id", (-bound).alias("low"), (2 * bound + 1).alias("span"), F.lit(k).cast("long").alias("need"))
    ranges = shared.checkpointed(ranges.withColumn("width", F.ceil(F.col("span") / F.lit(BINS)).cast("long")))
    far = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q_block")
    c_side = c_blocks.select("*", far)

    def against(ranges: DataFrame) -> DataFrame:
        """Cells with each query's present range."""
        block = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(n_q)).cast("int").alias("q_block")
        now = ranges.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("vec_id", "low", "span", "width"))).alias("r"))
        now = now.select("q_block", *[F.col(f"r.{c}").alias(c) for c in ("low", "span", "width")])
        q_side = q_blocks.join(now, "q_block").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c_block"))
        return q_side.join(c_side, ["q_block", "c_block"]).repartition(cells, "q_block", "c_block").select("q_ids", "q_v", "c_ids", "c_v", "low", "span", "width")

    widest = ranges.agg(F.coalesce(F.max("width"), F.lit(1))).first()[0]
    while True:  # ends: the width shrinks by BINS each time
        counts = against(ranges).mapInPandas(_histograms, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # at most BINS rows for each query
        per_query = counts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("h"))
        # walk down from the highest bin until `need` scores are passed; a query with fewer scores keeps its lowest filled bin
        start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("before"))
        walk = F.aggregate(
            "h",
            start,
            lambda s, x: F.when(
                s["above"] < F.col("need"), F.struct((s["above"] + x["n"]).alias("above"), x["bin"].alias("bin"), s["above"].alias("before"))
            ).otherwise(s),
        )
        met = ranges.join(per_query.withColumnRenamed("query_id", "vec_id"), "vec_id").withColumn("w", walk)
        low = F.col("low") + F.col("w.bin") * F.col("width")
        need = (F.col("need") - F.col("w.before")).alias("need")
        ranges = shared.checkpointed(met.select("vec_id", low.alias("low"), F.col("width").alias("span"), need, F.ceil(F.col("width") / F.lit(BINS)).cast("long").alias("width")))
        if widest == 1:
            break
        widest = math.ceil(widest / BINS)
    best = against(ranges).mapInPandas(_best(k), "query_id long, vec_id long, score long")
    # what lies above the k-th score, and of the ties with it at most k from each candidate block
    pick = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = best.groupBy("query_id").agg(pick.alias("best")).select("query_id", F.posexplode("best").alias("p", "e"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.s")).alias("score"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are NULL, or hold NULL, NaN or infinite components, take no part."""
    x = lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))
    rows = shared.table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    vectors = rows.where(finite).select("vec_id", F.transform("embedding", x).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
