"""Training corpus from documents: quality filter, line dedup, near-duplicate dedup, mixing to target weights, BPE ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as
the next one's docs. All but the last return the columns of documents. Later stages see changed texts, so n_chars is brought up to date.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import op02_lines, op03_simhash, op05_mixing, op06_bpe, op07_quality, shared


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of THRESHOLD or more)."""
    (name,) = shared.own_names(docs, "score")
    scored = op07_quality.scores(docs, shared.table(spark, sf_dir, "labels"), docs.columns, keep_text=True, name=name)
    return scored.where(F.col(name) >= op07_quality.THRESHOLD).select(*shared.columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one."""
    kept = op02_lines.dedup_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op03_simhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those of languages that the target mix asks more of are repeated by their rates. None is cut."""
    found, _, _ = op05_mixing.rates(docs, shared.table(spark, sf_dir, "labels"))
    return op05_mixing.mixed(docs, found, at_least=1)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their BPE ids in place of text, the number of ids and the digest of the bytes they decode to."""
    return op06_bpe.encoded(docs, *op06_bpe.default_vocabulary(), digests=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE", byte_bpe),
]

#: The stages are models and similarity searches, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is a Parquet table in the shared checkpoint folder."""
    folder = f"{shared.checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = shared.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
