"""The pipeline stage by stage, and the SQL statements of the queries that have one."""

import os

import duckdb
import pytest

import corpus_pipeline
from gridtide.llm import op06_bpe, op07_quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.STATEMENTS))
def test_statement(spark, key):
    con = duckdb.connect()
    for name in ("embeddings", "conversations"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.execute(queries.STATEMENTS[key])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[key](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_stages(spark, docs):
    sf_docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now, seen = sf_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        seen[name] = now
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = seen["quality classifier"].select("doc_id")
    good = labels.join(sf_docs.select("doc_id"), "doc_id").where("quality = 1")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count() and kept.count() < sf_docs.count()
    assert seen["line dedup"].count() == kept.count()
    near = seen["SimHash near-dedup"]
    assert near.count() < kept.count() and near.count() == near.select("doc_id").distinct().count()
    mixed = seen["mixing sources to target weights"]
    assert mixed.columns == sf_docs.columns and mixed.select("doc_id").distinct().count() == near.count()
    last = seen["byte-level BPE"]
    bpe = op06_bpe.TreeBpe(op06_bpe.read_ranks(op06_bpe.default_vocabulary()[0]), op06_bpe.default_vocabulary()[1])
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in last.collect():
        assert bpe.decode(__import__("numpy").array(r["ids"], "<u4")).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
    for name, stage in stages.items():  # odd rows, clashing columns, empty tables
        out = stage(spark, docs, SF)
        assert name == "byte-level BPE" or out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_applies_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert op07_quality.THRESHOLD == 0.5
