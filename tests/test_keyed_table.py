import os
from datetime import datetime

import pytest

from gridtide.sources import keyed_table as kt

SCHEMA = "day string, k int, v double, seq int"


def rows(spark, *r, schema=SCHEMA):
    return spark.createDataFrame(list(r), schema)


def content(table, version=None):
    return {(r.day, r.k): r.v for r in table.read(version).collect()}


@pytest.fixture()
def table(spark, folder):
    made = kt.KeyedTable(spark, f"{folder}/t", ["day", "k"], "seq", "day", 3)
    made.upsert(rows(spark, ("a", 1, 1.0, 1), ("a", 2, 2.0, 1), ("b", 3, 3.0, 1), ("a", 2, 1.5, 0), (None, 9, 9.0, 1), ("x/=y", 5, 5.0, 1)))
    return made


FIRST = {("a", 1): 1.0, ("a", 2): 2.0, ("b", 3): 3.0, (None, 9): 9.0, ("x/=y", 5): 5.0}


def test_upserts_make_snapshots_and_rewrite_only_touched_groups(spark, table):
    assert content(table) == FIRST and table.read().columns == ["day", "k", "v", "seq"]
    before = table.snapshot()
    table.upsert(rows(spark, ("a", 2, 20.0, 2), ("a", 1, 0.0, 0), ("c", 4, 4.0, 2), (None, 9, 9.5, 1)))
    after = table.snapshot()
    assert content(table) == {**FIRST, ("a", 2): 20.0, ("c", 4): 4.0, (None, 9): 9.5} and content(table, 1) == FIRST
    changed = {g for g, f in after.groups.items() if before.groups.get(g) != f}
    assert {g.split("/")[0] for g in changed} <= {"_p=a", "_p=c", "_p=null"} and after.groups.keys() - changed
    assert table.expire(1) >= 1 and table.versions() == [2] and content(table)[("a", 2)] == 20.0


def test_replayed_batches_change_nothing(spark, table):
    batch = rows(spark, ("a", 2, 20.0, 2))
    assert table.upsert(batch, "feed", 7) and not table.upsert(batch, "feed", 7) and not table.upsert(batch, "feed", 3)
    assert table.upsert(batch, "other", 0) and table.snapshot().applied == {"feed": 7, "other": 0} and table.versions() == [1, 2, 3]


def test_a_write_that_dies_before_its_commit_leaves_no_rows_and_no_mark(spark, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(kt.KeyedTable, "_commit", lambda self, snapshot: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, ("a", 1, 100.0, 9)), "feed", 0, {"feed": "5"})
    assert content(table) == FIRST and table.snapshot().marks == {} and table.versions() == [1]
    assert table.upsert(rows(spark, ("a", 1, 100.0, 9)), "feed", 0, {"feed": "5"})
    assert content(table)[("a", 1)] == 100.0 and table.mark("feed") == "5"


def test_the_second_of_two_writers_fails(spark, table):
    late = kt.KeyedTable(spark, table.path, ["day", "k"], "seq", "day", 3)
    seen = table.snapshot()
    table.upsert(rows(spark, ("a", 1, 7.0, 5)))
    late.snapshot = lambda version=None: seen  # it has read before the first has committed
    with pytest.raises(kt.Conflict):
        late.upsert(rows(spark, ("a", 1, 8.0, 5)))
    assert content(table)[("a", 1)] == 7.0
    hidden = [n for n in os.listdir(f"{table.path}/manifests") if n.startswith(".") and not n.endswith(".crc")]
    assert hidden == []


def test_empty_batches(spark, table, folder):
    assert table.upsert(rows(spark, schema=SCHEMA)) and content(table) == FIRST
    fresh = kt.KeyedTable(spark, f"{folder}/u", ["k"], "seq")
    with pytest.raises(ValueError):
        fresh.read()
    assert fresh.upsert(rows(spark, schema=SCHEMA)) and fresh.read().count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_second_load_reads_after_the_marks(spark, folder, kind, monkeypatch):
    at = lambda day, h=0: datetime(2024, 1, day, h, 0, 0, 250000)
    feed = lambda *r: spark.createDataFrame(list(r), "id int, src string, t timestamp").selectExpr("id", "src", f"CAST(t AS {kind}) AS t")
    path = f"{folder}/in"
    feed((1, "a", at(1)), (2, "a", at(9)), (3, "a", at(10)), (4, "b", at(5)), (5, None, at(5))).write.parquet(path)
    table = kt.KeyedTable(spark, f"{folder}/t", ["id"], "t")
    assert kt.load_new(table, spark.read.parquet(path), "src", "t")
    assert {r.id for r in table.read().collect()} == {2, 3, 4}  # a source without a mark: seven days
    assert not kt.load_new(table, spark.read.parquet(path), "src", "t") and table.versions() == [1]
    feed((6, "a", at(10)), (7, "a", at(11)), (8, "b", at(5, 1)), (9, "b", at(4)), (10, "c", at(2))).write.mode("append").parquet(path)
    marks = {k: int(v) for k, v in table.snapshot().marks.items()}
    plan = kt.after_marks(spark.read.parquet(path), marks, "src", "t")._jdf.queryExecution().toString()
    assert "GreaterThan(t,2024-01-05" in plan
    with monkeypatch.context() as m:
        m.setattr(kt.KeyedTable, "_commit", lambda self, snapshot: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            kt.load_new(table, spark.read.parquet(path), "src", "t")
    assert table.snapshot().marks.keys() == {"a", "b"}
    assert kt.load_new(table, spark.read.parquet(path), "src", "t")
    assert {r.id for r in table.read().collect()} == {2, 3, 4, 7, 8, 10} and table.snapshot().marks.keys() == {"a", "b", "c"}
