import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import align, dedup
from gridtide.sources import scan, sink
from gridtide.schemas import ANCILLARY_HIST


def test_upsert_parquet_is_idempotent(spark, folder):
    path = f"{folder}/t"
    rows = lambda *r: spark.createDataFrame(r, "day string, k int, v double, seq int")
    sink.upsert_parquet(spark, path, rows(("a", 1, 1.0, 1), ("a", 2, 2.0, 1), ("b", 3, 3.0, 1)), ["day", "k"], "day", "seq")
    batch = rows(("a", 2, 20.0, 2), ("a", 4, 4.0, 2))
    for _ in range(2):
        sink.upsert_parquet(spark, path, batch, ["day", "k"], "day", "seq")
        got = {(r.day, r.k): r.v for r in spark.read.parquet(path).collect()}
        assert got == {("a", 1): 1.0, ("a", 2): 20.0, ("a", 4): 4.0, ("b", 3): 3.0}


def test_merge_priority_and_keep_last(spark):
    api = spark.createDataFrame([("t1", "p", 100.0)], "t string, point string, price double")
    feed = spark.createDataFrame([("t1", "p", 1.0), ("t2", "p", 2.0)], "t string, point string, price double")
    got = {r.t: r.price for r in dedup.first_source_wins([api, feed], ["t", "point"]).collect()}
    assert got == {"t1": 100.0, "t2": 2.0}
    x = spark.createDataFrame([(1, 1, None, 5.0), (1, 2, 7.0, None)], "k int, o int, a double, b double")
    r = dedup.keep_last_non_null(x, ["k"], F.col("o"), ["a", "b"]).first()
    assert (r.a, r.b) == (7.0, 5.0)


def test_one_to_one_join_fails_on_duplicates(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 9.0)], "k int, y double")
    with pytest.raises(Exception, match="duplicate keys"):
        align.join_one_to_one(a, b, ["k"]).collect()


def test_header_mapping(spark):
    old = spark.createDataFrame([("01/02/2020", "01:00", "N", "1.5", " ", "3", "4")], ["Delivery Date", "Hour Ending", "Repeated Hour Flag", "REGDN", "REGUP ", "RRS", "NSPIN"])
    r = scan.ancillary_by_header(old).first()
    assert (str(r.delivery_date), r.hour_ending, r.repeated_hour, r.regdn, r.regup, r.ecrs) == ("2020-01-02", 1, 0, 1.5, None, None)


def test_reserve_header_drift_and_repeated_hour(spark):
    a = spark.createDataFrame(
        [("2025-11-02 01:10:00", "N", 1, 20.0), ("2025-11-02 01:10:00", "Y", 1, 21.0)], ["SCED Timestamp", "Repeated Hour", "Batch ID", "System Lamda"]
    )
    got = sorted((str(r.sced_timestamp), r.system_lambda) for r in scan.reserves_with_drift([a]).collect())
    assert got == [("2025-11-02 06:10:00", 20.0), ("2025-11-02 07:10:00", 21.0)]


def test_positional_pages(spark):
    page = '{"fields": [{"name": "p", "dataType": "VARCHAR"}, {"name": "n", "dataType": "INTEGER"}, {"name": "f", "dataType": "BOOLEAN"}, {"name": "x", "dataType": "DOUBLE"}],' \
           ' "data": [["A", 3, true, 1.5], ["B", 0, false, 0], ["C", 7]]}'  # fmt: skip
    df = spark.createDataFrame([(page,)], "body string")
    rows = scan.decode_positional(df, "body", {"p": "string", "n": "int", "f": "boolean", "x": "double", "gone": "double"}).orderBy("row_no").collect()
    assert [(r.p, r.n, r.f, r.x, r.gone) for r in rows] == [("A", 3, True, 1.5, None), ("B", None, False, None, None), ("C", 7, None, None, None)]


def test_html_price_rows(spark):
    html = "<table><tr><th>Day</th></tr><tr><td>02/15/2026</td><td> 01:00 </td><td>1.5</td><td>n/a</td></tr><tr><td>x</td><td>1</td><td>2</td><td>3</td></tr></table>"
    rows = scan.html_price_rows(spark.createDataFrame([(html,)], "html string"), "html", ["A", "B"]).collect()
    assert [(str(r.oper_day), r.hour_ending, r.settlement_point, r.lmp) for r in rows] == [("2026-02-15", 1, "A", 1.5), ("2026-02-15", 1, "B", None)]


def test_optional_table(spark):
    assert scan.optional_table(spark, "no_such_table", ANCILLARY_HIST).columns == ANCILLARY_HIST.names
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("present_table")
    assert scan.optional_table(spark, "present_table", spark.table("present_table").schema).count() == 1


def test_fill_missing_only(spark):
    have = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, v string")
    other = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    got = {r.k: r.v for r in align.fill_missing_only(have, other, ["k"], "v").collect()}
    assert got == {1: "a", 2: "y", 3: None, 4: "z"}


def test_matrix_labels(spark):
    pdf = pd.DataFrame({"d": [pd.Timestamp("2024-01-01").date()], "f": ["Wnd"], "0:15": [1.0], "0:00": [2.0], "1:15 (DST)": [9.0]})
    rows = scan.interval_headers_to_ts(spark.createDataFrame(pdf), "d", ["f"]).collect()
    assert sorted((str(r.t), r.mw) for r in rows) == [("2024-01-01 00:15:00", 1.0), ("2024-01-02 00:00:00", 2.0)]
