from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridtide.functions import calendar as cal
from gridtide.functions import rules

CASES = [
    ("2026-02-16 06:00:00", (date(2026, 2, 15), 24, 1, 0)),
    ("2026-02-15 18:00:00", (date(2026, 2, 15), 12, 1, 0)),
    ("2026-02-15 07:00:00", (date(2026, 2, 15), 1, 1, 0)),
    ("2026-02-15 07:15:00", (date(2026, 2, 15), 1, 2, 0)),
    ("2026-02-15 07:45:00", (date(2026, 2, 15), 1, 4, 0)),
    ("2026-03-08 08:00:00", (date(2026, 3, 8), 3, 1, 0)),
    ("2026-11-01 06:00:00", (date(2026, 11, 1), 1, 1, 0)),
    ("2026-11-01 07:00:00", (date(2026, 11, 1), 1, 1, 1)),
]


def test_market_parts(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "s string").withColumn("u", F.col("s").cast("timestamp"))
    rows = {r.s: r for r in cal.utc_to_market_parts(df, "u").collect()}
    for t, want in CASES:
        r = rows[t]
        assert (r.delivery_date, r.delivery_hour, r.delivery_interval, r.repeated_hour) == want


def test_local_day_has_23_hours_in_spring(spark):
    df = spark.createDataFrame([(date(2026, 3, 8),)], "d date")
    start, end = cal.local_day_bounds(F.col("d"))
    r = df.select(start.alias("a"), end.alias("b")).first()
    assert (r.a, r.b) == (datetime(2026, 3, 8, 6), datetime(2026, 3, 9, 5))


@pytest.mark.parametrize(
    "local, ambiguous, nonexistent, want",
    [
        ("2024-11-03 01:30:00", "null", "shift", None),
        ("2024-11-03 01:30:00", "daylight", "shift", datetime(2024, 11, 3, 6, 30)),
        ("2024-03-10 02:30:00", "null", "shift", datetime(2024, 3, 10, 8, 0)),
        ("2024-03-10 02:30:00", "null", "null", None),
        ("2024-07-01 12:00:00", "null", "shift", datetime(2024, 7, 1, 17, 0)),
    ],
)
def test_local_to_utc_rules(spark, local, ambiguous, nonexistent, want):
    df = spark.createDataFrame([(local,)], "s string").withColumn("l", F.col("s").cast("timestamp"))
    assert df.select(cal.local_to_utc(F.col("l"), ambiguous, nonexistent).alias("u")).first().u == want


def test_grid_never_holds_the_missing_hour(spark):
    days = spark.createDataFrame([(date(2024, 3, 10),), (date(2024, 3, 11),)], "delivery_date date")
    got = {(r.delivery_date, r.hour_ending) for r in cal.market_hour_grid(days).collect()}
    assert (date(2024, 3, 10), 2) not in got
    assert len(got) == 47


def test_holidays(spark):
    days = ["2024-11-28", "2024-11-21", "2024-09-02", "2024-05-27", "2024-05-20", "2024-12-31"]
    df = spark.createDataFrame([(x,) for x in days], "s string").withColumn("d", F.col("s").cast("date"))
    flags = {r.s: r.h for r in df.select("s", cal.major_holiday(F.col("d")).alias("h")).collect()}
    assert flags == {"2024-11-28": 1, "2024-11-21": 0, "2024-09-02": 1, "2024-05-27": 1, "2024-05-20": 0, "2024-12-31": 1}
    years = spark.createDataFrame([(2021,)], "y int")
    federal = {str(r.holiday) for r in cal.federal_holidays(years).collect()}
    # Saturday holidays move to Friday, Sunday ones to Monday
    assert {"2021-06-18", "2021-07-05", "2021-12-24", "2021-12-31", "2021-11-25"} <= federal


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(-20.0,), (-5.0,), (5.0,), (20.0,), (20.01,), (None,)], "x double")
    rows = df.select(rules.spread_class(F.col("x")).alias("c"), rules.price_level_bin(F.col("x")).alias("p")).collect()
    assert [r.c for r in rows] == [0, 1, 2, 3, 4, None]
    assert [r.p for r in rows] == [None, None, 0, 0, 1, None]


def test_clean_keys(spark):
    raw = spark.createDataFrame(
        [("05:00", "Y", "02/15/2026", " hb_west "), ("5", "N", "2026-02-15", "XX"), ("24:00", "True", "2026-02-15", "HB_WEST")],
        "hour string, repeated string, date string, point string",
    )
    got = [
        (r.delivery_hour, r.repeated_hour, str(r.delivery_date), r.settlement_point, r.known_point)
        for r in rules.clean_market_keys(raw, ["HB_WEST"]).collect()
    ]
    assert got == [(5, 1, "2026-02-15", "HB_WEST", 1), (5, 0, "2026-02-15", "XX", 0), (24, 1, "2026-02-15", "HB_WEST", 1)]
