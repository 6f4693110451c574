"""Market-shaped projections of the shared tables (whole tables, no row subsets).

Each projection exists twice: a DataFrame function and a SQL common table
expression of the same name.  Measures are averaged through decimal sums so
both sides start from the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.frames import exact_mean, exact_sum


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def _mean(x: str, s: int = 2) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{s}))) AS DOUBLE) / count({x})"


def _sum(x: str, s: int = 2) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{s}))) AS DOUBLE)"


# Order priority -> reserve service, line number -> fuel, event type -> weather station.
SERVICES = {
    "1-URGENT": "regup",
    "2-HIGH": "regdn",
    "3-MEDIUM": "rrs",
    "4-NOT SPECIFIED": "nspin",
    "5-LOW": "ecrs",
}
FUELS = {1: "Gas", 2: "Gas-CC", 3: "Coal", 4: "Nuclear", 5: "Solar", 6: "Wnd", 7: "Hydro"}


def b_ev(spark, d):
    return read(spark, d, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.col("event_type").alias("point"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _gridded(spark, d, minutes):
    return (
        b_ev(spark, d)
        .groupBy("point", cal.floor_time(F.col("ts"), minutes).alias("t"))
        .agg(exact_mean(F.col("price")).alias("price"))
    )


def b_rtm5(spark, d):
    return _gridded(spark, d, 5)


def b_rtm15(spark, d):
    return _gridded(spark, d, 15)


def b_rtm1h(spark, d):
    return _gridded(spark, d, 60)


def _hub(spark, d, minutes):
    return b_ev(spark, d).groupBy(cal.floor_time(F.col("ts"), minutes).alias("t")).agg(exact_mean(F.col("price")).alias("hub"))


def b_hub5(spark, d):
    return _hub(spark, d, 5)


def b_hub15(spark, d):
    return _hub(spark, d, 15)


def b_hub1h(spark, d):
    return _hub(spark, d, 60)


def b_wx(spark, d):
    """Hourly weather per station."""
    return (
        b_ev(spark, d)
        .groupBy(F.col("point").alias("station"), cal.floor_time(F.col("ts"), 60).alias("t"))
        .agg(
            (exact_mean(F.col("k")) / 2 - 10).alias("temp"),
            (exact_mean(F.col("user_id")) / 2).alias("wind"),
            (exact_mean(F.col("k")) * 3.6).alias("wdir"),
            (exact_mean(F.col("price")) / 10 + 1000).alias("pressure"),
        )
    )


def b_res(spark, d):
    """Five-minute reserve measures of the whole system."""
    return (
        b_ev(spark, d)
        .groupBy(cal.floor_time(F.col("ts"), 5).alias("t"))
        .agg(
            F.max("price").alias("prc"),
            exact_mean(F.col("price")).alias("lam"),
            F.when(F.min("k") > 5, F.min("price")).alias("adder"),
        )
    )


def b_gen(spark, d):
    """Hourly generation and its short-term forecast."""
    return (
        b_ev(spark, d)
        .groupBy(cal.floor_time(F.col("ts"), 60).alias("t"))
        .agg((exact_sum(F.col("price")) * 10).alias("gen"), (exact_sum(F.col("k")) * 10).alias("stwpf"))
    )


def b_dam_d(spark, d):
    return (
        read(spark, d, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("d"))
        .agg((exact_mean(F.col("o_totalprice")) / 997).alias("dam"))
    )


def _line(spark, d):
    return read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("point"),
        F.col("l_shipdate").cast("date").alias("d"),
        "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def b_rtm_d(spark, d):
    return _line(spark, d).groupBy("point", "d").agg((exact_mean(F.col("l_extendedprice")) / 997).alias("rtm"))


def b_sys_d(spark, d):
    """One system-wide daily series: day-ahead and real-time value of the same day."""
    rtm = _line(spark, d).groupBy("d").agg((exact_mean(F.col("l_extendedprice")) / 997).alias("rtm"))
    return b_dam_d(spark, d).join(rtm, "d")


def b_asmcpc_d(spark, d):
    by_service = read(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d"))
    price = F.col("o_totalprice")
    return by_service.agg(
        *[
            F.try_divide(
                exact_sum(F.when(F.col("o_orderpriority") == p, price)),
                F.count(F.when(F.col("o_orderpriority") == p, price)) * 997,
            ).alias(s)
            for p, s in SERVICES.items()
        ]
    )


def b_fuel(spark, d):
    """Generation rows (date, fuel, 15-minute interval, MW)."""
    names = F.create_map(*[F.lit(x) for kv in FUELS.items() for x in kv])
    return read(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("delivery_date"),
        F.try_element_at(names, F.col("l_linenumber")).alias("fuel"),
        (F.col("l_suppkey") % 96 + 1).cast("int").alias("interval_15min"),
        F.col("l_quantity").alias("mw"),
        "l_orderkey",
    )


def b_score(spark, d):
    """Scored rows: y = quality label, p = score, y2 = second label, grouping columns."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return (
        read(spark, d, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id", "lang", "source", "n_chars",
            F.col("quality").alias("y"),
            F.col("toxic").alias("y2"),
            (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("p"),
        )
    )


def b_err(spark, d):
    """Hourly forecasts against actuals: pred = hub mean, actual = point mean."""
    return (
        b_rtm1h(spark, d)
        .join(b_hub1h(spark, d), "t")
        .select("point", "t", F.col("price").alias("actual"), F.col("hub").alias("pred"))
    )


def b_when(spark, d):
    """Wall-clock instants spread over all seasons and hours."""
    day = F.unix_timestamp("o_orderdate") + (F.col("o_custkey") % 24) * 3600 + (F.col("o_orderkey") % 4) * 900
    return read(spark, d, "orders").select(F.timestamp_seconds(day).alias("t")).distinct()


def b_pnl(spark, d):
    """Daily profit and loss per point."""
    return (
        b_ev(spark, d)
        .groupBy("point", F.col("ts").cast("date").alias("d"))
        .agg((exact_sum(F.col("price") - F.lit(50.0)) / 10).alias("pnl"))
    )


CTES = {
    "b_ev": """SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS point, value AS price,
        CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS DOUBLE) AS k FROM events""",
    "b_rtm5": f"SELECT point, time_bucket(INTERVAL '5 minutes', ts) AS t, {_mean('price')} AS price FROM b_ev GROUP BY 1, 2",
    "b_rtm15": f"SELECT point, time_bucket(INTERVAL '15 minutes', ts) AS t, {_mean('price')} AS price FROM b_ev GROUP BY 1, 2",
    "b_rtm1h": f"SELECT point, date_trunc('hour', ts) AS t, {_mean('price')} AS price FROM b_ev GROUP BY 1, 2",
    "b_hub5": f"SELECT time_bucket(INTERVAL '5 minutes', ts) AS t, {_mean('price')} AS hub FROM b_ev GROUP BY 1",
    "b_hub15": f"SELECT time_bucket(INTERVAL '15 minutes', ts) AS t, {_mean('price')} AS hub FROM b_ev GROUP BY 1",
    "b_hub1h": f"SELECT date_trunc('hour', ts) AS t, {_mean('price')} AS hub FROM b_ev GROUP BY 1",
    "b_wx": f"""SELECT point AS station, date_trunc('hour', ts) AS t, {_mean('k')} / 2 - 10 AS temp,
        {_mean('user_id')} / 2 AS wind, ({_mean('k')}) * 3.6 AS wdir, ({_mean('price')}) / 10 + 1000 AS pressure
        FROM b_ev GROUP BY 1, 2""",
    "b_res": f"""SELECT time_bucket(INTERVAL '5 minutes', ts) AS t, max(price) AS prc, {_mean('price')} AS lam,
        CASE WHEN min(k) > 5 THEN min(price) END AS adder FROM b_ev GROUP BY 1""",
    "b_gen": f"""SELECT date_trunc('hour', ts) AS t, {_sum('price')} * 10 AS gen, {_sum('k')} * 10 AS stwpf
        FROM b_ev GROUP BY 1""",
    "b_dam_d": f"SELECT CAST(o_orderdate AS DATE) AS d, {_mean('o_totalprice')} / 997 AS dam FROM orders GROUP BY 1",
    "b_rtm_d": f"""SELECT l_returnflag AS point, CAST(l_shipdate AS DATE) AS d, {_mean('l_extendedprice')} / 997 AS rtm
        FROM lineitem GROUP BY 1, 2""",
    "b_sys_d": f"""SELECT d, dam, rtm FROM b_dam_d JOIN (SELECT CAST(l_shipdate AS DATE) AS d,
        {_mean('l_extendedprice')} / 997 AS rtm FROM lineitem GROUP BY 1) AS r USING (d)""",
    "b_asmcpc_d": "SELECT CAST(o_orderdate AS DATE) AS d, "
    + ", ".join(
        f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '{p}') AS DOUBLE)"
        f" / (nullif(count(*) FILTER (o_orderpriority = '{p}'), 0) * 997) AS {s}"
        for p, s in SERVICES.items()
    )
    + " FROM orders GROUP BY 1",
    "b_fuel": "SELECT CAST(l_shipdate AS DATE) AS delivery_date, CASE l_linenumber "
    + " ".join(f"WHEN {n} THEN '{f}'" for n, f in FUELS.items())
    + " END AS fuel, CAST(l_suppkey % 96 + 1 AS INTEGER) AS interval_15min, l_quantity AS mw, l_orderkey FROM lineitem",
    "b_score": """SELECT doc_id, lang, source, n_chars, quality AS y, toxic AS y2,
        CAST(n_chars AS DOUBLE) / (n_chars + 2000) AS p FROM labels JOIN documents USING (doc_id)""",
    "b_err": "SELECT point, t, price AS actual, hub AS pred FROM b_rtm1h JOIN b_hub1h USING (t)",
    "b_when": """SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) + to_hours(o_custkey % 24) + to_minutes(o_orderkey % 4 * 15)
        AS t FROM orders""",
    "b_pnl": f"""SELECT point, CAST(ts AS DATE) AS d, {_sum('price - 50.0')} / 10 AS pnl FROM b_ev GROUP BY 1, 2""",
}


def add_cte(name: str, sql: str) -> None:
    """Register a derived expression; it may use those registered before it."""
    _DEPENDS[name] = [m for m in CTES if re.search(rf"\b{m}\b", sql)]
    CTES[name] = sql


_DEPENDS = {n: [m for m in CTES if m != n and re.search(rf"\b{m}\b", body)] for n, body in CTES.items()}


def needed_ctes(sql: str) -> list[str]:
    """Base expressions a statement uses, dependencies first."""
    found: list[str] = []

    def visit(name: str) -> None:
        for dep in _DEPENDS[name]:
            visit(dep)
        if name not in found:
            found.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return found
