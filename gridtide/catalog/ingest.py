"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.frames import exact_mean
from ..operators import dedup
from ..schemas import ANCILLARY_HIST, schema
from ..sources.keyed_table import KeyedTable, load_new
from ..sources import scan, sink
from . import base
from .registry import query
from .rules import loc


def market_history(spark, d):
    """Hourly prices as a stored history table."""
    parts = cal.utc_to_market_parts(base.b_rtm1h(spark, d), "t")
    return parts.select(
        "delivery_date", F.col("delivery_hour").alias("hour_ending"), "repeated_hour",
        F.col("point").alias("settlement_point"), F.col("price").alias("lmp"),
    )


HISTORY = f"""SELECT CASE WHEN hour(l) = 0 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS delivery_date,
   CASE WHEN hour(l) = 0 THEN 24 ELSE hour(l) END AS hour_ending, point AS settlement_point, price AS lmp
   FROM (SELECT point, price, {loc("t")} AS l FROM b_rtm1h)"""


@query(
    "scan_dam_hourly", text="settlement_point", dates="delivery_date", ints="hour_ending", nums="lmp",
    sql=f"SELECT * FROM ({HISTORY}) WHERE delivery_date >= DATE '2024-01-03' AND delivery_date < DATE '2024-01-25'",
)
def scan_dam_hourly(spark, d):
    path = sink.scratch_path(spark, "dam_hist")
    market_history(spark, d).write.partitionBy("settlement_point").parquet(path)
    return scan.price_history(spark.read.parquet(path), date_from="2024-01-03", date_to="2024-01-25")


@query(
    "scan_optional_table", dates="d", nums="dam regup",
    sql="SELECT d, dam, CAST(NULL AS DOUBLE) AS regup FROM b_dam_d",
)
def scan_optional_table(spark, d):
    absent = scan.optional_table(spark, "ancillary_hist_not_loaded", ANCILLARY_HIST)
    prices = base.b_dam_d(spark, d)
    return prices.join(absent.groupBy(F.col("delivery_date").alias("d")).agg(F.avg("regup").alias("regup")), "d", "left")


@query("scan_price_csv", text="point", times="t", nums="price", sql="SELECT point, t, price FROM b_rtm15")
def scan_price_csv(spark, d):
    path = sink.scratch_path(spark, "price_csv")
    t = F.col("t")
    base.b_rtm15(spark, d).select(
        F.date_format(t, "MM/dd/yyyy").alias("date"), (F.hour(t) + 1).alias("hour"),
        (F.floor(F.minute(t) / 15) + 1).alias("interval"), "price", "point",
    ).write.option("header", True).csv(path)
    return scan.price_csv(spark, path)


def fuel_matrix(spark, d):
    """Wide text table: one row per (date, fuel), one column per interval."""
    f = base.b_fuel(spark, d)
    wide = f.groupBy("delivery_date", "fuel").pivot("interval_15min", list(range(1, 97))).agg(F.sum("mw"))
    cell = lambda c: F.when(F.col(c) < 5, "n/a").otherwise(F.col(c).cast("string")).alias(c)
    return wide.select("delivery_date", "fuel", *[cell(str(i)) for i in range(1, 97)])


@query(
    "interval_matrix_to_long", text="layout fuel", dates="delivery_date", ints="interval_15min", nums="generation_mw",
    sql=" UNION ALL ".join(
        f"""SELECT '{x}' AS layout, fuel, delivery_date, interval_15min, sum(mw) AS generation_mw FROM b_fuel
        GROUP BY ALL HAVING sum(mw) >= 5""" for x in ("combined", "separate")),
)
def interval_matrix_to_long(spark, d):
    wide = fuel_matrix(spark, d)
    separate = scan.interval_matrix(wide, ["delivery_date", "fuel"]).withColumn("layout", F.lit("separate"))
    joined = wide.withColumn("Date_Fuel", F.concat_ws("_", F.date_format("delivery_date", "MM/dd/yy"), "fuel")).drop("delivery_date", "fuel")
    combined = scan.split_combined_key(scan.interval_matrix(joined, ["Date_Fuel"]), "Date_Fuel")
    return separate.unionByName(combined.withColumn("layout", F.lit("combined")))


def _label(i):
    return f"{i * 15 // 60 % 24}:{i * 15 % 60:02d}"


@query("interval_header_to_ts", text="point", times="t", nums="mw", sql="SELECT point, t + INTERVAL 15 MINUTE AS t, price AS mw FROM b_rtm15")
def interval_header_to_ts(spark, d):
    r = base.b_rtm15(spark, d).withColumns({"day": F.col("t").cast("date"), "i": (F.hour("t") * 60 + F.minute("t")) / 15 + 1})
    wide = r.groupBy("day", "point").pivot("i", [float(i) for i in range(1, 97)]).agg(F.first("price"))
    named = wide.select("day", "point", *[F.col(f"`{float(i)}`").alias(_label(i)) for i in range(1, 97)], F.lit(0.0).alias("1:15 (DST)"))
    return scan.interval_headers_to_ts(named, "day", ["point"])


@query(
    "csv_header_mapping", dates="delivery_date", ints="hour_ending repeated_hour", nums="regdn regup rrs nspin ecrs",
    sql="""SELECT d AS delivery_date, CAST(day(d) % 24 + 1 AS INTEGER) AS hour_ending, month(d) = 11 AS repeated_hour, regdn, regup, rrs, nspin,
      CASE WHEN year(d) >= 1998 THEN ecrs END AS ecrs FROM b_asmcpc_d""",
)
def csv_header_mapping(spark, d):
    a = base.b_asmcpc_d(spark, d)
    day = F.col("d")
    head = {
        "Delivery Date": F.date_format(day, "MM/dd/yyyy"),
        "Hour Ending": F.concat(F.lpad((F.dayofmonth(day) % 24 + 1).cast("string"), 2, "0"), F.lit(":00")),
        "Repeated Hour Flag": F.when(F.month(day) == 11, "Y").otherwise("N"),
    }
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    prices = {"REGDN": text("regdn"), "REGUP ": text("regup"), "RRS": text("rrs"), "NSPIN": text("nspin")}
    old = a.filter(F.year(day) < 1998).select(*[v.alias(k) for k, v in {**head, **prices}.items()])
    new = a.filter(F.year(day) >= 1998).select(*[v.alias(k) for k, v in {**head, **prices, "ECRS": text("ecrs")}.items()])
    return scan.union_with_drift([scan.ancillary_by_header(old), scan.ancillary_by_header(new)])


@query(
    "schema_drift_reserves", times="sced_timestamp", ints="batch_id", nums="system_lambda prc rtordpa",
    sql="""SELECT t + INTERVAL 6 HOUR AS sced_timestamp, 1 AS batch_id, lam AS system_lambda,
      CASE WHEN t >= TIMESTAMP '2024-01-15' THEN prc ELSE prc + 1 END AS prc,
      CASE WHEN t >= TIMESTAMP '2024-01-15' THEN adder END AS rtordpa FROM b_res""",
)
def schema_drift_reserves(spark, d):
    r = base.b_res(spark, d)
    late = F.col("t") >= "2024-01-15"
    first = r.select(F.col("t").alias("SCED Time Stamp"), F.lit(1).alias("Batch ID"), F.col("lam").alias("System Lamda"), F.col("prc").alias("PRC "))
    again = r.filter(~late).select(
        F.col("t").alias("sced_timestamp"), F.lit(1).alias("BatchID"), F.col("lam").alias("system_lambda"), (F.col("prc") + 1).alias("prc")
    )
    second = r.filter(late).select(
        F.col("t").alias("SCED TimeStamp".replace("TimeStamp", "Timestamp")), F.lit(1).alias("batch-id"),
        F.col("lam").alias("SYSTEM_LAMBDA"), F.col("prc").alias("Prc"), F.col("adder").alias("RTORDPA"),
    )
    return scan.reserves_with_drift([first, again, second])


@query("union_leaf_files", text="point", times="t", nums="price", sql="SELECT point, t, price FROM b_rtm1h")
def union_leaf_files(spark, d):
    root = sink.scratch_path(spark, "leaf")
    r = base.b_rtm1h(spark, d)
    r.withColumn("day", F.col("t").cast("date")).write.option("header", True).partitionBy("day").csv(f"{root}/a")
    r.filter(F.hour("t") < 6).write.option("header", True).csv(f"{root}/b/again")
    return scan.leaf_csv(spark, root, schema("point STRING, t TIMESTAMP, price DOUBLE")).orderBy("point", "t")


@query(
    "decode_positional_json", ints="page row_no event_id hot", nums="lmp", text="point",
    sql="""SELECT event_id // 50 AS page, event_id % 50 + 1 AS row_no, CASE WHEN event_id <> 0 THEN event_id END AS event_id,
      point, CASE WHEN price <> 0 AND k >= 5 THEN price END AS lmp, price > 100 AS hot FROM b_ev""",
)
def decode_positional_json(spark, d):
    e = base.b_ev(spark, d)
    lmp = F.col("price").cast("string")
    full = F.array(F.col("event_id").cast("string"), F.col("point"), (F.col("price") > 100).cast("string"), lmp)
    row = F.when(F.col("k") >= 5, full).otherwise(F.slice(full, 1, 3))
    # a page holds at most 50 rows, so the collected list is bounded
    pages = e.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.sort_array(F.collect_list(F.struct("event_id", row.alias("r")))).alias("x"))
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("dataType"))
                       for n, k in (("event_id", "INTEGER"), ("point", "VARCHAR"), ("hot", "BOOLEAN"), ("lmp", "DOUBLE"))])
    pages = pages.select("page", F.to_json(F.struct(fields.alias("fields"), F.col("x.r").alias("data"))).alias("body"))
    return scan.decode_positional(pages, "body", {"event_id": "bigint", "point": "string", "hot": "boolean", "lmp": "double"}, keep=["page"])


@query(
    "html_table_to_rows", ints="page_id pos", text="href label",
    sql=r"""SELECT page_id, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href, unnest(l) AS label FROM (SELECT page_id,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l
      FROM pages)""",
)
def html_table_to_rows(spark, d):
    return scan.html_cells(base.read(spark, d, "pages"), "html", ["page_id"], r'<a href="([^"]*)">([^<]*)</a>', ["href", "label"])


@query(
    "upsert_last_write", text="point", ints="user_id event_id", nums="price",
    sql="""SELECT point, user_id, max(event_id) AS event_id, arg_max(price, event_id) AS price FROM b_ev GROUP BY 1, 2""",
)
def upsert_last_write(spark, d):
    e = base.b_ev(spark, d).select("point", "user_id", "event_id", "price")
    cut = "2024-01-16"
    ts = base.b_ev(spark, d)
    old = ts.filter(F.col("ts") < cut).select(e.columns)
    new = ts.filter(F.col("ts") >= cut).select(e.columns)
    table = KeyedTable(spark, sink.scratch_path(spark, "latest"), ["point", "user_id"], "event_id")
    for number, batch in enumerate((old, new)):
        table.upsert(batch, "feed", number)
    return table.read()


@query(
    "floor_5min_ingest", text="settlement_point", times="time", nums="lmp",
    sql="""SELECT point AS settlement_point, time_bucket(INTERVAL '5 minutes', ts) AS time,
      arg_max(CASE WHEN k < 5 THEN 0 ELSE price END, event_id) AS lmp FROM b_ev GROUP BY 1, 2""",
)
def floor_5min_ingest(spark, d):
    e = base.b_ev(spark, d)
    price = F.when(F.col("k") >= 5, F.col("price").cast("string"))
    early = F.col("ts") < "2024-01-10"
    raw = e.select(
        "event_id", F.col("ts").alias("timestamp"),
        F.when(early, F.col("point")).alias("settlementPoint"), F.when(~early, F.col("point")).alias("SettlementPointName"),
        F.when(early, price).alias("settlementPointPrice"), F.when(~early, price).alias("LMP"),
    )
    names = {
        "time": ["timestamp"],
        "settlement_point": ["settlementPoint", "SettlementPointName"],
        "lmp": ["settlementPointPrice", "LMP"],
    }
    return sink.floor_5min_ingest(raw, "event_id", names)


@query(
    "hour_ending_to_utc_fixed", ints="o_orderkey", times="utc",
    sql="SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_custkey % 24 + 6) AS utc FROM orders",
)
def hour_ending_to_utc_fixed(spark, d):
    o = base.read(spark, d, "orders")
    label = F.concat(F.lpad((F.col("o_custkey") % 24 + 1).cast("string"), 2, "0"), F.lit(":00"))
    return o.select("o_orderkey", cal.hour_ending_to_utc_fixed(F.col("o_orderdate").cast("date"), label).alias("utc"))


@query(
    "incremental_high_water", text="point", ints="n", times="hwm",
    sql="""SELECT point, count(*) AS n, max(ts) AS hwm FROM b_ev JOIN (SELECT point, CASE WHEN point = 'error'
      THEN date_trunc('second', max(ts)) - INTERVAL 7 DAY ELSE max(ts) FILTER (ts < TIMESTAMP '2024-01-20') END AS h FROM b_ev GROUP BY 1)
      USING (point) WHERE ts > h GROUP BY 1""",
)
def incremental_high_water(spark, d):
    """Two loads: the first takes what there was before a day, of all sources but one; the second goes on from the marks that the first has stored."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("point"), "ts")
    table = KeyedTable(spark, sink.scratch_path(spark, "loaded"), ["event_id"], "ts", buckets=4)
    load_new(table, e.filter((F.col("ts") < "2024-01-20") & (F.col("point") != "error")), "point", "ts")
    load_new(table, e, "point", "ts")
    second = table.read(2).join(table.read(1), "event_id", "left_anti")
    return second.groupBy("point").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp").alias("hwm"))


@query(
    "missing_days_to_load", dates="d",
    sql="""SELECT CAST(x AS DATE) AS d FROM (SELECT unnest(generate_series(min(d), max(d) + 1, INTERVAL 1 DAY)) AS x FROM b_dam_d)
      WHERE CAST(x AS DATE) NOT IN (SELECT d FROM b_dam_d)""",
)
def missing_days_to_load(spark, d):
    days = base.b_dam_d(spark, d).select("d")
    return scan.missing_days(days, "d", F.min("d"), F.date_add(F.max("d"), 1))


@query(
    "filename_timestamp", ints="o_orderkey", times="init valid_time",
    sql="""SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_custkey % 24) AS init,
      CAST(o_orderdate AS TIMESTAMP) + to_hours(o_custkey % 24 + o_orderkey % 18) AS valid_time FROM orders""",
)
def filename_timestamp(spark, d):
    o = base.read(spark, d, "orders")
    name = F.concat(
        F.lit("grids/hrrr_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
        F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0"), F.lit(".nc"),
    )
    init, valid = scan.filename_time(name, F.col("o_orderkey") % 18)
    return o.select("o_orderkey", init.alias("init"), valid.alias("valid_time"))


@query(
    "export_partitioned_parquet", text="settlement_point split", ints="n hours", nums="total",
    sql="""SELECT point AS settlement_point, CASE WHEN t < TIMESTAMP '2024-01-15' THEN 'train' WHEN t < TIMESTAMP '2024-01-22' THEN 'val'
      ELSE 'test' END AS split, count(*) AS n, sum(hour(t)) AS hours, sum(CAST(CAST(price AS FLOAT) AS DOUBLE)) AS total FROM b_rtm1h GROUP BY 1, 2""",
)
def export_partitioned_parquet(spark, d):
    path = sink.scratch_path(spark, "export")
    t = F.col("t")
    split = F.when(t < "2024-01-15", "train").when(t < "2024-01-22", "val").otherwise("test")
    out = base.b_rtm1h(spark, d).select(
        F.col("point").alias("settlement_point"), split.alias("split"), t.cast("string").alias("time"),
        F.hour(t).cast("tinyint").alias("hour"), F.col("price").cast("float").alias("price"),
    )
    sink.export_partitioned(out, path, ["settlement_point", "split"], salt=F.col("time"))
    back = spark.read.parquet(path).groupBy("settlement_point", "split")
    return back.agg(F.count("*").alias("n"), F.sum("hour").alias("hours"), F.sum(F.col("price").cast("double")).alias("total"))


@query("export_sorted_csv", text="point", times="t", nums="price", sql="SELECT point, t, price FROM b_rtm1h")
def export_sorted_csv(spark, d):
    path = sink.scratch_path(spark, "sorted_csv")
    sink.export_sorted_csv(base.b_rtm1h(spark, d), path, ["point", "t"])
    return spark.read.schema("point STRING, t TIMESTAMP, price DOUBLE").option("header", True).csv(path)


@query(
    "export_json_report", text="model", ints="n hour", nums="mae hour_mae",
    sql="""SELECT m.point AS model, m.n, m.mae, h.hour, h.hour_mae FROM (SELECT point, count(*) AS n, avg(abs(pred - actual)) AS mae
      FROM b_err GROUP BY 1) m JOIN (SELECT point, hour(t) AS hour, avg(abs(pred - actual)) AS hour_mae FROM b_err GROUP BY 1, 2) h USING (point)""",
)
def export_json_report(spark, d):
    path = sink.scratch_path(spark, "report")
    e = base.b_err(spark, d).withColumn("a", F.abs(F.col("pred") - F.col("actual")))
    overall = e.groupBy("point").agg(F.count("*").alias("n"), F.avg("a").alias("mae"))
    hourly = e.groupBy("point", F.hour("t").alias("h")).agg(F.avg("a").alias("mae"))
    # 24 entries per model at most
    nested = hourly.groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct(F.col("h").cast("string"), "mae"))).alias("by_hour"))
    report = overall.join(nested, "point").select(F.col("point").alias("model"), F.struct("n", "mae").alias("metrics"), "by_hour")
    sink.export_json(report, path)
    back = spark.read.schema("model STRING, metrics STRUCT<n: BIGINT, mae: DOUBLE>, by_hour MAP<STRING, DOUBLE>").json(path)
    return back.select("model", "metrics.n", "metrics.mae", F.explode("by_hour").alias("hour", "hour_mae"))
