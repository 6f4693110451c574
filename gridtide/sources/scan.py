"""Scans: typed tables, CSV, interval matrices, drifting headers, JSON pages, HTML pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..operators.dedup import keep_last
from ..schemas import PRICE_CSV


def price_history(
    df: DataFrame, points: list[str] | None = None, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """First readings only, optional points and half-open date range; the filters reach the Parquet scan."""
    out = df.filter(F.col("repeated_hour") == 0)
    if points:
        out = out.filter(F.col("settlement_point").isin(points))
    if date_from:
        out = out.filter(F.col("delivery_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.filter(F.col("delivery_date") < F.lit(date_to).cast("date"))
    return out


def optional_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The named table, or an empty frame with its schema where it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return spark.createDataFrame([], schema)


def price_csv(spark: SparkSession, path: str, schema: T.StructType = PRICE_CSV, date_format: str = "MM/dd/yyyy") -> DataFrame:
    """Price CSV with date, hour 1-24 and optional interval 1-4 to slot start times."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    minutes = (F.col("hour") - 1) * 60
    if "interval" in schema.names:
        minutes = minutes + (F.col("interval") - 1) * 15
    day = F.unix_timestamp(F.to_timestamp("date", date_format))
    return raw.withColumn("t", F.timestamp_seconds(day + minutes * 60))


def leaf_csv(spark: SparkSession, root: str, schema: T.StructType, points: list[str] | None = None, point: str = "point") -> DataFrame:
    """All leaf CSV files below a folder, exact duplicates removed."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    if points:
        df = df.filter(F.col(point).isin(points))
    return df.distinct()


def interval_matrix(df: DataFrame, id_cols: list[str], value: str = "generation_mw") -> DataFrame:
    """Columns "1".."96" to long rows; NULL and non-numeric cells are dropped."""
    cells = [c for c in df.columns if c.isdigit()]
    long = df.unpivot(id_cols, cells, "interval_15min", value)
    return long.withColumns(
        {"interval_15min": F.col("interval_15min").cast("int"), value: F.trim(F.col(value)).try_cast("double")}
    ).filter(F.col(value).isNotNull())


def split_combined_key(df: DataFrame, col: str, date_format: str = "MM/dd/yy") -> DataFrame:
    """A "MM/DD/YY_Fuel" column to delivery_date and fuel; two-digit years 69-99 are of the last century."""
    day = F.to_date(F.regexp_extract(col, r"^([^_]+)_", 1), date_format)
    return df.withColumns(
        {
            "delivery_date": F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day),
            "fuel": F.regexp_extract(col, r"^[^_]+_(.*)$", 1),
        }
    ).drop(col)


def interval_headers_to_ts(df: DataFrame, date: str, id_cols: list[str], value: str = "mw") -> DataFrame:
    """Interval-end labels 0:15 .. 0:00 to end timestamps; DST duplicates dropped, 0:00 is the next midnight."""
    cells = [c for c in df.columns if re.fullmatch(r"\d{1,2}:\d{2}", c)]
    long = df.unpivot([date, *id_cols], cells, "label", value)
    hour = F.split_part("label", F.lit(":"), F.lit(1)).cast("int")
    minute = F.split_part("label", F.lit(":"), F.lit(2)).cast("int")
    seconds = F.when((hour == 0) & (minute == 0), 86400).otherwise(hour * 3600 + minute * 60)
    ts = F.timestamp_seconds(F.unix_timestamp(F.col(date).cast("timestamp")) + seconds)
    return long.withColumn("t", ts).filter(F.col(value).isNotNull()).drop("label", date)


def union_with_drift(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Ancillary price services, in table order.
SERVICES = ["regdn", "regup", "rrs", "nspin", "ecrs"]


def ancillary_by_header(df: DataFrame) -> DataFrame:
    """Find columns by header content, absent services become NULL, blank cells NULL."""
    found: dict[str, str] = {}
    for c in df.columns:
        h = c.strip().upper()
        if "DATE" in h:
            found["delivery_date"] = c
        elif "REPEAT" in h:
            found["repeated_hour"] = c
        elif "HOUR" in h:
            found["hour_ending"] = c
        else:
            for s in SERVICES:
                if h.startswith(s.upper()):
                    found[s] = c

    def number(c: str | None) -> Column:
        if c is None:
            return F.lit(None).cast("double")
        return F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).try_cast("double")

    date_text = F.col(f"`{found['delivery_date']}`").cast("string")
    parsed = F.coalesce(F.try_to_timestamp(date_text, F.lit("MM/dd/yyyy")), F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd")))
    hour = F.split_part(F.trim(F.col(f"`{found['hour_ending']}`").cast("string")), F.lit(":"), F.lit(1)).try_cast("int")
    repeated = F.col(f"`{found['repeated_hour']}`").cast("string") if "repeated_hour" in found else F.lit("N")
    return df.select(
        parsed.cast("date").alias("delivery_date"),
        hour.alias("hour_ending"),
        F.upper(F.trim(repeated)).isin("Y", "TRUE").cast("int").alias("repeated_hour"),
        *[number(found.get(s)).alias(s) for s in SERVICES],
    )


# Normalised reserve header -> canonical column.
RESERVE_HEADERS = {
    "sced_timestamp": "sced_timestamp", "sced_time_stamp": "sced_timestamp",
    "repeated_hour": "repeated_hour", "repeated_hour_flag": "repeated_hour",
    "batch_id": "batch_id", "batchid": "batch_id",
    "system_lambda": "system_lambda", "system_lamda": "system_lambda",
    "prc": "prc", "rtolcap": "rtolcap", "rtoffcap": "rtoffcap", "rtorpa": "rtorpa",
    "rtoffpa": "rtoffpa", "rtolhsl": "rtolhsl", "rtbp": "rtbp", "rtordpa": "rtordpa",
}


def reserves_with_drift(frames: list[DataFrame], zone: str = cal.MARKET_ZONE) -> DataFrame:
    """Yearly reserve files with differing headers to one UTC table, newest row per (time, batch)."""
    normal = []
    for i, f in enumerate(frames):
        names = {}
        for c in f.columns:
            key = re.sub(r"[\s\-]+", "_", c.strip().lower())
            if key in RESERVE_HEADERS:
                names[RESERVE_HEADERS[key]] = c
        normal.append(f.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.lit(i).alias("_file")))
    all_rows = union_with_drift(normal)
    repeated = F.upper(F.trim(F.col("repeated_hour"))) == "Y" if "repeated_hour" in all_rows.columns else F.lit(False)
    first = F.to_utc_timestamp(F.col("sced_timestamp").cast("timestamp"), zone)
    utc = F.when(repeated, cal.plus_hours(first, 1)).otherwise(first)
    return keep_last(all_rows.withColumn("sced_timestamp", utc), ["sced_timestamp", "batch_id"], [F.col("_file")]).drop("_file")


PAGE = "fields ARRAY<STRUCT<name: STRING, dataType: STRING>>, data ARRAY<ARRAY<STRING>>"


def decode_positional(df: DataFrame, page: str, columns: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """Positional JSON pages to typed rows.

    ``columns`` maps field names to types.  Short rows read as NULL at the end;
    a numeric zero is read as missing, as the feed uses zero for "no value".
    """
    parsed = df.select(*keep, F.from_json(page, PAGE).alias("_p"))
    rows = parsed.select(*keep, F.col("_p.fields.name").alias("_names"), F.posexplode("_p.data").alias("_pos", "_row"))

    def cell(name: str, kind: str) -> Column:
        at = F.array_position("_names", name).cast("int")
        raw = F.when(at > 0, F.try_element_at("_row", at))
        if kind == "boolean":
            return F.lower(raw).isin("true", "1", "yes").alias(name)
        value = raw.try_cast(kind)
        return (F.when(value != 0, value) if kind != "string" else value).alias(name)

    return rows.select(*keep, (F.col("_pos") + 1).alias("row_no"), *[cell(n, k) for n, k in columns.items()])


def html_cells(df: DataFrame, html: str, keep: list[str], pattern: str, names: list[str]) -> DataFrame:
    """All matches of a cell pattern with its groups, numbered in page order."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), i + 1).alias(n) for i, n in enumerate(names)]
    zipped = df.select(*keep, F.arrays_zip(*groups).alias("_c"))
    out = zipped.select(*keep, F.posexplode("_c").alias("pos", "_c"))
    return out.select(*keep, (F.col("pos") + 1).alias("pos"), *[F.col(f"_c.{n}").alias(n) for n in names])


def html_price_rows(df: DataFrame, html: str, points: list[str]) -> DataFrame:
    """Report pages (date, hour, one column per point) to long price rows.

    Table rows with a different cell count or without a date in the first cell are skipped.
    """
    rows = df.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("_tr"))
    cells = rows.select(
        F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(c)).alias("c")
    ).filter((F.size("c") == len(points) + 2) & F.col("c")[0].rlike(r"^\d{2}/\d{2}/\d{4}$"))
    priced = F.array(*[F.struct(F.lit(p).alias("p"), F.col("c")[i + 2].alias("v")) for i, p in enumerate(points)])
    long = cells.select(
        F.to_date(F.col("c")[0], "MM/dd/yyyy").alias("oper_day"),
        F.split_part(F.col("c")[1], F.lit(":"), F.lit(1)).try_cast("int").alias("hour_ending"),
        F.explode(priced).alias("x"),
    )
    return long.select("oper_day", "hour_ending", F.col("x.p").alias("settlement_point"), F.col("x.v").try_cast("double").alias("lmp"))


def filename_time(name: Column, lead_hours: Column, prefix: str = "hrrr") -> tuple[Column, Column]:
    """Init time in a file name ``<prefix>_YYYYMMDD_HH`` and the valid time ``lead_hours`` later."""
    text = F.regexp_extract(name, rf"{prefix}_(\d{{8}}_\d{{2}})", 1)
    init = F.try_to_timestamp(text, F.lit("yyyyMMdd_HH"))
    return init, F.timestamp_seconds(F.unix_timestamp(init) + lead_hours * 3600)


def after_high_water(df: DataFrame, stored: DataFrame, key: str, ts: str, default_days: int = 7) -> DataFrame:
    """Rows newer than the stored last timestamp per key.

    Keys never loaded start ``default_days`` before the newest row.  ``stored``
    has one row per key (key, hwm).
    """
    limits = df.groupBy(key).agg(F.max(ts).alias("_max")).join(stored, key, "left")
    back = F.timestamp_seconds(F.unix_timestamp("_max") - default_days * 86400)
    limits = limits.select(key, F.coalesce("hwm", back).alias("_hwm"))
    return df.join(limits, key).filter(F.col(ts) > F.col("_hwm")).drop("_hwm")


def missing_days(existing: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """Dates of [first, last] that are not in ``existing``."""
    bounds = existing.agg(first.alias("_a"), last.alias("_b"))
    expected = bounds.select(F.explode(F.sequence("_a", "_b")).alias(day))
    return expected.join(existing.select(day).distinct(), day, "left_anti")
