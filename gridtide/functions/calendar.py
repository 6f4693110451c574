"""Market calendar: zone conversion, market hours, holidays, calendar parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/Chicago"

# Market calendar definitions.
MAJOR_FIXED_HOLIDAYS = [(1, 1), (7, 4), (11, 11), (12, 25), (12, 31)]
PEAK_HOURS = list(range(7, 23))
SUMMER_MONTHS = [6, 7, 8, 9]
SUPER_PEAK_HOURS = list(range(14, 21))
MORNING_RAMP_HOURS = list(range(5, 10))
EVENING_RAMP_HOURS = list(range(17, 21))
FIXED_UTC_OFFSET_HOURS = 6


def floor_time(ts: Column, minutes: int) -> Column:
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step).cast("long") * step)


def plus_hours(ts: Column, hours: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts) + hours * 3600)


def to_local(ts: Column, zone: str = MARKET_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def is_repeated_hour(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """True exactly for the second reading of the fall-back hour."""
    return F.to_utc_timestamp(F.from_utc_timestamp(ts, zone), zone) != ts


def utc_to_market_parts(df: DataFrame, ts: str, zone: str = MARKET_ZONE) -> DataFrame:
    """Add delivery_date, hour 1-24, interval 1-4 and repeated flag (end-stamp reading:
    local hour 0 is hour 24 of the day before, local hour h > 0 stays h)."""
    local = to_local(F.col(ts), zone)
    hour = F.hour(local)
    return (
        df.withColumn("delivery_date", F.when(hour == 0, F.date_sub(local.cast("date"), 1)).otherwise(local.cast("date")))
        .withColumn("delivery_hour", F.when(hour == 0, 24).otherwise(hour))
        .withColumn("delivery_interval", (F.floor(F.minute(local) / 15) + 1).cast("int"))
        .withColumn("repeated_hour", is_repeated_hour(F.col(ts), zone).cast("int"))
    )


def local_to_utc(local: Column, ambiguous: str = "null", nonexistent: str = "shift", zone: str = MARKET_ZONE) -> Column:
    """Local wall time to UTC with explicit rules.

    ambiguous: "null" or "daylight" (first reading); nonexistent: "shift" to the
    first legal instant or "null".
    """
    utc = F.to_utc_timestamp(local, zone)
    hour_later = F.timestamp_seconds(F.unix_timestamp(utc) + 3600)
    twice = F.from_utc_timestamp(hour_later, zone) == local
    back = F.from_utc_timestamp(utc, zone)
    gap = back != local
    out = utc
    if ambiguous == "null":
        out = F.when(twice, F.lit(None).cast("timestamp")).otherwise(out)
    if nonexistent == "null":
        return F.when(gap, F.lit(None).cast("timestamp")).otherwise(out)
    # the transition instant itself: the legal hour the shifted reading starts in
    return F.when(gap, F.date_trunc("hour", utc)).otherwise(out)


def market_parts_to_utc(date: Column, hour: Column, interval: Column | None = None, hour_base: int = 1) -> Column:
    """(date, hour, interval) to the UTC start of the slot; ambiguous hour NULL, missing hour shifted."""
    minutes = (hour - hour_base) * 60
    if interval is not None:
        minutes = minutes + (interval - 1) * 15
    local = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + minutes * 60)
    return local_to_utc(local)


def market_hour_start(date: Column, hour_ending: Column) -> Column:
    """(date, hour ending) to the UTC interval start; ambiguous = daylight, missing = NULL.

    Hour 24 is read as the midnight that opens the date, so it sorts before hour 1.
    """
    end_local = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + F.pmod(hour_ending, F.lit(24)) * 3600)
    end = local_to_utc(end_local, ambiguous="daylight", nonexistent="null")
    return F.timestamp_seconds(F.unix_timestamp(end) - 3600)


def market_hour_grid(days: DataFrame, date: str = "delivery_date") -> DataFrame:
    """Every legal (date, hour_ending) of the given dates with its UTC start."""
    return (
        days.select(date, F.explode(F.sequence(F.lit(1), F.lit(24))).alias("hour_ending"))
        .withColumn("dt", market_hour_start(F.col(date), F.col("hour_ending")))
        .filter(F.col("dt").isNotNull())
    )


def local_day_bounds(date: Column, zone: str = MARKET_ZONE) -> tuple[Column, Column]:
    """Half-open UTC bounds of one local day (23, 24 or 25 hours)."""
    start = F.to_utc_timestamp(date.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone)
    return start, end


def fixed_day_bounds(date: Column, offset_hours: int = FIXED_UTC_OFFSET_HOURS) -> tuple[Column, Column]:
    start = plus_hours(date.cast("timestamp"), offset_hours)
    return start, plus_hours(start, 24)


def hour_ending_to_utc_fixed(date: Column, hour_ending: Column, offset_hours: int = FIXED_UTC_OFFSET_HOURS) -> Column:
    """Hour-ending label (1-24 or "HH:00") to UTC start by a fixed offset."""
    hour = F.split_part(hour_ending.cast("string"), F.lit(":"), F.lit(1)).cast("int")
    return F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + (hour - 1 + offset_hours) * 3600)


def monday_based_dow(d: Column) -> Column:
    return F.weekday(d)


def major_holiday(d: Column) -> Column:
    month, day, dow = F.month(d), F.dayofmonth(d), F.weekday(d)
    hit = F.lit(False)
    for m, dd in MAJOR_FIXED_HOLIDAYS:
        hit = hit | ((month == m) & (day == dd))
    hit = hit | ((month == 11) & (dow == 3) & day.between(22, 28))
    hit = hit | ((month == 9) & (dow == 0) & (day <= 7))
    hit = hit | ((month == 5) & (dow == 0) & (day >= 25))
    return hit.cast("int")


def federal_holidays(years: DataFrame) -> DataFrame:
    """Observed federal holidays of the given years (column ``y``), derived from the rules.

    At most eleven rows a year. The year after the last is needed too: a
    Saturday New Year is observed on the last day of the year before.
    """
    years = years.select(F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y")).distinct()

    def nth(month: int, dow: int, n: int) -> Column:
        first = F.make_date("y", F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(dow) - F.weekday(first), F.lit(7)) + 7 * (n - 1))

    def observed(month: int, day: int) -> Column:
        d = F.make_date("y", F.lit(month), F.lit(day))
        return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)

    last_may = F.make_date("y", F.lit(5), F.lit(31))
    memorial = F.date_sub(last_may, F.weekday(last_may))
    juneteenth = F.when(F.col("y") >= 2021, observed(6, 19))
    days = [
        observed(1, 1), nth(1, 0, 3), nth(2, 0, 3), memorial, juneteenth, observed(7, 4),
        nth(9, 0, 1), nth(10, 0, 2), observed(11, 11), nth(11, 3, 4), observed(12, 25),
    ]
    return years.select(F.explode(F.array(*days)).alias("holiday")).filter("holiday is not null").distinct()


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def calendar_features(df: DataFrame, ts: str, holiday: str | None = None) -> DataFrame:
    """Calendar parts and market flags of a wall-clock timestamp."""
    t = F.col(ts)
    hour, dow, month = F.hour(t), F.weekday(t), F.month(t)
    weekend, summer = dow >= 5, month.isin(SUMMER_MONTHS)
    hol = F.col(holiday) == 1 if holiday else major_holiday(t.cast("date")) == 1
    business = ~weekend & ~hol
    cols = {
        "hour": hour,
        "minute": F.minute(t),
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(t),
        "month": month,
        "quarter": F.quarter(t),
        "week_of_year": F.weekofyear(t),
        "is_weekend": weekend.cast("int"),
        "is_peak_hour": hour.isin(PEAK_HOURS).cast("int"),
        "is_summer": summer.cast("int"),
        "is_super_peak": (summer & hour.isin(SUPER_PEAK_HOURS) & ~weekend).cast("int"),
        "is_holiday": hol.cast("int"),
        "is_business_day": business.cast("int"),
        "hour_block": F.when(hour <= 6, 0).when(hour <= 12, 1).when(hour <= 18, 2).otherwise(3),
        "hour_dow_interaction": hour * 10 + dow,
        "is_morning_ramp": (hour.isin(MORNING_RAMP_HOURS) & business).cast("int"),
        "is_evening_ramp": (hour.isin(EVENING_RAMP_HOURS) & summer).cast("int"),
    }
    return df.withColumns(cols)


def season_flags(df: DataFrame, ts: str, part_starts: tuple[int, int, int, int] = (5, 12, 17, 22)) -> DataFrame:
    """Season and day-part flags; ``part_starts`` are the first hours of morning, afternoon, evening, night."""
    t = F.col(ts)
    hour, month = F.hour(t), F.month(t)
    morning, afternoon, evening, night = part_starts
    return df.withColumns(
        {
            "is_winter": month.isin(12, 1, 2).cast("int"),
            "is_spring": month.isin(3, 4, 5).cast("int"),
            "is_summer": month.isin(6, 7, 8).cast("int"),
            "is_fall": month.isin(9, 10, 11).cast("int"),
            "is_morning": ((hour >= morning) & (hour < afternoon)).cast("int"),
            "is_afternoon": ((hour >= afternoon) & (hour < evening)).cast("int"),
            "is_evening": ((hour >= evening) & (hour < night)).cast("int"),
            "is_night": ((hour >= night) | (hour < morning)).cast("int"),
        }
    )


def sunrise_features(df: DataFrame, ts: str, latitude: float = 29.76) -> DataFrame:
    t = F.col(ts)
    decl = 23.45 * F.sin(F.radians((F.dayofyear(t) - 81) * (360 / 365)))
    sunrise = 12 - F.degrees(F.acos(-math.tan(math.radians(latitude)) * F.tan(F.radians(decl)))) / 15
    raw = (sunrise - (F.hour(t) + F.minute(t) / 60)) * 60
    minutes = F.when(raw < -720, raw + 1440).otherwise(raw)
    return df.withColumns(
        {
            "minutes_to_sunrise": minutes,
            "is_pre_sunrise": ((minutes > 0) & (minutes < 120)).cast("int"),
            "is_post_sunrise": ((minutes < 0) & (minutes > -120)).cast("int"),
            "is_evening_peak": F.hour(t).between(17, 22).cast("int"),
        }
    )
