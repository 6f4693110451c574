"""Events in series: sessions, gap islands, lead time of alarms, ramps and their matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.frames import series
from .ranked import prefix_scan


def sessions(df: DataFrame, keys: list[str], t: str, gap_minutes: float, chunk: Column) -> DataFrame:
    """Add ``event_id``: rows closer than (or exactly) the gap belong to one event.

    Works on raw rows. The previous time comes from the row's own chunk or from
    the last row of the chunk before; the running count is a chunked scan, so a
    busy key is not one task.
    """
    src = df.withColumn("_ck", chunk)
    tails = src.groupBy(*keys, "_ck").agg(F.max(t).alias("_tail"))
    carried = tails.select(*keys, "_ck", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_ck")).alias("_before"))
    inside = W.partitionBy(*keys, "_ck").orderBy(t)
    prev = src.withColumn("_prev", F.lag(t).over(inside)).join(carried, [*keys, "_ck"])
    gap = (F.unix_micros(t) - F.unix_micros(F.coalesce("_prev", "_before"))) > int(gap_minutes * 60_000_000)
    starts = prev.withColumn("_start", F.coalesce(gap, F.lit(True)).cast("long")).drop("_prev", "_before", "_ck")
    return prefix_scan(starts, keys, chunk, [F.col(t)], sums={"event_id": F.col("_start")}).drop("_start")


def event_summary(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    return df.groupBy(*keys, "event_id").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("size"))


def event_recall(df: DataFrame, keys: list[str], score: str, threshold: float) -> DataFrame:
    """Share of events with at least one score at the threshold."""
    hits = df.groupBy(*keys, "event_id").agg(F.max((F.col(score) >= threshold).cast("int")).alias("_hit"))
    return hits.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.sum("_hit").alias("events_detected"), F.avg("_hit").alias("event_recall")
    )


def lead_times(df: DataFrame, keys: list[str], y: str, alarm: str, lookback: int = 12) -> DataFrame:
    """Per event start the rows between the earliest alarm in the lookback and the start (0 without alarm)."""
    w = series(keys)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    earliest = F.min(F.when(F.col(alarm) == 1, F.col("_rn"))).over(w.rowsBetween(-lookback, 0))
    start = (F.col(y) == 1) & F.coalesce(F.lag(y).over(w) != 1, F.lit(True))
    lead = F.coalesce(F.col("_rn") - earliest, F.lit(0))
    return numbered.withColumns({"_start": start, "lead": lead}).filter("_start").drop("_start", "_rn")


def lead_time_summary(leads: DataFrame, keys: list[str]) -> DataFrame:
    detected = F.count_if(F.col("lead") > 0)
    return leads.groupBy(*keys).agg(
        F.avg("lead").alias("mean_lead"), F.percentile("lead", 0.5).alias("median_lead"), F.max("lead").alias("max_lead"),
        detected.alias("n_detected"), F.count("*").alias("n_events"), (detected / F.count("*")).alias("detection_rate"),
    )


def ramp_candidates(df: DataFrame, keys: list[str], value: str, threshold: Column, window: int, direction: Column) -> DataFrame:
    """All rows with ``i``, their monotone run, whether their change over ``window`` rows reaches the threshold, and whether and where it goes on."""
    w = series(keys)
    v = F.col(value)
    s = df.withColumns({"i": F.row_number().over(w) - 1, "_sg": F.signum(v - F.lag(value).over(w))})
    change = F.coalesce((F.col("_sg") != F.lag("_sg").over(w)).cast("int"), F.lit(1))
    s = s.withColumn("_chg", change).withColumn("_run", F.sum("_chg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    here = F.struct(F.col("i"), F.col("t"), v.alias("v"))
    s = s.withColumns({"_here": here, "_run_end": F.max(here).over(W.partitionBy(*keys, "_run"))})
    s = s.withColumns({"_from": F.lag("_here", window).over(w), "_ns": F.lead("_sg").over(w), "_ne": F.lead("_run_end").over(w)})
    change = v - F.col("_from.v")
    up, down = change >= threshold, change <= -threshold
    # an extension follows the direction of the ramp while the next steps keep its sign
    extends = (down & (F.col("_ns") < 0)) | (up & (F.col("_ns") > 0))
    wanted = F.when(direction == "up", up).when(direction == "down", down).otherwise(up | down)
    found = F.coalesce(wanted, F.lit(False))
    return s.withColumns({"_found": found, "_goes_on": found & F.coalesce(extends, F.lit(False))}).withColumn(
        "_end", F.when(F.col("_goes_on"), F.col("_ne")).otherwise(F.col("_here"))
    )


def ramp_events(df: DataFrame, keys: list[str], value: str, threshold: float | str, window: int = 3, direction: str = "both") -> DataFrame:
    """Ramp events (start_i, end_i, magnitude, duration, rate, is_ramp_down); the search resumes after the end of an event.

    ``threshold`` and ``direction`` may name columns (they then belong in ``keys``).

    What "resume after the end" skips has a closed form. An event that goes on covers the rest of one monotone run, the run of the row after it. So a
    row is skipped if a candidate before it in its run goes on, or if the run's turning point before it is an event that goes on. A turning point is
    one exactly if it is a candidate that goes on, none before it in its own run does, and the turning point before is not one. In a row of runs that
    meet the first two conditions these are the first, third, fifth ... All of it is windows over one sort of the series, whatever its length.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    way = F.col(direction) if direction in df.columns else F.lit(direction)
    w = series(keys, "i")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    s = ramp_candidates(df, keys, value, limit, window, way)
    # the last row before this one that is a candidate and goes on, as the run it is in
    s = s.withColumn("_on", F.max(F.when(F.col("_goes_on"), F.col("_run"))).over(before))
    covered = F.coalesce(F.col("_on") == F.col("_run"), F.lit(False))
    turns = F.col("i") == F.col("_run_end.i")
    s = s.withColumns({"_covered": covered, "_able": F.when(turns, F.col("_goes_on") & ~covered)})
    unable = F.max(F.when(~F.col("_able"), F.col("_run"))).over(upto)
    s = s.withColumn("_chain", F.when(F.col("_able"), (F.col("_run") - F.coalesce(unable, F.lit(0))) % 2 == 1).otherwise(F.when(turns, F.lit(False))))
    entered = F.coalesce(F.last("_chain", ignorenulls=True).over(before), F.lit(False))
    out = s.withColumn("_entered", entered).filter(F.col("_found") & ~F.col("_covered") & ~F.col("_entered")).select(
        *keys, F.col("_from.i").alias("start_i"), F.col("_end.i").alias("end_i"), F.col("_from.t").alias("start_time"),
        F.col("_end.t").alias("end_time"), (F.col("_end.v") - F.col("_from.v")).alias("magnitude"),
    )
    out = out.withColumn("duration", F.col("end_i") - F.col("start_i"))
    return out.withColumns({"rate": F.try_divide(F.col("magnitude"), F.col("duration")), "is_ramp_down": F.col("magnitude") < 0})


#: Rows of a series whose events one block of the matching holds.
MATCH_ROWS = 4096


def match_events(events: DataFrame, keys: list[str], tolerance: int = 2, rows: int = MATCH_ROWS) -> DataFrame:
    """Greedy one-to-one matching of predicted (is_true = 0) to true events in time order: same direction, starts at most ``tolerance`` rows apart.

    A predicted event takes the first true one within the tolerance that is free. Later ones never look back past it, so all that the past decides is
    the last true start taken, and for a block of ``rows`` rows only the 2 * tolerance + 1 positions about its first row make a difference. Each block
    gives its hits and its own last true start for each of them; a key's blocks are then composed in order. A block holds the events of its rows, a
    key's fold one small table a block: no task sees the events of a series.
    """
    if rows <= 2 * tolerance:
        raise ValueError("blocks must be longer than twice the tolerance")
    group = [*keys, "is_ramp_down"]
    at, span = F.col("start_i").cast("long"), F.lit(rows)
    both = events.select(*group, at.alias("at"), (F.col("is_true") == 1).alias("_true"))
    first, last = F.floor((F.col("at") - tolerance) / span).cast("long"), F.floor((F.col("at") + tolerance) / span).cast("long")
    own = F.floor(F.col("at") / span).cast("long")
    dealt = both.withColumn("_block", F.explode(F.when(F.col("_true"), F.sequence(first, last)).otherwise(F.array(own))))
    near = W.partitionBy(*group, "_block").orderBy("at").rangeBetween(-tolerance, tolerance)
    guesses = dealt.withColumn("near", F.array_sort(F.collect_list(F.when(F.col("_true"), F.col("at"))).over(near))).filter(~F.col("_true"))
    low = F.col("_block") * span - (tolerance + 1)  # a last start here or before it is out of reach for the whole block

    def run(entering: Column) -> Column:
        state = lambda last, hits: F.struct(last.cast("long").alias("last"), hits.cast("long").alias("hits"))

        def step(acc: Column, guess: Column) -> Column:
            free = F.get(F.filter(guess["near"], lambda a: a > acc["last"]), F.lit(0))
            return F.when(free.isNotNull(), state(free, acc["hits"] + 1)).otherwise(acc)

        return F.aggregate("_guesses", state(entering, F.lit(0)), step)

    blocks = guesses.groupBy(*group, "_block").agg(F.array_sort(F.collect_list(F.struct("at", "near"))).alias("_guesses"))
    tables = blocks.select(*group, "_block", low.alias("low"), F.transform(F.sequence(low, low + 2 * tolerance), run).alias("by_state"))
    parts = tables.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_block", "low", "by_state"))).alias("_blocks"))
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("hits"))

    def chain(acc: Column, block: Column) -> Column:
        there = F.get(block["by_state"], (F.greatest(acc["last"], block["low"]) - block["low"]).cast("int"))
        return F.struct(there["last"].alias("last"), (acc["hits"] + there["hits"]).alias("hits"))

    hits = parts.select(*keys, F.aggregate("_blocks", begin, chain)["hits"].alias("hits")).groupBy(*keys).agg(F.sum("hits").alias("_hits"))
    totals = both.groupBy(*keys).agg(F.count_if("_true").alias("_trues"), F.count_if(~F.col("_true")).alias("_guesses"))
    # both sides stem from one table, so keys are renamed for the join; NULL keys meet
    hits = hits.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_hits")
    joined = totals.join(hits, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    n = F.coalesce("_hits", F.lit(0))
    return joined.select(*keys, n.alias("hits"), (F.col("_trues") - n).alias("misses"), (F.col("_guesses") - n).alias("false_alarms"))


def ramp_scores(matches: DataFrame) -> DataFrame:
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return matches.withColumns(
        {
            "pod": part(h, h + m), "far": part(f, h + f), "csi": part(h, h + m + f),
            "bias": part(h + f, h + m), "miss_rate": part(m, h + m),
        }
    )


def label_events(df: DataFrame, keys: list[str], flag: Column, min_gap: int, step_minutes: int) -> DataFrame:
    """Events of a flag on a slot series: closed once a row without flag lies more than ``min_gap`` steps after the last one."""
    w = series(keys)
    s = df.withColumn("_f", flag)
    last = F.max(F.when(F.col("_f"), F.col("t"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumns({"_last": last, "_row": F.lag("t").over(w)}).filter("_f")
    new = (F.unix_timestamp("_row") - F.unix_timestamp("_last")) > min_gap * step_minutes * 60
    s = s.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    s = s.withColumn("event_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return event_summary(s, keys, "t")
