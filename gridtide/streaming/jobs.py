"""Structured Streaming jobs: ingest, windows, sessions, joins and keyed state.

Every job takes streaming DataFrames and returns a streaming DataFrame (or, for
upserts, starts a ``foreachBatch`` writer).  Checkpoints belong in the shared
folder, so a restarted query resumes from its offsets and state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.calendar import floor_time
from ..sources.keyed_table import KeyedTable
from ..sources.sink import is_folder, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed custom state needs the RocksDB store (state on disk, changelog in the checkpoint)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, folder: str, name_glob: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream; admission control bounds a micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of part files."""
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return file_stream(spark, path, "*.parquet", schema, files_per_trigger)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, name, schema, files_per_trigger)


def drain(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything available now into a Parquet folder and read it back.

    With a folder (shared, of this stream alone) a later call goes on from its checkpoint; without one, each call starts anew.
    """
    spark = df.sparkSession
    out = folder or scratch_path(spark, "stream")
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_upsert(feed: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keyed last-write-wins per micro-batch, one snapshot a batch. A batch that is replayed after a failure is known by its number and changes nothing."""
    return each_batch(feed, lambda batch, number: table.upsert(batch, checkpoint, number), checkpoint)


def tumbling_average(feed: DataFrame, key: str, t: str, value: str, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    w = feed.withWatermark(t, delay).groupBy(F.window(t, width).alias("w"), key)
    return w.agg(F.avg(value).alias("price"), F.count("*").alias("n")).select(key, F.col("w.start").alias("t"), "price", "n")


def merged_moments(parts: Column) -> Column:
    """(n, mean, m2) of an array of (n, mean, m2) of disjoint sets, merged one after the other.

    m2 is the sum of squared distances from the mean. Each merge adds the distance of two means, so no large squares cancel, whatever the level.
    """
    moments = lambda n, mean, m2: F.struct(n.cast("double").alias("n"), mean.cast("double").alias("mean"), m2.cast("double").alias("m2"))

    def step(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        both = moments(n, a["mean"] + apart * b["n"] / n, a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n)
        return F.when(a["n"] == 0, moments(b["n"], b["mean"], b["m2"])).otherwise(both)

    some = F.filter(parts, lambda x: x["n"] > 0)
    return F.aggregate(some, moments(F.lit(0), F.lit(0), F.lit(0)), step)


def sliding_stats(feed: DataFrame, key: str, t: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """24-hour mean, deviation and maximum at every quarter hour.

    Rows are first folded into 15-minute partial moments; only those few partials are spread over the 96 overlapping windows, not the raw feed. A window
    holds at most 96 partials, merged in time order.
    """
    v = F.col(value)
    slots = (
        feed.withWatermark(t, delay)
        .groupBy(F.window(t, "15 minutes").alias("slot"), key)
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.max(v).alias("m"))
    )
    part = F.struct(F.col("slot.start").alias("at"), F.col("n").cast("double").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    day = slots.groupBy(F.window(F.window_time("slot"), "24 hours", "15 minutes").alias("w"), key).agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("m").alias("max")
    )
    day = day.withColumn("_all", merged_moments(F.col("parts")))
    n = F.col("_all.n")
    std = F.when(n > 1, F.sqrt(F.col("_all.m2") / (n - 1)))
    return day.select(key, F.col("w.end").alias("t"), n.cast("long").alias("n"), F.when(n > 0, F.col("_all.mean")).alias("mean"), std.alias("std"), "max")


def session_events(feed: DataFrame, key: str, t: str, gap: str = "60 minutes", delay: str = "10 minutes") -> DataFrame:
    s = feed.withWatermark(t, delay).groupBy(F.session_window(t, gap).alias("w"), key)
    return s.agg(F.min(t).alias("first_time"), F.max(t).alias("last_time"), F.count("*").alias("n")).drop("w")


def dedup_deliveries(feed: DataFrame, keys: list[str], t: str, delay: str = "1 hour") -> DataFrame:
    return feed.withWatermark(t, delay).dropDuplicatesWithinWatermark(keys)


def late_correction(fast: DataFrame, slow: DataFrame, table: KeyedTable, checkpoint: str, seq: str) -> StreamingQuery:
    """Fast feed now, authoritative feed hours later; the authoritative row wins whenever it arrives. The table's order column is "rank"."""
    both = fast.withColumn("prio", F.lit(0)).unionByName(slow.withColumn("prio", F.lit(1)))
    ranked = both.withColumn("rank", F.struct("prio", seq)).drop("prio")
    return ingest_upsert(ranked, table, checkpoint)


def score_join(predictions: DataFrame, actuals: DataFrame, keys: list[str], delay: str = "6 hours", bound: str = "2 hours") -> DataFrame:
    """Forecasts and actuals matched as either side arrives; the time bound lets old state go."""
    p = predictions.withWatermark("p_time", delay)
    a = actuals.withWatermark("a_time", delay)
    on = F.expr(f"a_time BETWEEN p_time - INTERVAL {bound} AND p_time + INTERVAL {bound}")
    for k in keys:
        on = on & (F.col(f"p_{k}") == F.col(f"a_{k}"))
    return p.join(a, on)


def freshness(feed: DataFrame, key: str, t: str, clock: str, limit_hours: int = 24) -> DataFrame:
    """Newest time per source against a clock; older than the limit is stale."""
    newest = feed.groupBy(key).agg(F.max(t).alias("latest"))
    age = (F.unix_timestamp(F.lit(clock).cast("timestamp")) - F.unix_timestamp("latest")) / 3600
    return newest.withColumns({"age_hours": age, "stale": age > limit_hours})


def _in_order(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(micros, event_id) of a key's rows of a batch by time, taken chunk by chunk: two numbers a row are kept, not the rows."""
    chunks = [(c["micros"].to_numpy(), c["event_id"].to_numpy()) for c in rows]
    micros, ids = (np.concatenate(x) for x in zip(*chunks))
    order = np.lexsort((ids, micros))
    return micros[order], ids[order]


#: Rows that a keyed processor returns at once.
ROWS_OUT = 100_000


class AlertCooldown(StatefulProcessor):
    """Emit a row unless an alert of the same key was sent less than ``minutes`` before (event time).

    The last alert is forgotten by an event-time timer once the watermark has passed its cooldown: no row that can still arrive needs it.
    """

    def __init__(self, minutes: float) -> None:
        self.micros = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last_sent = handle.getValueState("last_sent", "sent BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        micros, ids = _in_order(rows)
        last = self.last_sent.get()[0] if self.last_sent.exists() else None
        keep, at = [], 0 if last is None else int(np.searchsorted(micros, last + self.micros))
        while at < len(micros):
            keep.append(at)
            at = int(np.searchsorted(micros, micros[at] + self.micros))
        if keep:
            last = int(micros[keep[-1]])
            self.last_sent.update((last,))
            self.handle.registerTimer(_after(last + self.micros))
        for part in range(0, len(keep), ROWS_OUT):
            own = keep[part : part + ROWS_OUT]
            yield pd.DataFrame({"point": key[0], "event_id": ids[own], "micros": micros[own]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a later alert has set a timer of its own
        if self.last_sent.exists() and _after(self.last_sent.get()[0] + self.micros) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last_sent.clear()
        yield pd.DataFrame({"point": [], "event_id": [], "micros": []}).astype({"point": object, "event_id": "int64", "micros": "int64"})

    def close(self) -> None:
        pass


def _after(micros: int) -> int:
    """The first millisecond at or after a time in microseconds."""
    return -(-micros // 1000)


def alert_cooldown(feed: DataFrame, key: str, probability: str, threshold: float = 0.7, minutes: float = 30, delay: str = "10 minutes") -> DataFrame:
    """Alerts that are sent; with a constant key column the cooldown is global. Rows later than the delay are left out."""
    use_rocksdb(feed.sparkSession)
    hot = feed.withWatermark("ts", delay).filter(F.col(probability) >= threshold)
    rows = hot.select("event_id", F.col(key).alias("point"), "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("point").transformWithStateInPandas(
        AlertCooldown(minutes), "point STRING, event_id BIGINT, micros BIGINT", "Append", "EventTime"
    )


class RateWindow(StatefulProcessor):
    """Accept a request while fewer than ``limit`` accepted ones lie in the last ``hours``.

    Accepted times leave the state by event-time timers once the watermark has passed their window; a key without any has no state.
    """

    def __init__(self, limit: int, hours: float) -> None:
        self.limit = limit
        self.micros = int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        micros, ids = _in_order(rows)
        window = deque(sorted(r[0] for r in self.accepted.get()) if self.accepted.exists() else ())
        verdict = np.zeros(len(micros), bool)
        for i, at in enumerate(micros.tolist()):
            while window and window[0] <= at - self.micros:
                window.popleft()
            if len(window) < self.limit:  # never more than ``limit`` entries
                window.append(at)
                verdict[i] = True
        if window:
            self.accepted.put([(x,) for x in window])
            self.handle.registerTimer(_after(window[0] + self.micros))
        else:
            self.accepted.clear()
        for part in range(0, len(ids), ROWS_OUT):
            own = slice(part, part + ROWS_OUT)
            yield pd.DataFrame({"user_id": key[0], "event_id": ids[own], "accepted": verdict[own]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        left = [r[0] for r in self.accepted.get()] if self.accepted.exists() else []
        left = [x for x in left if _after(x + self.micros) > now]
        if left:
            self.accepted.put([(x,) for x in left])
            self.handle.registerTimer(_after(min(left) + self.micros))
        else:
            self.accepted.clear()
        yield pd.DataFrame({"user_id": [], "event_id": [], "accepted": []}).astype({"user_id": "int64", "event_id": "int64", "accepted": bool})

    def close(self) -> None:
        pass


def rate_window(feed: DataFrame, limit: int, hours: float = 24, delay: str = "10 minutes") -> DataFrame:
    """Decision per request and key; only accepted requests count against the limit. Rows later than the delay are left out."""
    use_rocksdb(feed.sparkSession)
    rows = feed.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        RateWindow(limit, hours), "user_id BIGINT, event_id BIGINT, accepted BOOLEAN", "Append", "EventTime"
    )


def floor_feed(feed: DataFrame, t: str, minutes: int = 5) -> DataFrame:
    return feed.withColumn("t", floor_time(F.col(t), minutes)).withColumn("day", F.col("t").cast("date"))
