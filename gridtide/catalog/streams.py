"""Streaming jobs over the event table read as a file stream (everything available, then stop)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.keyed_table import KeyedTable
from ..sources.sink import scratch_path
from ..streaming import jobs
from . import base
from .registry import query

UNIT = 0.7071067811865476


def feed(spark, d):
    raw = jobs.table_stream(spark, f"{d}/events.parquet")
    return raw.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("point"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


# a window is final once the watermark (newest time less the delay) has passed its end
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM b_ev)"


@query(
    "stream_ingest_upsert", text="point", times="t", ints="event_id", nums="price",
    sql="""SELECT point, time_bucket(INTERVAL '5 minutes', ts) AS t, max(event_id) AS event_id, arg_max(price, event_id) AS price FROM b_ev GROUP BY 1, 2""",
)
def stream_ingest_upsert(spark, d):
    out = scratch_path(spark, "upsert")
    rows = jobs.floor_feed(feed(spark, d), "ts").select("day", "t", "point", "event_id", "price")
    table = KeyedTable(spark, f"{out}/table", ["t", "point"], "event_id", buckets=4)
    jobs.ingest_upsert(rows, table, f"{out}/ckpt").awaitTermination()
    return table.read()


@query(
    "stream_tumbling_15min", text="point", times="t", ints="n", nums="price",
    sql=f"""SELECT point, time_bucket(INTERVAL '15 minutes', ts) AS t, count(*) AS n, avg(price * {UNIT}) AS price FROM b_ev GROUP BY 1, 2
      HAVING time_bucket(INTERVAL '15 minutes', max(ts)) + INTERVAL 15 MINUTE <= {CLOSED}""",
)
def stream_tumbling_15min(spark, d):
    return jobs.drain(jobs.tumbling_average(feed(spark, d).withColumn("price", F.col("price") * UNIT), "point", "ts", "price"))


@query(
    "stream_sliding_stats", text="point", times="t", ints="n", nums="mean std max",
    sql=f"""SELECT point, time_bucket(INTERVAL '15 minutes', ts) + to_minutes(15 * i) AS t, count(*) AS n, avg(price * {UNIT}) AS mean, stddev_samp(price * {UNIT}) AS std,
      max(price * {UNIT}) AS max FROM b_ev, range(1, 97) AS r(i) GROUP BY 1, 2 HAVING time_bucket(INTERVAL '15 minutes', min(ts)) IS NOT NULL AND t <= {CLOSED}""",
)
def stream_sliding_stats(spark, d):
    return jobs.drain(jobs.sliding_stats(feed(spark, d).withColumn("price", F.col("price") * UNIT), "point", "ts", "price"))


@query(
    "stream_session_events", text="point", times="first_time last_time", ints="n",
    sql=f"""SELECT point, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM (SELECT *, sum(st) OVER (PARTITION BY point ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY point ORDER BY ts) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS st FROM b_ev WHERE price > 60)) GROUP BY point, sess
      HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM b_ev WHERE price > 60)""",
)
def stream_session_events(spark, d):
    return jobs.drain(jobs.session_events(feed(spark, d).filter("price > 60"), "point", "ts"))


@query("stream_dedup", text="point", ints="event_id", sql="SELECT point, event_id FROM b_ev")
def stream_dedup(spark, d):
    twice = feed(spark, d).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.drain(jobs.dedup_deliveries(twice, ["point", "ts"], "ts"))


@query(
    "stream_alert_cooldown", text="point", ints="event_id",
    sql="""WITH RECURSIVE c AS (SELECT point, ts, event_id FROM b_ev WHERE price / 120 >= 0.7), n AS (SELECT c.*, (SELECT min(x.ts) FROM c x WHERE x.point = c.point
      AND x.ts >= c.ts + INTERVAL 30 MINUTE) AS nxt FROM c), r AS (SELECT point, min(ts) AS ts FROM c GROUP BY 1
      UNION ALL SELECT n.point, n.nxt FROM r JOIN n ON n.point = r.point AND n.ts = r.ts WHERE n.nxt IS NOT NULL) SELECT point, event_id FROM r JOIN c USING (point, ts)""",
)
def stream_alert_cooldown(spark, d):
    f = feed(spark, d).withColumn("p", F.col("price") / 120)
    return jobs.drain(jobs.alert_cooldown(f, "point", "p"))


@query(
    "stream_rate_window", ints="user_id event_id accepted",
    sql="""WITH RECURSIVE x AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM b_ev),
      r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS event_id, false AS accepted, CAST([] AS TIMESTAMP[]) AS w FROM x WHERE i = 1
      UNION ALL SELECT user_id, i, event_id, len(k) < 2, CASE WHEN len(k) < 2 THEN list_append(k, ts) ELSE k END FROM (SELECT x.user_id, x.i, x.event_id, x.ts,
      list_filter(r.w, lambda a: a > x.ts - INTERVAL 24 HOUR) AS k FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1))
      SELECT user_id, event_id, accepted FROM r WHERE i > 0""",
)
def stream_rate_window(spark, d):
    return jobs.drain(jobs.rate_window(feed(spark, d), limit=2))


@query(
    "stream_late_correction", text="point", times="t", nums="price",
    sql="""SELECT point, t, coalesce(a.price, f.price) AS price FROM (SELECT point, time_bucket(INTERVAL '5 minutes', ts) AS t, arg_max(price, event_id) AS price FROM b_ev GROUP BY 1, 2) f
      LEFT JOIN (SELECT point, time_bucket(INTERVAL '5 minutes', ts) AS t, arg_max(price + 1, event_id) AS price FROM b_ev WHERE k < 50 GROUP BY 1, 2) a USING (point, t)""",
)
def stream_late_correction(spark, d):
    out = scratch_path(spark, "late")
    cols = ["day", "t", "point", "event_id", "price"]
    fast = jobs.floor_feed(feed(spark, d), "ts").select(cols)
    slow = jobs.floor_feed(feed(spark, d).filter("k < 50"), "ts").withColumn("price", F.col("price") + 1).select(cols)
    table = KeyedTable(spark, f"{out}/table", ["t", "point"], "rank", buckets=4)
    jobs.late_correction(fast, slow, table, f"{out}/ckpt", "event_id").awaitTermination()
    return table.read()


@query(
    "stream_score_join", text="p_point", ints="p_event_id", nums="error",
    sql="SELECT point AS p_point, event_id AS p_event_id, k - price AS error FROM b_ev WHERE price > 20",
)
def stream_score_join(spark, d):
    p = feed(spark, d).select(F.col("event_id").alias("p_event_id"), F.col("point").alias("p_point"), F.col("ts").alias("p_time"), F.col("k").alias("predicted"))
    a = feed(spark, d).filter("price > 20").select(
        F.col("event_id").alias("a_event_id"), F.col("point").alias("a_point"), F.col("ts").alias("a_time"), F.col("price").alias("actual")
    )
    joined = jobs.score_join(p, a, ["event_id", "point"])
    return jobs.drain(joined.withColumn("error", F.col("predicted") - F.col("actual")))


@query(
    "stream_freshness_guard", text="point", times="latest", ints="stale",
    sql="""SELECT point, max(ts) AS latest, date_trunc('second', max(ts)) < TIMESTAMP '2024-01-31 23:45:00' - INTERVAL 24 HOUR AS stale FROM b_ev GROUP BY 1""",
)
def stream_freshness_guard(spark, d):
    out = scratch_path(spark, "fresh")
    state = jobs.freshness(feed(spark, d), "point", "ts", "2024-01-31 23:45:00")
    jobs.each_batch(state, lambda b, _: b.write.mode("overwrite").parquet(f"{out}/data"), f"{out}/ckpt", mode="complete").awaitTermination()
    return spark.read.parquet(f"{out}/data")
