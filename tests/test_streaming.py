"""State and results must survive several micro-batches (one file each)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridtide.sources.keyed_table import KeyedTable
from gridtide.streaming import jobs


def write_files(spark, folder, frames):
    for rows in frames:
        spark.createDataFrame(rows, "event_id long, user_id long, point string, ts timestamp, price double").coalesce(1).write.mode(
            "append"
        ).parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in").schema


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def stream(spark, folder, schema):
    return jobs.file_stream(spark, f"{folder}/in", "*.parquet", schema, files_per_trigger=1)


def test_cooldown_across_batches(spark, folder):
    schema = write_files(
        spark, folder,
        [[(1, 1, "a", at(0), 0.9), (2, 1, "a", at(10), 0.9), (3, 1, "b", at(10), 0.8)], [(4, 1, "a", at(29), 0.95), (5, 1, "a", at(30), 0.95), (6, 1, "a", at(70), 0.2)]],
    )
    out = jobs.drain(jobs.alert_cooldown(stream(spark, folder, schema), "point", "price"))
    assert sorted(r.event_id for r in out.collect()) == [1, 3, 5]


def test_rate_window_counts_only_accepted(spark, folder):
    schema = write_files(
        spark, folder,
        [[(1, 1, "a", at(0), 1.0), (2, 1, "a", at(1), 1.0), (3, 1, "a", at(2), 1.0)], [(4, 1, "a", at(1440), 1.0), (5, 1, "a", at(1440.5), 1.0), (6, 1, "a", at(1442), 1.0)]],
    )
    out = jobs.drain(jobs.rate_window(stream(spark, folder, schema), limit=2))
    assert {r.event_id: r.accepted for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_ingest_and_late_correction(spark, folder):
    schema = write_files(spark, folder, [[(1, 1, "a", at(1), 10.0), (2, 1, "a", at(6), 11.0)], [(3, 1, "a", at(2), 20.0)]])
    rows = jobs.floor_feed(stream(spark, folder, schema), "ts").select("day", "t", "point", "event_id", "price")
    table = KeyedTable(spark, f"{folder}/out", ["t", "point"], "event_id", "day", 2)
    jobs.ingest_upsert(rows, table, f"{folder}/ck").awaitTermination()
    assert sorted(r.price for r in table.read().collect()) == [11.0, 20.0] and table.versions() == [1, 2]
    assert sorted(r.price for r in table.read(1).collect()) in ([10.0, 11.0], [20.0])
    slow = rows.filter("event_id = 1").withColumn("price", F.col("price") + 0.5)
    table = KeyedTable(spark, f"{folder}/out2", ["t", "point"], "rank", "day")
    jobs.late_correction(rows, slow, table, f"{folder}/ck2", "event_id").awaitTermination()
    assert sorted(r.price for r in table.read().collect()) == [10.5, 11.0]


def test_dedup_across_batches(spark, folder):
    schema = write_files(spark, folder, [[(1, 1, "a", at(0), 1.0)], [(1, 1, "a", at(0), 1.0), (2, 1, "a", at(3), 1.0)]])
    out = jobs.drain(jobs.dedup_deliveries(stream(spark, folder, schema), ["point", "ts"], "ts"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").count()


def test_state_of_idle_keys_ends(spark, folder):
    late = at(5000)
    schema = write_files(
        spark, folder,
        [[(1, 1, "a", at(0), 0.9), (2, 2, "b", at(5), 0.9), (3, 2, "b", at(20), 0.9)], [(4, 3, "c", late, 0.9)], [(5, 1, "a", late + timedelta(minutes=1), 0.95)]],
    )
    out = jobs.drain(jobs.alert_cooldown(stream(spark, folder, schema), "point", "price"), folder=f"{folder}/alerts")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 4, 5]
    rates = jobs.drain(jobs.rate_window(stream(spark, folder, schema), limit=1), folder=f"{folder}/rates")
    assert {r.event_id: r.accepted for r in rates.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}
    # a and c have been seen since; what was known of b is gone
    assert state_rows(spark, f"{folder}/alerts", "last_sent") == 2
    read = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{folder}/rates/checkpoint")
    assert sorted(r.key.user_id for r in read.select("key").distinct().collect()) == [1, 3]


def test_a_hot_key_comes_in_chunks(spark, folder):
    n = 3000
    minutes = [(7 * i) % n for i in range(n)]  # not in order of time
    schema = write_files(spark, folder, [[(m, 1, "a", at(m), 0.9) for m in minutes]])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        alerts = jobs.drain(jobs.alert_cooldown(stream(spark, folder, schema), "point", "price", minutes=30))
        rates = jobs.drain(jobs.rate_window(stream(spark, folder, schema), limit=5, hours=1))
    finally:
        spark.conf.set(name, before)
    assert sorted(r.event_id for r in alerts.collect()) == list(range(0, n, 30))
    assert sorted(r.event_id for r in rates.filter("accepted").collect()) == [m for m in range(n) if m % 60 < 5]


def test_moments_keep_their_digits_at_high_levels(spark, folder):
    import numpy as np

    rng = np.random.default_rng(2)
    x = 1e7 + rng.normal(0, 0.3, 4000)
    rows = [(i, 1, "a", at(float(i) * 0.6), float(v)) for i, v in enumerate(x)]
    schema = write_files(spark, folder, [rows, [(9999, 1, "a", at(5000), 1e7)]])
    out = jobs.drain(jobs.sliding_stats(stream(spark, folder, schema), "point", "ts", "price")).collect()
    assert len(out) > 200
    for r in out:
        start = (r.t - datetime(2024, 1, 1)).total_seconds() / 60 - 1440
        own = np.array([v for i, _, _, _, v in rows if start <= i * 0.6 < start + 1440])
        assert r.n == len(own) and abs(r.mean - own.mean()) < 1e-8
        assert r.std is None if len(own) < 2 else abs(r.std - own.std(ddof=1)) < 1e-6
