import datetime as dt

from dealweave.streaming.events import event_stream, first_seen, run_to_end, sessions, tumbling, upsert_to_end

from support import as_set

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, path, rows):
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, t, v, "{}") for i, h, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, 1, "a", 1.0), (2, 2, "b", 2.0)])
    make = lambda: event_stream(spark, folder, "*.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    upsert_to_end(tumbling(make()), ["start", "event_type"], out, state)
    write(spark, folder, [(3, 3, "a", 4.0), (4, 30, "a", 5.0)])
    got = upsert_to_end(tumbling(make()), ["start", "event_type"], out, state)
    batch = spark.read.parquet(folder)
    want = tumbling(batch.withColumn("ts", batch.ts.cast("timestamp")))
    assert as_set(got.select("start", "event_type", "n", "cents")) == as_set(want)


def test_duplicates_are_dropped_and_sessions_split(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, 1, "a", 1.0), (1, 1, "a", 1.0), (2, 2, "a", 1.0)])
    got = run_to_end(first_seen(event_stream(spark, folder, "*.parquet")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
    batch = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 1) for h in (0, 5, 12)], "ts timestamp, user_id long")
    assert sorted(r.n for r in sessions(batch).collect()) == [1, 2]
