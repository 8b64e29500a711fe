"""Streaming operators, on real micro-batches and on history."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quoin.streaming import streams

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(minutes=m), u, t, v) for i, (m, u, t, v) in enumerate(rows)], SCHEMA)


def test_windows_over_a_stream_equal_those_over_the_table(spark, tmp_path):
    rows = events(spark, [(0, 1, "a", 1.0), (59, 1, "a", 2.0), (60, 2, "a", 4.0), (61, 2, "b", 8.0)])
    rows.write.parquet(f"{tmp_path}/events.parquet")
    live = streams.windowed(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events.parquet"))
    live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, r.total) for r in df.collect())
    assert key(spark.table("live")) == key(streams.windowed(rows)) and len(key(rows.transform(streams.windowed))) == 3


def test_sessions_break_after_the_gap(spark):
    rows = events(spark, [(0, 1, "a", 0.0), (20, 1, "a", 0.0), (60, 1, "a", 0.0), (61, 2, "a", 0.0)])
    assert sorted((r.user_id, r.n) for r in streams.sessions(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_a_rerun_writes_nothing_twice(spark, tmp_path):
    out = f"{tmp_path}/out"
    spark.range(0).select("id").write.parquet(out)
    spark.createDataFrame([(1,), (2,), (2,)], "id long").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        streams.resumable(source, lambda: spark.read.schema("id long").parquet(out), ["id"], lambda df: df.write.mode("append").parquet(out), f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_the_gate_closes_after_a_busy_answer(spark):
    rows = spark.createDataFrame([("g", 0, "ok"), ("g", 10, f"Error {streams.BUSY_MARKS[0]}"), ("g", 100, "ok"), ("g", 131, "ok"), ("h", 50, "ok")], "gate string, at long, message string")
    assert [(r.gate, r.at) for r in streams.gated(rows).where(~F.col("allowed")).collect()] == [("g", 100)]


def test_first_success_or_last_failure(spark):
    rows = spark.createDataFrame([(1, 0, False, "x"), (1, 1, True, "y"), (1, 2, True, "z"), (2, 0, False, "p"), (2, 1, False, "q"), (2, 5, True, "late")], "task int, try int, ok boolean, answer string")
    assert {r.task: (r.ok, r.answer) for r in streams.attempts(rows).collect()} == {1: (True, "y"), 2: (False, "q")}
