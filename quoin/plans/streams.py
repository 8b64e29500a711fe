"""Queries over the streaming operators, on the events table as a finished stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.sources import relations as S
from quoin.sources import scratch
from quoin.streaming import streams as T

from .catalogue import query


@query(
    "stm01_window_totals",
    "select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
)
def stm01(spark, d):
    """Window totals kept up to date by a stream; the whole result replaces the table after each micro-batch."""
    live = T.event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone
    made = T.drained(T.windowed(live), scratch.fresh(spark, "windows"), "complete")
    return made.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", "total")


@query("stm_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as b from events),
    s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 30 minutes) as end_us, count(*) as n from s group by user_id, k""")
def sessions(spark, d):
    made = T.sessions(S.read(spark, d, "events"))
    return made.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@query("stm02_resumed_results", "select e.event_id from events e where not exists (select 1 from events f where f.event_id = e.event_id and f.event_type = 'view')")
def stm02(spark, d):
    """A stream of work resumed against an identity-keyed table of what is done: the views are done before it starts."""
    path = scratch.fresh(spark, "resumed")
    S.read(spark, d, "events").where("event_type = 'view'").select("event_id").write.parquet(f"{path}/done")
    write = lambda rows: rows.select("event_id").write.mode("append").parquet(f"{path}/made")
    T.resumable(T.event_stream(spark, d), lambda: spark.read.parquet(f"{path}/done"), ["event_id"], write, f"{path}/state").awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{path}/made")


@query("stm03_capacity_gate", """with c as (select user_id, event_id, cast(epoch(date_trunc('second', ts)) as bigint) as at, event_type = 'error' as busy from events)
    select a.event_id, not exists (select 1 from c b where b.user_id = a.user_id and b.busy and b.at < a.at and b.at >= a.at - 120) as allowed from c a""")
def stm03(spark, d):
    rows = S.read(spark, d, "events").select("event_id", F.col("user_id").alias("gate"), F.unix_timestamp("ts").alias("at"), F.when(F.col("event_type") == "error", "429 rate limit").alias("message"))
    return T.gated(rows).select("event_id", "allowed")


@query("stm04_retries", """with c as (select user_id as task, row_number() over (partition by user_id order by ts, event_id) - 1 as try, event_type <> 'error' as ok, event_id as answer from events)
    select task, bool_or(ok) as ok, coalesce(arg_min(answer, try) filter (ok), arg_max(answer, try)) as answer from c where try < 3 group by task""")
def stm04(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = S.read(spark, d, "events").select(F.col("user_id").alias("task"), (F.row_number().over(order) - 1).alias("try"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("answer"))
    return T.attempts(rows)
