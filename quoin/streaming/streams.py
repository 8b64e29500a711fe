"""Incremental results, resumable state, a capacity gate and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that mark a refused call for lack of capacity, and seconds to wait then. Fixed values.
BUSY_MARKS = ("exceed limit", "rate limit", "rate_limit", "too many requests", "429")
COOL_DOWN = 120


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """event_type counts and value sums in tumbling or sliding event-time windows; rows later than late are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of every user: runs of events no further apart than gap."""
    window = F.session_window("ts", gap)
    made = events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def resumable(source: DataFrame, done: Callable[[], DataFrame], key: list[str], write: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that writes each micro-batch's rows whose key is not done yet; a rerun from the checkpoint repeats none."""

    def step(batch: DataFrame, _: int) -> None:
        write(batch.dropDuplicates(key).join(done().select(*key).distinct(), key, "left_anti"))

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def busy(message):
    """Whether an error text tells of lacking capacity."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for mark in BUSY_MARKS:
        found |= low.contains(mark)
    return found


def gated(calls: DataFrame, by: str = "gate") -> DataFrame:
    """calls (gate, at seconds, message) with allowed: false within COOL_DOWN seconds after a busy answer of the same gate.

    The latest busy answer before each call is a running maximum over a time range,
    so it works on a stream's micro-batches and on history alike.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(by).orderBy("at").rangeBetween(-COOL_DOWN, -1)
    return calls.withColumn("allowed", F.coalesce(F.max(F.when(busy(F.col("message")), F.col("at"))).over(before), F.lit(-COOL_DOWN - 1)) < F.col("at") - COOL_DOWN)


def attempts(calls: DataFrame, patience: int = 3) -> DataFrame:
    """The first success among at most patience tries of each task, or its last failure."""
    tries = calls.where(F.col("try") < patience)
    rank = F.struct(F.when(F.col("ok"), 0).otherwise(1).alias("k"), F.when(F.col("ok"), F.col("try")).otherwise(-F.col("try")).alias("t"), F.col("answer").alias("answer"))
    best = tries.groupBy("task").agg(F.min(rank).alias("b"))
    return best.select("task", (F.col("b.k") == 0).alias("ok"), F.col("b.answer").alias("answer"))


def drained(stream: DataFrame, path: str, mode: str = "append", step: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run a stream over all there is now, and read what it wrote to path.

    mode append adds each micro-batch's rows, after step; complete replaces the table by
    the whole result. The checkpoint beside the table makes a rerun go on, not repeat.
    """

    def write(batch: DataFrame, _: int) -> None:
        step(batch).write.mode("append" if mode == "append" else "overwrite").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parquet*")
