"""Shared plumbing: reading tables, shared scratch tables, stable random numbers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/quoin")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_written: list[str] = []


def written() -> int:
    """How many scratch tables there are; release() takes this mark."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables written since a mark, but the last keep. Results that read them must have been saved."""
    jvm, end = spark.sparkContext._jvm, len(_written) - keep
    for name in _written[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:end]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quoin-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place in the order, from 0; ordered by ranges, so no task holds all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__part", "__n", "__first", "__place")


#: Bytes of the Arrow batches that texts go to Python in, at most.
BATCH = "8m"


def tidy() -> None:
    """Give freed memory back to the system, where the C library can."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function of Arrow batches, without what it would leave behind: idle Python workers are kept for later stages."""

    def task(batches):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(-3, 8 << 20)  # the largest arrays come from the system and go back to it at once
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of BATCH bytes, with workers that keep no memory.

    The size of batches is a setting of the session, and stays set.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return rows.mapInArrow(lean(run), schema)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def uniform(id_column: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 52 bits of their MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


#: Bits of the filter below; its 4 KB blocks are broadcast, 8 MB in all at most.
FILTER_BITS = 1 << 26


def flagged(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows with __hit: false only if column is not in wanted's, by a Bloom filter of fixed size."""
    place = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__block"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("__block", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__block", "left")
    joined = joined.withColumn("__byte", F.coalesce(byte, F.lit(0))).withColumn("__bit", (at % 8).cast("int"))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), F.expr("shiftright(__byte, __bit) & 1 = 1").alias("__hit"))


def perhaps_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows, without most of those whose column is not in wanted's.

    Loses no row that is in wanted. It saves shuffling rows only to drop them; if
    wanted has more values than the filter has bits, it lets everything through.
    """
    return flagged(rows, column, wanted).where("__hit").drop("__hit")


def without(rows: DataFrame, column: str, unwanted: DataFrame) -> DataFrame:
    """rows whose column is not in unwanted's; only those the filter cannot clear are shuffled. Nulls stay."""
    marked = flagged(rows, column, unwanted)
    return marked.where("not __hit").drop("__hit").unionByName(marked.where("__hit").drop("__hit").join(unwanted.select(column), column, "left_anti").select(*rows.columns))
