"""Sharding by minimax contiguous partition.

Rows with equal texts are one atomic group. Groups stand in the order of the MD5 of
their text. The smallest capacity for which a greedy pass needs no more than the
shards there are is found by binary search, and the cuts are made there. A group
above an equal share (at most as many as there are shards) gets a shard of its own,
and the rest is cut into the shards that are left.

The driver never holds the groups. It starts from the totals of at most 2**RANGE_BITS
ranges of the order, in which each of the at most BIG groups that weigh 1/BIG of all
or more stands alone. Totals and largest groups bound where every cut can fall, from
below and from above; only the segments between these bounds are split, into
SPLIT parts each, until all that a cut can fall into are single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, RANGE_BITS, KEY_BITS, SLOT_PARTS = 24, 16, 60, 1024
BIG, SPLIT = 1 << 14, 256


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def key_of(text: Column) -> Column:
    """60 bits of the text's MD5; -1 for null. Texts that agree in them share a group."""
    digits = F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4)
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


class Line:
    """The ordered groups in segments: first and last key, total, largest group and number of groups of each."""

    def __init__(self, first, last, totals, largest, count):
        order = np.argsort(first)
        self.first, self.last, self.totals, self.largest, self.count = (np.asarray(x, np.int64)[order] for x in (first, last, totals, largest, count))
        self.ends = np.cumsum(self.totals)
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def start(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else 0

    def at(self, x: int) -> int:
        """The segment in which position x lies."""
        return min(int(np.searchsorted(self.ends, x, "right")), len(self.ends) - 1)

    def reach(self, capacity: int, shards: int, most: bool) -> list[tuple[int, int]]:
        """(segment in which it falls, position) of each cut if every shard takes what fits.

        Within a segment of several groups the position is the highest possible one, or
        else the lowest; in a single group it is the group's start, which is exact.
        """
        here, out = 0, []
        for _ in range(shards):
            x = here + capacity
            if x >= self.total:
                here, i = self.total, len(self.ends)
            else:
                i = self.at(x)
                if self.count[i] == 1:
                    here = self.start(i)
                elif most:
                    here = x
                else:
                    here = max(here, self.start(i), x - int(self.largest[i]) + 1)
            out.append((i, here))
        return out

    def split(self, wanted: list[int], parts: tuple) -> "Line":
        """The line with the segments of wanted replaced by their parts."""
        keep = np.ones(len(self.first), bool)
        keep[wanted] = False
        return Line(*(np.concatenate([own[keep], np.asarray(new, np.int64)]) for own, new in zip((self.first, self.last, self.totals, self.largest, self.count), parts, strict=True)))


def search(least: int, most: int, good) -> int:
    """The smallest number from least to most that is good; most is."""
    while least < most:
        middle = (least + most) // 2
        if good(middle):
            most = middle
        else:
            least = middle + 1
    return least


def partition(line: Line, shards: int, fetch) -> tuple[int, list[int]]:
    """The least capacity, and the last key of each shard.

    fetch(segments as (first, last)) gives first, last, totals, largest and count of their parts.
    """
    if not line.total:
        return 0, [1 << 62] * shards
    while True:
        least = max(-(-line.total // shards), int(line.largest.max()))
        low = search(least, line.total, lambda c: line.reach(c, shards, True)[-1][1] >= line.total)
        high = search(low, line.total, lambda c: line.reach(c, shards, False)[-1][1] >= line.total)
        wanted: set[int] = set()
        for (i, _), (j, _) in zip(line.reach(low, shards, False), line.reach(high, shards, True), strict=True):
            wanted.update(k for k in range(i, min(j + 1, len(line.ends))) if line.count[k] > 1)
        if not wanted:
            # low and high agree wherever the cuts fall, so the greedy pass is exact for both
            cuts = line.reach(low, shards, True)
            return low, [1 << 62 if i >= len(line.ends) else int(line.first[i]) - 1 for i, _ in cuts]
        line = line.split(chosen := sorted(wanted), fetch([(int(line.first[k]), int(line.last[k])) for k in chosen]))


def plan(groups: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Last keys of the shards in order, and (key, shard) of groups with a shard of their own.

    groups: key, bytes, one row a group.
    """
    spark = groups.sparkSession
    top = [(r["key"], int(r["bytes"])) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()]
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    alone: list[int] = []
    for key, size in top:
        left = shards - len(alone)
        if left < 2 or size * left <= total:
            break
        alone.append(key)
        total -= size
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    span = F.shiftright("key", KEY_BITS - RANGE_BITS)
    figures = (F.min("key").alias("first"), F.max("key").alias("last"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest"), F.count("*").alias("n"))

    def numbers(found: DataFrame) -> tuple:
        got = found.select("first", "last", "total", "largest", "n").toPandas()
        return tuple(got[c].to_numpy(np.int64) for c in got.columns)

    # BIG rows at most: each weighs 1/BIG of all or more
    big = rest.where(F.col("bytes") * BIG >= total).groupBy(span.alias("span")).agg(F.collect_list("key").alias("keys"))
    spread = rest.withColumn("span", span).join(F.broadcast(big), "span", "left")
    own = F.aggregate("keys", F.lit(0), lambda n, k: n + (k < F.col("key")).cast("int") + (k <= F.col("key")).cast("int"))
    spread = spread.groupBy("span", F.coalesce(own, F.lit(0)).alias("side")).agg(*figures)
    line = Line(*numbers(spread))  # 2**RANGE_BITS + 1 + 2 * BIG rows at most

    def fetch(wanted: list[tuple[int, int]]) -> tuple:
        rows = [(k, first >> (KEY_BITS - RANGE_BITS), first, last, max(0, (last - first).bit_length() - (SPLIT.bit_length() - 1))) for k, (first, last) in enumerate(wanted)]
        at = spark.createDataFrame(rows, "k int, span long, low long, high long, shift int")
        found = rest.withColumn("span", span).join(F.broadcast(at), "span").where("key between low and high")
        return numbers(found.groupBy("k", F.call_function("shiftright", F.col("key") - F.col("low"), F.col("shift")).alias("part")).agg(*figures))  # SPLIT for each segment at most

    kept = shards - len(alone)
    _, cuts = partition(line, kept, fetch)
    return cuts, [(key, kept + i) for i, key in enumerate(alone)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    docs: doc_id, text; all columns are kept unless they clash with the new ones.
    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 that of the bytes
    (null: of none). The law is bytes: groups above an equal share of what is left stand
    alone, and no contiguous cut of the others into the remaining shards has a smaller
    largest shard. Rows with a null text are a group, as are empty ones and any
    equal texts, repeated rows included. slot numbers a shard's rows from 0 without
    gaps. With fewer groups than shards some shards stay empty.
    """
    clash = {"size", "text_crc32", "law", "shard", "slot", "grown_shard", "key", "part", "first"}
    own = [c for c in docs.columns if c not in clash]
    text = F.col("text").cast("string")
    made = docs.select(*own, size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key_of(text).alias("key"))
    groups = table(made.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cuts, alone = plan(groups, shards)
    place = F.aggregate(F.array(*(F.lit(c) for c in cuts[:-1])), F.lit(0), lambda n, c: n + (F.col("key") > c).cast("int")) if len(cuts) > 1 else F.lit(0)
    for key, at in alone:
        place = F.when(F.col("key") == key, at).otherwise(place)
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_PARTS)).cast("int")
    placed = made.withColumn("shard", place.cast("int")).withColumn("part", part)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # shards * SLOT_PARTS rows at most are broadcast
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    rows = placed.join(F.broadcast(firsts), ["shard", "part"])
    slot = (F.col("first") + F.row_number().over(within) - 1).cast("long")
    return rows.select(*own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
