"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact check.

A window has as many words as the item it is held against and lies so that a word
shingle shared with an item of that length stands at its place in the item; any
other window shares no shingle with such an item and so has similarity 0. Each
window and item gets a 64-bit SimHash of its words. The fingerprints are cut into
BLOCKS blocks; within RADIUS = BLOCKS * (FLIPS + 1) - 1 bits, some block differs
by at most FLIPS bits, so looking every block up among the items' blocks with up
to FLIPS bits changed finds all items within the radius. The radius is wide, since
a ninth of a passage's words may differ and some words weigh more than others; it
only discards what is unlike an item. The rest is confirmed by the exact similarity of the two multisets of shingles, each shingle weighted by
how often it occurs: sum of the smaller counts over sum of the larger.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, perhaps_among, table

WIDTH, PERCENT, BLOCKS, FLIPS = 5, 80, 8, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: The items' shingles are broadcast up to this many; above, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_BITS = 64 // BLOCKS


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text.cast("string")), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def marks_of(items: DataFrame, width: int) -> DataFrame:
    """The items' distinct shingles by anchor, their longest word (the first such): anchor, offset, gram, places.

    A text holds a shingle only where it holds the anchor, and longest words are
    rare ones, so that few words of a text have to be looked at more closely. places
    are distinct (place in the item, item's length), so however many items share a
    shingle, there are no more than lengths and places in the longest item.
    """
    many = F.transform(F.sequence(F.lit(1), F.size("iw") - width + 1), lambda i: F.slice("iw", i, width))
    runs = F.when(F.size("iw") >= width, many).otherwise(F.array("iw"))
    rows = items.select("length", F.posexplode(runs).alias("at", "gram")).groupBy("gram").agg(F.collect_set(F.struct("at", "length")).alias("places"))
    top = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return rows.withColumn("top", top).select(F.col("top.x").alias("anchor"), (-F.col("top.i")).alias("offset"), "gram", "places")


def grams(w: Column, width: int) -> Column:
    """The runs of width words as text."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def simhash(w: Column) -> Column:
    """64 bits: bit b is set if more of the words' hashes have it set than not."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int") * 2 - 1))
    return F.aggregate(F.transform(bits, lambda s, b: F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def block_values(fingerprint: Column) -> list[Column]:
    return [F.shiftrightunsigned(fingerprint, k * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int") for k in range(BLOCKS)]


def similarity(a: Column, b: Column) -> Column:
    """Generalised Jaccard similarity of two arrays taken as multisets."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def bound(a: Column, b: Column) -> Column:
    """At least similarity(a, b), in linear time: only repeats can add to the distinct common items."""
    extra = lambda items: F.size(items) - F.size(F.array_distinct(items))
    both = F.size(F.array_intersect(a, b)) + F.least(extra(a), extra(b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def placed(hits: DataFrame) -> DataFrame:
    """hits with length and start_word of the windows that their places ask for; size: the text's words."""
    hits = hits.withColumn("place", F.explode("places"))
    length = F.least(F.col("place.length"), F.col("size"))
    start = F.greatest(F.lit(0), F.least(F.col("begin") - F.col("place.at"), F.col("size") - length))
    return hits.withColumn("length", F.col("place.length")).withColumn("start_word", start).withColumn("take", length)


def windows_here(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """doc_id, length, start_word, ww of the windows, by broadcasting the marks: nothing of the texts is shuffled but windows."""
    spots = docs.select("doc_id", words(F.col("text")).alias("w"))
    spots = spots.select("doc_id", "w", F.posexplode("w").alias("pos", "anchor"))
    hits = spots.join(F.broadcast(marks), "anchor").withColumn("begin", F.col("pos") - F.col("offset")).withColumn("size", F.size("w"))
    here = (F.col("begin") >= 0) & (F.slice("w", F.greatest("begin", F.lit(0)) + 1, F.size("gram")) == F.col("gram"))
    hits = placed(hits.where(here & ((F.size("gram") >= width) | (F.col("size") == F.size("gram")))))
    return hits.select("doc_id", "length", "start_word", F.slice("w", F.col("start_word") + 1, F.col("take")).alias("ww"))


def windows_far(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """As windows_here, for more marks than may be broadcast.

    Words that a Bloom filter of fixed size finds among the anchors are shuffled, each
    with the width - 1 words on both sides; texts are fetched for hits only. A hot
    anchor's rows are split by Spark's skew join.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    spots = rows.select("doc_id", "mark", "w", F.posexplode("w").alias("pos", "anchor"))
    spots = perhaps_among(spots, "anchor", marks.select("anchor"))
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    spots = spots.select("doc_id", "mark", F.size("w").alias("size"), "pos", "anchor", first.alias("first"), F.slice("w", first + 1, 2 * width - 1).alias("near"))
    hits = spots.join(marks, "anchor").withColumn("begin", F.col("pos") - F.col("offset"))
    here = (F.col("begin") >= 0) & (F.slice("near", F.greatest(F.col("begin") - F.col("first"), F.lit(0)) + 1, F.size("gram")) == F.col("gram"))
    hits = placed(hits.where(here & ((F.size("gram") >= width) | (F.col("size") == F.size("gram")))))
    asked = table(hits.select("doc_id", "mark", "length", "start_word", "take").distinct(), "asked")
    texts = docs.withColumn("mark", F.xxhash64("text"))
    texts = perhaps_among(texts, "mark", asked.select("mark")).select(F.col("doc_id").alias("text_id"), F.col("mark").alias("text_mark"), "text")
    met = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("mark") == F.col("text_mark")))
    return met.select("doc_id", "length", "start_word", F.slice(words(F.col("text")), F.col("start_word") + 1, F.col("take")).alias("ww"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, start_word, n_words, hamming, similarity.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored, also if
    their names clash. Words are runs of characters other than space and 0x09-0x0D,
    A-Z lower-cased. Of several windows the most similar is named, then the first. A
    null or empty text, on either side, holds and matches nothing; an item of fewer
    than width words is found only in a text of the same words. A null doc_id or
    item_id is carried along. Repeated rows give one result.
    """
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee a radius of {RADIUS} only")
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = items.select("item_id", "iw", F.size("iw").alias("length"), grams(F.col("iw"), width).alias("ig"), simhash(F.col("iw")).alias("ifp"))
    marks = marks_of(items, width)
    small = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    find = windows_here if small else windows_far
    windows = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), marks, width).distinct()
    windows = windows.withColumn("fp", simhash(F.col("ww")))
    changes = [0, *(sum(1 << b for b in bits) for n in range(1, FLIPS + 1) for bits in combinations(range(_BITS), n))]
    flips = F.array(*map(F.lit, changes))
    index = items.select("item_id", "length", "ifp", F.posexplode(F.array(*block_values(F.col("ifp")))).alias("block", "value"))
    index = index.select("item_id", "length", "ifp", "block", F.explode(F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    looked = windows.select("doc_id", "start_word", "length", "ww", "fp", F.posexplode(F.array(*block_values(F.col("fp")))).alias("block", "value"))
    found = looked.join(index, ["length", "block", "value"])
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))).cast("int")
    # a pair found in several blocks counts in the first of them
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.bit_count(F.call_function("shiftrightunsigned", F.col("fp").bitwiseXOR(F.col("ifp")), (k * _BITS).cast("int")).bitwiseAND(F.lit((1 << _BITS) - 1))) <= FLIPS), True) - 1
    found = found.withColumn("hamming", hamming).where((F.col("hamming") <= radius) & (F.col("block") == first))
    texts = items.select(F.col("item_id").alias("text_id"), F.col("length").alias("text_length"), F.col("ifp").alias("text_fp"), "ig")
    found = found.join(texts, F.col("item_id").eqNullSafe(F.col("text_id")) & (F.col("length") == F.col("text_length")) & (F.col("ifp") == F.col("text_fp")))
    found = found.withColumn("wg", grams(F.col("ww"), width)).where(bound(F.col("wg"), F.col("ig")) * 100 >= percent)
    found = found.select("doc_id", "item_id", "start_word", F.size("ww").alias("n_words"), "hamming", similarity(F.col("wg"), F.col("ig")).alias("similarity"))
    found = found.where(F.col("similarity") * 100 >= percent)
    best = F.max_by(F.struct("start_word", "n_words", "hamming", "similarity"), F.struct("similarity", (-F.col("start_word")).alias("s"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start_word", "best.n_words", "best.hamming", "best.similarity")


SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where text is not null),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark where text is not null),
ig as (select item_id, len(w) as n, unnest(range(0, len(w) - 4)) as i, w from b where len(w) >= 5),
ix as (select item_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') as g from ig),
dg as (select doc_id, unnest(range(0, len(w) - 4)) as p, w from d where len(w) >= 5),
dx as (select doc_id, p, len(w) as dn, array_to_string(w[p + 1 : p + 5], ' ') as g from dg),
s as (select distinct dx.doc_id, ix.item_id, ix.n, dx.dn, greatest(0, least(dx.p - ix.i, dx.dn - least(ix.n, dx.dn))) as st from dx join ix on dx.g = ix.g),
wg as (select s.doc_id, s.item_id, s.st, least(s.n, s.dn) as wn, s.n, dx.g, count(*) as c from s join dx on dx.doc_id = s.doc_id and dx.p >= s.st and dx.p <= s.st + least(s.n, s.dn) - 5 group by all),
ic as (select item_id, g, count(*) as c from ix group by all),
m as (select wg.doc_id, wg.item_id, wg.st, wg.wn, wg.n, sum(least(wg.c, coalesce(ic.c, 0))) as shared from wg left join ic on ic.item_id = wg.item_id and ic.g = wg.g group by all),
r as (select doc_id, item_id, st, wn, cast(shared as double) / cast((wn - 4) + (n - 4) - shared as double) as similarity from m)
select doc_id, item_id, cast(st as int) as start_word, cast(wn as int) as n_words, similarity
from (select *, row_number() over (partition by doc_id, item_id order by similarity desc, st) as k from r where similarity * 100 >= 80) where k = 1
"""
