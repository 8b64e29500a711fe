"""Mixing sources to target weights with Pareto order sampling.

Each source gets a share of all words by weight, at most CAP times its own words;
what is above goes to the others by weight (water filling). Every document gets
the whole copies that the source's ratio of target to words makes certain. The
rest is a Pareto sample of unequal probabilities: a document's inclusion
probability grows with its size class, the number of binary digits of its words,
up to 1, and is set so that the expected words are those still wanted. Documents
are ranked by the odds of their random number divided by the odds of their
inclusion, and taken in that order up to the words wanted. The place of the cut is
found from sums per bucket of that rank, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, table, uniform

WEIGHTS, CAP, BUCKETS, SEED = (5, 2, 1), 3, 4096, "mix"
_BEFORE = (Window.unboundedPreceding, -1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The number of binary digits: 1 for one word, 64 at most."""
    return F.length(F.bin(size)).cast("int")


def level(sums: DataFrame) -> float:
    """The words a unit of weight gets once no source is above its most.

    sums: weight, most. A source that its share would lift above its most is held there
    and leaves the rest to the others; the sources held only become more, so this ends
    after a few sums over the sources.
    """
    total, now = None, 0.0
    while True:
        held = F.col("most") < F.lit(now) * F.col("weight")
        got = sums.agg(F.sum("source_size").cast("double").alias("all"), F.sum(F.when(held, F.col("most"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open")).first()
        total = got["all"] or 0.0
        new = (total - (got["held"] or 0.0)) / got["open"] if got["open"] else now
        if new <= now:
            return now
        now = new


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, whole (certain copies), rest (words to sample), one row a source."""
    sums = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    sums = table(sums.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")), "sources")
    sums = sums.withColumn("target", F.least("most", F.lit(level(sums)) * F.col("weight")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sums = sums.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return sums.select("source", "source_size", "target", "whole", "rest")


def chances(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with class and chance, one row for each source and size class: min(1, scale * class), rest words expected in all.

    The windows run over the classes of one source, 64 at most. A class is certain
    where the scale that the smaller classes need would lift it above 1.
    """
    groups = sized.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").cast("double").alias("words"))
    groups = groups.select(F.col("source").alias("class_source"), "class", "words")
    groups = groups.join(goal, F.col("source").eqNullSafe(F.col("class_source"))).drop("class_source")
    larger = Window.partitionBy("source").orderBy(F.desc("class"))
    above = F.coalesce(F.sum("words").over(larger.rowsBetween(*_BEFORE)), F.lit(0.0))
    below = F.sum(F.col("class") * F.col("words")).over(larger.rowsBetween(0, Window.unboundedFollowing))
    groups = groups.withColumn("above", above).withColumn("below", below)
    groups = groups.withColumn("scale", F.when(F.col("below") > 0, (F.col("rest") - F.col("above")) / F.col("below")))
    good = F.when(F.col("scale") * F.col("class") <= 1, F.struct(F.col("class").alias("k"), F.col("scale").alias("scale")))
    scale = F.max(good).over(Window.partitionBy("source"))["scale"]
    chance = F.when((F.col("rest") > 0) & (F.col("words") > 0), F.least(F.lit(1.0), scale * F.col("class")))
    return groups.select(*goal.columns, "class", chance.alias("chance"))


def standing(chance: Column, seed: str) -> Column:
    """The Pareto rank q = odds(random) / odds(chance), as q / (1 + q) in [0, 1); null where nothing is sampled."""
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("mark").cast("string"))), seed)
    q = (u / (1 - u)) / (chance / (1 - chance))
    return F.when(chance >= 1, F.lit(0.0)).otherwise(q / (1 + q))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken (words taken, repeats counted) and copies.

    docs: doc_id, text, source; all its columns are kept unless they clash with the
    new ones. A null or empty text has size 0 and is never sampled (0 words are
    taken). A null source is a source, the last. A row whose doc_id is null is told
    apart by its text. Rows that repeat a doc_id are taken or left together. The
    result depends on doc_id, texts and the seed only, so reruns agree. An empty
    table gives none.
    """
    clash = {"size", "source_size", "target", "taken", "copies"}
    own = [c for c in docs.columns if c not in clash]
    text = F.col("text").cast("string")
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64(text))
    sized = table(docs.select("doc_id", "source", words(text).alias("size"), mark.alias("mark")), "sized")
    goal = table(chances(sized, targets(sized, weights, cap)), "targets")
    key = F.coalesce(F.col("doc_id").cast("long"), F.col("mark"))

    def ranked(rows: DataFrame) -> DataFrame:
        # 64 rows a source: Spark broadcasts them if their measured size allows, else sorts and splits hot sources
        at = goal.select(F.col("source").alias("goal_source"), F.col("class").alias("goal_class"), "source_size", "target", "whole", "rest", "chance")
        joined = rows.withColumn("goal_at", size_class(F.col("size")))
        joined = joined.join(at, rows["source"].eqNullSafe(at["goal_source"]) & (F.col("goal_at") == at["goal_class"])).drop("goal_source", "goal_class", "goal_at")
        return joined.withColumn("q", standing(F.col("chance"), seed))

    bucket = F.floor(F.col("q") * BUCKETS)
    open_rows = ranked(sized).where("q is not null and size > 0")
    sums = open_rows.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run.rowsBetween(*_BEFORE)), F.lit(0)))
    last = table(sums.where("before < rest and before + words >= rest").select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut_bucket"), "before"), "cuts")
    near = open_rows.join(last, open_rows["source"].eqNullSafe(last["cut_source"]) & (bucket == last["cut_bucket"]))
    run = Window.partitionBy("source").orderBy("q", key, "size")
    near = near.withColumn("total", F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    inside = near.where("total - size / 2 <= rest").groupBy("source").agg(F.max(F.struct("q", key.alias("id"))).alias("end"))
    ends = last.join(inside, F.col("cut_source").eqNullSafe(F.col("source")), "left").select("cut_source", "cut_bucket", "end")
    ends = table(ends, "ends")
    rows = ranked(docs.select(*(F.col(f"`{c}`") for c in own), words(text).alias("size"), mark.alias("mark")))
    rows = rows.join(ends, rows["source"].eqNullSafe(ends["cut_source"]), "left")
    here = F.struct(F.col("q").alias("q"), key.alias("id"))
    sampled = F.when(F.col("q").isNull() | (F.col("size") == 0), False)
    sampled = sampled.when(F.col("cut_bucket").isNull(), True).when(bucket != F.col("cut_bucket"), bucket < F.col("cut_bucket"))
    sampled = sampled.otherwise(F.coalesce(here <= F.col("end"), F.lit(False)))
    copies = (F.col("whole") + sampled.cast("long")).cast("long")
    return rows.select(*(F.col(f"`{c}`") for c in own), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast([5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as double) as weight, cast(source_size * 3 as double) as most from s),
r as (select *, row_number() over (order by most / weight, source nulls last) as k from w),
l as (select *, ((select cast(sum(source_size) as double) from w) - coalesce(sum(most) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by k rows between current row and unbounded following) as lev from r),
v as (select lev from l where lev <= most / weight order by k limit 1),
t as (select source, source_size, least(most, (select lev from v) * weight) as target from l),
g as (select *, floor(case when source_size > 0 then target / source_size else 0 end) as whole from t),
h as (select *, target - whole * source_size as rest from g),
k as (select d.source, len(bin(size)) as class, cast(sum(size) as double) as words from d group by d.source, len(bin(size))),
e as (select k.class, k.words, h.*, (rest - coalesce(sum(words) over (partition by k.source order by k.class desc rows between unbounded preceding and 1 preceding), 0.0)) / sum(k.class * words) over (partition by k.source order by k.class desc rows between current row and unbounded following) as scale from k join h on k.source is not distinct from h.source),
c as (select *, case when rest > 0 and words > 0 then least(1.0::double, max_by(scale, case when scale * class <= 1 then class end) over (partition by source) * class) end as chance from e),
u as (select d.doc_id, d.size, c.*, (cast(('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 13)) as bigint) + 0.5::double) / 4503599627370496::double as u from d join c on d.source is not distinct from c.source and len(bin(d.size)) = c.class),
q as (select *, case when chance >= 1 then 0.0::double else ((u / (1 - u)) / (chance / (1 - chance))) / (1 + ((u / (1 - u)) / (chance / (1 - chance)))) end as q from u),
n as (select *, sum(case when q is null then 0 else size end) over (partition by source order by q nulls first, doc_id, size rows unbounded preceding) as total from q)
select doc_id, size, source_size, target, cast(size * (whole + case when q is not null and size > 0 and total - size / 2 <= rest then 1 else 0 end) as bigint) as taken
from n
"""
