"""Paired comparisons, descriptive statistics, histograms and gates over score and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

R6 = lambda c: F.round(c, 6)


def paired(scores: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """sample, baseline, candidate, delta of the samples that both methods have: one pass, no self-join."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    wide = scores.where(F.col("method").isin(baseline, candidate)).groupBy("sample").agg(pick(baseline).alias("baseline"), pick(candidate).alias("candidate"))
    return wide.where("baseline is not null and candidate is not null").withColumn("delta", R6(F.col("candidate") - F.col("baseline")))


def paired_summary(scores: DataFrame, baseline: str, candidate: str) -> DataFrame:
    d = F.col("delta")
    return paired(scores, baseline, candidate).agg(
        F.count("*").alias("n"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
        R6(F.avg(d)).alias("mean_delta"),
        R6(F.percentile(d, 0.5)).alias("median_delta"),
        F.count_if(d > 0.01).alias("improvement_gt_0_01"),
        F.count_if(d < -0.01).alias("regression_lt_minus_0_01"),
        F.count_if(d < -0.03).alias("regression_lt_minus_0_03"),
    )


def descriptive(rows: DataFrame, by: str, value: str, bottom: int = 10) -> DataFrame:
    """Count, mean, median, min, interpolated 10th percentile, mean of the bottom ones, for each group.

    The bottom values come from a bounded partial aggregate, not from sorting groups.
    """
    v = F.col(value)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(v))
    lowest = rows.where(v.isNotNull()).withColumn("rank", rank).where(F.col("rank") <= bottom).groupBy(by).agg(R6(F.avg(v)).alias("bottom_10_mean"))
    rest = rows.groupBy(by).agg(
        F.count(v).alias("sample_count"),
        R6(F.avg(v)).alias("mean"),
        R6(F.percentile(v, 0.5)).alias("median"),
        R6(F.min(v)).alias("min"),
        R6(F.percentile(v, 0.1)).alias("p10"),
    )
    return rest.join(lowest, by, "left")


def percentiles(rows: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles."""
    return rows.groupBy(by).agg(*(R6(F.percentile(value, p)).alias(name) for name, p in points.items()))


def generation_summary(records: DataFrame) -> DataFrame:
    """By segmenter over successful records; nulls do not count in means."""
    return records.where("status = 'ok'").groupBy("segmenter").agg(
        F.count("*").alias("record_count"),
        R6(F.avg("elapsed")).alias("mean_elapsed_seconds"),
        R6(F.avg("leaf_count")).alias("mean_leaf_count"),
        F.count_if(F.col("leaf_count") == 1).alias("single_leaf_count"),
        F.sum("leaf_count").cast("long").alias("total_api_calls"),
    )


def failure_summary(records: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return records.agg(F.count("*").alias("record_count"), failed.alias("failure_count"), R6(F.try_divide(failed, F.count("*"))).alias("failure_rate"), R6(F.avg(F.when(F.col("status") == "ok", F.col("elapsed")))).alias("mean_elapsed_seconds"))


def comparison_gate(scores: DataFrame, records: DataFrame, baseline: str, candidate: str, samples: int, floors: dict[int, float], mean_floor: float, min_wins: int, most_calls: int) -> DataFrame:
    """One row: the summary, every clause of the success gate, and whether all hold.

    candidate_mean is over all of the candidate's scores; candidate_mean_paired over the shared samples.
    """
    pairs = paired(scores, baseline, candidate)
    d = F.col("delta")
    one = {s: F.max(F.when(F.col("sample") == s, d)) for s in floors}
    summary = pairs.agg(
        F.count("*").alias("sample_count"),
        R6(F.avg("baseline")).alias("baseline_mean"),
        R6(F.avg("candidate")).alias("candidate_mean_paired"),
        R6(F.avg(d)).alias("mean_delta"),
        R6(F.percentile(d, 0.5)).alias("median_delta"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < -0.02).alias("regressions"),
        *(v.alias(f"delta_{s}") for s, v in one.items()),
    )
    everything = scores.where(F.col("method") == candidate).agg(R6(F.avg("score")).alias("candidate_mean"))
    calls = records.agg(F.coalesce(F.sum("leaf_count"), F.lit(0)).cast("long").alias("actual_api_calls"), F.count_if(F.col("status") != "ok").alias("render_failures"))
    row = summary.crossJoin(everything).crossJoin(calls)  # three single rows
    clauses = {
        "ok_mean": F.col("candidate_mean") >= mean_floor,
        "ok_median": F.col("median_delta") > 0,
        "ok_wins": F.col("wins") >= min_wins,
        "ok_regressions": F.col("regressions") <= 1,
        **{f"ok_{s}": F.col(f"delta_{s}") >= floor for s, floor in floors.items()},
        "ok_calls": F.col("actual_api_calls") <= most_calls,
        "ok_renders": F.col("render_failures") == 0,
    }
    row = row.select("*", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in clauses.items()))
    passed = F.col("sample_count") == samples
    for k in clauses:
        passed &= F.col(k)
    return row.withColumn("passed", passed)


def histogram(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """bucket, n, low, high for equal widths; the maximum falls in the last bucket."""
    edges = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    v = F.col(value)
    place = F.when((v == F.col("hi")) | (F.col("hi") == F.col("lo")), buckets - 1).otherwise(F.floor((v - F.col("lo")) / ((F.col("hi") - F.col("lo")) / buckets)))
    return rows.where(v.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def bounds(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """bucket, low, high: equal intervals from the least to the greatest value."""
    edges = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / buckets
    i = F.col("bucket")
    rows = edges.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return rows.select("bucket", R6(F.col("lo") + i * step).alias("low"), R6(F.when(i < buckets - 1, F.col("lo") + (i + 1) * step).otherwise(F.col("hi"))).alias("high"))


def quantile_buckets(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """bucket, low, high with about equally many values each."""
    points = [i / buckets for i in range(buckets + 1)]
    q = rows.agg(F.percentile(value, F.array(*map(F.lit, points))).alias("q"))
    q = q.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return q.select("bucket", R6(F.element_at("q", F.col("bucket") + 1)).alias("low"), R6(F.element_at("q", F.col("bucket") + 2)).alias("high"))


def binned(rows: DataFrame, value: str, metric: str, cuts: tuple[int, ...]) -> DataFrame:
    """Mean and population deviation of a metric in bins of a value."""
    place: Column = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        place = F.when(F.col(value) < cuts[i], i).otherwise(place)
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), R6(F.avg(metric)).alias("mean"), R6(F.stddev_pop(metric)).alias("deviation"))


def multiset_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Means of what each list has beyond the other, counted with repeats."""
    left, right = a.select(value).exceptAll(b.select(value)), b.select(value).exceptAll(a.select(value))
    return left.agg(F.count("*").alias("n_only_a"), R6(F.avg(value)).alias("mean_only_a")).crossJoin(right.agg(F.count("*").alias("n_only_b"), R6(F.avg(value)).alias("mean_only_b")))


def in_every_group(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Items that occur in every group."""
    groups = rows.agg(F.count_distinct(group).alias("groups"))
    return rows.groupBy(item).agg(F.count_distinct(group).alias("has")).crossJoin(F.broadcast(groups)).where("has = groups").select(item)


def best_candidate(rows: DataFrame, by: list[str], cost: Column, index: str) -> DataFrame:
    """The index of least cost, ties to the least index, and its cost: a bounded partial aggregate."""
    best = F.min(F.struct(cost.alias("cost"), F.col(index).alias("index")))
    return rows.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.index").alias("best_index"), F.col("best.cost").alias("best_cost"))
