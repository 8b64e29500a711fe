"""Queries over score tables, generation records and other experiment data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import reports as R
from quoin.sources import relations as S

from .catalogue import query
from .sql import PAIRS, RECORDS, SCORES


@query(
    "agg20_paired_summary",
    f"""with {SCORES}, {PAIRS} select count(*) as n, count(*) filter (delta > 0) as wins, count(*) filter (delta < 0) as losses, count(*) filter (delta = 0) as ties,
    round(avg(delta), 6) as mean_delta, round(quantile_cont(delta, 0.5), 6) as median_delta, count(*) filter (delta > 0.01) as improvement_gt_0_01,
    count(*) filter (delta < -0.01) as regression_lt_minus_0_01, count(*) filter (delta < -0.03) as regression_lt_minus_0_03 from pairs""",
)
def agg20(spark, d):
    return R.paired_summary(S.scores(spark, d), "view", "click")


@query(
    "agg19_descriptive_by_method",
    f"""with {SCORES}, k as (select *, row_number() over (partition by method order by score) as k from scores)
    select method, count(*) as sample_count, round(avg(score), 6) as mean, round(quantile_cont(score, 0.5), 6) as median, round(min(score), 6) as min, round(quantile_cont(score, 0.1), 6) as p10,
    round(avg(score) filter (k <= 10), 6) as bottom_10_mean from k group by method""",
)
def agg19(spark, d):
    return R.descriptive(S.scores(spark, d), "method", "score")


@query("agg18_percentiles", f"with {SCORES} select method, round(quantile_cont(score, 0.1), 6) as p10, round(quantile_cont(score, 0.25), 6) as p25, round(quantile_cont(score, 0.9), 6) as p90 from scores group by method")
def agg18(spark, d):
    return R.percentiles(S.scores(spark, d), "method", "score", {"p10": 0.1, "p25": 0.25, "p90": 0.9})


@query(
    "agg21_generation_summary",
    f"""with {RECORDS} select segmenter, count(*) as record_count, round(avg(elapsed), 6) as mean_elapsed_seconds, round(avg(leaf_count), 6) as mean_leaf_count,
    count(*) filter (leaf_count = 1) as single_leaf_count, cast(sum(leaf_count) as bigint) as total_api_calls from records where status = 'ok' group by segmenter""",
)
def agg21(spark, d):
    return R.generation_summary(S.records(spark, d))


@query(
    "flt17_status_rates",
    f"with {RECORDS} select count(*) as record_count, count(*) filter (status = 'failed') as failure_count, round(count(*) filter (status = 'failed') / count(*), 6) as failure_rate, round(avg(elapsed) filter (status = 'ok'), 6) as mean_elapsed_seconds from records",
)
def flt17(spark, d):
    return R.failure_summary(S.records(spark, d))


@query(
    "agg22_comparison_gate",
    f"""with {SCORES}, {PAIRS}, {RECORDS},
    p as (select count(*) as sample_count, round(avg(baseline), 6) as baseline_mean, round(avg(candidate), 6) as candidate_mean_paired, round(avg(delta), 6) as mean_delta, round(quantile_cont(delta, 0.5), 6) as median_delta,
      count(*) filter (delta > 0) as wins, count(*) filter (delta < -0.02) as regressions, max(delta) filter (sample = 22) as delta_22, max(delta) filter (sample = 91) as delta_91, max(delta) filter (sample = 12) as delta_12, max(delta) filter (sample = 13) as delta_13 from pairs),
    q as (select round(avg(score), 6) as candidate_mean from scores where method = 'click'),
    r as (select cast(sum(leaf_count) as bigint) as actual_api_calls, count(*) filter (status <> 'ok') as render_failures from records),
    g as (select *, candidate_mean >= 0.948 as ok_mean, median_delta > 0 as ok_median, wins >= 8 as ok_wins, regressions <= 1 as ok_regressions, coalesce(delta_22 >= 0.02, false) as ok_22, coalesce(delta_91 >= 0.03, false) as ok_91,
      coalesce(delta_12 >= -0.01, false) as ok_12, coalesce(delta_13 >= -0.01, false) as ok_13, actual_api_calls <= 450 as ok_calls, render_failures = 0 as ok_renders from p, q, r)
    select *, sample_count = 12 and ok_mean and ok_median and ok_wins and ok_regressions and ok_22 and ok_91 and ok_12 and ok_13 and ok_calls and ok_renders as passed from g""",
)
def agg22(spark, d):
    floors = {22: 0.02, 91: 0.03, 12: -0.01, 13: -0.01}
    return R.comparison_gate(S.scores(spark, d), S.records(spark, d), "view", "click", 12, floors, 0.948, 8, 450)


@query("agg23_method_means", f"with {SCORES} select method, round(avg(score), 6) as mean_score from scores group by method")
def agg23(spark, d):
    return S.scores(spark, d).groupBy("method").agg(F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    "agg24_run_summary",
    f"with {RECORDS} select status, count(*) as n, round(min(elapsed), 6) as fastest, round(max(elapsed), 6) as slowest, round(sum(elapsed), 4) as total_seconds from records group by status",
)
def agg24(spark, d):
    return S.records(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.min("elapsed"), 6).alias("fastest"), F.round(F.max("elapsed"), 6).alias("slowest"), F.round(F.sum("elapsed"), 4).alias("total_seconds"))


@query("agg28_equal_width_hist", "with e as (select min(n_chars) as lo, max(n_chars) as hi from documents) select cast(case when n_chars = hi then 9 else floor((n_chars - lo) / ((hi - lo) / 10.0::double)) end as int) as bucket, count(*) as n, min(n_chars) as low, max(n_chars) as high from documents, e group by 1")
def agg28(spark, d):
    return R.histogram(S.read(spark, d, "documents"), "n_chars", 10)


@query(
    "agg29_bounds",
    "with e as (select cast(min(n_chars) as double) as lo, cast(max(n_chars) as double) as hi from documents) select cast(i as int) as bucket, round(lo + i * ((hi - lo) / 8), 6) as low, round(case when i < 7 then lo + (i + 1) * ((hi - lo) / 8) else hi end, 6) as high from e, range(8) t(i)",
)
def agg29(spark, d):
    return R.bounds(S.read(spark, d, "documents"), "n_chars", 8)


@query(
    "agg30_quantile_buckets",
    "with q as (select quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1]) as q from documents) select cast(i as int) as bucket, round(q[i + 1], 6) as low, round(q[i + 2], 6) as high from q, range(4) t(i)",
)
def agg30(spark, d):
    return R.quantile_buckets(S.read(spark, d, "documents"), "n_chars", 4)


LABELLED = "labelled as (select d.doc_id, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id)"


def labelled(spark, d):
    return S.read(spark, d, "documents").select("doc_id", "n_chars").join(S.read(spark, d, "labels"), "doc_id")


@query("agg31_correlation", f"with {LABELLED} select round(corr(n_chars, quality), 6) as r, count(*) as n from labelled")
def agg31(spark, d):
    return labelled(spark, d).agg(F.round(F.corr("n_chars", "quality"), 6).alias("r"), F.count("*").alias("n"))


@query(
    "agg32_difficulty_bins",
    f"with {LABELLED} select cast(case when n_chars < 141 then 0 when n_chars < 270 then 1 when n_chars < 399 then 2 when n_chars < 528 then 3 else 4 end as int) as bin, count(*) as n, round(avg(quality), 6) as mean, round(stddev_pop(quality), 6) as deviation from labelled group by 1",
)
def agg32(spark, d):
    return R.binned(labelled(spark, d), "n_chars", "quality", (141, 270, 399, 528))


@query("agg34_method_vectors", f"with {RECORDS} select segmenter, round(avg(elapsed), 6) as elapsed, round(avg(leaf_count), 6) as leaves, round(avg((status = 'ok')::int), 6) as ok from records group by segmenter")
def agg34(spark, d):
    return S.records(spark, d).groupBy("segmenter").agg(F.round(F.avg("elapsed"), 6).alias("elapsed"), F.round(F.avg("leaf_count"), 6).alias("leaves"), F.round(F.avg((F.col("status") == "ok").cast("int")), 6).alias("ok"))


@query(
    "agg37_multiset_diff",
    """with a as (select value from events where event_type = 'view'), b as (select value from events where event_type = 'click'),
    x as (select value from a except all select value from b), y as (select value from b except all select value from a)
    select (select count(*) from x) as n_only_a, (select round(avg(value), 6) from x) as mean_only_a, (select count(*) from y) as n_only_b, (select round(avg(value), 6) from y) as mean_only_b""",
)
def agg37(spark, d):
    rows = S.read(spark, d, "events")
    return R.multiset_difference(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "value")


@query("agg40_call_accounting", f"with {RECORDS} select segmenter, cast(sum(leaf_count * 2 + 1) as bigint) as estimated, cast(sum(leaf_count * 2) as bigint) as leaf_calls from records group by segmenter")
def agg40(spark, d):
    n = F.col("leaf_count")
    return S.records(spark, d).groupBy("segmenter").agg(F.sum(n * 2 + 1).cast("long").alias("estimated"), F.sum(n * 2).cast("long").alias("leaf_calls"))


@query("agg42_equal_content", "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def agg42(spark, d):
    rows = S.read(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


@query("jon10_paired_scores", f"with {SCORES}, {PAIRS} select * from pairs")
def jon10(spark, d):
    return R.paired(S.scores(spark, d), "view", "click")


@query("jon11_in_every_method", "select user_id from events group by user_id having count(distinct event_type) = (select count(distinct event_type) from events)")
def jon11(spark, d):
    return R.in_every_group(S.read(spark, d, "events"), "event_type", "user_id")


@query("jon12_todo", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def jon12(spark, d):
    return S.read(spark, d, "documents").select("doc_id").join(S.read(spark, d, "labels"), "doc_id", "left_anti")


@query("jon13_missing_inputs", "select d.doc_id, l.doc_id is null as missing from documents d left join labels l on d.doc_id = l.doc_id")
def jon13(spark, d):
    found = S.read(spark, d, "labels").select("doc_id", F.lit(True).alias("has"))
    return S.read(spark, d, "documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("has").isNull().alias("missing"))


@query("jon14_drop_duplicates", "select doc_id, source from documents d where doc_id = (select min(doc_id) from documents e where e.text = d.text)")
def jon14(spark, d):
    """Drop known duplicates: all but the first document of each text. The first is found by a partial aggregate on a digest."""
    docs = S.read(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("k")).agg(F.min(F.struct("doc_id", "source")).alias("f")).select("f.doc_id", "f.source")


@query("jon19_by_name", "select a.doc_id, a.quality, b.lang from labels a join documents b on a.doc_id = b.doc_id")
def jon19(spark, d):
    return S.read(spark, d, "labels").select("doc_id", "quality").join(S.read(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("set01_sample_intersection", "select user_id from events where event_type = 'view' and value > 20 intersect select user_id from events where event_type = 'click' and value > 20")
def set01(spark, d):
    rows = S.read(spark, d, "events").where("value > 20")
    return rows.where("event_type = 'view'").select("user_id").intersect(rows.where("event_type = 'click'").select("user_id"))


@query("set03_ordered_distinct", "select conv_id, array_to_string(list(role order by first), ',') as roles from (select conv_id, role, min(turn) as first from conversations group by all) group by conv_id")
def set03(spark, d):
    rows = S.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.array_distinct(F.col("t.role")), ",").alias("roles"))


@query(
    "set04_source_intersections",
    "with u as (select user_id, list(distinct event_type) filter (value > 30) as a, list(distinct event_type) filter (value < 10) as b from events group by user_id) select user_id, coalesce(list_has_any(a, b), false) as both_kinds from u",
)
def set04(spark, d):
    kinds = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    rows = S.read(spark, d, "events").groupBy("user_id").agg(kinds(F.col("value") > 30).alias("a"), kinds(F.col("value") < 10).alias("b"))
    return rows.select("user_id", F.arrays_overlap("a", "b").alias("both_kinds"))


@query("set05_source_union", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as sources from events group by user_id")
def set05(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"))


@query("set07_distinct_urls", "select distinct regexp_replace(url, '[?#].*$', '') as url from pages")
def set07(spark, d):
    return S.read(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()


@query("set08_stage_union", f"with {RECORDS} select 'raw' as stage, segmenter, count(*) as n from records group by segmenter union all select 'final', segmenter, count(*) from records where status = 'ok' group by segmenter")
def set08(spark, d):
    rows = S.records(spark, d)
    stages = F.when(F.col("status") == "ok", F.array(F.lit("raw"), F.lit("final"))).otherwise(F.array(F.lit("raw")))
    return rows.select(F.explode(stages).alias("stage"), "segmenter").groupBy("stage", "segmenter").agg(F.count("*").alias("n"))


@query("srt06_bottom_10", f"with {SCORES} select method, round(avg(score), 6) as bottom_10_mean from (select *, row_number() over (partition by method order by score) as k from scores) where k <= 10 group by method")
def srt06(spark, d):
    return R.descriptive(S.scores(spark, d), "method", "score").select("method", "bottom_10_mean")


@query("srt07_top_improvements", f"with {SCORES}, {PAIRS} select sample, delta from pairs order by delta desc, sample limit 10")
def srt07(spark, d):
    return R.paired(S.scores(spark, d), "view", "click").select("sample", "delta").orderBy(F.desc("delta"), "sample").limit(10)


@query("srt08_record_order", f"with {SCORES} select sample, row_number() over (order by sample) as numeric_place, row_number() over (order by cast(sample as varchar)) as text_place from (select distinct sample from scores)")
def srt08(spark, d):
    """Numeric and lexicographic order of sample ids, which are a bounded list of the experiment."""
    from pyspark.sql import Window

    ids = S.scores(spark, d).select("sample").distinct()
    place = lambda c: F.row_number().over(Window.orderBy(c)).cast("long")
    return ids.select("sample", place(F.col("sample")).alias("numeric_place"), place(F.col("sample").cast("string")).alias("text_place"))


@query(
    "srt09_best_candidate",
    "select conv_id, turn as best_index, cost as best_cost from (select conv_id, turn, abs(length(text) - 300) as cost, row_number() over (partition by conv_id order by abs(length(text) - 300), turn) as k from conversations where role = 'assistant') where k = 1",
)
def srt09(spark, d):
    rows = S.read(spark, d, "conversations").where("role = 'assistant'")
    return R.best_candidate(rows, ["conv_id"], F.abs(F.length("text") - 300).cast("long"), "turn")


@query(
    "gen05_candidate_choice",
    "with c as (select conv_id, turn, length(text) as cost, regexp_matches(text, '[A-Z]') as accepted from conversations) select conv_id, arg_min(turn, (cost, turn)) filter (accepted) as chosen, bool_or(accepted) as found from c group by conv_id",
)
def gen05(spark, d):
    rows = S.read(spark, d, "conversations").withColumn("ok", F.col("text").rlike("[A-Z]"))
    return rows.groupBy("conv_id").agg(F.min(F.when(F.col("ok"), F.struct(F.length("text"), "turn"))).alias("best"), F.bool_or("ok").alias("found")).select("conv_id", F.col("best.turn").alias("chosen"), "found")


@query("flt18_structure_gate", f"with {RECORDS} select segmenter from records group by segmenter having bool_and(status = 'ok') or count(*) filter (status = 'failed') * 4 < count(*)")
def flt18(spark, d):
    failed = F.count_if(F.col("status") == "failed")
    return S.records(spark, d).groupBy("segmenter").agg(failed.alias("f"), F.count("*").alias("n")).where("f = 0 or f * 4 < n").select("segmenter")


@query("src12_rehydrate_passed", f"with {RECORDS} select r.record_id, r.leaf_count, l.quality from records r join labels l on l.doc_id = r.record_id where r.status = 'ok'")
def src12(spark, d):
    return S.records(spark, d).where("status = 'ok'").select("record_id", "leaf_count").join(S.read(spark, d, "labels").select(F.col("doc_id").alias("record_id"), "quality"), "record_id")


@query("src13_checkpoint_identity", "select doc_id, quality from labels l where exists (select 1 from documents d where d.doc_id = l.doc_id and d.n_chars % 2 = l.quality)")
def src13(spark, d):
    now = S.read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return S.if_same_identity(S.read(spark, d, "labels").select("doc_id", "quality"), now, ["doc_id"], ["quality"])


@query("src14_score_maps", f"with {SCORES} select method, cast(sample as varchar) as sample, score from scores")
def src14(spark, d):
    """Scores written as nested JSON maps, one for each method, and read back."""
    rows = S.scores(spark, d).groupBy("method").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("sample").cast("string"), "score")))).alias("m"))
    text = F.concat(F.lit('{"'), F.col("method"), F.lit('":'), F.col("m"), F.lit("}"))
    return S.score_maps(rows.select(text.alias("payload")), "payload")


@query("src16_request_bytes", "select doc_id, length(text) as n from documents where text is not null")
def src16(spark, d):
    """Data URLs as a request carries them, decoded again."""
    rows = S.read(spark, d, "documents").where("text is not null")
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "utf-8")))
    return rows.select("doc_id", F.length(F.decode(S.data_url_bytes(url), "utf-8")).cast("long").alias("n"))


@query("hlp16_score_embeddings", "select label, count(*) as n from embeddings group by label")
def hlp16(spark, d):
    return S.read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("hlp19_record_json", f"with {RECORDS} select record_id, segmenter, status, leaf_count from records")
def hlp19(spark, d):
    """Records serialised to JSON and parsed with a schema."""
    text = S.records(spark, d).select(F.to_json(F.struct("record_id", "segmenter", "status", "leaf_count")).alias("j"))
    return text.select(F.from_json("j", "record_id long, segmenter string, status string, leaf_count int").alias("r")).select("r.*")


@query("agg35_channel_error", "select l_linestatus, round(avg(abs((l_partkey * 7) % 256 - (l_suppkey * 13) % 256)), 6) as mean_abs_error from lineitem group by 1")
def agg35(spark, d):
    """Mean absolute error of two channels held as plain integers, so nothing wraps at 256."""
    a, b = (F.col("l_partkey") * 7) % 256, (F.col("l_suppkey") * 13) % 256
    return S.read(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg(F.abs(a - b)), 6).alias("mean_abs_error"))


@query("agg38_average_colour", "select o_orderpriority, cast(floor(avg(o_custkey % 256)) as int) as r, cast(floor(avg((o_custkey * 3) % 256)) as int) as g from orders group by 1")
def agg38(spark, d):
    c = F.col("o_custkey")
    return S.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.floor(F.avg(c % 256)).cast("int").alias("r"), F.floor(F.avg((c * 3) % 256)).cast("int").alias("g"))
