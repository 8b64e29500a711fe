"""Further queries: parameters, payloads, policies, node tables, and single steps of the layout search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.operators import layout as L
from quoin.operators import raster, scoring
from quoin.operators import spatial as P
from quoin.sources import relations as S

from . import boxes as B
from . import sql as V
from .catalogue import query

W, H = S.PAGE_WIDTH, S.PAGE_HEIGHT


@query("src01_parameters", "select 8 as minimum_gap, 10 as beam, 64 as expansions, 7 as depth, 3 as splits")
def src01(spark, d):
    """The search parameters as a one-row relation."""
    return spark.createDataFrame([tuple(L.PARAMETERS[k] for k in ("minimum_gap", "beam", "expansions", "depth", "splits"))], "minimum_gap int, beam int, expansions int, depth int, splits int")


def payloads(spark, d):
    """Detector payloads as JSON text, one for each page."""
    box = F.struct(F.col("l").alias("column_min"), F.col("t").alias("row_min"), F.col("r").alias("column_max"), F.col("b").alias("row_max"))
    part = F.struct(F.col("element_id").alias("id"), F.col("uied_class").alias("class"), box.alias("position"))
    rows = S.elements(spark, d).groupBy("page_id").agg(F.collect_list(part).alias("compos"))
    return rows.select(F.col("page_id").alias("page"), F.to_json(F.struct(F.array(F.lit(H), F.lit(W), F.lit(3)).alias("img_shape"), "compos")).alias("payload"))


def parsed(spark, d):
    rows = payloads(spark, d).select("page", F.from_json("payload", S.ARTIFACT, {"mode": "FAILFAST"}).alias("p"))
    return rows.select("page", F.col("p.img_shape")[0].alias("image_height"), F.col("p.img_shape")[1].alias("image_width"), "p.compos")


@query("src02_payload_elements", f"with {V.ELEMENTS} select page_id, element_id, uied_class, l, t, r, b from elements")
def src02(spark, d):
    return S.components(parsed(spark, d)).select(F.col("page").alias("page_id"), "element_id", "uied_class", "l", "t", "r", "b")


@query("src03_invalid_payloads", f"with {V.ELEMENTS} select distinct page_id from elements where page_id % 10 = 0")
def src03(spark, d):
    """Payloads that lost their height are found, the others are not."""
    broken = parsed(spark, d).withColumn("image_height", F.when(F.col("page") % 10 != 0, F.col("image_height")))
    return S.invalid_artifacts(broken).select(F.col("page").alias("page_id"))


WHOLE = """case when region_type in ('hero', 'navigation', 'text_section', 'footer') then least(1, 0.45 * background_continuity + 0.25 * text_ratio + 0.3 * largest)
  when region_type in ('card_grid', 'list') then least(1, rep) else least(1, density + 0.25 * background_continuity) end"""


@query("prj20_completeness", f"with {B.FEATURE_VIEWS}, {V.PROFILES} select page_id, region_id, round({WHOLE}, 10) as completeness from measured join kinds using (page_id, region_id)")
def prj20(spark, d):
    c, rep = F.col, (F.col("repeated_size") + F.col("repeated_gap")) / 2
    one = lambda x: F.least(F.lit(1.0), x)
    whole = F.when(c("region_type").isin("hero", "navigation", "text_section", "footer"), one(0.45 * c("background_continuity") + 0.25 * c("text_ratio") + 0.3 * c("largest")))
    whole = whole.when(c("region_type").isin("card_grid", "list"), one(rep)).otherwise(one(c("density") + 0.25 * c("background_continuity")))
    return P.classify(B.features(spark, d)).select("page_id", "region_id", F.round(whole, 10).alias("completeness"))


@query(
    "prj21_cohesion",
    f"""with {B.FEATURE_VIEWS}, {V.PROFILES} select page_id, region_id, round(least(1, 0.35 * background_continuity + 0.2 * density + case when region_type in ('hero', 'navigation', 'text_section', 'footer') then 0.2 * text_ratio + 0.25 * largest
    when region_type in ('card_grid', 'list') then 0.225 * (repeated_size + repeated_gap) else 0.2 end), 10) as cohesion from measured join kinds using (page_id, region_id)""",
)
def prj21(spark, d):
    c = F.col
    more = F.when(c("region_type").isin("hero", "navigation", "text_section", "footer"), 0.2 * c("text_ratio") + 0.25 * c("largest"))
    more = more.when(c("region_type").isin("card_grid", "list"), 0.225 * (c("repeated_size") + c("repeated_gap"))).otherwise(0.2)
    return P.classify(B.features(spark, d)).select("page_id", "region_id", F.round(F.least(F.lit(1.0), 0.35 * c("background_continuity") + 0.2 * c("density") + more), 10).alias("cohesion"))


@query("flt06_open_decisions", f"with {B.DECISIONS} select page_id, direction, position, final from decided where len(why) = 0 and final >= 0.6 and cut_large = 0")
def flt06(spark, d):
    """Decisions that a search may follow: not refused, not below the region's minimum, through no large component."""
    rows = P.decisions(P.apart(B.candidates(spark, d)), L.POLICIES["two_column"])
    return rows.where(F.size("blocked") == 0).select("page_id", "direction", "position", "final")


@query("flt09_valid_cuts", f"with {B.CANDIDATES} select page_id, direction, position from f where least(position, extent - position) >= 24 and before > 0 and after > 0 and cut_foreground + cut_other = 0")
def flt09(spark, d):
    """Cuts with both sides filled and wide enough that pass through no box."""
    extent = F.when(F.col("direction") == "vertical", W).otherwise(H)
    return B.candidates(spark, d).where((F.least(F.col("position"), extent - F.col("position")) >= 24) & (F.col("before") > 0) & (F.col("after") > 0) & (F.col("cut_foreground") + F.col("cut_other") == 0)).select("page_id", "direction", "position")


@query("win15_preorder", f"with {V.ELEMENTS}, {V.NODES} select page_id, node_id, cast(row_number() over (partition by page_id order by case when parent_id is null then 0 else 1 end, ordinal) - 1 as int) as preorder from nodes")
def win15(spark, d):
    order = Window.partitionBy("page_id").orderBy(F.col("parent_id").isNotNull().cast("int"), "ordinal")
    return S.nodes(S.elements(spark, d)).select("page_id", "node_id", (F.row_number().over(order) - 1).cast("int").alias("preorder"))


@query("win05_state_ranks", f"with {B.DECISIONS} select page_id, direction, position, cast(row_number() over (partition by page_id {B.BY_FINAL}) as int) as rank, cast(count(*) over (partition by page_id) - row_number() over (partition by page_id {B.BY_FINAL}) as int) as lower from decided where len(why) = 0")
def win05(spark, d):
    """The accepted one-cut states of a page by rank, and how many rank lower."""
    rows = P.decisions(P.apart(B.candidates(spark, d)), L.POLICIES["two_column"]).where("accepted")
    rank = F.row_number().over(B._by_final())
    return rows.select("page_id", "direction", "position", rank.cast("int").alias("rank"), (F.count("*").over(Window.partitionBy("page_id")) - rank).cast("int").alias("lower"))


@query("hlp07_selected_cuts", f"with {B.CANDIDATES} select page_id, direction, position from f where len(why) = 0")
def hlp07(spark, d):
    return B.candidates(spark, d).where("accepted").select("page_id", "direction", "position")


@query("hlp09_best_by_rank", f"with {B.APART} select page_id, direction, position, score, cast(row_number() over (partition by page_id order by score desc, len(sources) desc, gap desc, position, direction) as int) as rank from kept")
def hlp09(spark, d):
    """Candidates that no better one of their direction lies within eight pixels of, by score, sources, gap and place."""
    order = Window.partitionBy("page_id").orderBy(*P.candidate_order(), "direction")
    return P.apart(B.candidates(spark, d)).select("page_id", "direction", "position", "score", F.row_number().over(order).cast("int").alias("rank"))


@query("hlp11_merged_neighbours", f"with {V.ELEMENTS} select a.page_id, a.element_id, least(a.l, b.l) as l, least(a.t, b.t) as t, greatest(a.r, b.r) as r, greatest(a.b, b.b) as b, (a.l + b.l) // 2 as shade from elements a join elements b on a.page_id = b.page_id and b.element_id = a.element_id + 1")
def hlp11(spark, d):
    """Two blocks become one; whole-number halves for colours."""
    near = B._neighbours(spark, d)
    low, high = (lambda c: F.least(f"a_{c}", f"b_{c}").alias(c)), (lambda c: F.greatest(f"a_{c}", f"b_{c}").alias(c))
    return near.select("page_id", F.col("a_element_id").alias("element_id"), low("l"), low("t"), high("r"), high("b"), F.expr("cast((a_l + b_l) div 2 as int)").alias("shade"))


@query("hlp13_without_indices", f"with {V.ELEMENTS} select page_id, element_id from elements where element_id not in (0, 3)")
def hlp13(spark, d):
    gone = spark.createDataFrame([(0,), (3,)], "element_id int")
    return S.elements(spark, d).select("page_id", "element_id").join(F.broadcast(gone), "element_id", "left_anti").select("page_id", "element_id")


@query("hlp20_tree_json_valid", f"with {V.ELEMENTS}, {V.NODES} select page_id, count(*) as nodes, count(*) filter (layout_type not in ('row', 'column', 'atomic', 'spacer') or r <= l or b <= t) as bad from nodes group by page_id")
def hlp20(spark, d):
    """Node tables written as JSON, parsed with a schema, and checked."""
    text = S.nodes(S.elements(spark, d)).groupBy("page_id").agg(F.to_json(F.collect_list(F.struct("node_id", "layout_type", "l", "t", "r", "b"))).alias("j"))
    rows = text.select("page_id", F.inline(F.from_json("j", "array<struct<node_id: int, layout_type: string, l: int, t: int, r: int, b: int>>")))
    bad = ~F.col("layout_type").isin("row", "column", "atomic", "spacer") | (F.col("r") <= F.col("l")) | (F.col("b") <= F.col("t"))
    return rows.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(bad).alias("bad"))


@query("agg13_leaf_variance", "select l_orderkey, round(least(1, (stddev_pop(l_partkey % 256) + stddev_pop(l_suppkey % 256) + stddev_pop(l_linenumber * 30)) / 3 / 127.5), 6) as variance from lineitem group by 1")
def agg13(spark, d):
    """Mean over channels of the pixels' population deviation, as a part of 127.5."""
    channels = (F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber") * 30)
    mean = sum((F.stddev_pop(c) for c in channels), F.lit(0.0)) / 3
    return S.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.least(F.lit(1.0), mean / 127.5), 6).alias("variance"))


def page(spark, d):
    return P.roles(S.elements(spark, d), W, H), S.lines(spark, d)


@query("itr04_layout_groups")
def itr04(spark, d):
    """How many groups of each kind a page has."""
    return L.group_rows(*page(spark, d), W, H).groupBy("page_id", "layout_type").agg(F.count("*").alias("n"))


@query("agg41_merged_evidence")
def agg41(spark, d):
    """Sources that meet in one cut within 4 px."""
    return L.cut_rows(*page(spark, d), W, H).where("sources like '%,%'").select("page_id", "direction", "position", "sources")


@query("itr13_merged_runs")
def itr13(spark, d):
    """Leaves that took in the elements of several."""
    return L.shared_rows(*page(spark, d), W, H)


@query("jon06_spacers")
def jon06(spark, d):
    """Leaves left empty once icons moved to a readable leaf."""
    return L.spacer_rows(*page(spark, d), W, H)


@query("hlp21_baseline_segments")
def hlp21(spark, d):
    """Normalised boxes cut by projection: leaves and depth of every page."""
    rows = L.projection_rows(page(spark, d)[0], W, H)
    return rows.groupBy("page_id").agg(F.count_if(F.col("layout_type") == "atomic").alias("leaves"), (F.max("depth") + 1).alias("depth"))


@query("hlp22_page_records")
def hlp22(spark, d):
    """One record a page: passed, or the faults that sent it to the rejects."""
    rows = L.record_rows(*page(spark, d), W, H)
    return rows.select("page_id", F.when(F.col("faults") == "", "ok").otherwise("failed").alias("status"), "faults", "score")


@query("flt15_text_matches")
def flt15(spark, d):
    return scoring.matches(scoring.block_pairs(S.elements(spark, d))).groupBy("page_id").agg(F.count("*").alias("matches"), F.round(F.avg("similarity"), 6).alias("mean"))


@query("win09_raster_cuts")
def win09(spark, d):
    """Leaves of the raster trees by depth (soft and hard separators)."""
    return raster.trees(raster.images(S.elements(spark, d))).where("layout_type = 'atomic'").groupBy("page_id").agg(F.count("*").alias("leaves"), F.max("depth").alias("depth"))
