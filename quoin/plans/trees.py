"""Queries over layout trees: grouping, normalisation, search, ownership, merging, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import layout as L
from quoin.operators import raster, scoring
from quoin.operators import spatial as P
from quoin.sources import relations as S

from . import sql as V
from .boxes import NODES_SQL
from .catalogue import query

W, H = S.PAGE_WIDTH, S.PAGE_HEIGHT


def page(spark, d):
    return P.roles(S.elements(spark, d), W, H), S.lines(spark, d)


@query("itr03_groups")
def itr03(spark, d):
    """Groups of aligned neighbours that no separator crosses."""
    return L.group_rows(*page(spark, d), W, H)


@query("agg10_group_types")
def agg10(spark, d):
    return L.group_rows(*page(spark, d), W, H).groupBy("layout_type", "label").agg(F.count("*").alias("n"))


@query("itr05_normalize")
def itr05(spark, d):
    return L.normalised_rows(page(spark, d)[0])


@query("itr06_projection_tree")
def itr06(spark, d):
    return L.projection_rows(page(spark, d)[0], W, H)


@query("itr07_cut_evidence")
def itr07(spark, d):
    """Cuts with their merged evidence (AGG41), scores and refusals (ITR08)."""
    return L.cut_rows(*page(spark, d), W, H)


@query("itr09_decisions")
def itr09(spark, d):
    return L.decision_rows(*page(spark, d), W, H)


@query("itr10_beam_trees")
def itr10(spark, d):
    """The best sound tree of every page (ITR10, ITR11, ITR12, JON06, ITR13, ITR14, ITR15)."""
    return L.tree_rows(*page(spark, d), W, H)


@query("agg12_tree_terms")
def agg12(spark, d):
    return L.term_rows(*page(spark, d), W, H)


@query("itr12_owned")
def itr12(spark, d):
    trees = L.tree_rows(*page(spark, d), W, H).where("owned != ''")
    return trees.select("page_id", "node_id", F.explode(F.split("owned", ",").cast("array<int>")).alias("element_id"))


@query("itr14_tree_ranks")
def itr14(spark, d):
    return L.tree_rows(*page(spark, d), W, H).where("node_id = 0").select("page_id", "rank", "score", (F.col("faults") == "").alias("passed"))


@query("itr11_layout_nodes", f"with {NODES_SQL} select page_id, node_id, parent_id, layout_type from nodes where parent_id is not null")
def itr11(spark, d):
    return S.nodes(S.elements(spark, d)).where("parent_id is not null").select("page_id", "node_id", "parent_id", "layout_type")


@query("itr19_tree_depth", f"""with recursive {NODES_SQL}, walk as (select page_id, node_id, 0 as depth from nodes where parent_id is null union all select n.page_id, n.node_id, w.depth + 1 from nodes n join walk w on n.page_id = w.page_id and n.parent_id = w.node_id)
    select page_id, cast(max(depth) as int) as depth, count(*) as nodes from walk group by page_id""")
def itr19(spark, d):
    """Depth and size of node tables, walked level by level."""
    return P.tree_depths(S.nodes(S.elements(spark, d)))


@query("gen01_flex_html")
def gen01(spark, d):
    return L.html_rows(*page(spark, d), W, H).select("page_id", F.md5("html").alias("digest"), F.length("html").alias("n"))


@query("gen02_skeleton")
def gen02(spark, d):
    return L.html_rows(*page(spark, d), W, H, "skeleton").select("page_id", F.md5("html").alias("digest"), F.length("html").alias("n"))


@query("gen03_grid_html")
def gen03(spark, d):
    """Absolute placement with each leaf's code put in by its id (GEN04)."""
    return L.html_rows(*page(spark, d), W, H, "grid").select("page_id", F.md5("html").alias("digest"), F.length("html").alias("n"))


@query("snk09_tree_json")
def snk09(spark, d):
    return L.json_rows(*page(spark, d), W, H).select("page_id", F.md5("tree").alias("digest"), F.length("tree").alias("n"))


@query("agg07_pixel_features")
def agg07(spark, d):
    """Colour variance, strongest transitions and edge density of small images."""
    return raster.features(raster.images(S.elements(spark, d)))


@query("itr16_raster_tree")
def itr16(spark, d):
    """Recursive cuts of small images at uniform rows and columns (WIN09, WIN10, SET09)."""
    return raster.page_trees(S.elements(spark, d))


@query(
    "gen10_page_mask",
    f"""with {V.LINES} select page_id, case direction when 'vertical' then position - 2 else "start" end as l, case direction when 'vertical' then "start" else position - 2 end as t,
    case direction when 'vertical' then position + 3 else "end" end as r, case direction when 'vertical' then "end" else position + 3 end as b, 'black' as colour from lines""",
)
def gen10(spark, d):
    return raster.mask_rectangles(S.lines(spark, d))


@query(
    "gen11_text_blocks",
    f"""with {V.ELEMENTS}, one as (select page_id, unnest(range(t, b, 20)) as y, l, r, uied_class as colour from elements), two as (select page_id, unnest(range(t, b, 20)) as y, l + 4 as l2, r + 4 as r2, uied_class as colour from elements)
    select page_id, colour, cast(min(greatest(l, l2)) as int) as l, cast(min(y) as int) as t, cast(max(least(r, r2)) as int) as r, cast(max(y) + 1 as int) as b from one join two using (page_id, y, colour) where l < r2 and l2 < r group by page_id, colour""",
)
def gen11(spark, d):
    """Boxes of pixels that a rendering and one four pixels further right colour alike."""
    e = S.elements(spark, d)
    moved = e.withColumn("l", F.col("l") + 4).withColumn("r", F.col("r") + 4)
    return raster.matching_blocks(raster.pixel_runs(e), raster.pixel_runs(moved))


@query("jon16_assignment")
def jon16(spark, d):
    """One-to-one matches of the text blocks of two pages that follow each other."""
    return scoring.matches(scoring.block_pairs(S.elements(spark, d)))


@query("itr17_block_merge")
def itr17(spark, d):
    return scoring.matches(scoring.block_pairs(S.elements(spark, d)), merge=True)


@query("agg33_visual_score")
def agg33(spark, d):
    return scoring.visual_scores(scoring.block_pairs(S.elements(spark, d)))


@query(
    "agg36_equal_blocks",
    f"""with {V.ELEMENTS}, k as (select page_id, element_id, uied_class || ' ' || l || ' ' || (t % 100) as text, l / 1200.0::double as x, t / 900.0::double as y, (r - l) / 1200.0::double as w, (b - t) / 900.0::double as h,
      [(element_id * 37 + 17) % 256, (element_id * 71 + 17) % 256, (element_id * 113 + 17) % 256] as c from elements),
    g as (select page_id, x, y, w, h, string_agg(text, ' ' order by element_id) as text, list(c order by element_id) as cs from k group by page_id, x, y, w, h),
    f as (select *, list_reduce(cs, lambda a, v: [(a[1] + v[1]) // 2, (a[2] + v[2]) // 2, (a[3] + v[3]) // 2]) as c from g)
    select page_id, x, y, w, h, text, cast(c[1] as int) as "R", cast(c[2] as int) as "G", cast(c[3] as int) as "B" from f""",
)
def agg36(spark, d):
    return scoring.merged_equal(scoring.blocks(S.elements(spark, d)))


@query(
    "win12_greedy_positions",
    f"""with {V.LINES}, p as (select direction, page_id % 50 as page_block, list(distinct position) as ps from lines group by 1, 2),
    k as (select direction, page_block, list_reduce(list_transform(list_sort(ps), lambda x: [x]), lambda a, x: case when x[1] - a[len(a)] > 5 then list_concat(a, x) else a end) as kept from p)
    select direction, page_block, unnest(kept) as position from k""",
)
def win12(spark, d):
    """Line positions kept so that none lies within 5 px of an earlier one."""
    return raster.spaced_positions(S.lines(spark, d))
