"""Queries over page elements, separator lines and regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.operators import layout as L
from quoin.operators import spatial as P
from quoin.sources import relations as S

from . import sql as V
from .catalogue import query

W, H = S.PAGE_WIDTH, S.PAGE_HEIGHT
NODES_SQL = f"{V.ELEMENTS}, {V.NODES}"
OVER = "a.l < b.r and b.l < a.r and a.t < b.b and b.t < a.b"
COMMON = "greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))"


@query("prj01_overlap_pairs", f"with {V.ELEMENTS} select a.page_id, a.element_id as a, b.element_id as b, cast({COMMON} as bigint) as common from elements a join elements b on a.page_id = b.page_id and a.element_id < b.element_id where {OVER}")
def prj01(spark, d):
    return P.overlap_pairs(S.elements(spark, d)).select("page_id", "a", "b", "common")


@query(
    "prj04_iou",
    f"""with {V.ELEMENTS}, p as (select a.page_id, a.element_id as a, b.element_id as b, {COMMON} as c, (a.r - a.l) * (a.b - a.t) as x, (b.r - b.l) * (b.b - b.t) as y
    from elements a join elements b on a.page_id = b.page_id and a.element_id < b.element_id where {OVER})
    select page_id, a, b, c / (x + y - c)::double as iou, c / x::double as ioa, c / y::double as iob from p""",
)
def prj04(spark, d):
    return P.overlap_pairs(S.elements(spark, d)).select("page_id", "a", "b", "iou", "ioa", "iob")


@query("prj02_areas", f"with {V.ELEMENTS} select uied_class, cast(sum((r - l) * (b - t)) as bigint) as area from elements group by 1")
def prj02(spark, d):
    return S.elements(spark, d).groupBy("uied_class").agg(F.sum(G.area()).cast("long").alias("area"))


@query("prj03_measures", f"with {V.ELEMENTS} select page_id, element_id, r - l as width, b - t as height, (l + r) / 2.0::double as cx, (t + b) / 2.0::double as cy, uied_class = 'Text' as is_text from elements")
def prj03(spark, d):
    return S.elements(spark, d).select("page_id", "element_id", G.width().alias("width"), G.height().alias("height"), G.center_x().alias("cx"), G.center_y().alias("cy"), (F.col("uied_class") == "Text").alias("is_text"))


CLIPPED = """cut as (select page_id, element_id as old_id, least(greatest(l, 0), 800) as l, least(greatest(t, 0), 600) as t, least(greatest(r, 0), 800) as r, least(greatest(b, 0), 600) as b from elements),
 kept as (select * from cut where r - l >= 2 and b - t >= 2)"""


@query("prj05_clip", f"with {V.ELEMENTS}, {CLIPPED} select page_id, old_id, l, t, r, b from kept")
def prj05(spark, d):
    return P.clipped(S.elements(spark, d), 800, 600, 2).drop("element_id")


@query("flt01_degenerate", f"with {V.ELEMENTS}, {CLIPPED} select page_id, count(*) as kept from kept group by 1")
def flt01(spark, d):
    return P.clipped(S.elements(spark, d), 800, 600, 2).groupBy("page_id").agg(F.count("*").alias("kept"))


@query("hlp03_clip_renumber", f"with {V.ELEMENTS}, {CLIPPED} select page_id, old_id, cast(row_number() over (partition by page_id order by t, l, b, r, old_id) - 1 as int) as element_id, l, t, r, b from kept")
def hlp03(spark, d):
    return P.clipped(S.elements(spark, d), 800, 600, 2)


@query("win04_renumber", f"with {V.ELEMENTS} select page_id, element_id as old_id, cast(row_number() over (partition by page_id order by t, l, b, r, element_id) - 1 as int) as new_id from elements")
def win04(spark, d):
    order = Window.partitionBy("page_id").orderBy("t", "l", "b", "r", "element_id")
    return S.elements(spark, d).select("page_id", F.col("element_id").alias("old_id"), (F.row_number().over(order) - 1).cast("int").alias("new_id"))


@query("prj06_scale", f"with {V.ELEMENTS} select page_id, element_id, cast(least(greatest(round_even(l * 1.5::double, 0), 0), 1800) as int) as l, cast(least(greatest(round_even(t * 1.25::double, 0), 0), 1125) as int) as t, cast(least(greatest(round_even(r * 1.5::double, 0), 0), 1800) as int) as r, cast(least(greatest(round_even(b * 1.25::double, 0), 0), 1125) as int) as b from elements")
def prj06(spark, d):
    """Detector coordinates on the image's scale, rounded half to even and clamped."""
    e = S.elements(spark, d)
    return e.select("page_id", "element_id", *(G.clip(F.col(c) * k, F.lit(most)).alias(c) for c, k, most in (("l", 1.5, 1800), ("t", 1.25, 1125), ("r", 1.5, 1800), ("b", 1.25, 1125))))


@query("prj07_role", f"with {V.ROLES} select page_id, element_id, role from roles")
def prj07(spark, d):
    return P.roles(S.elements(spark, d), W, H).select("page_id", "element_id", "role")


@query("prj10_page_position", f"with {V.ELEMENTS} select case when (t + b) / 2.0 / 900 <= 0.2 then 'header' when (t + b) / 2.0 / 900 >= 0.82 then 'footer' else 'content' end as position, count(*) as n from elements group by 1")
def prj10(spark, d):
    return S.elements(spark, d).groupBy(G.page_position(F.lit(H)).alias("position")).agg(F.count("*").alias("n"))


@query("prj11_page_label", f"with {V.ELEMENTS} select case when (t + b) / 2.0 < 180 then 'header' when (t + b) / 2.0 > 720 then 'footer' else 'content' end as label, count(*) as n from elements group by 1")
def prj11(spark, d):
    return S.elements(spark, d).groupBy(G.page_label(F.lit(H)).alias("label")).agg(F.count("*").alias("n"))


@query("prj12_clamp", f"with {V.ELEMENTS} select page_id, element_id, round(greatest(0, least(1, l / 700.0::double - 0.1)), 6) as x from elements")
def prj12(spark, d):
    return S.elements(spark, d).select("page_id", "element_id", G.clamp01(F.col("l") / 700.0 - 0.1).alias("x"))


@query("prj08_line_crossings", f"with {V.ELEMENTS}, {V.LINES} select e.page_id, e.element_id, direction, position from elements e join lines on e.page_id = lines.page_id where {V.CROSS}")
def prj08(spark, d):
    cut = S.elements(spark, d).join(S.lines(spark, d), "page_id").where(G.crosses(F.col("direction"), F.col("position"), F.col("start"), F.col("end")))
    return cut.select("page_id", "element_id", "direction", "position")


@query("jon04_crossing_ids", f"with {V.ELEMENTS}, {V.LINES} select e.page_id, direction, position, count(*) as n, array_to_string(list_sort(list(e.element_id)), ',') as element_ids from elements e join lines on e.page_id = lines.page_id where {V.CROSS} group by all")
def jon04(spark, d):
    return P.crossings(S.elements(spark, d), S.lines(spark, d))


@query("flt03_uncrossed", f"with {V.ELEMENTS}, {V.LINES} select page_id, element_id from elements e where not exists (select 1 from lines where lines.page_id = e.page_id and {V.CROSS})")
def flt03(spark, d):
    return P.uncrossed(S.elements(spark, d), S.lines(spark, d)).select("page_id", "element_id")


@query("prj09_children", f"with {V.LINES} select page_id, 0 as l, 0 as t, case when direction = 'vertical' then position else 1200 end as r, case when direction = 'vertical' then 900 else position end as b from lines union all select page_id, case when direction = 'vertical' then position else 0 end, case when direction = 'vertical' then 0 else position end, 1200, 900 from lines")
def prj09(spark, d):
    rows = S.lines(spark, d).select("page_id", "direction", "position", F.lit(0).alias("l"), F.lit(0).alias("t"), F.lit(W).alias("r"), F.lit(H).alias("b"))
    return rows.select("page_id", F.inline(G.children(F.col("direction"), F.col("position"))))


@query("prj13_line_source", f"with {V.LINES}, s as (select page_id, list_distinct([source, case when position % 2 = 0 then 'layout_group' else 'component_boundary' end]) as s from lines) select page_id, case when list_contains(s, 'lsd') then 'lsd' when list_contains(s, 'component_boundary') then 'component_boundary' else 'whitespace' end as source from s")
def prj13(spark, d):
    return _sources(spark, d).select("page_id", G.line_source(F.col("s")).alias("source"))


@query("prj14_source_weights", f"with {V.LINES} select page_id, round(case when source = 'lsd' then 0.72 else 0.42 end + case when position % 2 = 0 then 0.22 else 0.55 end, 6) as weight from lines")
def prj14(spark, d):
    return _sources(spark, d).select("page_id", F.round(G.source_weight(F.col("s")), 6).alias("weight"))


def _sources(spark, d):
    other = F.when(F.col("position") % 2 == 0, "layout_group").otherwise("component_boundary")
    return S.lines(spark, d).select("page_id", F.array("source", other).alias("s"))


@query("prj15_semantic_groups", f"with {V.ELEMENTS} select page_id, element_id from elements where uied_class = 'Text' or not ((element_id % 2 = 0 and r - l <= 64) or (element_id % 2 = 1 and b - t <= 64))")
def prj15(spark, d):
    """Text groups count; narrow columns and low rows do not. The layout type follows the id here."""
    e = S.elements(spark, d).withColumn("layout_type", F.when(F.col("element_id") % 2 == 0, "column").otherwise("row"))
    narrow = ((F.col("layout_type") == "column") & (G.width() <= 64)) | ((F.col("layout_type") == "row") & (G.height() <= 64))
    return e.where((F.col("uied_class") == "Text") | ~narrow).select("page_id", "element_id")


@query("prj16_small_elements", f"with {V.ELEMENTS} select page_id, count(*) filter (uied_class = 'Text' or (r - l <= 64 and b - t <= 64)) as mergeable, count(*) filter ((r - l) * (b - t) < 43200 and uied_class <> 'Text' and r - l < 48 and b - t < 48) as small_single from elements group by 1")
def prj16(spark, d):
    text = F.col("uied_class") == "Text"
    return S.elements(spark, d).groupBy("page_id").agg(F.count_if(text | ((G.width() <= 64) & (G.height() <= 64))).alias("mergeable"), F.count_if((G.area() < 0.04 * W * H) & ~text & (G.width() < 48) & (G.height() < 48)).alias("small_single"))


@query(
    "prj17_portions",
    f"""with {V.ELEMENTS}, p as (select page_id, list(greatest(1, b - t) order by element_id) as h from elements group by page_id), g as (select page_id, h, list_reduce(h, lambda x, y: gcd(x, y)) as g from p)
    select page_id, array_to_string(list_transform(h, lambda x: x // g), ',') as portions from g""",
)
def prj17(spark, d):
    rows = S.elements(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("element_id", G.height().alias("h")))).alias("x"))
    return rows.select("page_id", F.array_join(G.portions(F.col("x.h")), ",").alias("portions"))


@query("prj18_line_ends", f"with {V.LINES} select page_id, case when direction = 'vertical' then position else \"start\" end as x1, case when direction = 'vertical' then \"start\" else position end as y1, case when direction = 'vertical' then position else \"end\" end as x2, case when direction = 'vertical' then \"end\" else position end as y2 from lines")
def prj18(spark, d):
    v = F.col("direction") == "vertical"
    pick = lambda a, b: F.when(v, F.col(a)).otherwise(F.col(b))
    return S.lines(spark, d).select("page_id", pick("position", "start").alias("x1"), pick("start", "position").alias("y1"), pick("position", "end").alias("x2"), pick("end", "position").alias("y2"))


@query("prj19_text_run_axis", f"""with {V.ELEMENTS}, m as (select page_id, count(*) filter (uied_class = 'Text') as n, coalesce(max(greatest(r - l, b - t)) filter (uied_class <> 'Text'), 0) as biggest,
    quantile_cont(b - t, 0.5) filter (uied_class = 'Text') as mh, quantile_cont(r - l, 0.5) filter (uied_class = 'Text') as mw,
    max((l + r) / 2.0::double) filter (uied_class = 'Text') - min((l + r) / 2.0::double) filter (uied_class = 'Text') as hs, max((t + b) / 2.0::double) filter (uied_class = 'Text') - min((t + b) / 2.0::double) filter (uied_class = 'Text') as vs from elements group by page_id),
    q as (select *, n >= 2 and biggest <= 48 and mh <= 96 as fit, hs <= 420 and vs >= 2 * mh as v, vs <= 315 and hs >= 2 * mw as h from m)
    select page_id, case when not coalesce(fit, false) then 'none' when v and h then case when vs / 900 >= hs / 1200 then 'vertical' else 'horizontal' end when v then 'vertical' when h then 'horizontal' else 'none' end as axis from q""")
def prj19(spark, d):
    """Axis along which a page's texts run, none with a large other element or tall text."""
    text = F.col("uied_class") == "Text"
    of = lambda x: F.when(text, x)
    spread = lambda x: F.max(of(x)) - F.min(of(x))
    m = S.elements(spark, d).groupBy("page_id").agg(
        F.count_if(text).alias("n"), F.coalesce(F.max(F.when(~text, F.greatest(G.width(), G.height()))), F.lit(0)).alias("biggest"),
        F.percentile(of(G.height()), 0.5).alias("mh"), F.percentile(of(G.width()), 0.5).alias("mw"), spread(G.center_x()).alias("hs"), spread(G.center_y()).alias("vs"),
    )
    fit = F.coalesce((F.col("n") >= 2) & (F.col("biggest") <= 48) & (F.col("mh") <= max(96, round(0.035 * H))), F.lit(False))
    v, h = (F.col("hs") <= 0.35 * W) & (F.col("vs") >= 2 * F.col("mh")), (F.col("vs") <= 0.35 * H) & (F.col("hs") >= 2 * F.col("mw"))
    axis = F.when(~fit, "none").when(v & h, F.when(F.col("vs") / H >= F.col("hs") / W, "vertical").otherwise("horizontal")).when(v, "vertical").when(h, "horizontal").otherwise("none")
    return m.select("page_id", axis.alias("axis"))


@query("prj24_max_axis_distance", f"with {V.ELEMENTS} select a.page_id, a.element_id as a, b.element_id as b, greatest(abs((a.l + a.r) / 2.0::double - (b.l + b.r) / 2.0::double), abs((a.t + a.b) / 2.0::double - (b.t + b.b) / 2.0::double)) as distance from elements a join elements b on a.page_id = b.page_id and b.element_id = a.element_id + 1")
def prj24(spark, d):
    return _neighbours(spark, d).select("page_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), G.max_axis_distance(G.center_x("a_"), G.center_y("a_"), G.center_x("b_"), G.center_y("b_")).alias("distance"))


@query("prj25_center_distance", f"with {V.ELEMENTS} select a.page_id, a.element_id as a, round(sqrt(pow((a.l + a.r) / 2.0::double - (b.l + b.r) / 2.0::double, 2) + pow((a.t + a.b) / 2.0::double - (b.t + b.b) / 2.0::double, 2)), 4) as distance from elements a join elements b on a.page_id = b.page_id and b.element_id = a.element_id + 1")
def prj25(spark, d):
    return _neighbours(spark, d).select("page_id", F.col("a_element_id").alias("a"), F.round(G.center_distance("a_", "b_"), 4).alias("distance"))


def _neighbours(spark, d):
    e = S.elements(spark, d)
    a = P.prefixed(e, "a_").withColumn("next", F.col("a_element_id") + 1)
    b = P.prefixed(e, "b_").withColumn("next", F.col("b_element_id"))
    return a.join(b, ["page_id", "next"])


def _linear(channel: str) -> str:
    return f"case when {channel} / 255.0::double <= 0.04045::double then {channel} / 255.0::double / 12.92::double else pow(({channel} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end"


def _root(x: str) -> str:
    return f"case when {x} > 0.008856 then cbrt({x}) else 7.787::double * {x} + 16 / 116.0::double end"


#: CIEDE2000 as published (Sharma, Wu, Dalal 2005), of sRGB colours under D65.
COLOUR_SQL = f"""with p as (select o_orderkey, unnest([1, 2]) as side, unnest([o_custkey % 256, (o_custkey * 5) % 256]) as r, unnest([(o_custkey * 3) % 256, (o_custkey * 11) % 256]) as g, unnest([(o_custkey * 7) % 256, (o_custkey * 13) % 256]) as b from orders),
 li as (select o_orderkey, side, {_linear('r')} as r, {_linear('g')} as g, {_linear('b')} as b from p),
 xyz as (select o_orderkey, side, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 as x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b as y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 as z from li),
 f as (select o_orderkey, side, {_root('x')} as fx, {_root('y')} as fy, {_root('z')} as fz from xyz),
 lab as (select o_orderkey, side, 116 * fy - 16 as l, 500 * (fx - fy) as a, 200 * (fy - fz) as b from f),
 two as (select p.o_orderkey, p.l as l1, p.a as a1, p.b as b1, q.l as l2, q.a as a2, q.b as b2, pow((sqrt(p.a * p.a + p.b * p.b) + sqrt(q.a * q.a + q.b * q.b)) / 2, 7) as c7 from lab p join lab q on p.o_orderkey = q.o_orderkey and p.side = 1 and q.side = 2),
 s as (select *, 1.5 - 0.5 * sqrt(c7 / (c7 + 6103515625.0::double)) as k from two),
 ch as (select o_orderkey, l1, l2, sqrt(a1 * k * a1 * k + b1 * b1) as c1, sqrt(a2 * k * a2 * k + b2 * b2) as c2, (degrees(atan2(b1, a1 * k)) + 360) % 360 as h1, (degrees(atan2(b2, a2 * k)) + 360) % 360 as h2 from s),
 m as (select *, l2 - l1 as dl, c2 - c1 as dc, (l1 + l2) / 2 as l, (c1 + c2) / 2 as c, case when c1 * c2 = 0 then 0 when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end as turn,
   case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as h from ch),
 w as (select *, 2 * sqrt(c1 * c2) * sin(radians(turn) / 2) as dh, 1 - 0.17 * cos(radians(h - 30)) + 0.24 * cos(radians(2 * h)) + 0.32 * cos(radians(3 * h + 6)) - 0.20 * cos(radians(4 * h - 63)) as t, pow(l - 50, 2) as off, pow(c, 7) as m7 from m),
 e as (select o_orderkey, dl / (1 + 0.015 * off / sqrt(20 + off)) as x, dc / (1 + 0.045 * c) as y, dh / (1 + 0.015 * c * t) as z, -sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) * 2 * sqrt(m7 / (m7 + 6103515625.0::double)) as rt from w)
 select o_orderkey, round(greatest(0, 1 - sqrt(greatest(0, x * x + y * y + z * z + rt * y * z)) / 100), 6) as similarity from e"""


@query("prj26_colour_similarity", COLOUR_SQL)
def prj26(spark, d):
    """CIEDE2000 similarity of two colours taken from each customer's order numbers."""
    k = F.col("o_custkey")
    one, two = (k % 256, (k * 3) % 256, (k * 7) % 256), ((k * 5) % 256, (k * 11) % 256, (k * 13) % 256)
    return S.read(spark, d, "orders").select("o_orderkey", F.round(G.ciede2000_similarity(one, two), 6).alias("similarity"))


@query("prj27_rotate", f"with {V.ELEMENTS} select page_id, element_id, 900 - b as l, l as t, 900 - t as r, r as b from elements")
def prj27(spark, d):
    return S.elements(spark, d).select("page_id", "element_id", *G.rotate(True, F.lit(W), F.lit(H)))


@query("prj28_percent_geometry", f"with {V.ELEMENTS}, {V.NODES} select c.page_id, c.node_id, round((c.l - p.l) * 100 / (p.r - p.l)::double, 6) as left_pct, round((c.t - p.t) * 100 / (p.b - p.t)::double, 6) as top_pct, round((c.r - c.l) * 100 / (p.r - p.l)::double, 6) as width_pct, round((c.b - c.t) * 100 / (p.b - p.t)::double, 6) as height_pct from nodes c join nodes p on c.page_id = p.page_id and c.parent_id = p.node_id")
def prj28(spark, d):
    return _kin(spark, d).select("page_id", F.col("c_node_id").alias("node_id"), *G.percent_of("c_", "p_"))


def _kin(spark, d):
    n = S.nodes(S.elements(spark, d))
    c = P.prefixed(n, "c_").withColumn("key", F.col("c_parent_id"))
    p = P.prefixed(n, "p_").withColumn("key", F.col("p_node_id"))
    return c.join(p, ["page_id", "key"])


@query("prj31_context", f"with {V.ELEMENTS}, c as (select page_id, uied_class, count(*) as n from elements group by all) select page_id, 'elements=' || cast(sum(n) as bigint) || '; classes=' || array_to_string(list(uied_class || ': ' || n order by uied_class), ', ') as context from c group by page_id")
def prj31(spark, d):
    """The element and class counts of a page as the text a prompt carries."""
    c = S.elements(spark, d).groupBy("page_id", "uied_class").agg(F.count("*").alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uied_class", "n"))), lambda x: F.concat(x["uied_class"], F.lit(": "), x["n"])), ", ")
    return c.groupBy("page_id").agg(F.concat(F.lit("elements="), F.sum("n"), F.lit("; classes="), parts).alias("context"))


@query("agg17_class_counts", f"with {V.ELEMENTS} select page_id, count(*) filter (uied_class = 'Text') as texts, count(*) filter (uied_class = 'Compo') as compos, count(*) filter (uied_class = 'Block') as blocks from elements group by 1")
def agg17(spark, d):
    n = lambda c: F.count_if(F.col("uied_class") == c)
    return S.elements(spark, d).groupBy("page_id").agg(n("Text").alias("texts"), n("Compo").alias("compos"), n("Block").alias("blocks"))


@query("agg09_group_box", f"with {V.ELEMENTS} select page_id, uied_class, min(l) as l, min(t) as t, max(r) as r, max(b) as b from elements group by 1, 2")
def agg09(spark, d):
    return S.elements(spark, d).groupBy("page_id", "uied_class").agg(*(F.min(c).alias(c) for c in "lt"), *(F.max(c).alias(c) for c in "rb"))


@query("agg08_spread", f"with {V.ELEMENTS} select page_id, round(least(1, (max((l + r) / 2.0::double) - min((l + r) / 2.0::double)) / 1200), 6) as spread from elements group by 1")
def agg08(spark, d):
    return S.elements(spark, d).groupBy("page_id").agg(G.clamp01((F.max(G.center_x()) - F.min(G.center_x())) / W).alias("spread"))


@query("agg02_text_lines", f"""with {V.ELEMENTS}, m as (select page_id, greatest(2, quantile_cont(b - t, 0.5) * 0.6) as step from elements where uied_class = 'Text' group by 1),
    x as (select page_id, (t + b) / 2.0::double as cy, lag((t + b) / 2.0::double) over (partition by page_id order by t + b) as p from elements where uied_class = 'Text')
    select x.page_id, cast(count(*) filter (p is null or cy - p > step) as int) as text_lines from x join m on x.page_id = m.page_id group by 1""")
def agg02(spark, d):
    return P.text_lines(S.elements(spark, d))


@query("win01_projection_intervals", f"with {V.ELEMENTS}, {V.INTERVALS} select * from intervals")
def win01(spark, d):
    return P.projection(S.elements(spark, d))


@query("win02_gaps", f"with {V.ELEMENTS}, {V.GAPS} select * from gaps")
def win02(spark, d):
    return P.gaps(P.projection(S.elements(spark, d)), ["page_id", "axis"], 8)


@query("flt08_wide_gaps", f"with {V.ELEMENTS}, {V.GAPS} select page_id, count(*) as n from gaps where size >= 40 group by 1")
def flt08(spark, d):
    return P.gaps(P.projection(S.elements(spark, d)), ["page_id", "axis"], 40).groupBy("page_id").agg(F.count("*").alias("n"))


@query("srt01_ranked_gaps", f"with {V.ELEMENTS}, {V.GAPS} select *, cast(row_number() over (partition by page_id order by size desc, case axis when 'y' then 0 else 1 end, gap_start, gap_end) as int) as rank from gaps")
def srt01(spark, d):
    return P.ranked_gaps(P.gaps(P.projection(S.elements(spark, d)), ["page_id", "axis"], 8))


@query("hlp02_best_gap", f"with {V.ELEMENTS}, {V.GAPS} select page_id, axis, cut from (select *, row_number() over (partition by page_id order by size desc, case axis when 'y' then 0 else 1 end, gap_start, gap_end) as k from gaps) where k = 1")
def hlp02(spark, d):
    return P.ranked_gaps(P.gaps(P.projection(S.elements(spark, d)), ["page_id", "axis"], 8)).where("rank = 1").select("page_id", "axis", "cut")


@query("hlp04_midpoints", f"with {V.ELEMENTS} select page_id, element_id, cast(round_even((l + r) / 2.0, 0) as int) as middle from elements")
def hlp04(spark, d):
    return S.elements(spark, d).select("page_id", "element_id", F.rint((F.col("l") + F.col("r")) / 2).cast("int").alias("middle"))


@query("hlp01_region_projection", f"""with {V.ELEMENTS}, c as (select page_id, greatest(l, 300) as lo, least(r, 900) as hi from elements where least(r, 900) > greatest(l, 300) and t < 600 and b > 100),
    m as (select *, max(hi) over (partition by page_id order by lo, hi rows between unbounded preceding and 1 preceding) as m from c), k as (select *, sum(case when m is null or m < lo then 1 else 0 end) over (partition by page_id order by lo, hi rows between unbounded preceding and current row) as run from m)
    select page_id, cast(min(lo) as int) as "start", cast(max(hi) as int) as "end" from k group by page_id, run""")
def hlp01(spark, d):
    """Boxes clipped to a region and merged on the x axis."""
    rows = S.elements(spark, d).where("t < 600 and b > 100").select("page_id", F.greatest("l", F.lit(300)).alias("lo"), F.least("r", F.lit(900)).alias("hi"))
    return P.merged_intervals(rows, ["page_id"], "lo", "hi")


@query("win03_steps", f"with {V.ELEMENTS} select * from (select page_id, element_id, l - lag(l) over (partition by page_id order by l, element_id) as step from elements) where step is not null")
def win03(spark, d):
    order = Window.partitionBy("page_id").orderBy("l", "element_id")
    return S.elements(spark, d).select("page_id", "element_id", (F.col("l") - F.lag("l").over(order)).alias("step")).where("step is not null")


PROFILE = "profile as (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as i, value from events)"


def profile(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return S.read(spark, d, "events").select("user_id", (F.row_number().over(order) - 1).cast("int").alias("i"), "value")


SMOOTH = f"{PROFILE}, smooth as (select *, round(sum(value) over (partition by user_id order by i rows between 2 preceding and 2 following) / 5, 6) as smooth from profile)"
PEAKS = f"{SMOOTH}, near as (select *, lag(smooth) over (partition by user_id order by i) as p, lead(smooth) over (partition by user_id order by i) as n from smooth), peaks as (select user_id, i, smooth from near where smooth > p and smooth >= n)"


@query("win06_smoothed_profile", f"with {SMOOTH} select * from smooth")
def win06(spark, d):
    return P.smoothed(profile(spark, d), ["user_id"], "i", "value")


@query("win07_local_maxima", f"with {PEAKS} select * from peaks")
def win07(spark, d):
    return P.local_maxima(win06(spark, d), ["user_id"], "i", "smooth").select("user_id", "i", "smooth")


@query("srt05_top8", f"with {PEAKS} select * from (select *, cast(row_number() over (partition by user_id order by smooth desc, i) as int) as rank from peaks) where rank <= 8")
def srt05(spark, d):
    return P.top(win07(spark, d), ["user_id"], "smooth", "i", 8)


@query("flt20_sustained_change", f"with {PEAKS}, q as (select user_id, greatest(6, quantile_cont(smooth, 0.92)) as floor_ from smooth group by user_id) select peaks.user_id, i, smooth from peaks join q on peaks.user_id = q.user_id where smooth >= floor_")
def flt20(spark, d):
    s = win06(spark, d)
    floor = s.groupBy("user_id").agg(F.greatest(F.lit(6.0), F.percentile("smooth", 0.92)).alias("floor"))
    return win07(spark, d).join(floor, "user_id").where("smooth >= floor").drop("floor")


@query("win08_window_means", f"with {PROFILE} select user_id, i, round(avg(value) over (partition by user_id order by i rows between 5 preceding and current row), 6) as before, round(avg(value) over (partition by user_id order by i rows between 1 following and 6 following), 6) as after from profile")
def win08(spark, d):
    order = Window.partitionBy("user_id").orderBy("i")
    return profile(spark, d).select("user_id", "i", F.round(F.avg("value").over(order.rowsBetween(-5, 0)), 6).alias("before"), F.round(F.avg("value").over(order.rowsBetween(1, 6)), 6).alias("after"))


@query("jon01_region_elements", f"with {V.ROLES}, {V.REGIONS}, {V.INSIDE} select page_id, region_id, element_id from inside")
def jon01(spark, d):
    e = S.elements(spark, d)
    return P.in_regions(e, P.quadrants(e, W, H)).select("page_id", "region_id", "element_id")


@query("jon02_adjacency", f"with {V.ELEMENTS}, {V.ADJACENT} select page_id, a, b, side from adjacent where side is not null")
def jon02(spark, d):
    return P.adjacency(S.elements(spark, d)).select("page_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), "side")


@query("itr02_gaps", f"with {V.ELEMENTS}, {V.ADJACENT} select page_id, a, b, cast(case side when 'right' then b_l - a_r when 'left' then a_l - b_r when 'bottom' then b_t - a_b else a_t - b_b end as int) as gap from adjacent where side is not null")
def itr02(spark, d):
    return P.adjacency(S.elements(spark, d)).select("page_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), "gap")


@query("jon03_unblocked", f"with {V.ELEMENTS}, {V.UNBLOCKED} select page_id, a, b, side from unblocked")
def jon03(spark, d):
    return P.unblocked(S.elements(spark, d)).select("page_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), "side")


@query("itr01_alignment", f"""with {V.ELEMENTS}, {V.UNBLOCKED}, n as (select *, count(*) over (partition by page_id, a, side) as n, greatest(a_r - a_l, b_r - b_l, a_b - a_t, b_b - b_t) * 0.03::double as tol from unblocked)
    select page_id, a, b, side from n where n = 1 and case when side in ('right', 'left') then abs(a_t - b_t) <= tol and abs(a_b - b_b) <= tol else abs(a_l - b_l) <= tol and abs(a_r - b_r) <= tol end""")
def itr01(spark, d):
    return P.aligned(S.elements(spark, d)).select("page_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), "side")


OWNERS = """owned as (select e.page_id, e.element_id, g.region_id, row_number() over (partition by e.page_id, e.element_id order by
  case when g.l <= (e.l + e.r) / 2.0 and (e.l + e.r) / 2.0 < g.r and g.t <= (e.t + e.b) / 2.0 and (e.t + e.b) / 2.0 < g.b then 0 else 1 end,
  case when g.l <= (e.l + e.r) / 2.0 and (e.l + e.r) / 2.0 < g.r and g.t <= (e.t + e.b) / 2.0 and (e.t + e.b) / 2.0 < g.b then (g.r - g.l) * (g.b - g.t) else -(greatest(0, least(e.r, g.r) - greatest(e.l, g.l)) * greatest(0, least(e.b, g.b) - greatest(e.t, g.t))) end, g.region_id) as k
  from elements e join regions g on e.page_id = g.page_id), owners as (select page_id, element_id, region_id from owned where k = 1)"""


@query("jon05_ownership", f"with {V.ELEMENTS}, {V.REGIONS}, {OWNERS} select * from owners")
def jon05(spark, d):
    e = S.elements(spark, d)
    return P.owners(e, P.quadrants(e, W, H))


@query("agg16_ownership_counts", f"with {V.ELEMENTS}, {V.REGIONS}, {OWNERS} select page_id, region_id, count(*) as owned, count(distinct element_id) as distinct_owned from owners group by 1, 2")
def agg16(spark, d):
    return jon05(spark, d).groupBy("page_id", "region_id").agg(F.count("*").alias("owned"), F.count_distinct("element_id").alias("distinct_owned"))


@query("set02_ownership_coverage", f"with {V.ELEMENTS}, {V.REGIONS}, {OWNERS} select page_id, element_id from elements except all select page_id, element_id from owners")
def set02(spark, d):
    return S.elements(spark, d).select("page_id", "element_id").exceptAll(jon05(spark, d).select("page_id", "element_id"))


@query("hlp10_generation_targets", f"with {V.ELEMENTS}, {V.REGIONS}, {OWNERS} select page_id, region_id from owners group by 1, 2 having count(*) > 0")
def hlp10(spark, d):
    return jon05(spark, d).select("page_id", "region_id").distinct()


@query("jon07_id_lookup", f"with {V.ELEMENTS}, {V.REGIONS}, {OWNERS} select o.page_id, o.region_id, e.element_id, e.uied_class from owners o join elements e on o.page_id = e.page_id and o.element_id = e.element_id")
def jon07(spark, d):
    """Groups hold arrays of element ids; explode and look the elements up."""
    groups = jon05(spark, d).groupBy("page_id", "region_id").agg(F.collect_list("element_id").alias("ids"))
    ids = groups.select("page_id", "region_id", F.explode("ids").alias("element_id"))
    return ids.join(S.elements(spark, d).select("page_id", "element_id", "uied_class"), ["page_id", "element_id"])


@query("jon21_foreground_groups", f"with {V.ROLES}, {V.REGIONS}, {OWNERS} select distinct o.page_id, o.region_id from owners o join roles e on o.page_id = e.page_id and o.element_id = e.element_id where e.role = 'foreground'")
def jon21(spark, d):
    front = P.roles(S.elements(spark, d), W, H).where("role = 'foreground'").select("page_id", "element_id")
    return jon05(spark, d).join(front, ["page_id", "element_id"], "left_semi").select("page_id", "region_id").distinct()


@query("jon09_overlapping", f"with {V.ELEMENTS} select a.page_id, count(*) as pairs from elements a join elements b on a.page_id = b.page_id and a.element_id < b.element_id where {OVER} group by 1")
def jon09(spark, d):
    return P.overlap_pairs(S.elements(spark, d)).groupBy("page_id").agg(F.count("*").alias("pairs"))


@query("flt04_region_members", f"with {V.ELEMENTS} select page_id, element_id from elements where l < 600 and r > 0 and t < 450 and b > 0")
def flt04(spark, d):
    return S.elements(spark, d).where("l < 600 and r > 0 and t < 450 and b > 0").select("page_id", "element_id")


@query("flt07_eligible_lines", f"with {V.LINES} select page_id, direction, position from lines where case when direction = 'vertical' then position > 100 and position < 900 and least(\"end\", 700) - greatest(\"start\", 100) >= 300 else position > 100 and position < 700 and least(\"end\", 900) - greatest(\"start\", 100) >= 400 end")
def flt07(spark, d):
    """Lines inside the region (100, 100, 900, 700) that span at least half of it."""
    v = F.col("direction") == "vertical"
    low, high = F.lit(100), F.when(v, 900).otherwise(700)
    far = F.when(v, 700).otherwise(900)
    span = F.least("end", far) - F.greatest("start", F.lit(100))
    return S.lines(spark, d).where((F.col("position") > low) & (F.col("position") < high) & (span * 2 >= far - 100)).select("page_id", "direction", "position")


@query("flt02_axis_lines", "select l_orderkey, l_partkey, case when abs(l_partkey % 11) <= 3 then 'vertical' else 'horizontal' end as direction from lineitem where (l_partkey % 11 <= 3 and l_quantity * 20 >= 450) or (l_suppkey % 11 <= 3 and l_partkey % 11 > 3 and l_quantity * 24 >= 600)")
def flt02(spark, d):
    """Detected segments that are nearly axis-parallel (3 px of tilt) and long enough (half the axis)."""
    dx, dy, q = F.col("l_partkey") % 11, F.col("l_suppkey") % 11, F.col("l_quantity")
    rows = S.read(spark, d, "lineitem").where(((dx <= 3) & (q * 20 >= H * 0.5)) | ((dy <= 3) & (dx > 3) & (q * 24 >= W * 0.5)))
    return rows.select("l_orderkey", "l_partkey", F.when(dx <= 3, "vertical").otherwise("horizontal").alias("direction"))


@query("flt13_rescale", "select p_partkey, cast(round_even(p_size * 40 * 768.0::double / least(p_size * 40, 600), 0) as int) as long_side from part where p_size * 40 * 768.0::double / least(p_size * 40, 600) <= 2000")
def flt13(spark, d):
    """Images scaled to a short side of 768 whose long side stays within 2000."""
    size = F.col("p_size") * 40
    long = size * 768.0 / F.least(size, F.lit(600))
    return S.read(spark, d, "part").where(long <= 2000).select("p_partkey", F.rint(long).cast("int").alias("long_side"))


@query("flt14_placeholder_share", "select l_orderkey, round(avg((l_partkey % 3 = 0)::int), 6) as share from lineitem group by 1 having avg((l_partkey % 3 = 0)::int) <= 0.65")
def flt14(spark, d):
    """Images in which the placeholder colour fills no more than 65 % of the pixels."""
    blue = F.avg((F.col("l_partkey") % 3 == 0).cast("int"))
    return S.read(spark, d, "lineitem").groupBy("l_orderkey").agg(blue.alias("s")).where("s <= 0.65").select("l_orderkey", F.round("s", 6).alias("share"))


FEATURE_VIEWS = f"{V.ROLES}, {V.LINES}, {V.REGIONS}, {V.FEATURES}"
FEATURE_COLUMNS = "page_id, region_id, position, foreground_count, text_count, nontext_count, container_count, text_ratio, density, largest, container_ratio, repeated_size, horizontal_spread, vertical_spread, horizontal_gap, vertical_gap, repeated_gap, horizontal_separator, vertical_separator, median_text_height, text_line_count"


def features(spark, d):
    e = S.elements(spark, d)
    return P.region_features(e, P.quadrants(e, W, H), S.lines(spark, d), W, H)


@query("agg01_region_features", f"with {FEATURE_VIEWS} select {FEATURE_COLUMNS} from features")
def agg01(spark, d):
    return features(spark, d).select(*FEATURE_COLUMNS.split(", "))


@query("agg03_axis_gaps", f"with {FEATURE_VIEWS} select page_id, region_id, horizontal_gap, vertical_gap from features where horizontal_gap > 0 or vertical_gap > 0")
def agg03(spark, d):
    e = S.elements(spark, d)
    rows = P.gathered(P.in_regions(P.roles(e, W, H), P.quadrants(e, W, H)), W, H)
    return P.axis_gaps(rows).select("page_id", "region_id", "horizontal_gap", "vertical_gap").where("horizontal_gap > 0 or vertical_gap > 0")


@query("agg04_strongest_separators", f"with {FEATURE_VIEWS} select page_id, region_id, horizontal_separator, vertical_separator from sep")
def agg04(spark, d):
    return P.separators(P.quadrants(S.elements(spark, d), W, H), S.lines(spark, d))


@query("agg05_repeated_size", f"with {FEATURE_VIEWS} select page_id, region_id, repeated_size from features")
def agg05(spark, d):
    return features(spark, d).select("page_id", "region_id", "repeated_size")


@query("agg06_repeated_gap", f"with {FEATURE_VIEWS} select page_id, region_id, repeated_gap from gap")
def agg06(spark, d):
    e = S.elements(spark, d)
    rows = P.gathered(P.in_regions(P.roles(e, W, H), P.quadrants(e, W, H)), W, H).where("foreground_count > 0")
    return P.repeated_gaps(rows).select("page_id", "region_id", "repeated_gap")


@query("prj22_classify", f"with {FEATURE_VIEWS}, {V.PROFILES} select page_id, region_id, region_type, cast(floor(confidence * 1000 + 0.001) as int) as confidence_permille from kinds")
def prj22(spark, d):
    return P.classify(features(spark, d)).select("page_id", "region_id", "region_type", F.floor(F.col("confidence") * 1000 + 0.001).cast("int").alias("confidence_permille"))


@query(
    "prj23_reasons",
    f"""with {FEATURE_VIEWS}, {V.PROFILES}, q as (select m.*, region_type, list_filter([case when text_ratio >= 0.6 then 'text_dominant' end, case when largest >= 0.25 then 'large_component' end, case when background_continuity >= 0.7 then 'continuous_background' end,
    case when rep >= 0.65 then 'repeated_layout' end, case when vp >= 0.35 then 'vertical_partition' end, case when hp >= 0.35 then 'horizontal_partition' end], lambda x: x is not null) as f from measured m join kinds using (page_id, region_id))
    select page_id, region_id, array_to_string(list_concat(['page_position:' || position], case when region_type = 'mixed' and len(f) = 0 then ['no_specialized_profile'] else f end), ',') as reasons from q""",
)
def prj23(spark, d):
    return P.reasons(P.classify(features(spark, d))).select("page_id", "region_id", F.array_join("reasons", ",").alias("reasons"))


CROSS_PAGE = "case when ev.direction = 'vertical' then e.l < ev.position and ev.position < e.r and 0 < e.b and 900 > e.t else e.t < ev.position and ev.position < e.b and 0 < e.r and 1200 > e.l end"
SIDE = "case when ev.direction = 'vertical' then (l + r) / 2.0 else (t + b) / 2.0 end < ev.position"
BIG = "((r - l) * (b - t))::double / 1080000 >= 0.07"
#: A page has one line at most, and gaps' middles lie further apart than evidence joins, so joining is one outer join here.
CANDIDATES = f"""{V.ROLES}, {V.LINES}, fronts as (select * from roles where role = 'foreground'), {V.GAPS.replace("from elements", "from fronts")},
 spaces as (select page_id, case axis when 'y' then 'horizontal' else 'vertical' end as direction, cut as position, size as gap from gaps),
 whole as (select page_id, direction, position from lines where position > 0 and position < case direction when 'vertical' then 1200 else 900 end and page_id in (select page_id from elements)),
 ev as (select w.page_id, w.direction, w.position, case when s.page_id is null then ['lsd'] else ['lsd', 'whitespace'] end as sources, coalesce(s.gap, 0) as gap
   from whole w left join spaces s on s.page_id = w.page_id and s.direction = w.direction and abs(s.position - w.position) <= 4
   union all select page_id, direction, position, ['whitespace'], gap from spaces s where not exists (select 1 from whole w where s.page_id = w.page_id and s.direction = w.direction and abs(s.position - w.position) <= 4)),
 runs_of as (select page_id, median(b - t) filter (uied_class = 'Text') as tall, median(r - l) filter (uied_class = 'Text') as wide, max((l + r) / 2.0::double) filter (uied_class = 'Text') - min((l + r) / 2.0::double) filter (uied_class = 'Text') as across,
   max((t + b) / 2.0::double) filter (uied_class = 'Text') - min((t + b) / 2.0::double) filter (uied_class = 'Text') as down, count(*) filter (uied_class = 'Text') as texts,
   count(*) filter (role = 'foreground' and uied_class <> 'Text' and greatest(r - l, b - t) > 48) as big from roles group by page_id),
 ways as (select page_id, across <= 420 and down >= 2 * tall as v, down <= 315 and across >= 2 * wide as h, down / 900 >= across / 1200 as longer from runs_of where texts >= 2 and big = 0 and tall <= 96),
 axes as (select page_id, case when v and (not h or longer) then 'vertical' when h then 'horizontal' end as axis from ways where v or h),
 c as (select ev.page_id, ev.direction, ev.position, ev.sources, ev.gap, count(*) filter (role = 'foreground' and {SIDE}) as before, count(*) filter (role = 'foreground' and not {SIDE}) as after,
   count(*) filter ((role = 'foreground' or {BIG}) and {SIDE}) as content_before, count(*) filter ((role = 'foreground' or {BIG}) and not {SIDE}) as content_after,
   count(*) filter (role = 'foreground' and {CROSS_PAGE}) as cut_foreground, count(*) filter (role <> 'foreground' and {CROSS_PAGE}) as cut_other,
   case when list_contains(ev.sources, 'lsd') then 0 else count(*) filter ({BIG} and {CROSS_PAGE}) end as cut_large, max(case ev.direction when 'vertical' then 1200 else 900 end) as extent
   from ev join roles e on e.page_id = ev.page_id group by ev.page_id, ev.direction, ev.position, ev.sources, ev.gap),
 s as (select *, round((case when list_contains(sources, 'lsd') then 0.72::double else 0.0::double end + case when list_contains(sources, 'whitespace') then 0.42::double else 0.0::double end) + least(0.28::double, gap / extent::double * 2)
   + least(content_before, content_after) / greatest(1, content_before, content_after)::double * 0.34::double + least(position, extent - position) / greatest(1, position, extent - position)::double * 0.16::double
   - (cut_foreground / greatest(1, before + after)::double * 1.35::double + cut_foreground * 0.08::double + least(0.12::double, cut_other * 0.015::double)), 6) as score from c),
 f as (select s.*, list_filter([case when least(position, extent - position) < 10 then 'child_too_small' end, case when before + after < 2 then 'insufficient_foreground' end, case when content_before = 0 or content_after = 0 then 'empty_foreground_child' end,
   case when axis <> direction and not list_contains(sources, 'lsd') then 'semantic_text_run' end, case when score < 0.45 then 'score_below_threshold' end], lambda x: x is not null) as why from s left join axes using (page_id))"""
OUTRANKS = "(o.score, len(o.sources), o.gap, -o.position) > (x.score, len(x.sources), x.gap, -x.position)"
#: Only a line and the gaps beside it can be within eight pixels of each other.
APART = f"""{CANDIDATES}, kept_lines as (select x.* from f x where list_contains(x.sources, 'lsd') and not exists (select 1 from f o where o.page_id = x.page_id and o.direction = x.direction and o.position <> x.position and abs(o.position - x.position) < 8 and {OUTRANKS})),
 kept as (select * from kept_lines union all select x.* from f x where not list_contains(x.sources, 'lsd') and not exists (select 1 from kept_lines o where o.page_id = x.page_id and o.direction = x.direction and abs(o.position - x.position) < 8 and {OUTRANKS}))"""


def candidates(spark, d):
    return P.candidate_scores(S.elements(spark, d), S.lines(spark, d), W, H)


@query("agg11_candidate_score", f"with {CANDIDATES} select page_id, direction, position, array_to_string(sources, ',') as sources, cast(gap as int) as gap, before, after, content_before, content_after, cut_foreground, cut_other, cut_large, score from f")
def agg11(spark, d):
    return candidates(spark, d).select("page_id", "direction", "position", F.array_join("sources", ",").alias("sources"), "gap", "before", "after", "content_before", "content_after", "cut_foreground", "cut_other", "cut_large", "score")


@query("flt05_rejections", f"with {CANDIDATES} select page_id, direction, position, array_to_string(why, ',') as reasons, len(why) = 0 as accepted from f")
def flt05(spark, d):
    return candidates(spark, d).select("page_id", "direction", "position", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("prj30_candidate_key", f"with {V.LINES} select page_id, md5(direction || ':' || position) as key from lines")
def prj30(spark, d):
    return S.lines(spark, d).select("page_id", F.md5(F.concat_ws(":", "direction", "position")).alias("key"))


@query("jon17_new_candidates", f"with {CANDIDATES} select page_id, direction, position from lines l where not exists (select 1 from f where f.page_id = l.page_id and f.direction = l.direction and f.position = l.position and len(why) = 0)")
def jon17(spark, d):
    known = candidates(spark, d).where("accepted")
    return S.lines(spark, d).join(known, ["page_id", "direction", "position"], "left_anti").select("page_id", "direction", "position")


@query("hlp06_mark_selected", f"with {CANDIDATES} select l.page_id, l.direction, l.position, f.page_id is not null as selected from lines l left join f on f.page_id = l.page_id and f.direction = l.direction and f.position = l.position and len(why) = 0")
def hlp06(spark, d):
    known = candidates(spark, d).where("accepted").select("page_id", "direction", "position", F.lit(True).alias("s"))
    return S.lines(spark, d).join(known, ["page_id", "direction", "position"], "left").select("page_id", "direction", "position", F.coalesce("s", F.lit(False)).alias("selected"))


def _by_final():
    return Window.partitionBy("page_id").orderBy(F.desc("final"), "direction", *P.candidate_order()[1:])


BY_FINAL = "order by final desc, direction, len(sources) desc, gap desc, position"
#: A search under the policy of regions of two columns.
DECISIONS = f"{APART}, decided as (select *, round(score + case direction when 'vertical' then 0.5::double else 0.0::double end - case when cut_large > 0 then 0.8::double else 0.0::double end, 6) as final from kept)"


@query("srt02_decisions", f"with {DECISIONS} select page_id, direction, position, final, cast(row_number() over (partition by page_id {BY_FINAL}) as int) as place from decided")
def srt02(spark, d):
    """Each page's decisions, the best first."""
    rows = P.decisions(P.apart(candidates(spark, d)), L.POLICIES["two_column"])
    return rows.select("page_id", "direction", "position", "final", F.row_number().over(_by_final()).cast("int").alias("place"))


@query("srt03_best_per_axis", f"with {DECISIONS} select page_id, direction, position, final from (select *, row_number() over (partition by page_id, direction order by final desc, score desc, len(sources) desc, gap desc, position) as k from decided) where k = 1")
def srt03(spark, d):
    """The best decision of each page and axis; of equal ones the one that ranked first as a candidate."""
    rows = P.decisions(P.apart(candidates(spark, d)), L.POLICIES["two_column"])
    first = F.row_number().over(Window.partitionBy("page_id", "direction").orderBy(F.desc("final"), *P.candidate_order()))
    return rows.withColumn("k", first).where("k = 1").select("page_id", "direction", "position", "final")


@query("jon22_sibling_overlap", f"with {V.ELEMENTS}, {V.NODES} select a.page_id, a.node_id as a, b.node_id as b from nodes a join nodes b on a.page_id = b.page_id and a.parent_id = b.parent_id and a.ordinal < b.ordinal where {OVER}")
def jon22(spark, d):
    n = S.nodes(S.elements(spark, d)).where("parent_id is not null")
    a, b = P.prefixed(n, "a_", ("page_id", "parent_id")), P.prefixed(n, "b_", ("page_id", "parent_id"))
    return a.join(b, ["page_id", "parent_id"]).where((F.col("a_ordinal") < F.col("b_ordinal")) & G.overlaps("a_", "b_")).select("page_id", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"))


@query("jon23_containment", f"with {V.ELEMENTS}, {V.NODES} select c.page_id, c.node_id, p.l <= c.l and p.t <= c.t and p.r >= c.r and p.b >= c.b as inside from nodes c join nodes p on c.page_id = p.page_id and c.parent_id = p.node_id")
def jon23(spark, d):
    inside = (F.col("p_l") <= F.col("c_l")) & (F.col("p_t") <= F.col("c_t")) & (F.col("p_r") >= F.col("c_r")) & (F.col("p_b") >= F.col("c_b"))
    return _kin(spark, d).select("page_id", F.col("c_node_id").alias("node_id"), inside.alias("inside"))


@query("jon20_parents", f"with {V.ELEMENTS}, {V.NODES} select c.page_id, c.node_id, p.layout_type as parent_type from nodes c join nodes p on c.page_id = p.page_id and c.parent_id = p.node_id where c.layout_type = 'atomic'")
def jon20(spark, d):
    return _kin(spark, d).where("c_layout_type = 'atomic'").select("page_id", F.col("c_node_id").alias("node_id"), F.col("p_layout_type").alias("parent_type"))


@query("jon24_boundary_atomics", f"with {V.ELEMENTS}, {V.LINES} select page_id, element_id from elements e where exists (select 1 from lines where lines.page_id = e.page_id and direction = 'vertical' and position > e.l and position < e.r)")
def jon24(spark, d):
    v = S.lines(spark, d).where("direction = 'vertical'").select(F.col("page_id").alias("p"), "position")
    return S.elements(spark, d).join(v, (F.col("page_id") == F.col("p")) & (F.col("position") > F.col("l")) & (F.col("position") < F.col("r")), "left_semi").select("page_id", "element_id")


@query("jon08_leaf_profiles", f"with {FEATURE_VIEWS}, {V.PROFILES} select g.page_id, g.region_id, k.region_type from regions g left join kinds k using (page_id, region_id)")
def jon08(spark, d):
    regions = P.quadrants(S.elements(spark, d), W, H)
    return regions.join(prj22(spark, d), ["page_id", "region_id"], "left").select("page_id", "region_id", "region_type")


@query("agg25_tree_stats", f"with {V.ELEMENTS}, {V.NODES} select page_id, count(*) filter (layout_type = 'atomic') as leaf_count, cast(max(case when parent_id is null then 0 else 1 end) as int) + 1 as tree_depth from nodes group by 1")
def agg25(spark, d):
    n = S.nodes(S.elements(spark, d))
    return n.groupBy("page_id").agg(F.count_if(F.col("layout_type") == "atomic").alias("leaf_count"), (F.max(F.when(F.col("parent_id").isNull(), 0).otherwise(1)) + 1).alias("tree_depth"))


@query("agg14_under_segmentation", f"with {FEATURE_VIEWS}, n as (select page_id, region_id, count(*) as n from inside group by 1, 2) select page_id, region_id, round(least(1, greatest(horizontal_gap, vertical_gap, horizontal_separator, vertical_separator) * least(1, n / 8.0::double)), 9) as under from n join features using (page_id, region_id) where n >= 4")
def agg14(spark, d):
    """How much a decided leaf of four elements or more should have been cut: its strongest partition by its elements."""
    c = F.col
    rows = features(spark, d).withColumn("n", c("foreground_count") + c("container_count")).where("n >= 4")
    strongest = F.greatest("horizontal_gap", "vertical_gap", "horizontal_separator", "vertical_separator", "horizontal_transition", "vertical_transition")
    return rows.select("page_id", "region_id", F.round(F.least(F.lit(1.0), strongest * F.least(F.lit(1.0), c("n") / 8)), 9).alias("under"))


@query(
    "agg15_validation",
    f"""with {V.ROLES}, {V.NODES}, roots as (select page_id, ((r - l) * (b - t))::double as page_area, greatest(96, round_even((b - t) * 0.035, 0)) as thin from nodes where parent_id is null),
    kin as (select c.page_id, p.l > c.l or p.t > c.t or p.r < c.r or p.b < c.b as escapes, coalesce(lag(case p.layout_type when 'row' then c.l when 'column' then c.t end) over (partition by c.page_id, c.parent_id order by c.ordinal) > case p.layout_type when 'row' then c.l when 'column' then c.t end, false) as late
      from nodes c join nodes p on c.page_id = p.page_id and c.parent_id = p.node_id),
    shape as (select page_id, count(*) filter (escapes) as escapes, count(*) filter (late) as disordered from kin group by 1),
    crossing as (select a.page_id, count(*) as crossings from nodes a join nodes b on a.page_id = b.page_id and a.parent_id = b.parent_id and a.ordinal < b.ordinal where {OVER} group by 1),
    leaves as (select e.page_id, page_area, thin, uied_class = 'Text' as is_text, e.r - e.l as w, e.b - e.t as h, ((e.r - e.l) * (e.b - e.t)) / page_area as share from roles e join roots using (page_id)),
    m as (select page_id, count(*) as atomic_count, round(1 / count(*)::double, 6) as largest_ratio, round(count(*) filter (is_text and h <= thin) / count(*)::double, 6) as thin_text_ratio, round(1.0::double, 6) as single_ratio, 0.0::double as empty_ratio,
      round(count(*) filter (case when is_text then h <= thin and share < 0.03 else share < 0.04 and greatest(w, h) <= 48 end) / count(*)::double, 6) as small_single_ratio, greatest(0, count(*) filter (w * h * 2 >= page_area) - 1) as page_scale,
      count(*) filter (not is_text and greatest(w, h) <= 48) as icon_only, count(*) as owned_element_count, cast(0 as bigint) as owned_twice from leaves group by 1)
    select m.*, coalesce(escapes, 0) as escapes, coalesce(disordered, 0) as disordered, coalesce(crossings, 0) as crossings,
      not (coalesce(escapes, 0) + coalesce(disordered, 0) + coalesce(crossings, 0) + page_scale + icon_only > 0 or thin_text_ratio > 0.4 or small_single_ratio > 0.45) as passed
    from m left join shape using (page_id) left join crossing using (page_id)""",
)
def agg15(spark, d):
    """Measures and broken rules of node tables whose leaves own one element each."""
    e = S.elements(spark, d)
    return P.structure_measures(S.nodes(e), e.withColumn("node_id", F.col("element_id") + 1))


@query("hlp05_cluster_test", f"with {V.ELEMENTS} select a.page_id, count(*) filter ((e.l + e.r) / 2.0 >= a.l and (e.l + e.r) / 2.0 <= a.r) as same_column from elements e join elements a on a.page_id = e.page_id and a.element_id = 0 group by 1")
def hlp05(spark, d):
    """Elements whose centre lies in the span of their page's first element."""
    e = S.elements(spark, d)
    first = P.prefixed(e.where("element_id = 0"), "f_")
    return e.join(first, "page_id").groupBy("page_id").agg(F.count_if((G.center_x() >= F.col("f_l")) & (G.center_x() <= F.col("f_r"))).alias("same_column"))


@query("hlp18_crop", f"with {V.ELEMENTS} select page_id, element_id, greatest(l, 100) - 100 as x, greatest(t, 100) - 100 as y from elements where r > 100 and b > 100 and l < 700 and t < 500")
def hlp18(spark, d):
    return S.elements(spark, d).where("r > 100 and b > 100 and l < 700 and t < 500").select("page_id", "element_id", (F.greatest("l", F.lit(100)) - 100).alias("x"), (F.greatest("t", F.lit(100)) - 100).alias("y"))


@query("hlp15_channel_similarity", "select o_orderkey, abs(o_custkey % 256 - (o_custkey * 3) % 256) <= 8 as alike, upper(hex(o_custkey % 256)) as hex from orders")
def hlp15(spark, d):
    c = F.col("o_custkey")
    return S.read(spark, d, "orders").select("o_orderkey", (F.abs(c % 256 - (c * 3) % 256) <= 8).alias("alike"), F.hex(c % 256).alias("hex"))


@query("agg39_colour_boxes", f"with {V.ELEMENTS} select page_id, uied_class as colour, min(l) as l, min(t) as t, max(r) - 1 as r, max(b) - 1 as b from elements group by 1, 2")
def agg39(spark, d):
    """The box of all pixels of one colour, from runs of pixels."""
    return S.elements(spark, d).groupBy("page_id", F.col("uied_class").alias("colour")).agg(F.min("l").alias("l"), F.min("t").alias("t"), (F.max("r") - 1).alias("r"), (F.max("b") - 1).alias("b"))


@query("jon25_pixel_intersection", "select a.l_orderkey, a.l_linenumber, count(*) as n from lineitem a join orders o on a.l_orderkey = o.o_orderkey where a.l_partkey % 5 = o.o_custkey % 5 group by 1, 2")
def jon25(spark, d):
    """Coordinates where two images agree: an equi-join on the coordinate, filtered on the value."""
    a = S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return a.join(b, "l_orderkey").where("l_partkey % 5 = o_custkey % 5").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("set06_group_union", f"with {V.ELEMENTS} select page_id, element_id, cast(row_number() over (partition by page_id order by case when uied_class = 'Text' then 0 else 1 end, element_id) - 1 as int) as group_id from elements")
def set06(spark, d):
    """Text groups, then the others, renumbered."""
    e = S.elements(spark, d).select("page_id", "element_id", "uied_class")
    both = e.where("uied_class = 'Text'").withColumn("k", F.lit(0)).unionByName(e.where("uied_class != 'Text'").withColumn("k", F.lit(1)))
    return both.select("page_id", "element_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("k", "element_id")) - 1).cast("int").alias("group_id"))


@query("snk03_ownership_payload", f"with {V.ELEMENTS}, {V.NODES} select page_id, node_id, l, t, r, b from nodes where layout_type = 'atomic'")
def snk03(spark, d):
    return S.nodes(S.elements(spark, d)).where("layout_type = 'atomic'").select("page_id", "node_id", "l", "t", "r", "b")
