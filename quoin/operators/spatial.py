"""Joins, windows and aggregates over boxes, lines and nodes, page_id being the key of every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.sources import scratch

R6 = lambda c: F.round(c, 6)
BOX = ("l", "t", "r", "b")


def prefixed(rows: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All columns but keep renamed with the prefix."""
    return rows.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns))


def overlap_pairs(boxes: DataFrame) -> DataFrame:
    """Overlapping boxes of a page, the smaller id first: a, b, common area, iou, shares."""
    a, b = prefixed(boxes, "a_"), prefixed(boxes, "b_")
    pairs = a.join(b, "page_id").where((F.col("a_element_id") < F.col("b_element_id")) & G.overlaps("a_", "b_"))
    return pairs.select(
        "page_id",
        F.col("a_element_id").alias("a"),
        F.col("b_element_id").alias("b"),
        G.intersection("a_", "b_").alias("common"),
        G.iou("a_", "b_").alias("iou"),
        G.share_of("a_", "b_").alias("ioa"),
        G.share_of("b_", "a_").alias("iob"),
    )


def in_regions(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes with positive common area with a region of their page; regions has region_id and a box."""
    r = prefixed(regions, "g_", ("page_id", "region_id"))
    return boxes.join(r, "page_id").where(G.overlaps("", "g_"))


def quadrants(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Four regions of every page."""
    w, h = width // 2, height // 2
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("region_id", *BOX), (i, x, y, x + w, y + h), strict=True))) for i, (x, y) in enumerate(((0, 0), (w, 0), (0, h), (w, h)))))
    return boxes.select("page_id").distinct().select("page_id", F.inline(cells))


def adjacency(boxes: DataFrame) -> DataFrame:
    """a, b, side: b lies on that side of a and shares a band with it. side is of a: right, left, bottom, top."""
    a, b = prefixed(boxes, "a_"), prefixed(boxes, "b_")
    rows = (F.col("a_t") < F.col("b_b")) & (F.col("b_t") < F.col("a_b"))
    columns = (F.col("a_l") < F.col("b_r")) & (F.col("b_l") < F.col("a_r"))
    side = (
        F.when(rows & (F.col("a_r") <= F.col("b_l")), "right")
        .when(rows & (F.col("b_r") <= F.col("a_l")), "left")
        .when(columns & (F.col("a_b") <= F.col("b_t")), "bottom")
        .when(columns & (F.col("b_b") <= F.col("a_t")), "top")
    )
    pairs = a.join(b, "page_id").where("a_element_id != b_element_id").withColumn("side", side).where("side is not null")
    gap = F.when(F.col("side") == "right", F.col("b_l") - F.col("a_r")).when(F.col("side") == "left", F.col("a_l") - F.col("b_r")).when(F.col("side") == "bottom", F.col("b_t") - F.col("a_b")).otherwise(F.col("a_t") - F.col("b_b"))
    return pairs.withColumn("gap", gap.cast("int"))


def unblocked(boxes: DataFrame) -> DataFrame:
    """Adjacent pairs with no third box of the page between them in their shared band."""
    pairs = adjacency(boxes)
    c = prefixed(boxes, "c_", ("page_id",)).withColumnRenamed("page_id", "c_page")
    across = F.col("side").isin("right", "left")
    low = F.when(across, F.greatest("a_t", "b_t")).otherwise(F.greatest("a_l", "b_l"))
    high = F.when(across, F.least("a_b", "b_b")).otherwise(F.least("a_r", "b_r"))
    c_low, c_high = F.when(across, F.col("c_t")).otherwise(F.col("c_l")), F.when(across, F.col("c_b")).otherwise(F.col("c_r"))
    between = (
        F.when(F.col("side") == "right", (F.col("c_l") >= F.col("a_r")) & (F.col("c_l") < F.col("b_l")))
        .when(F.col("side") == "left", (F.col("c_r") <= F.col("a_l")) & (F.col("c_r") > F.col("b_r")))
        .when(F.col("side") == "bottom", (F.col("c_t") >= F.col("a_b")) & (F.col("c_t") < F.col("b_t")))
        .otherwise((F.col("c_b") <= F.col("a_t")) & (F.col("c_b") > F.col("b_b")))
    )
    other = ~F.col("c_element_id").isin(F.col("a_element_id")) & (F.col("c_element_id") != F.col("b_element_id"))
    return pairs.join(c, (F.col("page_id") == F.col("c_page")) & other & (c_low < high) & (c_high > low) & between, "left_anti")


def aligned(boxes: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Unblocked neighbours that are the only one on their side and whose edges along that side agree.

    Edges agree within tolerance of the larger side of the two boxes.
    """
    pairs = unblocked(boxes)
    only = Window.partitionBy("page_id", "a_element_id", "side")
    across = F.col("side").isin("right", "left")
    longest = F.greatest(*(G.width(p) for p in ("a_", "b_")), *(G.height(p) for p in ("a_", "b_")))
    d1 = F.when(across, F.abs(F.col("a_t") - F.col("b_t"))).otherwise(F.abs(F.col("a_l") - F.col("b_l")))
    d2 = F.when(across, F.abs(F.col("a_b") - F.col("b_b"))).otherwise(F.abs(F.col("a_r") - F.col("b_r")))
    return pairs.withColumn("neighbours", F.count("*").over(only)).where((F.col("neighbours") == 1) & (d1 <= longest * tolerance) & (d2 <= longest * tolerance))


def crossings(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with the ids, in order, of the boxes they cut."""
    cut = boxes.join(lines, "page_id").where(G.crosses(F.col("direction"), F.col("position"), F.col("start"), F.col("end")))
    return cut.groupBy("page_id", "direction", "position").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("element_id")), ",").alias("element_ids"))


def uncrossed(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Groups that no separator line of their page crosses."""
    cut = lines.withColumnRenamed("page_id", "line_page")
    return groups.join(cut, (F.col("page_id") == F.col("line_page")) & G.crosses(F.col("direction"), F.col("position"), F.col("start"), F.col("end")), "left_anti")


def owners(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Each box's region: the smallest that holds its centre, else the one with most common area, else the first.

    One bounded partial aggregate instead of a ranking window.
    """
    r = prefixed(regions, "g_", ("page_id", "region_id"))
    x, y = G.center_x(), G.center_y()
    inside = (F.col("g_l") <= x) & (x < F.col("g_r")) & (F.col("g_t") <= y) & (y < F.col("g_b"))
    rank = F.struct(
        F.when(inside, 0).otherwise(1).alias("k"),
        F.when(inside, G.area("g_")).otherwise(-G.intersection("", "g_")).alias("v"),
        F.col("region_id").alias("region_id"),
    )
    return boxes.join(r, "page_id").groupBy("page_id", "element_id").agg(F.min(rank).alias("best")).select("page_id", "element_id", F.col("best.region_id").alias("region_id"))


def merged_intervals(rows: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Union of intervals for each key; touching ones coalesce."""
    order = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.where(F.col(high) > F.col(low)).withColumn("__new", F.when(reach.isNull() | (reach < F.col(low)), 1).otherwise(0))
    runs = opens.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run").agg(F.min(low).cast("int").alias("start"), F.max(high).cast("int").alias("end")).drop("__run")


def projection(boxes: DataFrame) -> DataFrame:
    """Merged intervals of every page on both axes: page_id, axis, start, end."""
    both = boxes.select("page_id", F.inline(F.array(F.struct(F.lit("x").alias("axis"), F.col("l").alias("lo"), F.col("r").alias("hi")), F.struct(F.lit("y").alias("axis"), F.col("t").alias("lo"), F.col("b").alias("hi")))))
    return merged_intervals(both, ["page_id", "axis"], "lo", "hi")


def gaps(intervals: DataFrame, by: list[str], least: int) -> DataFrame:
    """Inner gaps between merged intervals, their size and their middle rounded half to even."""
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    rows = intervals.withColumn("gap_end", nxt).where(F.col("gap_end") - F.col("end") >= least)
    return rows.select(*by, F.col("end").alias("gap_start"), "gap_end", (F.col("gap_end") - F.col("end")).cast("int").alias("size"), F.rint((F.col("end") + F.col("gap_end")) / 2).cast("int").alias("cut"))


def ranked_gaps(rows: DataFrame) -> DataFrame:
    """Gaps of a page by size, y before x, then by place."""
    order = Window.partitionBy("page_id").orderBy(F.desc("size"), F.when(F.col("axis") == "y", 0).otherwise(1), "gap_start", "gap_end")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def clipped(boxes: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """Boxes clamped to the image, small ones dropped, renumbered by top, left, bottom, right, id."""
    w, h = F.lit(width), F.lit(height)
    cut = boxes.select("page_id", F.col("element_id").alias("old_id"), G.clip(F.col("l"), w).alias("l"), G.clip(F.col("t"), h).alias("t"), G.clip(F.col("r"), w).alias("r"), G.clip(F.col("b"), h).alias("b"))
    kept = cut.where((G.width() >= least) & (G.height() >= least))
    order = Window.partitionBy("page_id").orderBy("t", "l", "b", "r", "old_id")
    return kept.withColumn("element_id", (F.row_number().over(order) - 1).cast("int"))


def text_lines(boxes: DataFrame) -> DataFrame:
    """Distinct text lines of a page: breaks where centres differ by more than 0.6 of the median height, 2 at least."""
    texts = boxes.where("uied_class = 'Text'").withColumn("cy", G.center_y())
    height = texts.groupBy("page_id").agg(F.greatest(F.lit(2.0), F.percentile(G.height(), 0.5) * 0.6).alias("step"))
    before = F.lag("cy").over(Window.partitionBy("page_id").orderBy("cy"))
    rows = texts.join(height, "page_id").withColumn("new", F.when(before.isNull() | (F.col("cy") - before > F.col("step")), 1).otherwise(0))
    return rows.groupBy("page_id").agg(F.sum("new").cast("int").alias("text_lines"))


KEY = ("page_id", "region_id")


def roles(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return boxes.withColumn("role", G.role(F.col("uied_class"), F.lit(None).cast("string"), F.lit(width), F.lit(height)))


def gathered(rows: DataFrame, page_width: int, page_height: int) -> DataFrame:
    """Counts and shares of the boxes of every region, and its foreground boxes and texts as arrays: one shuffle.

    A region's boxes are bounded by its page's.
    """
    own = F.max(F.greatest(F.lit(1), G.area("g_", True)).cast("double"))
    common = G.intersection("", "g_").cast("double")
    front, text = F.col("role") == "foreground", F.col("uied_class") == "Text"
    w, h = F.max(F.greatest(F.lit(1), G.width("g_"))), F.max(F.greatest(F.lit(1), G.height("g_")))
    share = lambda x: G.clamp01(F.coalesce(x, F.lit(0.0)) / own)
    fronts = F.array_sort(F.collect_list(F.when(front, F.struct("t", "l", "element_id", "r", "b"))))
    texts = F.collect_list(F.when(front & text, F.struct(G.center_x().alias("x"), G.center_y().alias("y"), G.height().cast("double").alias("h"))))
    return rows.groupBy(*KEY).agg(
        G.clamp01(w / page_width).alias("width_ratio"),
        G.clamp01(h / page_height).alias("height_ratio"),
        G.clamp01(w * h / (page_width * page_height)).alias("page_area"),
        F.max(F.when(G.center_y("g_") / page_height <= 0.2, "header").when(G.center_y("g_") / page_height >= 0.82, "footer").otherwise("content")).alias("position"),
        F.count_if(front).alias("foreground_count"),
        F.count_if(front & text).alias("text_count"),
        F.count_if(front & ~text).alias("nontext_count"),
        F.count_if(~front).alias("container_count"),
        R6(F.coalesce(F.try_divide(F.count_if(front & text).cast("double"), F.count_if(front)), F.lit(0.0))).alias("text_ratio"),
        share(F.sum(F.when(front, common))).alias("density"),
        share(F.max(F.when(~(front & text), common))).alias("largest"),
        share(F.sum(F.when(~front, common))).alias("container_ratio"),
        fronts.alias("fronts"),
        texts.alias("texts"),
        w.alias("region_width"),
        h.alias("region_height"),
    )


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(a))


def _even(a: Column) -> Column:
    """One minus deviation over mean, the mean 1 at least."""
    mean = _mean(a)
    return 1 - F.sqrt(_mean(F.transform(a, lambda x: (x - mean) * (x - mean)))) / F.greatest(F.lit(1.0), mean)


def _steps(a: Column, step) -> Column:
    """step(before, item) of the items of an array that follow each other."""
    return F.filter(F.transform(a, lambda x, i: F.when(i > 0, step(F.get(a, i - 1), x))), lambda x: x.isNotNull())


def _median(a: Column) -> Column:
    half = F.floor(F.size(a) / 2).cast("int")
    return F.when(F.size(a) % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2)


def axis_gaps(rows: DataFrame) -> DataFrame:
    """rows with the largest gap, as a share of the region, between foreground boxes that follow each other on an axis."""
    across = F.array_sort(F.transform("fronts", lambda x: F.struct(x["l"].alias("l"), x["t"].alias("t"), x["element_id"].alias("element_id"), x["r"].alias("r"))))
    rows = rows.withColumn("__across", across)
    gap = lambda a, low, high: F.coalesce(F.array_max(_steps(a, lambda p, x: F.greatest(F.lit(0), x[low] - p[high]))), F.lit(0))
    rows = rows.withColumn("horizontal_gap", G.clamp01(gap(F.col("fronts"), "t", "b") / F.col("region_height")))
    return rows.withColumn("vertical_gap", G.clamp01(gap(F.col("__across"), "l", "r") / F.col("region_width"))).drop("__across")


def repeated_sizes(rows: DataFrame) -> DataFrame:
    widths, heights = F.transform("fronts", lambda x: (x["r"] - x["l"]).cast("double")), F.transform("fronts", lambda x: (x["b"] - x["t"]).cast("double"))
    return rows.withColumn("repeated_size", F.when(F.size("fronts") >= 2, G.clamp01((_even(widths) + _even(heights)) / 2)).otherwise(0.0))


def repeated_gaps(rows: DataFrame) -> DataFrame:
    """rows with the regularity of the steps above 1 between sorted centres, on the better axis."""
    middles = {"__dx": F.transform("fronts", lambda x: (x["l"] + x["r"]) / 2), "__dy": F.transform("fronts", lambda x: (x["t"] + x["b"]) / 2)}
    for name, centres in middles.items():
        rows = rows.withColumn(name, F.array_sort(centres)).withColumn(name, F.filter(_steps(F.col(name), lambda p, x: x - p), lambda d: d > 1))
    value = lambda c: F.when(F.size(c) >= 2, _even(F.col(c)))
    best = F.coalesce(F.greatest(value("__dx"), value("__dy")), F.lit(0.0))
    return rows.withColumn("repeated_gap", F.when(F.size("fronts") >= 3, G.clamp01(best)).otherwise(0.0)).drop("__dx", "__dy")


def text_measures(rows: DataFrame) -> DataFrame:
    """rows with the texts' spreads, median height as a share of the region, and number of lines."""
    heights = F.array_sort(F.transform("texts", lambda x: x["h"]))
    rows = rows.withColumn("__h", heights).withColumn("__step", F.greatest(F.lit(2.0), _median(F.col("__h")) * 0.6)).withColumn("__y", F.array_sort(F.transform("texts", lambda x: x["y"])))
    few = F.size("texts") < 2
    spread = lambda at, axis: F.when(few, 0.0).otherwise(G.clamp01((F.array_max(F.col("texts")[at]) - F.array_min(F.col("texts")[at])) / F.col(axis)))
    rows = rows.withColumn("horizontal_spread", spread("x", "region_width")).withColumn("vertical_spread", spread("y", "region_height"))
    rows = rows.withColumn("median_text_height", F.when(F.size("texts") > 0, G.clamp01(_median(F.col("__h")) / F.col("region_height"))).otherwise(0.0))
    breaks = F.size(F.filter(_steps(F.col("__y"), lambda p, y: y - p), lambda d: d > F.col("__step")))
    return rows.withColumn("text_line_count", F.when(F.size("texts") > 0, breaks + 1).otherwise(0).cast("long")).drop("__h", "__step", "__y")


def separators(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the lines inside a region, the longest on each axis as a share of the region."""
    rows = prefixed(regions, "g_", KEY).join(lines, "page_id")
    wide, tall = F.greatest(F.lit(1), G.width("g_")), F.greatest(F.lit(1), G.height("g_"))
    flat = (F.col("direction") == "horizontal") & (F.col("g_t") < F.col("position")) & (F.col("position") < F.col("g_b"))
    steep = (F.col("direction") == "vertical") & (F.col("g_l") < F.col("position")) & (F.col("position") < F.col("g_r"))
    along = (F.least("g_r", "end") - F.greatest("g_l", "start")) / wide
    down = (F.least("g_b", "end") - F.greatest("g_t", "start")) / tall
    return rows.groupBy(*KEY).agg(
        G.clamp01(F.coalesce(F.max(F.when(flat, along)), F.lit(0.0))).alias("horizontal_separator"),
        G.clamp01(F.coalesce(F.max(F.when(steep, down)), F.lit(0.0))).alias("vertical_separator"),
    )


def region_features(boxes: DataFrame, regions: DataFrame, lines: DataFrame, width: int, height: int, groups: DataFrame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """The feature row of every region that holds a box.

    groups (page_id, region_id, layout_type) adds group counts; pixels (page_id, region_id,
    color_variance, edge_density, horizontal_transition, vertical_transition) the colour
    measures. Without them those are 0.
    """
    out = gathered(in_regions(roles(boxes, width, height), regions), width, height)
    out = text_measures(repeated_gaps(repeated_sizes(axis_gaps(out)))).drop("fronts", "texts", "region_width", "region_height")
    out = out.join(separators(regions, lines), list(KEY), "left")
    if groups is not None:
        counts = groups.groupBy(*KEY).agg(F.count("*").alias("group_count"), *(F.count_if(F.col("layout_type") == t).alias(f"{t}_groups") for t in ("row", "column", "grid")))
        out = out.join(counts, list(KEY), "left")
    else:
        out = out.select("*", *(F.lit(0).cast("long").alias(c) for c in ("group_count", "row_groups", "column_groups", "grid_groups")))
    if pixels is not None:
        out = out.join(pixels, list(KEY), "left")
    else:
        out = out.select("*", *(F.lit(0.0).alias(c) for c in ("color_variance", "edge_density", "horizontal_transition", "vertical_transition")))
    out = out.fillna(0)
    return out.withColumn("background_continuity", G.clamp01(1 - 0.55 * F.col("color_variance") - 0.45 * F.col("edge_density")))


#: Order in which equal region scores win. Fixed values.
TYPES = ("hero", "navigation", "footer", "card_grid", "two_column", "list", "text_section", "mixed")


def region_scores() -> dict[str, Column]:
    """The eight weighted scores; columns as named in the feature row."""
    c = F.col
    one = lambda x: F.least(F.lit(1.0), x)
    rep = (c("repeated_size") + c("repeated_gap")) / 2
    vp, hp = F.greatest("vertical_gap", "vertical_separator"), F.greatest("horizontal_gap", "horizontal_separator")
    bg, text, fg = c("background_continuity"), c("text_ratio"), c("foreground_count")
    top, foot = (c("position") == "header").cast("double"), (c("position") == "footer").cast("double")
    hero = 0.20 * c("page_area") + 0.25 * c("largest") + 0.20 * (1 - one(c("text_count") / 8)) + 0.20 * bg + 0.15 * (1 - rep)
    hero *= F.when((c("largest") < 0.2) & (c("container_ratio") < 0.35), 0.35).otherwise(1.0)
    two = 0.25 * vp + 0.25 * vp / F.greatest(F.lit(0.01), vp + hp) + 0.15 * one(fg / 4) + 0.25 * F.greatest(F.lit(0.0), 1 - F.abs(c("height_ratio") - 0.55) / 0.45) + 0.10 * (1 - hp)
    two *= F.when((fg < 4) | (vp < 0.15) | (vp <= hp), 0.4).otherwise(1.0)
    return {
        "hero": hero,
        "two_column": two,
        "navigation": 0.25 * top + 0.20 * (1 - one(c("height_ratio") / 0.25)) + 0.20 * c("horizontal_spread") + 0.15 * text + 0.20 * bg,
        "text_section": 0.35 * text + 0.20 * (1 - one(c("nontext_count") / 3)) + 0.20 * c("vertical_spread") + 0.15 * (1 - hp) + 0.10 * bg,
        "card_grid": 0.35 * rep + 0.30 * one((c("row_groups") + c("grid_groups")) / 2) + 0.20 * one(fg / 6) + 0.15 * F.greatest(hp, vp),
        "list": 0.30 * c("repeated_gap") + 0.20 * c("repeated_size") + 0.20 * c("vertical_spread") + 0.15 * one(c("row_groups") / 2) + 0.15 * text,
        "footer": 0.30 * foot + 0.20 * text + 0.15 * one(fg / 6) + 0.20 * one((c("column_groups") + c("grid_groups")) / 2) + 0.15 * bg,
        "mixed": 0.25 * one(fg / 8) + 0.20 * one(c("group_count") / 3) + 0.15 * (1 - text) + 0.15 * (1 - rep) + 0.25 * F.greatest(hp, vp),
    }


def classify(features: DataFrame, floor: float = 0.42) -> DataFrame:
    """features with region_type and confidence: the best score, ties by TYPES; below the floor mixed, with its own score."""
    scores = {name: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for name, s in region_scores().items()}
    ranked = F.array_sort(F.array(*(F.struct((-scores[n]).alias("s"), F.lit(i).alias("k"), F.lit(n).alias("n")) for i, n in enumerate(TYPES))))
    rows = features.withColumn("__ranked", ranked)
    rows = rows.withColumn("region_type", F.when(-F.col("__ranked")[0]["s"] < floor, "mixed").otherwise(F.col("__ranked")[0]["n"]))
    score = lambda keep: -F.filter("__ranked", keep)[0]["s"]
    win, other = score(lambda x: x["n"] == F.col("region_type")), score(lambda x: x["n"] != F.col("region_type"))
    return rows.withColumn("confidence", G.clamp01(0.7 * win + 0.3 * F.greatest(F.lit(0.0), win - other))).drop("__ranked")


def reasons(profiles: DataFrame) -> DataFrame:
    """Classified features with the labels whose thresholds hold, the page position first."""
    c = F.col
    labels = [
        (c("text_ratio") >= 0.6, "text_dominant"),
        (c("largest") >= 0.25, "large_component"),
        (c("background_continuity") >= 0.7, "continuous_background"),
        ((c("repeated_size") + c("repeated_gap")) / 2 >= 0.65, "repeated_layout"),
        (F.greatest("vertical_gap", "vertical_separator") >= 0.35, "vertical_partition"),
        (F.greatest("horizontal_gap", "horizontal_separator") >= 0.35, "horizontal_partition"),
    ]
    found = G.ordered_reasons(labels)
    found = F.when((c("region_type") == "mixed") & (F.size(found) == 0), F.array(F.lit("no_specialized_profile"))).otherwise(found)
    return profiles.withColumn("reasons", F.concat(F.array(F.concat(F.lit("page_position:"), c("position"))), found))


#: Evidence this near joins; candidates nearer than APART compete; a component this large counts as content. Fixed values.
REACH, APART, LARGE = 4, 8, 0.07


def joined_evidence(items: Column, reach: int = REACH) -> Column:
    """An array of evidence (direction, position, sources, gap) in which each joins the first of its direction within reach.

    The first keeps its place, takes over the sources and the larger gap.
    """

    def add(found: Column, x: Column) -> Column:
        near = F.transform(found, lambda y: (y["direction"] == x["direction"]) & (F.abs(y["position"] - x["position"]) <= reach))
        at = F.array_position(near, True)
        both = lambda y: F.struct(y["direction"].alias("direction"), y["position"].alias("position"), F.array_union(y["sources"], x["sources"]).alias("sources"), F.greatest(y["gap"], x["gap"]).alias("gap"))
        return F.when(at == 0, F.concat(found, F.array(x))).otherwise(F.transform(found, lambda y, i: F.when(i + 1 == at, both(y)).otherwise(y)))

    return F.aggregate(items, F.slice(items, 1, 0), add)


def evidence(boxes: DataFrame, lines: DataFrame, width: int, height: int, least: int = 8) -> DataFrame:
    """page_id, direction, position, sources, gap of the places at which each whole page might be cut.

    Detected lines inside the page that span half of it come first, then gaps between
    foreground boxes, horizontal cuts before vertical ones. boxes have roles.
    """
    v = F.col("direction") == "vertical"
    extent, span = F.when(v, width).otherwise(height), F.when(v, height).otherwise(width)
    inside = lines.where((F.col("position") > 0) & (F.col("position") < extent) & ((F.least("end", span) - F.greatest("start", F.lit(0))) * 2 >= span))
    item = lambda k, direction, position, source, gap: F.struct(k.alias("k"), direction.alias("direction"), position.cast("int").alias("position"), F.array(F.lit(source)).alias("sources"), gap.cast("int").alias("gap"))
    found = inside.select("page_id", item(F.lit(0), F.col("direction"), F.col("position"), "lsd", F.lit(0)).alias("x"))
    wide = gaps(projection(boxes.where("role = 'foreground'")), ["page_id", "axis"], least)
    found = found.unionByName(wide.select("page_id", item(F.when(F.col("axis") == "y", 1).otherwise(2), F.when(F.col("axis") == "y", "horizontal").otherwise("vertical"), F.col("cut"), "whitespace", F.col("size")).alias("x")))
    items = F.transform(F.array_sort(F.collect_list("x")), lambda x: x.dropFields("k"))
    return found.groupBy("page_id").agg(items.alias("items")).select("page_id", F.inline(joined_evidence(F.col("items"))))


def text_axes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """page_id, axis: along which a page's texts run; none with a larger other foreground box or tall text."""
    text, front = F.col("uied_class") == "Text", F.col("role") == "foreground"
    of = lambda x: F.when(text, x)
    big = front & ~text & (F.greatest(G.width(), G.height()) > 48)
    rows = boxes.groupBy("page_id").agg(
        F.count_if(text).alias("n"), F.count_if(big).alias("big"), F.percentile(of(G.height()), 0.5).alias("tall"), F.percentile(of(G.width()), 0.5).alias("wide"),
        (F.max(of(G.center_x())) - F.min(of(G.center_x()))).alias("across"), (F.max(of(G.center_y())) - F.min(of(G.center_y()))).alias("down"),
    )
    rows = rows.where((F.col("n") >= 2) & (F.col("big") == 0) & (F.col("tall") <= max(96, round(height * 0.035))))
    vertical = (F.col("across") <= width * 0.35) & (F.col("down") >= F.col("tall") * 2)
    flat = (F.col("down") <= height * 0.35) & (F.col("across") >= F.col("wide") * 2)
    axis = F.when(vertical & (~flat | (F.col("down") / height >= F.col("across") / width)), "vertical").when(flat, "horizontal")
    return rows.select("page_id", axis.alias("axis")).where("axis is not null")


def candidate_scores(boxes: DataFrame, lines: DataFrame, width: int, height: int, least: int = 10, floor: float = 0.45, groups: DataFrame | None = None) -> DataFrame:
    """Score and refusal reasons of every evidence as a cut of its whole page.

    Crossing and content counts come from one conditional aggregate over the join of
    evidence and boxes; boxes fall to the side their centre is on. Content is the
    foreground and large other boxes. groups (page_id, l, t, r, b: text groups of two
    or more) refuses weak cuts through them.
    """
    known = roles(boxes, width, height)
    found = evidence(known, lines, width, height)
    rows = known.join(found, "page_id")
    vertical = F.col("direction") == "vertical"
    extent, span = F.when(vertical, F.lit(width)).otherwise(F.lit(height)), F.when(vertical, F.lit(height)).otherwise(F.lit(width))
    before = F.when(vertical, G.center_x()).otherwise(G.center_y()) < F.col("position")
    fg = F.col("role") == "foreground"
    big = G.area().cast("double") / (width * height) >= LARGE
    cut = G.crosses(F.col("direction"), F.col("position"), F.lit(0), span)
    out = rows.groupBy("page_id", "direction", "position", "sources", "gap").agg(
        F.count_if(fg & before).alias("before"),
        F.count_if(fg & ~before).alias("after"),
        F.count_if((fg | big) & before).alias("content_before"),
        F.count_if((fg | big) & ~before).alias("content_after"),
        F.count_if(fg & cut).alias("cut_foreground"),
        F.count_if(~fg & cut).alias("cut_other"),
        F.count_if(big & cut).alias("cut_large"),
    )
    strong = F.array_contains("sources", "lsd")
    out = out.withColumn("cut_large", F.when(strong, F.lit(0).cast("long")).otherwise(F.col("cut_large")))
    out = out.join(text_axes(known, width, height), "page_id", "left")
    first, second = F.col("position"), extent - F.col("position")
    one = F.lit(1)
    score = G.source_weight(F.col("sources")) + F.least(F.lit(0.28), F.col("gap") / extent * 2)
    score = score + F.least("content_before", "content_after") / F.greatest(one, "content_before", "content_after") * 0.34 + F.least(first, second) / F.greatest(one, first, second) * 0.16
    n = F.greatest(one, F.col("before") + F.col("after"))
    score = score - (F.col("cut_foreground") / n * 1.35 + F.col("cut_foreground") * 0.08 + F.least(F.lit(0.12), F.col("cut_other") * 0.015))
    out = out.withColumn("score", F.round(score, 6))
    if groups is None:
        out = out.withColumn("cut_text_groups", F.lit(0).cast("long"))
    else:
        crossing = out.select("page_id", "direction", "position").join(groups, "page_id").where(G.crosses(F.col("direction"), F.col("position"), F.lit(0), span))
        out = out.join(crossing.groupBy("page_id", "direction", "position").agg(F.count("*").alias("cut_text_groups")), ["page_id", "direction", "position"], "left").fillna(0, ["cut_text_groups"])
    why = [
        (F.least(first, second) < least, "child_too_small"),
        (F.col("before") + F.col("after") < 2, "insufficient_foreground"),
        ((F.col("content_before") == 0) | (F.col("content_after") == 0), "empty_foreground_child"),
        (F.coalesce(F.col("axis") != F.col("direction"), F.lit(False)) & ~strong, "semantic_text_run"),
        ((F.col("cut_text_groups") > 0) & ~strong, "semantic_layout_group"),
        (F.col("score") < floor, "score_below_threshold"),
    ]
    out = out.withColumn("reasons", G.ordered_reasons(why)).drop("axis")
    return out.withColumn("accepted", F.size("reasons") == 0)


def candidate_order() -> list[Column]:
    """Better candidates first: score, number of sources, gap, then the smaller place."""
    return [F.desc("score"), F.desc(F.size("sources")), F.desc("gap"), F.col("position")]


def apart(candidates: DataFrame, reach: int = APART) -> DataFrame:
    """Of each page's candidates, better ones first, those not within reach of one kept before in their direction."""
    item = F.struct((-F.col("score")).alias("s"), (-F.size("sources")).alias("n"), (-F.col("gap")).alias("g"), "position", "direction")

    def add(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda y: (y["direction"] == x["direction"]) & (F.abs(y["position"] - x["position"]) < reach))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    rows = candidates.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = rows.select("page_id", F.inline(F.aggregate("items", F.slice("items", 1, 0), add))).select("page_id", "direction", "position")
    return candidates.join(kept, ["page_id", "direction", "position"])


def decisions(candidates: DataFrame, policy: dict) -> DataFrame:
    """candidates with final, their score under a region type's policy, and blocked, why a search passes them over.

    policy as in layout.POLICIES. Evidence of groups and component edges is not among these candidates' sources.
    """
    final = F.col("score") + F.when(F.col("direction").isin(*policy.get("prefer", ())), policy.get("direction", 0.0)).otherwise(0.0)
    cut = F.col("cut_large") > 0
    final = F.round(final - F.when(cut, policy.get("cut", 0.0)).otherwise(0.0), 6)
    blocked = [(cut, "large_component_cut"), (final < policy.get("minimum", 0.0), "below_region_minimum"), (~F.col("accepted"), "raw_candidate_rejected")]
    return candidates.withColumn("final", final).withColumn("blocked", G.ordered_reasons(blocked))


#: Most that a page's ratios may be. Fixed values.
GATE = {"empty_ratio": 0.0, "thin_text_ratio": 0.40, "small_single_ratio": 0.45}


def structure_measures(tree: DataFrame, owned: DataFrame) -> DataFrame:
    """One row a page: the measures of its node table and how often each rule is broken.

    tree: a node table; owned: page_id, node_id and element_id, box, uied_class of the
    elements that leaves own. Rules: no siblings overlap, no child escapes its parent,
    children stand in order, at most one leaf takes half the page, no leaf holds small
    icons only, every element has one owner, and the ratios of GATE.
    """
    key = ["page_id", "node_id"]
    kids = prefixed(tree.where("parent_id is not null"), "c_").withColumnRenamed("c_parent_id", "parent_id")
    parents = prefixed(tree, "p_").withColumnRenamed("p_node_id", "parent_id")
    kin = kids.join(parents, ["page_id", "parent_id"])
    escapes = (F.col("c_l") < F.col("p_l")) | (F.col("c_t") < F.col("p_t")) | (F.col("c_r") > F.col("p_r")) | (F.col("c_b") > F.col("p_b"))
    start = F.when(F.col("p_layout_type") == "row", F.col("c_l")).when(F.col("p_layout_type") == "column", F.col("c_t"))
    kin = kin.withColumn("late", F.coalesce(F.lag(start).over(Window.partitionBy("page_id", "parent_id").orderBy("c_ordinal")) > start, F.lit(False)))
    shape = kin.groupBy("page_id").agg(F.count_if(escapes).alias("escapes"), F.count_if("late").alias("disordered"))
    a, b = (tree.where("parent_id is not null").select("page_id", "parent_id", *(F.col(c).alias(f"{side}_{c}") for c in (*BOX, "ordinal"))) for side in "ab")
    pairs = a.join(b, ["page_id", "parent_id"]).where((F.col("a_ordinal") < F.col("b_ordinal")) & G.overlaps("a_", "b_"))
    roots = tree.where("parent_id is null").select("page_id", G.area().cast("double").alias("page_area"), F.greatest(F.lit(96), F.rint(G.height() * 0.035)).alias("thin"))
    e = owned.join(roots, "page_id")
    text, area = F.col("uied_class") == "Text", G.area().cast("double") / F.col("page_area")
    side = F.greatest(G.width(), G.height())
    weak = F.when(text, (G.height() <= F.col("thin")) & (area < 0.03)).otherwise((area < 0.04) & (side <= 48))
    leaves = e.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(text).alias("texts"), F.max(side).alias("side"), (F.max("b") - F.min("t")).alias("span"), F.max("thin").alias("thin"), F.bool_and(weak).alias("weak"))
    atoms = tree.where("layout_type = 'atomic'").join(roots.select("page_id", "page_area"), "page_id").select(*key, (G.area() * 2 >= F.col("page_area")).alias("wide")).join(leaves, key, "left")
    filled = F.col("n").isNotNull()
    thin, small = filled & (F.col("texts") == F.col("n")) & (F.col("span") <= F.col("thin")), (F.col("n") == 1) & F.col("weak")
    share = lambda x: R6(F.count_if(x) / F.greatest(F.lit(1), F.count_if(filled)))
    found = atoms.groupBy("page_id").agg(
        F.count_if(filled).alias("atomic_count"), R6(F.max(F.coalesce("n", F.lit(0))) / F.greatest(F.lit(1), F.sum("n"))).alias("largest_ratio"), share(thin).alias("thin_text_ratio"), share(F.col("n") == 1).alias("single_ratio"),
        R6(F.count_if(~filled) / F.count("*")).alias("empty_ratio"), share(small).alias("small_single_ratio"), F.greatest(F.lit(0), F.count_if("wide") - 1).alias("page_scale"),
        F.count_if(filled & (F.col("texts") == 0) & (F.col("side") <= 48)).alias("icon_only"),
    )
    once = owned.groupBy("page_id").agg(F.count_distinct("element_id").alias("owned_element_count"), (F.count("*") - F.count_distinct("element_id")).alias("owned_twice"))
    out = found.join(once, "page_id", "left").join(shape, "page_id", "left").join(pairs.groupBy("page_id").agg(F.count("*").alias("crossings")), "page_id", "left").fillna(0)
    broken = sum((F.col(c) for c in ("crossings", "escapes", "disordered", "page_scale", "icon_only", "owned_twice")), F.lit(0)) > 0
    for name, most in GATE.items():
        broken |= F.col(name) > most
    return out.withColumn("passed", ~broken)


def smoothed(rows: DataFrame, by: list[str], at: str, value: str, taps: int = 5) -> DataFrame:
    """Moving average with zeros beyond the ends: the sum over the window always divided by its width."""
    half = taps // 2
    frame = Window.partitionBy(*by).orderBy(at).rowsBetween(-half, half)
    return rows.withColumn("smooth", R6(F.sum(value).over(frame) / taps))


def local_maxima(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Inner rows above the one before and not below the one after."""
    order = Window.partitionBy(*by).orderBy(at)
    near = rows.withColumn("__p", F.lag(value).over(order)).withColumn("__n", F.lead(value).over(order))
    return near.where((F.col(value) > F.col("__p")) & (F.col(value) >= F.col("__n"))).drop("__p", "__n")


def top(rows: DataFrame, by: list[str], value: str, at: str, most: int) -> DataFrame:
    """The largest values for each key, ties to the smaller place."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), at)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= most)


def context_bonus(cells: DataFrame, reach: int, weight: float = 1.0, least: float = -0.5) -> DataFrame:
    """cells (page_id, i, j, cost) with adjusted: a good cost is raised by the best of its neighbours.

    For costs below least, the sum of the 2 * reach lowest other costs within reach rows
    and columns is added, times weight. Neighbours come from one equi-join on the page.
    """
    a, b = prefixed(cells, "a_"), prefixed(cells, "b_")
    near = (F.abs(F.col("a_i") - F.col("b_i")) <= reach) & (F.abs(F.col("a_j") - F.col("b_j")) <= reach) & ((F.col("a_i") != F.col("b_i")) | (F.col("a_j") != F.col("b_j")))
    rows = a.where(F.col("a_cost") < least).join(b, "page_id").where(near).groupBy("page_id", F.col("a_i").alias("i"), F.col("a_j").alias("j"))
    lowest = F.slice(F.array_sort(F.collect_list("b_cost")), 1, 2 * reach)
    sums = rows.agg((F.aggregate(lowest, F.lit(0.0), lambda s, x: s + x) * weight).alias("bonus"))
    out = cells.join(sums, ["page_id", "i", "j"], "left")
    return out.select("page_id", "i", "j", "cost", R6(F.col("cost") + F.coalesce("bonus", F.lit(0.0))).alias("adjusted"))


def substituted(pages: DataFrame, code: DataFrame) -> DataFrame:
    """pages (page_id, html) with code (page_id, id, code) put into the empty div of each id, without Markdown fences."""
    plain = F.replace(F.replace("code", F.lit("```html"), F.lit("")), F.lit("```"), F.lit(""))
    found = code.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", plain.alias("code")))).alias("parts"))
    tag = lambda x: F.concat(F.lit('<div id="'), x["id"], F.lit('">'))
    put = F.aggregate("parts", F.col("html"), lambda h, x: F.replace(h, F.concat(tag(x), F.lit("</div>")), F.concat(tag(x), x["code"], F.lit("</div>"))))
    return pages.join(found, "page_id", "left").select("page_id", F.when(F.col("parts").isNull(), F.col("html")).otherwise(put).alias("html"))


def tree_depths(nodes: DataFrame) -> DataFrame:
    """page_id, depth, nodes of node tables: how deep and how many are the nodes that a root leads to.

    Each level is a table of its own, made from the one before. A recursive query would
    do in small: Spark ends it at a million rows (spark.sql.cteRecursionRowLimit) or 100 levels.
    """
    spark, paths = nodes.sparkSession, []

    def level(rows: DataFrame) -> DataFrame:
        paths.append(scratch.fresh(spark, "level"))
        rows.write.parquet(paths[-1])
        return spark.read.schema(rows.schema).parquet(paths[-1])

    edges = nodes.where("parent_id is not null").select("page_id", "node_id", "parent_id")
    now = level(nodes.where("parent_id is null").select("page_id", "node_id", F.lit(0).alias("depth")))
    schema = now.schema
    while not now.isEmpty():
        above = now.select("page_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
        now = level(edges.join(above, ["page_id", "parent_id"]).select("page_id", "node_id", "depth"))
    return spark.read.schema(schema).parquet(*paths).groupBy("page_id").agg(F.max("depth").cast("int").alias("depth"), F.count("*").alias("nodes"))
