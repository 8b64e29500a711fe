"""Box arithmetic as column expressions.

A box is four columns left, top, right, bottom, right and bottom exclusive. Functions
take the prefix of those columns: box("a_") means a_l, a_t, a_r, a_b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F




def side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def width(p: str = "") -> Column:
    return side(p, "r") - side(p, "l")


def height(p: str = "") -> Column:
    return side(p, "b") - side(p, "t")


def area(p: str = "", clamped: bool = False) -> Column:
    w, h = width(p), height(p)
    return (F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h) if clamped else w * h).cast("long")


def center_x(p: str = "") -> Column:
    return (side(p, "l") + side(p, "r")) / 2


def center_y(p: str = "") -> Column:
    return (side(p, "t") + side(p, "b")) / 2


def intersection(a: str, b: str) -> Column:
    w = F.greatest(F.lit(0), F.least(side(a, "r"), side(b, "r")) - F.greatest(side(a, "l"), side(b, "l")))
    h = F.greatest(F.lit(0), F.least(side(a, "b"), side(b, "b")) - F.greatest(side(a, "t"), side(b, "t")))
    return (w * h).cast("long")


def overlaps(a: str, b: str) -> Column:
    """Positive common area, as comparisons that a join can evaluate on its own."""
    return (side(a, "l") < side(b, "r")) & (side(b, "l") < side(a, "r")) & (side(a, "t") < side(b, "b")) & (side(b, "t") < side(a, "b"))


def ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return ratio(i, area(a, True) + area(b, True) - i)


def share_of(a: str, b: str) -> Column:
    """The part of a that b covers."""
    return ratio(intersection(a, b), area(a, True))


def clip(value: Column, most: Column) -> Column:
    """Round half to even, then clamp to 0..most."""
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), most.cast("double")).cast("int")


def clamp01(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)


def role(kind: Column, text: Column, page_w: Column, page_h: Column, p: str = "") -> Column:
    """foreground, container or background, from class, text and the shares of the page's width, height and area."""
    w, h = width(p) / page_w, height(p) / page_h
    a = area(p) / (page_w * page_h)
    read = (kind == "Text") | F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))
    block = F.when((a >= 0.5) | ((w >= 0.9) & (h >= 0.4)), "background").otherwise("container")
    other = F.when((w >= 0.9) | (a >= 0.15) | ((w >= 0.65) & (h >= 0.15)), "container").otherwise("foreground")
    return F.when(read, "foreground").when(kind == "Block", block).otherwise(other)


def page_position(page_h: Column, p: str = "") -> Column:
    """Where a region's centre stands: header up to a fifth, footer from 82 %."""
    at = center_y(p) / page_h
    return F.when(at <= 0.2, "header").when(at >= 0.82, "footer").otherwise("content")


def page_label(page_h: Column, p: str = "") -> Column:
    """The ownership label: header under a fifth, footer over 80 %."""
    at = center_y(p) / page_h
    return F.when(at < 0.2, "header").when(at > 0.8, "footer").otherwise("content")


def crosses(direction: Column, position: Column, start: Column, end: Column, p: str = "") -> Column:
    """A line strictly inside a box whose span meets the box."""
    v = (side(p, "l") < position) & (position < side(p, "r")) & (start < side(p, "b")) & (end > side(p, "t"))
    h = (side(p, "t") < position) & (position < side(p, "b")) & (start < side(p, "r")) & (end > side(p, "l"))
    return F.when(direction == "vertical", v).otherwise(h)


def children(direction: Column, position: Column, p: str = "") -> Column:
    """The two boxes of a cut, as an array of structs."""
    box = lambda **s: F.struct(*(s.get(n, side(p, n)).cast("int").alias(n) for n in "ltrb"))
    return F.when(direction == "vertical", F.array(box(r=position), box(l=position))).otherwise(F.array(box(b=position), box(t=position)))


def rotate(clockwise: bool, page_w: Column, page_h: Column, p: str = "") -> list[Column]:
    """The box after the page turns by 90 degrees."""
    l, t, r, b = (side(p, n) for n in "ltrb")
    turned = (page_h - b, l, page_h - t, r) if clockwise else (t, page_w - r, b, page_w - l)
    return [c.cast("int").alias(n) for n, c in zip("ltrb", turned, strict=True)]


def percent_of(child: str, parent: str) -> list[Column]:
    """left, top, width, height of the child in percent of its parent."""
    pw, ph = width(parent), height(parent)
    cells = (side(child, "l") - side(parent, "l"), pw), (side(child, "t") - side(parent, "t"), ph), (width(child), pw), (height(child), ph)
    return [F.round(ratio(x * 100, y), 6).alias(n) for n, (x, y) in zip(("left_pct", "top_pct", "width_pct", "height_pct"), cells, strict=True)]


#: Evidence weights and priority of separator sources. Fixed values.
SOURCE_WEIGHTS = {"lsd": 0.72, "whitespace": 0.42, "layout_group": 0.22, "component_boundary": 0.55}
SOURCE_PRIORITY = ("lsd", "color_change", "component_boundary", "whitespace", "layout_group")


def line_source(sources: Column) -> Column:
    """The first source in order of priority that an array holds."""
    found = F.lit("whitespace")
    for name in reversed(SOURCE_PRIORITY):
        found = F.when(F.array_contains(sources, name), name).otherwise(found)
    return found


def source_weight(sources: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair))
    return F.aggregate(F.array_distinct(sources), F.lit(0.0), lambda s, x: s + F.coalesce(table[x], F.lit(0.0)))


def gcd(a: Column, b: Column, steps: int = 24) -> Column:
    """Euclid's algorithm, unrolled over an accumulator; 24 steps cover numbers up to 46,368."""
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.pmod(s["x"], F.nullif(s["y"], F.lit(0).cast("long")))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def portions(lengths: Column) -> Column:
    """Lengths divided by their common divisor, at least 1 each."""
    long = F.transform(lengths, lambda x: F.greatest(F.lit(1), x).cast("long"))
    common = F.aggregate(long, F.lit(0).cast("long"), lambda g, x: gcd(g, x))
    return F.transform(long, lambda x: (x / common).cast("long"))


def max_axis_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def center_distance(a: str, b: str) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def ordered_reasons(pairs: list[tuple[Column, str]]) -> Column:
    """The labels whose conditions hold, in order."""
    cells = F.array(*(F.when(cond, label) for cond, label in pairs))
    return F.filter(cells, lambda x: x.isNotNull())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _lab(rgb: tuple[Column, Column, Column]) -> Column:
    r, g, b = (F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, 2.4)).otherwise(c / 255 / 12.92) for c in rgb)
    f = lambda v: F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116)
    x, y, z = f((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047), f(0.2126729 * r + 0.7151522 * g + 0.0721750 * b), f((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda s: F.struct((116 * s["y"] - 16).alias("l"), (500 * (s["x"] - s["y"])).alias("a"), (200 * (s["y"] - s["z"])).alias("b")))


def _chroma(p: Column) -> Column:
    """Chroma and hue of both colours after the correction of a."""
    c7 = F.pow((F.hypot(p["one"]["a"], p["one"]["b"]) + F.hypot(p["two"]["a"], p["two"]["b"])) / 2, 7)
    scale = 1.5 - 0.5 * F.sqrt(c7 / (c7 + 25.0**7))
    hue = lambda q: F.pmod(F.degrees(F.atan2(q["b"], q["a"] * scale)) + 360, F.lit(360.0))
    return F.struct(
        p["one"]["l"].alias("l1"), p["two"]["l"].alias("l2"),
        F.hypot(p["one"]["a"] * scale, p["one"]["b"]).alias("c1"), F.hypot(p["two"]["a"] * scale, p["two"]["b"]).alias("c2"),
        hue(p["one"]).alias("h1"), hue(p["two"]).alias("h2"),
    )


def _means(q: Column) -> Column:
    grey, gap, total = q["c1"] * q["c2"] == 0, q["h2"] - q["h1"], q["h1"] + q["h2"]
    turn = F.when(grey, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
    hue = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    return F.struct(
        (q["l2"] - q["l1"]).alias("dl"), (q["c2"] - q["c1"]).alias("dc"), (2 * F.sqrt(q["c1"] * q["c2"]) * F.sin(F.radians(turn) / 2)).alias("dh"),
        ((q["l1"] + q["l2"]) / 2).alias("l"), ((q["c1"] + q["c2"]) / 2).alias("c"), hue.alias("h"),
    )


def _delta(m: Column) -> Column:
    cosd = lambda d: F.cos(F.radians(d))
    t = 1 - 0.17 * cosd(m["h"] - 30) + 0.24 * cosd(2 * m["h"]) + 0.32 * cosd(3 * m["h"] + 6) - 0.20 * cosd(4 * m["h"] - 63)
    off, c7 = F.pow(m["l"] - 50, 2), F.pow(m["c"], 7)
    light = m["dl"] / (1 + 0.015 * off / F.sqrt(20 + off))
    chroma, hue = m["dc"] / (1 + 0.045 * m["c"]), m["dh"] / (1 + 0.015 * m["c"] * t)
    twist = -F.sin(F.radians(60 * F.exp(-F.pow((m["h"] - 275) / 25, 2)))) * 2 * F.sqrt(c7 / (c7 + 25.0**7))
    return F.sqrt(F.greatest(F.lit(0.0), light * light + chroma * chroma + hue * hue + twist * chroma * hue))


def ciede2000_similarity(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """1 - CIEDE2000 / 100, not below 0, of two sRGB colours with channels 0 to 255, in column arithmetic."""
    labs = F.struct(_lab(one).alias("one"), _lab(two).alias("two"))
    delta = let(let(let(labs, _chroma), _means), _delta)
    return F.greatest(F.lit(0.0), 1 - delta / 100)
