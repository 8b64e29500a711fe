"""Layout of one page at a time: grouping, overlap normalisation, cuts, tree search, ownership, merging, HTML.

These steps depend on the order in which they change things, so they are no plans
over rows. A page's boxes, few and bounded by the page, are gathered by one shuffle
on page_id and handled in Arrow batches of pages; everything before and after is
DataFrame code.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import escape
from math import gcd, hypot, sqrt
from operator import itemgetter
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.geometry import SOURCE_PRIORITY as PRIORITY
from quoin.functions.geometry import SOURCE_WEIGHTS as EVIDENCE

from .spatial import TYPES

Box = tuple[int, int, int, int]

#: Search, scoring and policy parameters. Fixed values.
PARAMETERS = {
    "minimum_gap": 8, "minimum_region": 10, "minimum_score": 0.45, "strong_score": 0.9, "second_pass": 8, "large_share": 0.07, "icon": 48,
    "beam": 10, "splits": 3, "expansions": 64, "depth": 7, "local_weight": 0.10,
}
POLICIES = {
    "hero": {"bias": 0.40, "minimum": 0.95, "cut": 0.80, "fragment": 0.40},
    "navigation": {"bias": 0.35, "minimum": 0.90, "fragment": 0.45, "prefer": ("vertical",)},
    "text_section": {"bias": 0.35, "minimum": 0.85, "cut": 0.80, "group": 0.10, "fragment": 0.60},
    "card_grid": {"bias": 0.05, "minimum": 0.60, "group": 0.45, "repeat": 0.40, "broken": 0.80, "prefer": ("horizontal", "vertical")},
    "two_column": {"bias": 0.05, "minimum": 0.60, "cut": 0.80, "group": 0.15, "direction": 0.50, "prefer": ("vertical",)},
    "list": {"bias": 0.20, "minimum": 0.75, "repeat": 0.25, "broken": 0.80, "prefer": ("horizontal",)},
    "footer": {"bias": 0.25, "minimum": 0.75, "fragment": 0.40, "prefer": ("vertical",)},
    "mixed": {"bias": 0.10, "minimum": 0.45, "group": 0.15, "broken": 0.80, "prefer": ("horizontal", "vertical")},
}
REWARDS = {"separator": 0.20, "cohesion": 0.25, "groups": 0.20, "repeats": 0.12, "direction": 0.08, "background": 0.10, "visual": 0.10}
PENALTIES = {"empty": 0.45, "thin_text": 0.25, "small_single": 0.15, "broken_large": 0.40, "under": 0.40, "cost": 0.08}


def unit(x: float) -> float:
    return 0.0 if x <= 0 else 1.0 if x >= 1 else round(x, 6)


def common_area(a: Box, b: Box) -> int:
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def hull(boxes: list[Box]) -> Box:
    ls, ts, rs, bs = zip(*boxes, strict=True)
    return min(ls), min(ts), max(rs), max(bs)


def crosses(line: tuple, box: Box) -> bool:
    """line: direction, position, start, end."""
    direction, at, start, end = line[:4]
    a, b, lo, hi = (box[0], box[2], box[1], box[3]) if direction == "vertical" else (box[1], box[3], box[0], box[2])
    return a < at < b and max(lo, start) < min(hi, end)


# Groups of aligned neighbours


def neighbours(boxes: dict[int, Box]) -> dict[int, dict[str, dict[int, int]]]:
    """Per box and side the unblocked neighbours there with their gaps."""
    out = {i: {s: {} for s in ("right", "left", "bottom", "top")} for i in boxes}
    for i, a in boxes.items():
        for j, b in boxes.items():
            if i == j:
                continue
            if a[1] < b[3] and b[1] < a[3]:
                axis, band = 0, (max(a[1], b[1]), min(a[3], b[3]))
            elif a[0] < b[2] and b[0] < a[2]:
                axis, band = 1, (max(a[0], b[0]), min(a[2], b[2]))
            else:
                continue
            ahead = a[axis + 2] <= b[axis]
            if not ahead and b[axis + 2] > a[axis]:
                continue
            side = (("right", "left"), ("bottom", "top"))[axis][0 if ahead else 1]
            other = 1 - axis

            def between(c: Box, ahead=ahead, axis=axis, other=other, band=band, a=a, b=b) -> bool:
                if not (band[0] < c[other + 2] and band[1] > c[other]):
                    return False
                return a[axis + 2] <= c[axis] < b[axis] if ahead else b[axis + 2] < c[axis + 2] <= a[axis]

            if not any(k not in (i, j) and between(c) for k, c in boxes.items()):
                out[i][side][j] = b[axis] - a[axis + 2] if ahead else a[axis] - b[axis + 2]
    return out


def grow_groups(boxes: dict[int, Box], tolerance: float = 0.03) -> list[list[int]]:
    """Sets of boxes reached over aligned sides, seeds by id; every box is in one set only."""
    near = neighbours(boxes)
    links: dict[int, list[int]] = {}
    for i, sides in near.items():
        links[i] = []
        for side in ("right", "left", "bottom", "top"):
            if len(sides[side]) != 1:
                continue
            (j, gap), a = next(iter(sides[side].items())), boxes[i]
            b = boxes[j]
            k = 1 if side in ("right", "left") else 0
            most = max(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]) * tolerance
            if gap >= 0 and abs(a[k] - b[k]) <= most and abs(a[k + 2] - b[k + 2]) <= most:
                links[i].append(j)
    seen: set[int] = set()
    found = []
    for seed in sorted(boxes):
        if seed in seen:
            continue
        seen.add(seed)
        group, queue = [seed], deque([seed])
        while queue:
            for j in links[queue.popleft()]:
                if j not in seen:
                    seen.add(j)
                    group.append(j)
                    queue.append(j)
        found.append(group)
    return found


def bands(boxes: list[Box], axis: int) -> int:
    """How many rows (axis 1) or columns (axis 0) boxes fall in: a box joins the first band whose first box spans its centre."""
    heads: list[Box] = []
    for box in sorted(boxes, key=lambda b: (b[axis], b[1 - axis])):
        centre = (box[axis] + box[axis + 2]) / 2
        if not any(h[axis] <= centre <= h[axis + 2] for h in heads):
            heads.append(box)
    return len(heads)


def group_type(boxes: list[Box]) -> str | None:
    rows, columns = bands(boxes, 1), bands(boxes, 0)
    if rows > 1 and columns > 1 and rows * columns == len(boxes):
        return "grid"
    if len(boxes) > 1 and rows == 1:
        return "row"
    return "column" if len(boxes) > 1 and columns == 1 else None


@dataclass(frozen=True)
class Group:
    number: int
    kind: str
    box: Box
    members: tuple[int, ...]
    label: str

    @property
    def semantic(self) -> bool:
        """Text and grids count; narrow columns and low rows of icons do not."""
        w, h = self.box[2] - self.box[0], self.box[3] - self.box[1]
        return self.label == "Text" or self.kind == "grid" or not (self.kind == "column" and w <= 64 or self.kind == "row" and h <= 64)


def layout_groups(elements: list[dict], lines: list[tuple]) -> list[Group]:
    out: list[Group] = []
    for label, own in (("Text", [e for e in elements if e["text"]]), ("Compo", [e for e in elements if not e["text"]])):
        boxes = {e["id"]: e["box"] for e in own}
        for members in grow_groups(boxes):
            kind = group_type([boxes[i] for i in members])
            box = hull([boxes[i] for i in members])
            if kind and not any(crosses(line, box) for line in lines):
                out.append(Group(len(out), kind, box, tuple(sorted(members)), label))
    return out


# Overlaps and projections


def normalise(boxes: list[tuple[int, Box]], same: float = 0.90, inside: float = 0.95) -> tuple[list[Box], list[tuple[str, int, int]]]:
    """Boxes without overlaps, and what was done.

    The first overlapping pair in order (top, left, bottom, right, id) is replaced by
    one box and the order is made anew, until no pair overlaps.
    """
    order = lambda x: (x[1][1], x[1][0], x[1][3], x[1][2], x[0])
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    now, done = sorted(boxes, key=order), []
    while True:
        pair = next(((i, j) for i in range(len(now)) for j in range(i + 1, len(now)) if common_area(now[i][1], now[j][1])), None)
        if pair is None:
            return [b for _, b in now], done
        (p, a), (q, b) = now[pair[0]], now[pair[1]]
        c = common_area(a, b)
        larger = min((p, a), (q, b), key=lambda x: (-size(x[1]), x[0]))
        if c / (size(a) + size(b) - c) >= same:
            what, kept = "duplicate_keep_preferred", larger
        elif c / size(a) >= inside or c / size(b) >= inside:
            what, kept = "containment_keep_larger", larger
        else:
            what, kept = "intersection_merge_enclosing", (min(p, q), hull([a, b]))
        done.append((what, p, q))
        now = sorted([x for k, x in enumerate(now) if k not in pair] + [kept], key=order)


def spans(boxes: list[Box], axis: int, region: Box) -> list[tuple[int, int]]:
    """Merged intervals of boxes on an axis within a region; touching ones coalesce."""
    l, t, r, b = region
    low, high = region[axis], region[axis + 2]
    cut = []
    for box in boxes:
        x, y, x2, y2 = box
        if (x2 if x2 < r else r) > (x if x > l else l) and (y2 if y2 < b else b) > (y if y > t else t):
            lo, hi = box[axis], box[axis + 2]
            cut.append((lo if lo > low else low, hi if hi < high else high))
    if not cut:
        return []
    cut.sort()
    out: list[tuple[int, int]] = []
    start, end = cut[0]
    for lo, hi in cut:
        if lo > end:
            out.append((start, end))
            start, end = lo, hi
        elif hi > end:
            end = hi
    out.append((start, end))
    return out


def projection_tree(boxes: list[Box], page: Box, depth: int = 2, most: int = 20, gap: int = 8, narrow: int = 24, low: int = 16) -> list[tuple]:
    """node, parent, depth, box, kind of the tree of the widest valid gaps, y before x at equal width."""
    nodes: list[tuple] = []
    leaves = 1

    def build(region: Box, own: list[Box], level: int, parent: int | None) -> None:
        nonlocal leaves
        number = len(nodes)
        nodes.append((number, parent, level, region, "atomic"))
        if level >= depth or leaves >= most:
            return
        found = []
        for axis in (1, 0):
            merged = spans(own, axis, region)
            found += [(a[1] - b[0], 1 - axis, a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False) if b[0] - a[1] >= gap]
        for _, across, lo, hi in sorted(found):
            axis, at = 1 - across, round((lo + hi) / 2)
            first, second = list(region), list(region)
            first[axis + 2] = second[axis] = at
            pair = (tuple(first), tuple(second))
            small = any(c[2] - c[0] < narrow or c[3] - c[1] < low for c in pair)
            parts = [[b for b in own if common_area(b, c)] for c in pair]
            if small or not all(parts) or any(b[axis] < at < b[axis + 2] for b in own):
                continue
            leaves += 1
            nodes[number] = (number, parent, level, region, "column" if axis else "row")
            for c, part in zip(pair, parts, strict=True):
                build(c, part, level + 1, number)
            return

    build(page, [b for b in boxes if common_area(b, page)], 0, None)
    return nodes


# Regions: features, type, cuts, decisions


@dataclass
class Page:
    width: int
    height: int
    elements: list[dict]
    lines: list[tuple]
    groups: list[Group]
    memo: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)
    leaves: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))
    looks: dict = field(default_factory=dict)

    def within(self, region: Box) -> list[dict]:
        """The elements that overlap a region, looked up once for each region."""
        if region not in self.held:
            l, t, r, b = region
            self.held[region] = [e for x, y, x2, y2, e in self.placed if x < r and l < x2 and y < b and t < y2]
        return self.held[region]

    @cached_property
    def placed(self) -> list[tuple]:
        return [(*e["box"], e) for e in self.elements]

    @property
    def box(self) -> Box:
        return 0, 0, self.width, self.height

    @cached_property
    def semantic(self) -> int:
        return max(1, sum(g.semantic for g in self.groups))


def regularity(values: list[float], floor: float = 1.0) -> float:
    """One less the deviation by the mean. Up to seven values are added one after another, as NumPy adds them."""
    n = len(values)
    if n > 7:
        return 1 - float(np.std(values)) / max(floor, float(np.mean(values)))
    mean, squares = sum(values) / n, 0.0
    for x in values:
        squares += (x - mean) * (x - mean)
    return 1 - sqrt(squares / n) / max(floor, mean)


def measure(page: Page, region: Box) -> dict:
    """The feature row of a region. Without pixels the colour measures are those of a plain page."""
    l, t, r, b = region
    w, h = r - l if r > l else 1, b - t if b > t else 1
    size = max(1, (r - l) * (b - t))
    boxes, texts, dense, back, largest = [], [], 0, 0, 0
    for e in page.within(region):
        box = x, y, x2, y2 = e["box"]
        across, down = (x2 if x2 < r else r) - (x if x > l else l), (y2 if y2 < b else b) - (y if y > t else t)
        common = across * down if across > 0 and down > 0 else 0
        if e["role"] != "foreground":
            back += common
            if common > largest:
                largest = common
            continue
        boxes.append(box)
        dense += common
        if e["text"]:
            texts.append(box)
        elif common > largest:
            largest = common
    front, kinds = len(boxes), [g.kind for g in page.groups if common_area(g.box, region)] if page.groups else []
    same_size = same_step = hgap = vgap = hspread = vspread = 0.0
    if front >= 2:
        same_size = unit((regularity([x[2] - x[0] for x in boxes]) + regularity([x[3] - x[1] for x in boxes])) / 2)
        down, over = sorted(boxes, key=itemgetter(1, 0)), sorted(boxes)
        hgap = unit(max(0, *[y[1] - x[3] for x, y in zip(down, down[1:], strict=False)]) / h)
        vgap = unit(max(0, *[y[0] - x[2] for x, y in zip(over, over[1:], strict=False)]) / w)
    if len(texts) >= 2:
        middles = [(x[0] + x[2]) / 2 for x in texts]
        hspread = unit((max(middles) - min(middles)) / w)
        middles = [(x[1] + x[3]) / 2 for x in texts]
        vspread = unit((max(middles) - min(middles)) / h)
    if front >= 3:
        best = 0.0
        for k in (0, 1):
            c = sorted([(x[k] + x[k + 2]) / 2 for x in boxes])
            steps = [y - x for x, y in zip(c, c[1:], strict=False) if y - x > 1]
            if len(steps) >= 2:
                best = max(best, regularity(steps))
        same_step = unit(best)
    hline = vline = 0.0
    for d, p, start, end in page.lines:
        if d == "horizontal":
            if t < p < b:
                hline = max(hline, (min(r, end) - max(l, start)) / w)
        elif l < p < r:
            vline = max(vline, (min(b, end) - max(t, start)) / h)
    if hline:
        hline = unit(hline)
    if vline:
        vline = unit(vline)
    middle = (t + b) / 2 / page.height
    return {
        "front": front, "texts": len(texts), "others": front - len(texts), "text_ratio": len(texts) / front if front else 0.0,
        "density": unit(dense / size), "container": unit(back / size) if back else 0.0, "largest": unit(largest / size) if largest else 0.0,
        "height": unit((b - t) / page.height), "area": unit((r - l) * (b - t) / (page.width * page.height)), "groups": len(kinds), "background": 1.0,
        "row": kinds.count("row"), "column": kinds.count("column"), "grid": kinds.count("grid"),
        "same_size": same_size, "same_step": same_step, "hgap": hgap, "vgap": vgap, "hspread": hspread, "vspread": vspread,
        "position": "header" if middle <= 0.2 else "footer" if middle >= 0.82 else "content",
        "hline": hline, "vline": vline, "repeat": (same_size + same_step) / 2, "v": vgap if vgap >= vline else vline, "h": hgap if hgap >= hline else hline,
    }


def type_scores(m: dict) -> list[float]:
    """How well a region fits each type, in the order of TYPES."""
    bg, text, rep, v, h = m["background"], m["text_ratio"], m["repeat"], m["v"], m["h"]
    front, texts, step = m["front"], m["texts"], m["same_step"]
    header, footer = m["position"] == "header", m["position"] == "footer"
    four, six, eight = front / 4 if front < 4 else 1.0, front / 6 if front < 6 else 1.0, front / 8 if front < 8 else 1.0
    height, largest, most = m["height"], m["largest"], h if h >= v else v
    row, column, grid, groups, others, vspread = m["row"], m["column"], m["grid"], m["groups"], m["others"], m["vspread"]
    hero = 0.20 * m["area"] + 0.25 * largest + 0.20 * (1 - (texts / 8 if texts < 8 else 1.0)) + 0.20 * bg + 0.15 * (1 - rep)
    off = 1 - abs(height - 0.55) / 0.45
    two = 0.25 * v + 0.25 * v / (v + h if v + h > 0.01 else 0.01) + 0.15 * four + 0.25 * (off if off > 0 else 0.0) + 0.10 * (1 - h)
    scores = (
        hero * (0.35 if largest < 0.2 and m["container"] < 0.35 else 1),
        0.25 * header + 0.20 * (1 - (height / 0.25 if height < 0.25 else 1.0)) + 0.20 * m["hspread"] + 0.15 * text + 0.20 * bg,
        0.30 * footer + 0.20 * text + 0.15 * six + 0.20 * ((column + grid) / 2 if column + grid < 2 else 1.0) + 0.15 * bg,
        0.35 * rep + 0.30 * ((row + grid) / 2 if row + grid < 2 else 1.0) + 0.20 * six + 0.15 * most,
        two * (0.4 if front < 4 or v < 0.15 or v <= h else 1),
        0.30 * step + 0.20 * m["same_size"] + 0.20 * vspread + 0.15 * (row / 2 if row < 2 else 1.0) + 0.15 * text,
        0.35 * text + 0.20 * (1 - (others / 3 if others < 3 else 1.0)) + 0.20 * vspread + 0.15 * (1 - h) + 0.10 * bg,
        0.25 * eight + 0.20 * (groups / 3 if groups < 3 else 1.0) + 0.15 * (1 - text) + 0.15 * (1 - rep) + 0.25 * most,
    )
    return [x if 0.0 < x < 1.0 else 0.0 if x <= 0 else 1.0 for x in scores]


def best_type(scores: list[float]) -> str:
    best = max(scores)
    return TYPES[scores.index(best)] if best >= 0.42 else "mixed"  # the first of equal ones


def region_type(m: dict) -> tuple[str, float]:
    scores = type_scores(m)
    kind = best_type(scores)
    own = scores.pop(TYPES.index(kind))
    return kind, unit(0.7 * own + 0.3 * max(0.0, own - max(scores)))


@dataclass(slots=True)
class Cut:
    direction: str
    at: int
    sources: set[str]
    gap: int = 0
    colour: float = 0.0
    score: float = 0.0
    why: tuple[str, ...] = ()
    cut_front: tuple[int, ...] = ()
    cut_groups: tuple[int, ...] = ()
    cut_large: tuple[int, ...] = ()
    region: Box = (0, 0, 0, 0)

    @property
    def line(self) -> tuple:
        l, t, r, b = self.region
        return (self.direction, self.at, t, b) if self.direction == "vertical" else (self.direction, self.at, l, r)

    @property
    def children(self) -> tuple[Box, Box]:
        l, t, r, b = self.region
        return ((l, t, self.at, b), (self.at, t, r, b)) if self.direction == "vertical" else ((l, t, r, self.at), (l, self.at, r, b))


def gather(found: list[Cut], direction: str, at: int, source: str, gap: int = 0, colour: float = 0.0, reach: int = 4) -> None:
    """Add evidence to the first cut of the direction within reach, which keeps its place, or as a new one."""
    for cut in found:
        if cut.direction == direction and abs(cut.at - at) <= reach:
            cut.sources.add(source)
            cut.gap, cut.colour = max(cut.gap, gap), max(cut.colour, colour)
            return
    found.append(Cut(direction, at, {source}, gap, colour))


def evidence(page: Page, region: Box, front: list[dict], large: list[Box], groups: list[Group]) -> list[Cut]:
    l, t, r, b = region
    found: list[Cut] = []
    boxes = [e["box"] for e in front]
    for direction, at, start, end in page.lines:
        lo, hi, a, z = (l, r, t, b) if direction == "vertical" else (t, b, l, r)
        if lo < at < hi and min(z, end) - max(a, start) >= (z - a) * 0.5:
            gather(found, direction, at, "lsd")
    for direction, axis in (("horizontal", 1), ("vertical", 0)):
        merged = spans(boxes, axis, region)
        for x, y in zip(merged, merged[1:], strict=False):
            if y[0] - x[1] >= PARAMETERS["minimum_gap"]:
                gather(found, direction, round((x[1] + y[0]) / 2), "whitespace", y[0] - x[1])
    for g in groups:
        for direction, k in (("vertical", 0), ("vertical", 2), ("horizontal", 1), ("horizontal", 3)):
            gather(found, direction, g.box[k], "layout_group")
    for box in large:
        if box[3] - box[1] >= (b - t) * 0.5:
            gather(found, "vertical", box[0], "component_boundary")
            gather(found, "vertical", box[2], "component_boundary")
        if box[2] - box[0] >= (r - l) * 0.5:
            gather(found, "horizontal", box[1], "component_boundary")
            gather(found, "horizontal", box[3], "component_boundary")
    return sorted(found, key=lambda c: (c.direction, c.at))


def text_axis(front: list[dict], region: Box, page: Page) -> str | None:
    """The axis along which a region's texts run; none with a large other element or tall text."""
    texts = [e["box"] for e in front if e["text"]]
    if len(texts) < 2 or any(max(e["box"][2] - e["box"][0], e["box"][3] - e["box"][1]) > 48 for e in front if not e["text"]):
        return None
    tall, wide = median(b[3] - b[1] for b in texts), median(b[2] - b[0] for b in texts)
    if tall > max(96, round(0.035 * page.height)):
        return None
    xs, ys = [(b[0] + b[2]) / 2 for b in texts], [(b[1] + b[3]) / 2 for b in texts]
    across, down, w, h = max(xs) - min(xs), max(ys) - min(ys), region[2] - region[0], region[3] - region[1]
    vertical, horizontal = across <= 0.35 * w and down >= 2 * tall, down <= 0.35 * h and across >= 2 * wide
    if vertical and horizontal:
        return "vertical" if down / max(1, h) >= across / max(1, w) else "horizontal"
    return "vertical" if vertical else "horizontal" if horizontal else None


def big(e: dict, region: Box) -> bool:
    return common_area(e["box"], region) / max(1, (region[2] - region[0]) * (region[3] - region[1])) >= PARAMETERS["large_share"]


def rate(page: Page, region: Box, cut: Cut, front: list[dict], back: list[dict], groups: list[Group], axis: str | None) -> Cut:
    """Fill in a cut's score and the reasons against it."""
    p, at = PARAMETERS, cut.at
    cut.region = region
    k = 0 if cut.direction == "vertical" else 1
    low, high, start, end = region[k], region[k + 2], region[1 - k], region[3 - k]

    def hit(e: dict) -> bool:
        box = e["box"]
        return max(box[1 - k], start) < min(box[3 - k], end)

    cut.cut_front = tuple([e["id"] for e in front if e["box"][k] < at < e["box"][k + 2] and hit(e)]) if front else ()
    behind = sum([e["box"][k] < at < e["box"][k + 2] and hit(e) for e in back]) if back else 0
    crossed = [g for g in groups if g.box[k] < at < g.box[k + 2] and max(g.box[1 - k], start) < min(g.box[3 - k], end)] if groups else []
    cut.cut_groups = tuple([g.number for g in crossed if g.semantic]) if crossed else ()
    strong = "lsd" in cut.sources or "component_boundary" in cut.sources or cut.colour >= 0.75
    if not strong and "layout_group" not in cut.sources and (cut.cut_front or behind):
        cut.cut_large = tuple([e["id"] for e in front + back if e["box"][k] < at < e["box"][k + 2] and hit(e) and big(e, region)])
    before, after = 0, len(front)
    for e in front:
        x = e["box"]
        before += (x[k] + x[k + 2]) / 2 < at
    for e in back:
        if big(e, region):
            x = e["box"]
            before += (x[k] + x[k + 2]) / 2 < at
            after += 1
    after -= before
    first, second = at - low, high - at
    score = sum([EVIDENCE.get(s, 0.0) for s in cut.sources]) + 0.48 * cut.colour + min(0.28, cut.gap / max(1, first + second) * 2)
    score += 0.34 * min(before, after) / max(1, before, after) + 0.16 * min(first, second) / max(1, first, second)
    score -= len(cut.cut_front) * (1.35 / max(1, len(front)) + 0.08) + min(0.12, 0.015 * behind)
    cut.score = round(score, 6)
    run = not strong and axis is not None and axis != cut.direction
    split_text = bool(crossed) and not strong and any(g.label == "Text" and len(g.members) >= 2 for g in crossed)
    checks = (
        (min(first, second) < p["minimum_region"], "child_too_small"), (len(front) < 2, "insufficient_foreground"), (not before or not after, "empty_foreground_child"),
        (run, "semantic_text_run"), (split_text, "semantic_layout_group"), (score < p["minimum_score"], "score_below_threshold"),
    )
    cut.why = tuple([label for bad, label in checks if bad])
    return cut


@dataclass(slots=True)
class Choice:
    score: float
    cut: Cut | None
    reasons: tuple[str, ...]


def apart(cuts: list[Cut], reach: int = 8) -> list[Cut]:
    """Cuts from the best on, without those near a kept one of the same direction."""
    kept: list[Cut] = []
    for cut in sorted(cuts, key=lambda c: (c.score, len(c.sources), c.gap, -c.at), reverse=True):
        if not any(k.direction == cut.direction and abs(k.at - cut.at) < reach for k in kept):
            kept.append(cut)
    return kept


def weigh(cut: Cut, kind: str, m: dict, policy: dict, groups: list[Group]) -> Choice:
    change, reasons, sources = 0.0, list(cut.why), cut.sources
    grouped = "layout_group" in sources or "component_boundary" in sources
    if cut.direction in policy.get("prefer", ()):
        change += policy.get("direction", 0.0)
        reasons.append("preferred_direction")
    if grouped:
        change += policy.get("group", 0.0)
        reasons.append("layout_group_boundary")
    if m["repeat"] >= 0.6 and kind in ("card_grid", "list"):
        change += policy.get("repeat", 0.0) * m["repeat"]
        reasons.append("repeated_unit_boundary")
    if cut.cut_large and not (grouped or "lsd" in sources or cut.colour >= 0.75):
        change += -policy.get("cut", 0.0)
        reasons.append("large_component_cut")
    if groups and any([g.semantic and crosses(cut.line, g.box) for g in groups]):
        change += -policy.get("broken", 0.35)
        reasons.append("broken_layout_group")
    if cut.cut_front and kind in ("navigation", "text_section", "footer"):
        change += -policy.get("fragment", 0.0)
        reasons.append("text_fragment")
    total = cut.score + change
    if total < policy.get("minimum", 0.0):
        reasons.append("below_region_minimum")
    if cut.why:
        reasons.append("raw_candidate_rejected")
    return Choice(round(total, 6), cut, tuple(reasons))


def whole(m: dict, kind: str) -> Choice:
    """The choice to leave a region as it is."""
    line = max(m["hline"], m["vline"])
    if kind in ("hero", "navigation", "text_section", "footer"):
        share = min(1.0, 0.45 * m["background"] + 0.25 * m["text_ratio"] + 0.3 * m["largest"])
    else:
        share = min(1.0, m["repeat"]) if kind in ("card_grid", "list") else min(1.0, m["density"] + 0.25 * m["background"])
    loose = min(0.4, 0.08 * (m["row"] + m["column"] + m["grid"]))
    stay = POLICIES[kind]["bias"] + 0.35 * share + 0.2 * m["background"] + 0.2 * m["largest"] - 0.25 * line - loose - min(0.45, 0.25 * line + loose)
    return Choice(round(stay, 6), None, ())


def study(page: Page, region: Box) -> tuple[dict, str, list[Cut], list[Choice]]:
    """Features, type, rated cuts and choices of a region, worked out once for each region."""
    if region in page.memo:
        return page.memo[region]
    own = page.within(region)
    front, back = [e for e in own if e["role"] == "foreground"], [e for e in own if e["role"] != "foreground"]
    groups = [g for g in page.groups if common_area(g.box, region)] if page.groups else []
    large = [e["box"] for e in own if not e["text"] and big(e, region)]
    axis = text_axis(front, region, page)
    cuts = [rate(page, region, c, front, back, groups, axis) for c in evidence(page, region, front, large, groups)]
    m = measure(page, region)
    kind = best_type(type_scores(m))
    policy = POLICIES[kind]
    rated = [weigh(c, kind, m, policy, groups) for c in apart(cuts)]
    best = [max(own_way, key=lambda c: c.score) for d in ("horizontal", "vertical") if (own_way := [c for c in rated if c.cut.direction == d])]
    semantic = [c for c in rated if ("layout_group" in c.cut.sources or "component_boundary" in c.cut.sources) and not any([c is x for x in best])]
    if semantic:
        best.append(max(semantic, key=lambda c: c.score))
    choices = [whole(m, kind), *best[:3]]
    choices.sort(key=lambda c: (-c.score, c.cut is not None))
    page.memo[region] = (m, kind, cuts, choices)
    return page.memo[region]


@dataclass(slots=True)
class Look:
    """What a search needs of a region: features, type, the choice to leave it whole, the cuts it may follow, and cohesion with and without a fragmented text."""

    m: dict
    kind: str
    stay: Choice
    cuts: list[Choice]
    cohesion: tuple[float, float]


def look(page: Page, region: Box) -> Look:
    """As study, but cuts that a search may not follow are left out: below two foreground elements all are refused, so none is rated."""
    found = page.looks.get(region)
    if found is None:
        if sum([e["role"] == "foreground" for e in page.within(region)]) < 2:
            m = measure(page, region)
            kind = best_type(type_scores(m))
            stay, cuts = whole(m, kind), []
        else:
            m, kind, _, choices = study(page, region)
            stay = next(c for c in choices if c.cut is None)
            cuts = [c for c in choices if c.cut and BLOCKED.isdisjoint(c.reasons)][: PARAMETERS["splits"]]
        base = raw_cohesion(m, kind)
        found = page.looks[region] = Look(m, kind, stay, cuts, (unit(base - 0.0), unit(base - 0.4)))
    return found


# Tree search


#: Reasons that keep a search from following a cut.
BLOCKED = frozenset({"raw_candidate_rejected", "below_region_minimum", "large_component_cut"})


#: Sums that a tree's score is made of. The first six follow the decisions, the others the leaves.
SUMS = ("cuts", "separator", "direction", "boundary", "cohesion", "units", "repeat", "leaves", "empty", "thin_text", "small_single", "under", "filled")
_AT = {name: i for i, name in enumerate(SUMS)}


@dataclass(slots=True)
class State:
    """steps: (region, depth, choice) in the order decided; pending: (region, depth); sums as in SUMS; groups and large: what the cuts cross."""

    page: Page
    steps: tuple = ()
    pending: tuple = ()
    local: float = 0.0
    sums: tuple = (0.0,) * len(SUMS)
    groups: frozenset = frozenset()
    large: frozenset = frozenset()
    scored: float | None = None

    @property
    def score(self) -> float:
        """Made when first asked for: most states are grown on without being ranked."""
        if self.scored is None:
            self.scored = tree_score(self.page, self) if self.steps else 0.0
        return self.scored

    @property
    def average(self) -> float:
        return self.local / max(1, len(self.steps))

    def key(self) -> tuple:
        """Equal for equal trees: regions are decided in a fixed order."""
        return tuple((r, c.cut and (c.cut.direction, c.cut.at)) for r, _, c in self.steps)


class Spelling:
    """A state's tree written out, for the order of states of equal rank; made only when asked for.

    The keys and their order are fixed: equal ranks are ordered by this text.
    """

    def __init__(self, page: Page, state: State):
        self.page, self.state, self.text = page, state, None

    def spelled(self) -> str:
        if self.text is None:
            decided = {(r, d): c for r, d, c in self.state.steps}

            def node(region: Box, depth: int) -> dict:
                out, choice = {"bbox": list(region)}, decided.get((region, depth))
                if choice is None:
                    return out
                out["region_type"] = look(self.page, region).kind
                if choice.cut:
                    _, at, a, z = choice.cut.line
                    upright = choice.cut.direction == "vertical"
                    ends = {"x1": at, "y1": a, "x2": at, "y2": z} if upright else {"x1": a, "y1": at, "x2": z, "y2": at}
                    named = [x for x in PRIORITY if x in choice.cut.sources]
                    out |= {"split_line": ends | {"direction": choice.cut.direction, "source": named[0]}, "split_score": choice.score, "split_sources": named}
                    out["children"] = [node(c, depth + 1) for c in choice.cut.children]
                return out

            self.text = repr(node(self.page.box, 0))
        return self.text

    def __lt__(self, other: Spelling) -> bool:
        return self.spelled() < other.spelled()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Spelling) and self.spelled() == other.spelled()


def leaf_sums(page: Page, region: Box, decided: bool) -> tuple:
    """What a region adds to the sums from "leaves" on as a leaf; decided: it was left whole, not just not looked at."""
    known = page.leaves[decided]
    found = known.get(region)
    if found is None:
        own = page.within(region)
        single, under = False, 0.0
        if len(own) == 1:
            l, t, r, b = own[0]["box"]
            single = (r - l) * (b - t) / max(1, page.width * page.height) < 0.04 and (own[0]["text"] or r - l < 48 and b - t < 48)
        elif len(own) >= 4:
            m = look(page, region).m if decided else None
            under = unit(max(m["v"], m["h"]) * min(1.0, len(own) / 8)) if m else min(1.0, len(own) / 12)
        thin = bool(own) and region[3] - region[1] <= max(96, page.height * 0.035) and all([e["text"] for e in own])
        found = known[region] = (1, not own, thin, single, under, bool(own))
    return found


def raw_cohesion(m: dict, kind: str) -> float:
    base = 0.35 * m["background"] + 0.2 * m["density"]
    if kind in ("hero", "navigation", "text_section", "footer"):
        return base + (0.2 * m["text_ratio"] + 0.25 * m["largest"])
    return base + (0.225 * (m["same_size"] + m["same_step"]) if kind in ("card_grid", "list") else 0.2)


def cohesion(m: dict, kind: str, choice: Choice) -> float:
    return unit(raw_cohesion(m, kind) - (0.4 if choice.cut and "text_fragment" in choice.reasons else 0.0))


def tree_terms(page: Page, state: State) -> tuple[dict, dict]:
    """The rewards and penalties of a tree, each in 0..1, from its sums."""
    s = dict(zip(SUMS, state.sums, strict=True))
    semantic, boxes = page.semantic, max(1, len(page.elements))
    cuts, leaves, steps = max(1, s["cuts"]), max(1, s["leaves"]), max(1, len(state.steps))
    rewards = {
        "separator": s["separator"] / cuts, "cohesion": s["cohesion"] / steps, "groups": 1 - len(state.groups) / semantic, "repeats": s["repeat"] / max(1, s["units"]),
        "direction": s["direction"] / cuts, "background": s["boundary"] / cuts, "visual": 1.0,
    }
    penalties = {k: s[k] / leaves for k in ("empty", "thin_text", "small_single")} | {"broken_large": len(state.large) / boxes, "under": s["under"] / leaves, "cost": min(1.0, s["filled"] / boxes)}
    return {k: unit(v) for k, v in rewards.items()}, {k: unit(v) for k, v in penalties.items()}


def tree_score(page: Page, state: State) -> float:
    """The terms of tree_terms weighed and added in their order."""
    cuts, separator, direction, boundary, cohesion, units, repeat, leaves, empty, thin_text, small_single, under, filled = state.sums
    boxes, cuts, leaves, steps = max(1, len(page.elements)), max(1, cuts), max(1, leaves), max(1, len(state.steps))
    w, p = REWARDS, PENALTIES
    rewards = (
        w["separator"] * unit(separator / cuts), w["cohesion"] * unit(cohesion / steps), w["groups"] * unit(1 - len(state.groups) / page.semantic), w["repeats"] * unit(repeat / max(1, units)),
        w["direction"] * unit(direction / cuts), w["background"] * unit(boundary / cuts), w["visual"],
    )
    penalties = (
        p["empty"] * unit(empty / leaves) if empty else 0.0, p["thin_text"] * unit(thin_text / leaves) if thin_text else 0.0,
        p["small_single"] * unit(small_single / leaves) if small_single else 0.0, p["broken_large"] * unit(len(state.large) / boxes) if state.large else 0.0,
        p["under"] * unit(under / leaves), p["cost"] * unit(filled / boxes),
    )
    return round(sum(rewards) - sum(penalties), 6)


def advance(page: Page, state: State, choice: Choice) -> State:
    (region, depth), rest = state.pending[0], state.pending[1:]
    cuts, separator, direction, boundary, held, units, repeat, leaves, empty, thin, single, under, filled = state.sums
    groups, large, cut, seen = state.groups, state.large, choice.cut, look(page, region)
    held += seen.cohesion[cut is not None and "text_fragment" in choice.reasons]
    if seen.kind in ("card_grid", "list"):
        units += 1
        repeat += seen.m["repeat"]
    if depth:
        a, b, c, d, e, f = leaf_sums(page, region, False)
        leaves, empty, thin, single, under, filled = leaves - a, empty - b, thin - c, single - d, under - e, filled - f
    if cut is None:
        a, b, c, d, e, f = leaf_sums(page, region, True)
        leaves, empty, thin, single, under, filled = leaves + a, empty + b, thin + c, single + d, under + e, filled + f
        pending = rest
    else:
        parts = cut.children
        pending = (*[(x, depth + 1) for x in parts], *rest)
        for x in parts:
            a, b, c, d, e, f = leaf_sums(page, x, False)
            leaves, empty, thin, single, under, filled = leaves + a, empty + b, thin + c, single + d, under + e, filled + f
        known = 0.0 if cut.sources.isdisjoint(("lsd", "layout_group", "component_boundary")) else 1.0
        cuts += 1
        separator += min(1.0, cut.score)
        direction += 1.0 if "preferred_direction" in choice.reasons else 0.5
        boundary += max(cut.colour, known)
        if cut.cut_groups:
            groups = groups.union(cut.cut_groups)
        if cut.cut_large:
            large = large.union(cut.cut_large)
    sums = (cuts, separator, direction, boundary, held, units, repeat, leaves, empty, thin, single, under, filled)
    return State(page, (*state.steps, (region, depth, choice)), pending, round(state.local + choice.score, 6), sums, groups, large)


def settle(page: Page, state: State) -> State:
    """Leave all pending regions whole."""
    while state.pending:
        state = advance(page, state, look(page, state.pending[0][0]).stay)
    return state


def search(page: Page) -> list[State]:
    """Finished trees, the best first: a beam over decisions, the first pending region at each step.

    Trees of equal score rank by their average local score, then by fewer decisions,
    then by how they are spelled. States are ranked only where a step makes more than
    the beam holds.
    """
    p = PARAMETERS
    rank = lambda s: (s.score + p["local_weight"] * s.average, s.score, -len(s.steps), Spelling(page, s))
    final = lambda s: (s.score, s.average, -len(s.steps), Spelling(page, s))
    beam, done = [State(page, (), ((page.box, 0),))], []
    while beam:
        grown: list[State] = []  # no two are equal: a state's choices differ, and so do the states they are added to
        for state in beam:
            if not state.pending or len(state.steps) >= p["expansions"]:
                done.append(settle(page, state))
                continue
            region, depth = state.pending[0]
            seen = look(page, region)
            grown.append(advance(page, state, seen.stay))
            if depth < p["depth"]:
                grown += [advance(page, state, choice) for choice in seen.cuts]
        beam = sorted(grown, key=rank, reverse=True)[: p["beam"]] if len(grown) > p["beam"] else grown
    return sorted(done, key=final, reverse=True)[: p["beam"]]


# Layout trees


def layout_tree(state: State, page: Page) -> list[dict]:
    """Nodes in preorder: id, parent, ordinal, depth, box, kind, portion, score, sources, region type, label, owned ids."""
    cuts = {r: c for r, _, c in state.steps if c.cut}
    out: list[dict] = []

    def walk(region: Box, parent: int | None, ordinal: int, depth: int, portion: int) -> None:
        choice = cuts.get(region)
        node = {"id": len(out), "parent": parent, "ordinal": ordinal, "depth": depth, "box": region, "kind": "atomic", "portion": portion, "score": None, "sources": set(), "region_type": look(page, region).kind, "label": None, "owned": []}
        out.append(node)
        if choice is None:
            return
        node |= {"kind": "row" if choice.cut.direction == "vertical" else "column", "score": choice.score, "sources": set(choice.cut.sources)}
        k = 0 if choice.cut.direction == "vertical" else 1
        lengths = [c[k + 2] - c[k] for c in choice.cut.children]
        step = gcd(*lengths) or 1
        for i, (child, length) in enumerate(zip(choice.cut.children, lengths, strict=True)):
            walk(child, node["id"], i, depth + 1, max(1, length // step))

    walk(state.steps[0][0], None, 0, 0, 1)
    return out


def own_elements(tree: list[dict], elements: list[dict], height: int) -> None:
    """Name each leaf's part of the page, and give each element to the smallest leaf around its centre, else the one it covers most; then icons join readable leaves."""
    leaves = [n for n in tree if n["kind"] == "atomic"]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for e in elements:
        l, t, r, b = e["box"]
        x, y = (l + r) / 2, (t + b) / 2
        around = [n for n in leaves if n["box"][0] <= x < n["box"][2] and n["box"][1] <= y < n["box"][3]]
        home = min(around, key=lambda n: area(n["box"])) if around else min(leaves, key=lambda n: (-common_area(n["box"], e["box"]), n["id"]))
        home["owned"].append(e["id"])
    by_id = {e["id"]: e for e in elements}
    icon = lambda e: not e["text"] and max(e["box"][2] - e["box"][0], e["box"][3] - e["box"][1]) <= PARAMETERS["icon"]
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for n in leaves:
        if not n["owned"] or not all(icon(by_id[i]) for i in n["owned"]):
            continue
        hosts = [m for m in leaves if m is not n and any(not icon(by_id[i]) for i in m["owned"])]
        if hosts:
            x, y = centre(n["box"])
            host = min(hosts, key=lambda m: (hypot(centre(m["box"])[0] - x, centre(m["box"])[1] - y), m["id"]))
            host["owned"] += n["owned"]
            n["owned"] = []
    for n in leaves:
        n["owned"].sort()
        n |= {"label": label(n["box"], height)} if n["owned"] else {"kind": "spacer", "region_type": None}


def label(box: Box, height: int) -> str:
    y = (box[1] + box[3]) / 2
    return "header" if y < 0.2 * height else "footer" if y > 0.8 * height else "content"


def merge_weak(tree: list[dict], elements: list[dict], backgrounds: dict[Box, float]) -> list[dict]:
    """Bottom-up: weak same-axis children dissolve into their parent, and runs of compatible leaves become one.

    A run has the label and type of its first leaf. backgrounds: how even the decided regions are.
    """
    by_id, tree = {e["id"]: e for e in elements}, [dict(n) for n in tree]
    children: dict[int, list[dict]] = {n["id"]: [] for n in tree}
    for n in tree:
        if n["parent"] is not None:
            children[n["parent"]].append(n)
    strong = lambda n: n["score"] is None or n["score"] >= PARAMETERS["strong_score"] or {"lsd", "color_change"} & n["sources"]

    def soft(i: int) -> bool:
        e = by_id[i]
        w, h = e["box"][2] - e["box"][0], e["box"][3] - e["box"][1]
        return e["text"] or w <= 64 and h <= 64 or e["role"] != "foreground" and w * h <= 4096

    def joins(run: dict, nxt: dict) -> bool:
        """run: a leaf made of one or more, with the label and type of its first, and their boxes."""
        if not run["owned"] or not nxt["owned"] or run["kind"] != "atomic" or nxt["kind"] != "atomic":
            return False
        same = run["label"] == nxt["label"] and run["region_type"] == nxt["region_type"] != "card_grid"
        return same and all(map(soft, run["owned"] + nxt["owned"])) and all(backgrounds.get(x, 1.0) >= 0.65 for x in (*run.get("boxes", [run["box"]]), nxt["box"]))

    for n in sorted(tree, key=lambda n: -n["depth"]):
        kids: list[dict] = []
        for c in children[n["id"]]:
            kids += children[c["id"]] if c["kind"] == n["kind"] in ("row", "column") and not strong(c) else [c]
        if kids and not strong(n):
            runs: list[dict] = []
            for c in kids:
                if runs and joins(runs[-1], c):
                    last = runs[-1]
                    boxes = [*last.get("boxes", [last["box"]]), c["box"]]
                    last |= {"box": hull(boxes), "boxes": boxes, "owned": sorted(last["owned"] + c["owned"]), "portion": last["portion"] + c["portion"]}
                else:
                    runs.append(c)
            kids = runs
            if len(kids) == 1 and kids[0]["kind"] == "atomic":
                n |= {"kind": "atomic", "score": None, "sources": set()} | {k: kids[0][k] for k in ("owned", "label", "region_type")}
                kids = []
        children[n["id"]] = kids
    out: list[dict] = []

    def walk(n: dict, parent: int | None, ordinal: int, depth: int) -> None:
        made = n | {"id": len(out), "parent": parent, "ordinal": ordinal, "depth": depth}
        out.append(made)
        for i, c in enumerate(children[n["id"]]):
            walk(c, made["id"], i, depth + 1)

    walk(tree[0], None, 0, 0)
    return out


#: Least share that is too much, by ratio. Fixed values.
GATE = {"empty_atomic_ratio": 0.0, "thin_text_atomic_ratio": 0.40, "small_single_element_ratio": 0.45, "broken_layout_group_ratio": 0.10, "large_component_cut_ratio": 0.10, "region_type_mismatch_ratio": 0.10}
MIXED_SHARE = 0.75


def faults(tree: list[dict], elements: list[dict]) -> list[str]:
    """What is wrong with a tree's shape and ownership, with the node's id."""
    found = []
    kids: dict[int | None, list[dict]] = {}
    for n in tree:
        kids.setdefault(n["parent"], []).append(n)
    for n in tree:
        own, name = kids.get(n["id"], []), n["id"]
        if n["kind"] not in ("row", "column", "atomic", "spacer"):
            found.append(f"bad_type:{name}")
        if n["kind"] == "atomic" and own:
            found.append(f"atomic_with_children:{name}")
        if n["kind"] == "spacer" and (own or n["owned"]):
            found.append(f"spacer_with_content:{name}")
        l, t, r, b = n["box"]
        found += [f"child_escapes_parent:{c['id']}" for c in own if c["box"][0] < l or c["box"][1] < t or c["box"][2] > r or c["box"][3] > b]
        found += [f"sibling_overlap:{a['id']},{b['id']}" for i, a in enumerate(own) for b in own[i + 1 :] if common_area(a["box"], b["box"])]
        k = {"row": 0, "column": 1}.get(n["kind"])
        if k is not None and any(a["box"][k] > b["box"][k] for a, b in zip(own, own[1:], strict=False)):
            found.append(f"child_order:{name}")
    owned = [i for n in tree if n["kind"] == "atomic" for i in n["owned"]]
    if len(set(owned)) != len(owned):
        found.append("duplicate_ownership")
    if set(owned) != {e["id"] for e in elements}:
        found.append("incomplete_ownership")
    root = tree[0]["box"]
    half = (root[2] - root[0]) * (root[3] - root[1]) / 2
    wide = [n for n in tree if n["kind"] == "atomic" and (n["box"][2] - n["box"][0]) * (n["box"][3] - n["box"][1]) >= half]
    if len(wide) > 1:
        found.append("page_scale_atomics")
    if len({n["label"] for n in wide if n["label"]}) < sum(bool(n["label"]) for n in wide):
        found.append("page_scale_label_repeated")
    return found


def validate(tree: list[dict], elements: list[dict], groups: list[Group], cuts: list[Cut], selected: list[Cut], profiles: dict[Box, tuple[dict, str]], gate: dict | None = None, mixed_share: float = MIXED_SHARE) -> tuple[list[str], dict]:
    """What is wrong with a tree, in order and once each, and its eleven measures.

    cuts: all rated candidates; selected: those the tree was cut at; profiles: features
    and type of the regions decided, by box.
    """
    found, by_id = faults(tree, elements), {e["id"]: e for e in elements}
    atomics = [n for n in tree if n["kind"] == "atomic"]
    filled = [n for n in atomics if n["owned"]]
    root = tree[0]["box"]
    page_area, total = max(1, (root[2] - root[0]) * (root[3] - root[1])), max(1, len(elements))
    thin = max(96, round((root[3] - root[1]) * 0.035))
    sides = lambda e: (e["box"][2] - e["box"][0], e["box"][3] - e["box"][1])
    area = lambda e: sides(e)[0] * sides(e)[1]

    def weak_single(e: dict) -> bool:
        if e["text"]:
            return sides(e)[1] <= thin and area(e) / page_area < 0.03
        return area(e) / page_area < 0.04 and max(sides(e)) <= 48

    counts = {"thin": 0, "single": 0, "small": 0}
    for n in filled:
        own = [by_id[i] for i in n["owned"]]
        texts = [e["text"] for e in own]
        if not any(texts) and all(max(sides(e)) <= 48 for e in own):
            found.append(f"icon_only_atomic:{n['id']}")
        counts["thin"] += all(texts) and max(e["box"][3] for e in own) - min(e["box"][1] for e in own) <= thin
        counts["single"] += len(own) == 1
        counts["small"] += len(own) == 1 and weak_single(own[0])
    bounded = {c.region for c in cuts if not c.why and c.direction == "vertical" and "component_boundary" in c.sources}
    for n in filled:
        if n["box"] not in profiles:
            continue
        m, kind = profiles[n["box"]]
        if kind == "two_column" and m["front"] >= 4 and m["v"] >= 0.15:
            found.append(f"two_column_unsplit:{n['id']}")
        elif kind in ("text_section", "mixed") and m["texts"] >= 2 and any(by_id[i]["role"] != "foreground" for i in n["owned"]) and n["box"] in bounded:
            found.append(f"heterogeneous_unsplit:{n['id']}")
        elif kind == "mixed" and len(n["owned"]) / total > mixed_share and (max(m["v"], m["h"]) >= 0.45 or m["row"] + m["column"] + m["grid"] >= 2):
            found.append(f"mixed_unsplit:{n['id']}")
    special, wrong, strong = 0, 0, PARAMETERS["strong_score"]
    for c in selected:
        kind = profiles.get(c.region, (None, None))[1]
        special += kind in ("hero", "two_column")
        if kind == "hero" and c.score < strong:
            wrong += 1
            found.append(f"hero_fragmented:{c.region}")
        if kind == "two_column" and c.direction != "vertical":
            wrong += 1
            found.append(f"two_column_cut_across:{c.region}")
    big = sum(area(e) / page_area >= 0.04 for e in elements)
    n = max(1, len(filled))
    ratios = {
        "empty_atomic_ratio": (len(atomics) - len(filled)) / max(1, len(atomics)), "thin_text_atomic_ratio": counts["thin"] / n, "small_single_element_ratio": counts["small"] / n,
        "broken_layout_group_ratio": len({g for c in selected for g in c.cut_groups}) / max(1, sum(g.semantic for g in groups)),
        "large_component_cut_ratio": len({i for c in selected for i in c.cut_large}) / max(1, big), "region_type_mismatch_ratio": wrong / max(1, special),
    }
    found += [f"{k}:{v:.6f}" for k, v in ratios.items() if v > (GATE | (gate or {}))[k]]
    measures = {
        "atomic_count": len(filled), "owned_element_count": len({i for x in atomics for i in x["owned"]}), "largest_atomic_element_ratio": max((len(x["owned"]) / total for x in filled), default=0.0),
        "single_element_atomic_ratio": counts["single"] / n, "weak_separator_ratio": sum(c.score < strong for c in selected) / max(1, len(selected)),
    } | ratios
    return list(dict.fromkeys(found)), {k: round(v, 6) for k, v in measures.items()}


@dataclass
class Analysis:
    tree: list[dict]
    score: float
    faults: list[str]
    rank: int
    measures: dict
    state: State
    again: bool
    rejected: list[tuple[int, float, str]]


def analyse(page: Page) -> Analysis:
    """The first ranked tree that passes validation, else the first; the others with why they were not taken.

    A page whose ranked trees are all single leaves although it has many foreground
    elements is searched again with these and their groups only.
    """
    source, states = page, search(page)
    front = {e["id"] for e in page.elements if e["role"] == "foreground"}
    again = all(len(s.steps) == 1 for s in states) and len(front) >= PARAMETERS["second_pass"]
    if again:
        source = Page(page.width, page.height, [e for e in page.elements if e["id"] in front], page.lines, [g for g in page.groups if front.intersection(g.members)])
        states = search(source)
    cuts = [c for _, _, own, _ in source.memo.values() for c in own]
    first, rejected = None, []
    for rank, state in enumerate(states):
        tree = layout_tree(state, source)
        own_elements(tree, page.elements, page.height)
        profiles = {r: (x.m, x.kind) for r, _, _ in state.steps for x in [look(source, r)]}
        tree = merge_weak(tree, page.elements, {r: m["background"] for r, (m, _) in profiles.items()})
        wrong, measures = validate(tree, page.elements, page.groups, cuts, [c.cut for _, _, c in state.steps if c.cut], profiles)
        made = Analysis(tree, state.score, wrong, rank, measures, state, again, [])
        if not wrong:
            made.rejected = rejected + [(k, s.score, "not_selected_lower_rank") for k, s in enumerate(states[rank + 1 :], rank + 1)]
            return made
        rejected.append((rank, state.score, ",".join(wrong)))
        first = first or made
    first.rejected = rejected
    return first


# HTML


def flex_html(tree: list[dict], content: Callable[[dict], str]) -> str:
    """Nested flex boxes: rows and columns grow by their portions, leaves hold content(node)."""
    kids: dict[int | None, list[dict]] = {}
    for n in tree:
        kids.setdefault(n["parent"], []).append(n)

    def part(n: dict) -> str:
        grow = f"flex:{n['portion']} 1 0;min-width:0;min-height:0"
        if n["kind"] in ("row", "column"):
            return f'<div style="display:flex;flex-direction:{n["kind"]};{grow}">{"".join(map(part, kids.get(n["id"], [])))}</div>'
        return f'<div data-node="{n["id"]}" data-kind="{n["kind"]}" style="{grow}">{content(n) if n["kind"] == "atomic" else ""}</div>'

    return f"<!DOCTYPE html><html><body style=\"margin:0;display:flex\">{part(tree[0])}</body></html>"


def grid_html(tree: list[dict], codes: dict[int, str] | None = None) -> str:
    """Leaves placed absolutely, in percent of the page; codes replace leaves' placeholders by node id."""
    l, t, r, b = tree[0]["box"]
    cells = []
    for n in tree:
        if n["kind"] == "atomic":
            x = n["box"]
            place = [100 * (x[0] - l) / max(1, r - l), 100 * (x[1] - t) / max(1, b - t), 100 * (x[2] - x[0]) / max(1, r - l), 100 * (x[3] - x[1]) / max(1, b - t)]
            style = ";".join(f"{k}:{v:.4f}%" for k, v in zip(("left", "top", "width", "height"), place, strict=True))
            cells.append(f'<div id="{n["id"]}" style="position:absolute;{style}">{(codes or {}).get(n["id"], "")}</div>')
    return f'<html><body style="position:relative">{"".join(cells)}</body></html>'


# Spark


def page_rows(elements: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row for each page with its elements, in order of id, and its lines: one shuffle on page_id."""
    cells = F.struct("element_id", "l", "t", "r", "b", F.col("uied_class"), "role")
    rows = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(cells)).alias("elements"))
    if lines is None:
        return rows.withColumn("lines", F.lit(None).cast("array<struct<direction: string, position: int, start: int, end: int>>"))
    own = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("direction", "position", "start", "end"))).alias("lines"))
    return rows.join(own, "page_id", "left")


def page_of(elements: list[dict], lines: list[dict] | None, width: int, height: int) -> Page:
    own = [{"id": e["element_id"], "box": (e["l"], e["t"], e["r"], e["b"]), "text": e["uied_class"] == "Text", "kind": e["uied_class"], "role": e["role"]} for e in elements]
    found = [(x["direction"], x["position"], x["start"], x["end"]) for x in lines or []]
    return Page(width, height, own, found, layout_groups(own, found))


def unpacked(column: pa.ListArray) -> tuple[list[str], list[list[tuple] | None]]:
    """The names of an array column's struct, and each row's structs as tuples: a field is read for the whole batch at once."""
    names, at, given = [f.name for f in column.type.value_type], column.offsets.to_pylist(), column.is_valid().to_pylist()
    cells = list(zip(*(column.values.field(i).to_pylist() for i in range(len(names))), strict=True))
    return names, [cells[a:b] if own else None for a, b, own in zip(at, at[1:], given, strict=False)]


def per_page(rows: DataFrame, schema: str, emit: Callable[[int, list[dict], list[dict] | None], Iterator[tuple]], once: bool = False) -> DataFrame:
    """emit(page_id, elements, lines) for every row of page_rows.

    once: pages with the same elements and lines are brought together and worked out once,
    as emit's rows differ in the page_id that leads them only.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = None, []
        for batch in batches:
            out = []
            (cells, own), (ends, found) = unpacked(batch.column("elements")), unpacked(batch.column("lines"))
            for page_id, e, x in zip(batch.column("page_id").to_pylist(), own, found, strict=True):
                if not once or last != (e, x):
                    made = [row[1:] for row in emit(page_id, [dict(zip(cells, c, strict=True)) for c in e], x and [dict(zip(ends, c, strict=True)) for c in x])]
                    last = e, x
                out += [(page_id, *row) for row in made]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names)

    rows = rows.select("page_id", "elements", "lines")
    if once:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("content", F.xxhash64("elements", "lines")).repartition(parts, "content").sortWithinPartitions("content").drop("content")
    return rows.mapInArrow(run, schema)


def group_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    def emit(page_id, own, found):
        for g in page_of(own, found, width, height).groups:
            yield page_id, g.number, g.kind, *g.box, ",".join(map(str, g.members)), g.label

    return per_page(page_rows(elements, lines), "page_id long, group_id int, layout_type string, l int, t int, r int, b int, members string, label string", emit)


def normalised_rows(elements: DataFrame) -> DataFrame:
    def emit(page_id, own, _):
        kept, done = normalise([(e["element_id"], (e["l"], e["t"], e["r"], e["b"])) for e in own])
        for i, box in enumerate(kept):
            yield page_id, i, *box, len(done)

    return per_page(page_rows(elements), "page_id long, element_id int, l int, t int, r int, b int, operations int", emit)


def projection_rows(elements: DataFrame, width: int, height: int) -> DataFrame:
    def emit(page_id, own, _):
        boxes, _ = normalise([(e["element_id"], (e["l"], e["t"], e["r"], e["b"])) for e in own])
        for number, parent, depth, box, kind in projection_tree(boxes, (0, 0, width, height)):
            yield page_id, number, parent, depth, *box, kind

    return per_page(page_rows(elements), "page_id long, node_id int, parent_id int, depth int, l int, t int, r int, b int, layout_type string", emit)


def cut_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """All rated cuts of the whole page."""

    def emit(page_id, own, found):
        page = page_of(own, found, width, height)
        for c in study(page, page.box)[2]:
            yield page_id, c.direction, c.at, ",".join(s for s in PRIORITY if s in c.sources), c.score, ",".join(c.why)

    return per_page(page_rows(elements, lines), "page_id long, direction string, position int, sources string, score double, reasons string", emit)


def decision_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """The choices for the whole page, the best first."""

    def emit(page_id, own, found):
        page = page_of(own, found, width, height)
        for i, c in enumerate(study(page, page.box)[3]):
            yield page_id, i, c.cut.direction if c.cut else "no_split", c.cut.at if c.cut else None, c.score, ",".join(c.reasons)

    return per_page(page_rows(elements, lines), "page_id long, place int, decision string, position int, score double, reasons string", emit)


def best_trees(elements: DataFrame, lines: DataFrame, width: int, height: int, schema: str, rows_of: Callable[[Analysis], Iterator[tuple]]) -> DataFrame:
    """page_id and rows_of each page's analysis; schema: of all columns."""

    def emit(page_id, own, found):
        for row in rows_of(analyse(page_of(own, found, width, height))):
            yield page_id, *row

    return per_page(page_rows(elements, lines), schema, emit, once=True)


def tree_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """The layout tree of every page, its score, rank and faults."""

    def rows_of(a):
        for n in a.tree:
            yield n["id"], n["parent"], n["ordinal"], n["depth"], *n["box"], n["kind"], n["portion"], ",".join(map(str, n["owned"])), a.score, a.rank, ",".join(a.faults)

    schema = "page_id long, node_id int, parent_id int, ordinal int, depth int, l int, t int, r int, b int, layout_type string, portion int, owned string, score double, rank int, faults string"
    return best_trees(elements, lines, width, height, schema, rows_of)


def record_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """One row for each page: its tree's faults and score."""
    return best_trees(elements, lines, width, height, "page_id long, faults string, score double", lambda a: [(",".join(a.faults), a.score)])


def spacer_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """The number of spacers of every page that has some."""

    def rows_of(a):
        n = sum(n["kind"] == "spacer" for n in a.tree)
        return [(n,)] if n else []

    return best_trees(elements, lines, width, height, "page_id long, spacers long", rows_of)


def shared_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """The leaves that own several elements."""
    rows_of = lambda a: [(n["id"], ",".join(map(str, n["owned"]))) for n in a.tree if n["kind"] == "atomic" and len(n["owned"]) > 1]
    return best_trees(elements, lines, width, height, "page_id long, node_id int, owned string", rows_of)


def state_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """The states that the beam ends with: rank, score, average local score, decisions, leaves."""

    def emit(page_id, own, found):
        for rank, s in enumerate(search(page_of(own, found, width, height))):
            yield page_id, rank, s.score, round(s.average, 6), len(s.steps), int(s.sums[_AT["leaves"]])

    return per_page(page_rows(elements, lines), "page_id long, rank int, score double, average double, decisions int, leaves int", emit, once=True)


def set_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """What the whole page's candidate set holds: its type, candidates, accepted ones, decisions."""

    def emit(page_id, own, found):
        page = page_of(own, found, width, height)
        _, kind, cuts, choices = study(page, page.box)
        yield page_id, kind, len(cuts), sum(not c.why for c in cuts), len(choices)

    return per_page(page_rows(elements, lines), "page_id long, region_type string, candidates int, accepted int, decisions int", emit)


def analysis_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """One row a page: whether it was searched twice, trees refused, leaves before and after runs merged, and the eleven measures."""
    names = ["atomic_count", "owned_element_count", "largest_atomic_element_ratio", "single_element_atomic_ratio", "weak_separator_ratio", *GATE]

    def emit(page_id, own, found):
        a = analyse(page_of(own, found, width, height))
        leaves = sum(c.cut is None for _, _, c in a.state.steps)
        yield page_id, a.again, sum(why != "not_selected_lower_rank" for *_, why in a.rejected), leaves, sum(n["kind"] in ("atomic", "spacer") for n in a.tree), *(float(a.measures[k]) for k in names)

    return per_page(page_rows(elements, lines), "page_id long, again boolean, refused int, leaves_before int, leaves_after int, " + ", ".join(f"{n} double" for n in names), emit, once=True)


def term_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """Score terms of every page's best tree."""

    def emit(page_id, own, found):
        page = page_of(own, found, width, height)
        state = search(page)[0]
        rewards, penalties = tree_terms(page, state)
        for k, v in (rewards | penalties).items():
            yield page_id, k, v, k in rewards

    return per_page(page_rows(elements, lines), "page_id long, term string, value double, reward boolean", emit, once=True)


def html_rows(elements: DataFrame, lines: DataFrame, width: int, height: int, form: str = "flex") -> DataFrame:
    """page_id, html: flex or grid markup of the tree, leaves naming their elements, or empty skeletons."""

    def emit(page_id, own, found):
        tree = analyse(page_of(own, found, width, height)).tree
        named = lambda n: escape(f"elements {n['owned']}")
        if form == "grid":
            yield page_id, grid_html(tree, {n["id"]: named(n) for n in tree})
        else:
            yield page_id, flex_html(tree, named if form == "flex" else lambda n: "")

    return per_page(page_rows(elements, lines), "page_id long, html string", emit, once=True)


def tree_json(rows: list[dict]) -> str:
    """A node table's page as nested JSON."""
    by = {n["id"]: {"id": n["id"], "box": list(n["box"]), "type": n["kind"], "children": []} for n in rows}
    for n in rows:
        if n["parent"] is not None:
            by[n["parent"]]["children"].append(by[n["id"]])
    return json.dumps(by[rows[0]["id"]])


def json_rows(elements: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    def emit(page_id, own, found):
        yield page_id, tree_json(analyse(page_of(own, found, width, height)).tree)

    return per_page(page_rows(elements, lines), "page_id long, tree string", emit, once=True)
