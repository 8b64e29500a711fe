"""Visual scores: blocks of two pages matched one to one, in Arrow batches of page pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import unpacked
from .similarity import assign, ratcliff

LEAST_TEXT, LEAST_GAIN = 0.5, 0.05


def blocks(elements: DataFrame, width: int = 1200, height: int = 900) -> DataFrame:
    """page_id, element_id, text, x, y, w, h as parts of the page, r, g, b, from page elements."""
    k = F.col("element_id")
    text = F.concat_ws(" ", "uied_class", F.col("l").cast("string"), (F.col("t") % 100).cast("string"))
    colour = [((k * m + 17) % 256).alias(c) for c, m in zip("RGB", (37, 71, 113), strict=True)]
    return elements.select("page_id", "element_id", text.alias("text"), (F.col("l") / width).alias("x"), (F.col("t") / height).alias("y"), ((F.col("r") - F.col("l")) / width).alias("w"), ((F.col("b") - F.col("t")) / height).alias("h"), *colour)


def merged_equal(rows: DataFrame) -> DataFrame:
    """Blocks of one place become one: texts joined in order, colours halved step by step, as later ones weigh more."""
    cells = F.array_sort(F.collect_list(F.struct("element_id", "text", "R", "G", "B")))
    joined = rows.groupBy("page_id", "x", "y", "w", "h").agg(cells.alias("c"))
    fold = lambda n: F.aggregate(F.slice("c", 2, F.size("c")), F.col("c")[0][n], lambda a, v: F.floor((a + v[n]) / 2).cast("int"))
    return joined.select("page_id", "x", "y", "w", "h", F.array_join(F.col("c.text"), " ").alias("text"), *(fold(n).alias(n) for n in "RGB"))


def block_pairs(elements: DataFrame) -> DataFrame:
    """page_id with the blocks of the page and of the next one, as two renderings of a page."""
    cells = F.struct("x", "y", "w", "h", "text", "R", "G", "B")
    own = merged_equal(blocks(elements)).groupBy("page_id").agg(F.array_sort(F.collect_list(cells)).alias("one"))
    return own.join(own.select((F.col("page_id") - 1).alias("page_id"), F.col("one").alias("two")), "page_id")


def row_of(text: str, two: list[dict], known: dict[str, list[float]]) -> list[float]:
    """Similarities of a text with those of two, kept in known."""
    if text not in known:
        known[text] = [ratcliff(text, b["text"]) for b in two]
    return known[text]


def similarities(one: list[dict], two: list[dict], known: dict[str, list[float]] | None = None) -> np.ndarray:
    """Similarities of the texts of one with those of two. known: rows by text, for more calls with the same two."""
    known = {} if known is None else known
    return np.array([row_of(a["text"], two, known) for a in one])


def joined(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    w, h = max(a["x"] + a["w"], b["x"] + b["w"]) - x, max(a["y"] + a["h"], b["y"] + b["h"]) - y
    return {"x": x, "y": y, "w": w, "h": h, "text": f"{a['text']} {b['text']}", **{c: (a[c] + b[c]) // 2 for c in "RGB"}}


def total(sim: np.ndarray) -> float:
    rows, cols = assign(1 - sim)
    return float(sim[rows, cols].sum())


def merge_search(one: list[dict], two: list[dict], known: dict[str, list[float]] | None = None) -> list[dict]:
    """Blocks that follow each other in one are joined while that raises the best assignment's similarity by LEAST_GAIN.

    Joins that cannot raise it so far are not tried: no similarity exceeds what the lengths of its texts allow.
    """
    known = {} if known is None else known
    best = total(similarities(one, two, known))
    while len(one) > 1 and two:
        rows = [known[x["text"]] for x in one]
        trials = []
        for i in range(len(one) - 1):
            text = f"{one[i]['text']} {one[i + 1]['text']}"
            others, least = rows[:i] + rows[i + 2 :], best + LEAST_GAIN
            lengths = [2.0 * min(len(text), len(b["text"])) / max(1, len(text) + len(b["text"])) for b in two]
            if reachable(others, lengths) > least and reachable(others, row_of(text, two, known)) > least:
                trials.append((total(np.array([*rows[:i], known[text], *rows[i + 2 :]])), -i))
        gain, i = max(trials, default=(best, 0))
        if gain <= best + LEAST_GAIN:
            break
        i = -i
        one, best = [*one[:i], joined(one[i], one[i + 1]), *one[i + 2 :]], gain
    return one


def reachable(others: list[list[float]], row: list[float]) -> float:
    """At least the similarity of the best assignment of these rows: every row, or every column, at its best; a little more, for rounding."""
    by_row = max(row) + sum(map(max, others))
    return min(by_row, sum(map(max, zip(row, *others, strict=True)))) + 1e-9


def matched(one: list[dict], two: list[dict], merge: bool) -> tuple[list[dict], list[tuple[int, int, float]]]:
    known: dict[str, list[float]] = {}
    one = merge_search(one, two, known) if merge else one
    sim = similarities(one, two, known)
    rows, cols = assign(1 - sim)
    return one, [(int(i), int(j), float(sim[i, j])) for i, j in zip(rows, cols, strict=True) if sim[i, j] >= LEAST_TEXT]


def pages(batch: pa.RecordBatch) -> Iterator[tuple[int, list[dict], list[dict]]]:
    """page_id, one, two of every row of block_pairs."""
    (names, one), (_, two) = unpacked(batch.column("one")), unpacked(batch.column("two"))
    for page_id, a, b in zip(batch.column("page_id").to_pylist(), one, two, strict=True):
        yield page_id, [dict(zip(names, c, strict=True)) for c in a], [dict(zip(names, c, strict=True)) for c in b]


def matches(pairs: DataFrame, merge: bool = False) -> DataFrame:
    """page_id, i, j, similarity of blocks matched one to one whose texts agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(page_id, i, j, round(s, 6)) for page_id, one, two in pages(batch) for i, j, s in matched(one, two, merge)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["page_id", "i", "j", "similarity"])

    return pairs.mapInArrow(run, "page_id long, i int, j int, similarity double")


def similarity_matrix(pairs: DataFrame) -> DataFrame:
    """page_id, i, j, similarity of the texts of every block of a page with every block of the other rendering.

    All pairs of one page's few blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["page_id"], i, j, round(float(s), 6)) for r in batch.to_pylist() for i, row in enumerate(similarities(r["one"], r["two"])) for j, s in enumerate(row)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["page_id", "i", "j", "similarity"])

    return pairs.mapInArrow(run, "page_id long, i int, j int, similarity double")


def assignment_costs(pairs: DataFrame) -> DataFrame:
    """page_id, i, j, cost of every pair of the best one-to-one assignment; a cost is minus the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost = -similarities(r["one"], r["two"])
                out += [(r["page_id"], int(i), int(j), round(float(cost[i, j]), 6)) for i, j in zip(*assign(cost), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["page_id", "i", "j", "cost"])

    return pairs.mapInArrow(run, "page_id long, i int, j int, cost double")


def visual_scores(pairs: DataFrame, clip: float = 0.0) -> DataFrame:
    """page_id, size, text, position, colour and the final fifth of their sum and the given image similarity.

    Size is matched over all area; text, position (one less the larger axis distance
    of centres) and colour (one less CIEDE2000 / 100) are means over matches. Without
    matches all are 0 but the image's fifth.
    """
    from quoin.functions.geometry import ciede2000_similarity

    schema = "page_id long, i int, size double, similarity double, position double, R1 int, G1 int, B1 int, R2 int, G2 int, B2 int"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, one, two in pages(batch):
                one, found = matched(one, two, True)
                area = lambda x: x["w"] * x["h"]
                inside = sum(area(one[i]) + area(two[j]) for i, j, _ in found)
                whole = sum(map(area, one)) + sum(map(area, two))
                for i, j, s in found or [(-1, -1, 0.0)]:
                    a, b = (one[i], two[j]) if i >= 0 else ({c: 0 for c in "RGB"}, {c: 0 for c in "RGB"})
                    centre = lambda q, k, m: q[k] + q[m] / 2
                    apart = max(abs(centre(a, "x", "w") - centre(b, "x", "w")), abs(centre(a, "y", "h") - centre(b, "y", "h"))) if i >= 0 else 1.0
                    out.append((page_id, i, inside / whole if whole and i >= 0 else 0.0, s, 1 - apart, *(a[c] for c in "RGB"), *(b[c] for c in "RGB")))
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    rows = pairs.mapInArrow(run, schema)
    tone = F.when(F.col("i") >= 0, ciede2000_similarity(tuple(F.col(f"{c}1") for c in "RGB"), tuple(F.col(f"{c}2") for c in "RGB"))).otherwise(0.0)
    means = rows.withColumn("colour", tone).groupBy("page_id").agg(*(F.round(F.avg(c), 6).alias(n) for c, n in (("size", "size"), ("similarity", "text"), ("position", "position"), ("colour", "colour"))))
    return means.withColumn("final", F.round(0.2 * (F.col("size") + F.col("text") + F.col("position") + F.col("colour") + clip), 6))
