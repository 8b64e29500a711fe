import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import ann, decontam, line_dedup

from . import helpers as H


def test_nearest_equal_brute_force_and_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 150)
    monkeypatch.setattr(ann, "QUERIES", 7)
    draw = np.random.default_rng(3)
    v = draw.normal(size=(600, 64)) + 2 * draw.normal(size=(8, 64))[draw.integers(0, 8, 600)]
    v[10:400:2] = v[10]  # one common vector, a third of all rows
    v[11] = 3 * v[10]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(900, None), (950, [0.0] * 64), (1000, [float("nan")] * 64), (1050, [None, *[1.0] * 63]), (1100, [math.inf, *[1.0] * 63]), (1150, [])]
    ids = [*range(600), 0, 450, 450]
    v = np.concatenate([v, v[[7, 451, 452]]])
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, v)]
    table = spark.createDataFrame([*rows, *bad, (None, rows[1][1])], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    hits, found = 0, {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i, x in enumerate(ids) if x % 50 == 0]
    for q in {ids[i] for i in asked}:
        own = [i for i in asked if ids[i] == q]
        assert sorted(r for r, _, _ in found[q]) == sorted([1, 2, 3, 4, 5] * len(own))
        expected = []
        for i in own:
            scores = ann.cosine(np.repeat(v[[i]], len(v), 0), v)
            order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
            expected += [(k + 1, ids[j], round(scores[j], 12)) for k, j in enumerate(order)]
        hits += len(set(expected) & {(a, b, round(c, 12)) for a, b, c in found[q]}) / len(expected)
    assert hits >= 0.97 * len(found) and set(found) == {x for x in ids if x % 50 == 0}


def test_bounds_come_from_codes_and_hold():
    draw = np.random.default_rng(5)
    x = ann.unit(draw.normal(size=(500, 48)) + draw.normal(size=48))
    turn = ann.rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48)) and turn.shape[1] % 64 == 0
    codes, correction = ann.encode(x @ turn)
    planes, figures = ann.quantise(x[:40] @ turn)
    inside, block = [], ann.Codes(codes, correction, 3.0)
    for i in range(40):
        low, high = block.bounds(planes[i], figures[i])
        exact = x @ x[i]
        inside.append(((low <= exact) & (exact <= high)).mean())
        signs = np.unpackbits(codes.view(np.uint8), axis=1).astype(float) * 2 - 1
        estimate = signs @ (x[i] @ turn) / np.sqrt(turn.shape[1]) / correction
        assert np.abs((low + high) / 2 - estimate).max() <= 6 * figures[i][3] / correction.min()
        assert (high - low).mean() < 0.6
    assert np.mean(inside) > 0.99


def test_only_few_vectors_are_scored(spark, monkeypatch):
    """The limits of all blocks together choose; without the bounds every vector would be."""
    draw = np.random.default_rng(6)
    v = draw.normal(size=(3000, 64)) + 2 * draw.normal(size=(40, 64))[draw.integers(0, 40, 3000)]
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    kept, write = {}, ann.table

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(ann, "table", keep)
    ann.nearest(table, F.col("vec_id") % 50 == 0).count()
    assert 60 * 6 <= kept["scored"].count() < 0.1 * 60 * 3000


def test_near_copies_are_not_all_handed_on(spark, monkeypatch):
    """A cluster within the bounds' error is scored where it lies; each task hands on the best of each query."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=64) + 0.02 * draw.normal(size=(2000, 64))
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    kept, write = {}, ann.table

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(ann, "table", keep)
    monkeypatch.setattr(ann, "ROWS", 500)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    exact = ann.unit(v) @ ann.unit(v).T
    np.fill_diagonal(exact, -1)
    hits = sum(got[i, k + 1] in np.argsort(-exact[i])[:5] for i in range(0, 2000, 50) for k in range(5))
    assert hits >= 0.97 * 200 and kept["scored"].count() <= 40 * 6 * 4


def test_few_candidates_and_empty_table(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [1.0, 1.0], "b"), (2, [5.0, 5.0], None)], "vec_id long, embedding array<double>, rank string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(table, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("most", [decontam.BROADCAST_ROWS, 0])
def test_contaminated_documents_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", most)
    draw = random.Random(9)
    items = {i: H.prose(draw, draw.randrange(15, 40), 3000) for i in range(12)} | {50: None, 51: "", 52: "tiny item"}
    texts = {}
    for i in range(120):
        own = H.prose(draw, draw.randrange(5, 120), 3000).split()
        if i % 3 == 0:
            passage = items[i % 12].upper().split() if i % 2 else items[i % 12].split()
            if i % 4 == 1:
                passage[-1] = "changed"
            own[len(own) // 2 : len(own) // 2] = passage
        texts[i] = "\n ".join(own)
    texts |= {200: None, 201: "", 202: " Tiny\tITEM ", 203: items[3], 204: " ".join([H.prose(draw, 30_000, 3000), items[5], H.prose(draw, 30_000, 3000)])}
    docs = spark.createDataFrame([*((i, t, "x") for i, t in texts.items()), (203, items[3], "y"), (None, items[4], None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items.items(), (3, items[3])], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, t in texts.items() for i in H.held_items(t, items)} | {(202, 52), (None, 4)} and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert all(r.similarity >= 0.8 and r.hamming <= decontam.RADIUS for r in got)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_passages_with_a_tenth_replaced_are_found(spark):
    draw = random.Random(21)
    items = {i: H.prose(draw, 50, 3000) for i in range(40)}
    texts = {}
    for i, item in items.items():
        for k, (at, n) in enumerate(((0, 5), (45, 5), (24, 1))):  # head, tail, middle: similarity 0.804 each
            own = item.split()
            own[at : at + n] = [f"x{draw.randrange(9999)}" for _ in range(n)]
            texts[i * 3 + k] = " ".join([H.prose(draw, 12, 3000), *own, H.prose(draw, 9, 3000)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {(d, d // 3) for d in texts} == {(d, i) for d, t in texts.items() for i in H.held_items(t, {d // 3: items[d // 3]})}


def test_multi_index_finds_all_within_the_radius():
    draw = random.Random(2)
    bits = 64 // decontam.BLOCKS
    for _ in range(500):
        flips = draw.sample(range(64), draw.randrange(0, decontam.RADIUS + 1))
        per_block = [sum(f // bits == k for f in flips) for k in range(decontam.BLOCKS)]
        assert min(per_block) <= decontam.FLIPS


def lines_of(texts):
    for d in sorted(texts):
        for k, line in enumerate((texts[d] or "").split("\n")):
            if w := frozenset(x.lower() for x in H.WORD.findall(line)):
                yield d, k, line, w


def test_removed_lines_equal_brute_force(spark):
    draw = random.Random(7)
    base = [H.prose(draw, draw.randrange(1, 25), 200) for _ in range(60)]
    texts = {}
    for i in range(80):
        own = []
        for _ in range(draw.randrange(0, 6)):
            w = draw.choice(base).split()
            if draw.random() < 0.5:
                w[draw.randrange(len(w))] = f"z{draw.randrange(50)}"
            own.append(" ".join(w).upper() if draw.random() < 0.1 else " ".join(w))
        texts[i] = "\n".join(own)
    texts |= {500: None, 501: "", 502: "\n\n", 503: "common line\ncommon line\n \ncommon line"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, line_no int")
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs).collect()}
    rows, first, expected = list(lines_of(texts)), {}, set()
    for d, k, line, w in rows:
        early = [(a, b) for (a, b), (l2, v) in first.items() if l2 == line or 100 * len(v & w) >= 80 * len(v | w)]
        if early:
            expected.add((d, k))
        first[(d, k)] = (line, w)
    classes = {}
    for d, k, line, w in rows:
        classes.setdefault(line, (d, k))
    near = {line for line, at in classes.items() if at in expected}
    expected |= {(d, k) for d, k, line, _ in rows if classes[line] != (d, k) or line in near}
    assert got == expected
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {(r.doc_id, r.n_lines, r.n_removed, r.n_chars) for r in line_dedup.report(docs).collect()} == {(r.doc_id, r.n_lines, r.n_removed, None if r.text is None else len(r.text)) for r in kept.values()}
    assert kept[503].text.split("\n")[0] == "common line" and kept[503].n_removed == 2 and kept[500].text is None and kept[501].text == "" and len(kept) == len(texts)


def test_every_link_of_a_family_of_lines_is_reported(spark):
    base = " ".join(f"w{i}" for i in range(30))
    texts = {i: f"own{i} line of {i}a {i}b\n\n{base} tail{i}" for i in range(6)} | {9: f"{base} tail2"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes = {}
    for d, k, line, w in lines_of(texts):
        classes.setdefault(line, ((d, k), w))
    sets = list(classes.values())
    pairs = {(a, b) for a, v in sets for b, w in sets if a < b and 100 * len(v & w) >= 80 * len(v | w)}
    _, links = line_dedup.matches(docs)
    place = lambda x: (int(x) // 10**10, int(x) % 10**10)
    assert len(pairs) == 15 and {(place(r.earlier), place(r.later)) for r in links.collect()} == pairs
    got = {r.doc_id: (r.classes, r.n_links, r.removed) for r in line_dedup.report(docs).collect()}
    assert got == {i: ([f"{i}:0", f"{i}:2"], 5, [2] if i else []) for i in range(6)} | {9: (["2:2"], 5, [0])}


def test_line_edge_cases(spark):
    schema = "doc_id long, text string, n string"
    rows = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")], schema)
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup.dedup_lines(rows).collect()) == [("1", 0), ("1", 0), ("None", 0)]
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_repeated_rows_do_not_repeat_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i x"), (2, "a b c d e f g h i x")], "doc_id long, text string")
    _, links = line_dedup.matches(docs)
    assert links.count() == 1
    assert {(r.doc_id, r.n_links) for r in line_dedup.report(docs).collect()} == {(1, 1), (2, 1)}
