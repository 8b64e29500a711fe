"""Layout steps on small pages."""

import random
from collections import Counter

import numpy as np
import pytest

from quoin.operators import dom, layout, raster, reports, scoring, similarity, spatial
from quoin.plans import catalogue
from quoin.sources import relations


def element(i, box, text=False, role="foreground"):
    return {"id": i, "box": box, "text": text, "kind": "Text" if text else "Compo", "role": role}


def page(elements, lines=(), width=200, height=200):
    return layout.Page(width, height, elements, list(lines), layout.layout_groups(elements, list(lines)))


@pytest.mark.parametrize(
    ("boxes", "kept", "operations"),
    [
        ([(0, 0, 10, 10), (0, 0, 10, 10)], [(0, 0, 10, 10)], ["duplicate_keep_preferred"]),
        ([(0, 0, 20, 20), (2, 2, 5, 5)], [(0, 0, 20, 20)], ["containment_keep_larger"]),
        ([(0, 0, 10, 10), (8, 0, 18, 10), (16, 0, 26, 10)], [(0, 0, 26, 10)], ["intersection_merge_enclosing"] * 2),
        ([(0, 0, 5, 5), (10, 0, 15, 5)], [(0, 0, 5, 5), (10, 0, 15, 5)], []),
    ],
)
def test_normalised_overlaps(boxes, kept, operations):
    for order in (list(enumerate(boxes)), list(enumerate(boxes))[::-1]):
        got, done = layout.normalise(order)
        assert got == kept and [d[0] for d in done] == operations


def test_spans_coalesce_when_they_touch():
    boxes = [(5, 0, 10, 9), (0, 0, 5, 9), (9, 0, 12, 9), (20, 0, 25, 9)]
    assert layout.spans(boxes, 0, (0, 0, 100, 100)) == [(0, 12), (20, 25)]


def test_projection_tree_of_columns_and_grid():
    two = layout.projection_tree([(0, 0, 40, 100), (60, 0, 100, 100)], (0, 0, 100, 100))
    assert [(n[3], n[4]) for n in two] == [((0, 0, 100, 100), "row"), ((0, 0, 50, 100), "atomic"), ((50, 0, 100, 100), "atomic")]
    grid = layout.projection_tree([(0, 0, 40, 40), (60, 0, 100, 40), (0, 60, 40, 100), (60, 60, 100, 100)], (0, 0, 100, 100))
    assert grid[0][4] == "column" and [n[4] for n in grid[1:] if n[2] == 1] == ["row", "row"] and len(grid) == 7


def test_groups_follow_aligned_neighbours_and_stop_at_lines():
    elements = [element(0, (0, 0, 40, 20), True), element(1, (50, 0, 90, 20), True), element(2, (0, 60, 40, 80)), element(3, (50, 60, 90, 80))]
    found = layout.layout_groups(elements, [])
    assert [(g.kind, g.members, g.label) for g in found] == [("row", (0, 1), "Text"), ("row", (2, 3), "Compo")]
    assert [g.label for g in layout.layout_groups(elements, [("vertical", 45, 0, 30)])] == ["Compo"]


def test_group_types():
    assert layout.group_type([(0, 0, 9, 9), (20, 0, 29, 9), (0, 20, 9, 29), (20, 20, 29, 29)]) == "grid"
    assert layout.group_type([(0, 0, 9, 9), (0, 20, 9, 29)]) == "column" and layout.group_type([(0, 0, 9, 9)]) is None


def test_near_cuts_keep_the_best():
    cuts = [layout.Cut("vertical", 48, {"lsd"}, score=0.8), layout.Cut("vertical", 52, {"lsd"}, score=0.9), layout.Cut("horizontal", 50, {"lsd"}, score=0.7)]
    assert [(c.direction, c.at) for c in layout.apart(cuts)] == [("vertical", 52), ("horizontal", 50)]


def test_evidence_joins_the_first_place_within_four():
    found = []
    for at, source, gap in ((50, "lsd", 0), (53, "whitespace", 9), (58, "whitespace", 3)):
        layout.gather(found, "vertical", at, source, gap)
    assert [(c.at, sorted(c.sources), c.gap) for c in found] == [(50, ["lsd", "whitespace"], 9), (58, ["whitespace"], 3)]


def test_trees_own_every_element_once_and_do_not_depend_on_input_order():
    draw = random.Random(3)
    for _ in range(25):
        elements = []
        for i in range(draw.randrange(1, 12)):
            x, y = draw.randrange(160), draw.randrange(160)
            elements.append(element(i, (x, y, x + draw.randrange(5, 40), y + draw.randrange(5, 40)), draw.random() < 0.5))
        lines = [("vertical", 100, 0, 200)] if draw.random() < 0.5 else []
        found = layout.analyse(page(elements, lines))
        tree, score = found.tree, found.score
        owned = sorted(i for n in tree for i in n["owned"])
        assert owned == list(range(len(elements)))
        by = {n["id"]: n for n in tree}
        for n in tree:
            if n["parent"] is not None:
                p = by[n["parent"]]["box"]
                assert p[0] <= n["box"][0] and p[1] <= n["box"][1] and p[2] >= n["box"][2] and p[3] >= n["box"][3]
        assert layout.analyse(page(elements, lines)).score == score and len(found.measures) == 11
        rewards, penalties = layout.tree_terms(page(elements, lines), layout.search(page(elements, lines))[0])
        assert all(0 <= v <= 1 for v in (rewards | penalties).values())


def test_a_page_of_two_columns_and_a_line_is_cut():
    elements = [element(i, (10 + 110 * (i % 2), 10 + 45 * (i // 2), 80 + 110 * (i % 2), 45 + 45 * (i // 2)), True) for i in range(8)]
    found = layout.analyse(page(elements, [("vertical", 100, 0, 200)]))
    tree = found.tree
    assert tree[0]["kind"] in ("row", "column") and sum(n["kind"] == "atomic" for n in tree) >= 2


def test_icons_join_a_readable_leaf():
    tree = [{"id": 0, "parent": None, "ordinal": 0, "depth": 0, "box": (0, 0, 100, 50), "kind": "row", "portion": 1, "score": 1.0, "sources": {"lsd"}, "owned": []}]
    for i, box in ((1, (0, 0, 50, 50)), (2, (50, 0, 100, 50))):
        tree.append({"id": i, "parent": 0, "ordinal": i - 1, "depth": 1, "box": box, "kind": "atomic", "portion": 1, "score": None, "sources": set(), "owned": []})
    layout.own_elements(tree, [element(0, (5, 5, 20, 20)), element(1, (60, 5, 90, 40), True)], 50)
    assert tree[1]["kind"] == "spacer" and tree[2]["owned"] == [0, 1]
    html = layout.flex_html([tree[0] | {"kind": "row"}, tree[1] | {"portion": 3}, tree[2] | {"portion": 7}], lambda n: "x")
    assert "flex:3 1 0" in html and "flex:7 1 0" in html


def node(i, box, kind="atomic", owned=(), label="content", region=None, score=None, sources=(), parent=0):
    return {"id": i, "parent": parent if i else None, "ordinal": max(0, i - 1), "depth": int(i > 0), "box": box, "kind": kind, "portion": 1, "score": score, "sources": set(sources), "region_type": region, "label": label, "owned": list(owned)}


def profile(**changes):
    base = {"front": 4, "texts": 2, "v": 0.05, "h": 0.05, "row": 0, "column": 0, "grid": 0}
    return base | changes


ALL, LEFT, RIGHT = (0, 0, 100, 100), (0, 0, 50, 100), (50, 0, 100, 100)


def test_faults_are_found():
    tree = [node(0, ALL, "row"), node(1, (0, 0, 60, 100), owned=[0]), node(2, RIGHT, owned=[1])]
    own = [element(0, (5, 5, 20, 20), True), element(1, (70, 5, 90, 20), True)]
    wrong, _ = layout.validate(tree, own, [], [], [], {})
    assert "sibling_overlap:1,2" in wrong and "page_scale_atomics" in wrong and "page_scale_label_repeated" in wrong
    tree[1] |= {"box": (-5, 0, 50, 100), "owned": [0, 1]}
    wrong = layout.faults(tree, own)
    assert "child_escapes_parent:1" in wrong and "duplicate_ownership" in wrong
    assert "incomplete_ownership" in layout.faults([node(0, ALL, owned=[0])], own)
    assert "child_order:0" in layout.faults([node(0, ALL, "row"), node(1, RIGHT, owned=[0]), node(2, LEFT, owned=[1])], own)
    assert layout.faults([node(0, ALL, "row"), node(1, LEFT, "spacer", [0]), node(2, RIGHT, "table", [1])], own)[:2] == ["spacer_with_content:1", "bad_type:2"]


def test_validation_measures_and_gate():
    tree = [node(0, ALL, "row"), node(1, LEFT, owned=[0]), node(2, RIGHT, owned=[1])]
    own = [element(0, (5, 5, 20, 20), True), element(1, (70, 5, 90, 20))]
    cut = layout.Cut("vertical", 50, {"whitespace"}, 30, score=0.7, region=ALL)
    _, m = layout.validate(tree, own, [], [cut], [cut], {})
    assert (m["largest_atomic_element_ratio"], m["thin_text_atomic_ratio"], m["single_element_atomic_ratio"], m["weak_separator_ratio"]) == (0.5, 0.5, 1.0, 1.0)
    wrong, m = layout.validate([tree[0], tree[1], node(2, RIGHT)], own[:1], [], [], [], {})
    assert (m["empty_atomic_ratio"], m["small_single_element_ratio"]) == (0.5, 1.0) and any(x.startswith("empty_atomic_ratio") for x in wrong)
    wrong, m = layout.validate([tree[0], node(1, LEFT, "spacer", label=None), node(2, RIGHT, owned=[0])], [element(0, (55, 10, 95, 90))], [], [], [], {})
    assert not wrong and m["empty_atomic_ratio"] == 0
    assert "icon_only_atomic:0" in layout.validate([node(0, ALL, owned=[0])], [element(0, (5, 5, 20, 20))], [], [], [], {})[0]


def test_leaves_that_should_have_been_cut_are_found():
    one = [node(0, ALL, owned=range(8), region="mixed")]
    lines = [element(i, (5, 5 + 10 * i, 95, 12 + 10 * i), True) for i in range(8)]
    assert "mixed_unsplit:0" in layout.validate(one, lines, [], [], [], {ALL: (profile(front=8, h=0.9, row=2), "mixed")})[0]
    two = [node(0, ALL, owned=range(4))]
    columns = [element(i, (5 + 20 * i, 10, 20 + 20 * i, 90)) for i in range(4)]
    assert "two_column_unsplit:0" in layout.validate(two, columns, [], [], [], {ALL: (profile(v=0.4), "two_column")})[0]
    both = [element(0, (5, 10, 40, 30), True), element(1, (5, 40, 40, 60), True), element(2, (50, 5, 95, 95), role="container")]
    cut = layout.Cut("vertical", 48, {"component_boundary"}, score=0.8, region=ALL)
    leaf, known = [node(0, ALL, owned=[0, 1, 2])], {ALL: (profile(front=2), "text_section")}
    assert "heterogeneous_unsplit:0" in layout.validate(leaf, both, [], [cut], [], known)[0] and not layout.validate(leaf, both, [], [], [], known)[0]


def test_cuts_against_a_regions_type_are_found():
    tree = [node(0, ALL, "row"), node(1, LEFT, owned=[0]), node(2, RIGHT, owned=[1])]
    own = [element(0, (5, 5, 45, 95)), element(1, (55, 5, 95, 95))]
    for kind, direction, score, name in (("hero", "vertical", 0.7, "hero_fragmented"), ("two_column", "horizontal", 1.0, "two_column_cut_across"), ("two_column", "vertical", 0.2, None), ("hero", "vertical", 0.95, None)):
        cut = layout.Cut(direction, 50, {"lsd"}, score=score, region=ALL)
        wrong, m = layout.validate(tree, own, [], [cut], [cut], {ALL: (profile(), kind)})
        assert any(x.startswith(str(name)) for x in wrong) == bool(name) and m["region_type_mismatch_ratio"] == bool(name)


def test_features_of_texts_and_components():
    own = [element(0, (10, 10, 80, 25), True), element(1, (10, 40, 80, 55), True), element(2, (120, 10, 190, 80)), element(3, (0, 0, 200, 100), role="background")]
    m = layout.measure(page(own, [("vertical", 100, 0, 100)], 200, 100), (0, 0, 200, 100))
    assert (m["front"], m["texts"], m["column"], m["vline"]) == (3, 2, 1, 1.0)
    assert (m["hspread"], m["vspread"], m["largest"], m["container"]) == (0.0, 0.3, 1.0, 1.0)
    m = layout.measure(page(own[:3], (), 200, 100), (0, 0, 200, 100))
    assert (m["largest"], m["container"]) == (0.245, 0.0) and layout.measure(page([], (), 100, 100), (0, 85, 100, 100))["position"] == "footer"


def region(**changes):
    base = {
        "area": 0.25, "position": "content", "front": 4, "texts": 2, "others": 2, "text_ratio": 0.5, "density": 0.3, "hspread": 0.4, "vspread": 0.4, "largest": 0.1, "container": 0.1,
        "row": 0, "column": 0, "grid": 0, "same_size": 0.1, "same_step": 0.1, "hgap": 0.05, "vgap": 0.05, "hline": 0.0, "vline": 0.0, "background": 0.8, "height": 0.5,
    } | changes
    rep, v, h = (base["same_size"] + base["same_step"]) / 2, max(base["vgap"], base["vline"]), max(base["hgap"], base["hline"])
    return base | {"repeat": rep, "v": v, "h": h, "groups": base["row"] + base["column"] + base["grid"]}


def test_region_types():
    cases = {
        "hero": {"area": 0.8, "largest": 0.55}, "navigation": {"position": "header", "height": 0.08, "hspread": 0.9, "text_ratio": 0.9}, "text_section": {"text_ratio": 1.0, "others": 0, "vspread": 0.8},
        "card_grid": {"front": 10, "row": 2, "grid": 1, "same_size": 0.95, "same_step": 0.9}, "two_column": {"vgap": 0.8, "hgap": 0.0, "column": 2},
        "list": {"text_ratio": 0.8, "vspread": 0.9, "row": 2, "same_size": 0.8, "same_step": 0.9}, "footer": {"position": "footer", "front": 9, "text_ratio": 0.8, "column": 2},
    }
    for kind, changes in cases.items():
        assert layout.region_type(region(**changes))[0] == kind
    weak = region(front=1, texts=0, others=1, text_ratio=0.0, density=0.05, vspread=0.0, hspread=0.3, position="header", background=0.2)
    kind, confidence = layout.region_type(weak)
    assert kind == "mixed" and confidence < 0.42
    # navigation scores 0.35, below the floor; mixed takes its place with its own 0.25/8 + 0.15 + 0.15 * 0.9 + 0.25 * 0.05
    assert confidence == pytest.approx(0.7 * 0.32875, abs=1e-6)


def test_weak_runs_of_leaves_merge():
    lines = [element(0, (10, 10, 90, 30), True), element(1, (10, 60, 90, 80), True)]
    halves = [node(1, (0, 0, 100, 50), owned=[0]), node(2, (0, 50, 100, 100), owned=[1])]
    merged = layout.merge_weak([node(0, ALL, "column", score=0.7, sources=["whitespace"]), *halves], lines, {})
    assert [(n["kind"], n["owned"], n["box"]) for n in merged] == [("atomic", [0, 1], ALL)]
    strong = layout.merge_weak([node(0, ALL, "column", score=1.1, sources=["lsd"]), *halves], lines, {})
    assert [n["kind"] for n in strong] == ["column", "atomic", "atomic"]
    thirds = [node(i + 1, (0, 40 * i, 100, 40 * i + 40), owned=[i], label="footer", region="footer") for i in range(3)]
    mixed = [element(0, (10, 10, 90, 30), True), element(1, (10, 50, 26, 66)), element(2, (10, 90, 90, 110), True)]
    root = node(0, (0, 0, 100, 120), "column", score=0.6, sources=["whitespace"], region="footer")
    assert layout.merge_weak([root, *(dict(n) for n in thirds)], mixed, {})[0]["owned"] == [0, 1, 2]
    # the run keeps its first leaf's label, whatever its hull's would be
    parted = [thirds[0] | {"label": "header"}, *thirds[1:]]
    assert [n["owned"] for n in layout.merge_weak([root, *(dict(n) for n in parted)], mixed, {})] == [[], [0], [1, 2]]
    uneven = layout.merge_weak([root, *(dict(n) for n in thirds)], mixed, {(0, 40, 100, 80): 0.3})
    assert [n["owned"] for n in uneven] == [[], [0], [1], [2]]
    cards = [node(1, LEFT, owned=[0], region="card_grid"), node(2, RIGHT, owned=[1], region="card_grid")]
    kept = layout.merge_weak([node(0, ALL, "row", score=0.6, sources=["whitespace"], region="card_grid"), *cards], [element(0, (5, 5, 45, 95), True), element(1, (55, 5, 95, 95), True)], {})
    assert [n["kind"] for n in kept] == ["row", "atomic", "atomic"]


def test_running_sums_equal_sums_over_the_whole_tree():
    draw = random.Random(5)
    for _ in range(12):
        elements = [element(i, (x, y, x + draw.randrange(5, 60), y + draw.randrange(5, 40)), draw.random() < 0.6, draw.choice(["foreground", "foreground", "container"])) for i in range(14) for x, y in [(draw.randrange(140), draw.randrange(160))]]
        p = page(elements, [("vertical", 100, 0, 200)])
        for state in layout.search(p):
            leaves = [r for r, _, c in state.steps if c.cut is None]
            sums = dict(zip(layout.SUMS, state.sums))
            inside = [[e for e in elements if layout.common_area(e["box"], r)] for r in leaves]
            assert sums["leaves"] == len(leaves) and sums["empty"] == sum(not x for x in inside) and sums["filled"] == sum(map(bool, inside))
            assert sums["cuts"] == len(state.steps) - len(leaves) == len(leaves) - 1
            assert sums["cohesion"] == pytest.approx(sum(layout.cohesion(*layout.study(p, r)[:2], c) for r, _, c in state.steps))


def test_raster_cuts_at_uniform_rows():
    image = np.zeros((60, 40, 3), np.int16) + 255
    image[20:40, ::2] = 0
    assert raster.separators(image)[0] == 0 and raster.separators(image)[-1] == 60 and len(raster.separators(image)) > 2
    half = np.zeros((20, 20, 3), np.int16)
    half[10:] = 200
    assert raster.hard_cuts(half) == [10]


def test_raster_features_of_a_two_tone_image(spark):
    image = np.full((100, 200, 3), 240, np.uint8)
    image[:, 100:] = 20
    row = raster.features(spark.createDataFrame([(1, 200, 100, bytearray(image.tobytes()))], "page_id long, width int, height int, pixels binary")).first()
    assert row.vertical_transition > 0.8 and row.horizontal_transition == 0 and 0 < row.color_variance <= 1


def test_block_merge_raises_the_match():
    block = lambda text, x: {"text": text, "x": x, "y": 0.0, "w": 0.1, "h": 0.1, "R": 0, "G": 0, "B": 0}
    one, found = scoring.matched([block("hello", 0.0), block("world", 0.1)], [block("hello world", 0.0)], True)
    assert len(one) == 1 and found == [(0, 0, 1.0)]


def test_dom_steps():
    root = dom.parse("<ul>" + "<li>x</li>" * 6 + "</ul><p>One. Two. Three.</p><embed src=a><style>p{a}.q{b}</style>")
    for step in ("truncate", "sentences", "objects", "css"):
        dom.STEPS[step](root, 1)
    html = root.html()
    assert html.count("<li>") == 4 and "Three" not in html and '<img src="a">' in html and "p{a}" in html and ".q" not in html


def test_paired_summary_and_gate(spark):
    rows = [("b0", i, v) for i, v in enumerate((0.5, 0.6, 0.7))] + [("b1", i, v) for i, v in enumerate((0.52, 0.59, 0.7))] + [("b1", 9, 1.0)]
    scores = spark.createDataFrame(rows, "method string, sample int, score double")
    got = reports.paired_summary(scores, "b0", "b1").first()
    assert (got.n, got.wins, got.losses, got.ties, got.improvement_gt_0_01) == (3, 1, 1, 1, 1)
    assert reports.paired_summary(scores.limit(0), "b0", "b1").first().n == 0


def test_intervals_and_gaps(spark):
    rows = spark.createDataFrame([(1, "x", lo, hi) for lo, hi in ((5, 10), (0, 5), (9, 12), (20, 25), (30, 30))], "page_id long, axis string, lo int, hi int")
    merged = spatial.merged_intervals(rows, ["page_id", "axis"], "lo", "hi")
    assert sorted((r.start, r.end) for r in merged.collect()) == [(0, 12), (20, 25)]
    assert [(r.gap_start, r.gap_end, r.cut) for r in spatial.gaps(merged, ["page_id", "axis"], 8).collect()] == [(12, 20, 16)]


def test_spaced_positions(spark):
    rows = spark.createDataFrame([("v", 1, p) for p in (10, 14, 16, 30, 33)], "direction string, page_id long, position int")
    assert sorted(r.position for r in raster.spaced_positions(rows).collect()) == [10, 16, 30]


def test_detector_payloads(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"img_shape": [50, 100, 3], "compos": [{"id": 1, "class": "Text", "position": {"column_min": 1, "row_min": 2, "column_max": 3, "row_max": 4}}, {"id": 2, "class": "Compo", "column_min": 5, "row_min": 6, "column_max": 7, "row_max": 8}]}')
    rows = relations.artifacts(spark, str(tmp_path))
    got = {r.element_id: (r.l, r.t, r.r, r.b) for r in relations.components(rows).collect()}
    assert got == {1: (1, 2, 3, 4), 2: (5, 6, 7, 8)} and relations.invalid_artifacts(rows).count() == 0
    (tmp_path / "p2.json").write_text('{"img_shape": [0, 100], "compos": []}')
    assert relations.invalid_artifacts(relations.artifacts(spark, str(tmp_path))).count() == 1


def test_names_of_queries_are_unique_and_have_columns():
    assert len(catalogue.QUERIES) > 150 and set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_candidate_rows_equal_the_rated_cuts_of_pages_without_groups(spark):
    draw = random.Random(11)
    boxes, lines, expected = [], [], {}
    for p in range(40):
        own = []
        for i in range(draw.randrange(2, 9)):
            x, y = draw.randrange(0, 1000), draw.randrange(0, 780)
            own.append((i, (x, y, x + draw.randrange(20, 180), y + draw.randrange(12, 110)), draw.choice(["Text", "Compo", "Block"])))
        found = [("vertical", draw.randrange(1, 1200), 0, 900), ("vertical", draw.randrange(1, 1200), 0, 900), ("horizontal", draw.randrange(1, 900), 0, 300)]
        boxes += [(p, i, *b, c) for i, b, c in own]
        lines += [(p, *x, "lsd") for x in found]
        front = lambda b, c: c == "Text" or c == "Compo" and (b[2] - b[0]) * (b[3] - b[1]) / 1080000 < 0.15 and (b[2] - b[0]) / 1200 < 0.65
        elements = [element(i, b, c == "Text", "foreground" if front(b, c) else "container") for i, b, c in own]
        page_ = layout.Page(1200, 900, elements, sorted(found), [])
        back = [e for e in elements if e["role"] != "foreground"]
        ahead = [e for e in elements if e["role"] == "foreground"]
        axis = layout.text_axis(ahead, page_.box, page_)
        for cut in layout.evidence(page_, page_.box, ahead, [], []):
            r = layout.rate(page_, page_.box, cut, ahead, back, [], axis)
            expected[p, r.direction, r.at] = (r.score, r.gap, len(r.cut_large), list(r.why))
    e = spark.createDataFrame(boxes, "page_id long, element_id int, l int, t int, r int, b int, uied_class string")
    li = spark.createDataFrame(lines, "page_id long, direction string, position int, start int, end int, source string")
    got = {(r.page_id, r.direction, r.position): (r.score, r.gap, r.cut_large, r.reasons) for r in spatial.candidate_scores(e, li, 1200, 900).collect()}
    assert got.keys() == expected.keys()
    for k, (score, *rest) in got.items():
        assert score == pytest.approx(expected[k][0], abs=1e-6) and rest == list(expected[k][1:]), k


def test_better_candidates_keep_others_away(spark):
    rows = [(1, "vertical", 48, ["lsd"], 0, 0.8), (1, "vertical", 52, ["lsd"], 0, 0.9), (1, "horizontal", 50, ["lsd"], 0, 0.7), (1, "vertical", 60, ["whitespace"], 9, 0.5)]
    kept = spatial.apart(spark.createDataFrame(rows, "page_id long, direction string, position int, sources array<string>, gap int, score double")).collect()
    assert sorted((r.direction, r.position) for r in kept) == [("horizontal", 50), ("vertical", 52), ("vertical", 60)]


def test_images_survive_their_files(spark, tmp_path):
    import struct
    import zlib

    draw = random.Random(4)
    w, h = 7, 5
    pixels = bytes(draw.randrange(256) for _ in range(w * h * 3))
    assert raster.decoded(raster.png(w, h, pixels)) == (w, h, pixels) and raster.decoded(b"GIF89a") is None
    rows = np.frombuffer(pixels, np.uint8).reshape(h, w * 3).astype(int)
    raw = b""
    for y in range(h):  # every kind of filter
        kind, above = y % 5, rows[y - 1] if y else np.zeros(w * 3, int)
        left, corner = np.concatenate([[0] * 3, rows[y][:-3]]), np.concatenate([[0] * 3, above[:-3]])
        guess = left + above - corner
        near = np.array([min((a, b, c), key=lambda v: abs(g - v)) for a, b, c, g in zip(left, above, corner, guess)])
        base = [0 * left, left, above, (left + above) // 2, near][kind]
        raw += bytes([kind]) + bytes(((rows[y] - base) % 256).astype(np.uint8))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + b"crc."
    filtered = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert raster.decoded(filtered) == (w, h, pixels)
    (tmp_path / "1.png").write_bytes(raster.png(w, h, pixels))
    (tmp_path / "2.png").write_bytes(b"no image")
    got = raster.scanned(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.width, r.height, bytes(r.pixels)) for r in got] == [(w, h, pixels)]


def test_hard_cuts_follow_the_last_uniform_row():
    image = np.full((12, 10, 3), 255, np.int16)
    image[6:] = 100  # uniform again, but another colour
    image[3, ::2] = 0  # a busy row between
    assert raster.hard_cuts(image) == [6]


def test_context_bonus_equals_a_plain_version(spark):
    draw = random.Random(6)
    cost = [[-draw.randrange(100) / 100 for _ in range(7)] for _ in range(6)]
    expected = {}
    for i in range(6):
        for j in range(7):
            near = sorted(cost[a][b] for a in range(6) for b in range(7) if (a, b) != (i, j) and abs(a - i) <= 2 and abs(b - j) <= 2)
            expected[i, j] = cost[i][j] + (sum(near[:4]) if cost[i][j] < -0.5 else 0)
    cells = spark.createDataFrame([(1, i, j, cost[i][j]) for i in range(6) for j in range(7)], "page_id long, i int, j int, cost double")
    got = {(r.i, r.j): r.adjusted for r in spatial.context_bonus(cells, 2).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_measures_of_node_tables(spark):
    nodes = [(1, 0, None, 0, 0, 0, 100, 100, "row"), (1, 1, 0, 0, 0, 0, 50, 100, "atomic"), (1, 2, 0, 1, 50, 0, 100, 100, "atomic")]
    nodes += [(2, 0, None, 0, 0, 0, 100, 100, "row"), (2, 1, 0, 0, 60, 0, 110, 100, "atomic"), (2, 2, 0, 1, 0, 0, 70, 100, "atomic")]
    owned = [(1, 1, 0, 5, 5, 20, 20, "Text"), (1, 2, 1, 70, 5, 90, 20, "Compo"), (2, 2, 0, 5, 5, 60, 95, "Compo")]
    tree = spark.createDataFrame(nodes, "page_id long, node_id int, parent_id int, ordinal int, l int, t int, r int, b int, layout_type string")
    own = spark.createDataFrame(owned, "page_id long, node_id int, element_id int, l int, t int, r int, b int, uied_class string")
    one, two = sorted(spatial.structure_measures(tree, own).collect(), key=lambda r: r.page_id)
    assert (one.atomic_count, one.largest_ratio, one.thin_text_ratio, one.single_ratio, one.page_scale, one.icon_only, one.passed) == (2, 0.5, 0.5, 1.0, 1, 1, False)
    assert (two.empty_ratio, two.escapes, two.crossings, two.disordered, two.passed) == (0.5, 1, 1, 1, False)


def test_tree_depths_beyond_the_limit_of_recursive_queries(spark):
    """A chain, a page of one root, and nodes that no root leads to; then more rows than a recursive query may make."""
    from pyspark.sql import functions as F

    rows = [(1, 0, None), *((1, i, i - 1) for i in range(1, 4)), (2, 7, None), (3, 1, 2), (3, 2, 1)]
    nodes = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int")
    assert sorted(map(tuple, spatial.tree_depths(nodes).collect())) == [(1, 3, 4), (2, 0, 1)]
    assert spatial.tree_depths(nodes.limit(0)).count() == 0
    wide = spark.range(1_000_001).select(F.col("id").alias("page_id"), F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"))
    assert spatial.tree_depths(wide).agg(F.sum("nodes")).first()[0] == 1_000_001


def test_equal_pages_are_worked_out_once(spark):
    """Equal pages share what was made for one of them; other boxes, other lines or no lines are other pages."""
    import uuid

    boxes = [(i, 0, 0, 0, 9 + i % 7, 9, "Text", "foreground") for i in range(140)]
    lines = [(i, "vertical", 4 + i % 2, 0, 9) for i in range(140) if i % 7]
    elements = spark.createDataFrame(boxes, "page_id long, element_id int, l int, t int, r int, b int, uied_class string, role string")
    found = spark.createDataFrame(lines, "page_id long, direction string, position int, start int, end int")

    def emit(page_id, own, found):
        yield page_id, uuid.uuid4().hex, own[0]["r"], found[0]["position"] if found else None

    made = layout.per_page(layout.page_rows(elements, found), "page_id long, made string, r int, position int", emit, once=True).collect()
    assert sorted((x.page_id, x.r, x.position) for x in made) == [(i, 9 + i % 7, 4 + i % 2 if i % 7 else None) for i in range(140)]
    assert len({x.made for x in made}) == len({(x.r, x.position) for x in made}) == 13


def test_regularity_equals_numpy():
    draw = random.Random(2)
    for n in range(2, 14):
        for _ in range(200):
            x = [draw.randrange(2, 900) / 2 for _ in range(n)]
            assert layout.regularity(x) == 1 - float(np.std(x)) / max(1.0, float(np.mean(x)))


def test_merging_compares_every_pair_of_texts_once(monkeypatch):
    block = lambda i, text: {"x": i / 10, "y": 0.0, "w": 0.05, "h": 0.1, "text": text, "R": 0, "G": 0, "B": 0}
    one, two = [block(i, t) for i, t in enumerate(("ab", "cd", "efg", "hi", "jkl"))], [block(i, t) for i, t in enumerate(("ab cd", "efg hi jkl", "mn"))]
    seen, plain = [], scoring.ratcliff
    monkeypatch.setattr(scoring, "ratcliff", lambda a, b: seen.append((a, b)) or plain(a, b))
    merged, found = scoring.matched(one, two, True)
    assert [x["text"] for x in merged] == ["ab cd", "efg hi jkl"] and [(i, j, s) for i, j, s in found] == [(0, 0, 1.0), (1, 1, 1.0)]
    assert len(seen) == len(set(seen))


def test_a_search_rates_only_cuts_that_it_may_follow():
    """Below two foreground elements every cut is refused; the trees are those of rating all of them."""
    alone = page([element(0, (10, 10, 60, 40)), element(1, (0, 0, 150, 90), False, "container")], [("vertical", 100, 0, 200)])
    assert len(layout.search(alone)) == 1 and not alone.memo
    assert all("insufficient_foreground" in c.why for c in layout.study(alone, alone.box)[2]) and layout.study(alone, alone.box)[2]
    draw = random.Random(8)
    for _ in range(20):
        elements = [element(i, (x, y, x + draw.randrange(5, 60), y + draw.randrange(5, 40)), draw.random() < 0.6, draw.choice(["foreground", "container"])) for i in range(7) for x, y in [(draw.randrange(140), draw.randrange(160))]]
        p = page(elements, [("vertical", 100, 0, 200)])
        layout.search(p)
        for region, seen in list(p.looks.items()):
            m, kind, _, choices = layout.study(p, region)
            open_ = [c for c in choices if c.cut and not layout.BLOCKED.intersection(c.reasons)]
            assert (seen.m, seen.kind, [seen.stay], seen.cuts) == (m, kind, [c for c in choices if c.cut is None], open_[:3])


def test_records_spacers_and_shared_leaves_are_those_of_the_trees(spark):
    draw = random.Random(9)
    boxes = [(p, i, x, y, x + draw.randrange(20, 180), y + draw.randrange(12, 110), draw.choice(["Text", "Compo"]), "foreground") for p in range(60) for i in range(p % 8 + 1) for x, y in [(draw.randrange(1000), draw.randrange(780))]]
    elements = spark.createDataFrame(boxes, "page_id long, element_id int, l int, t int, r int, b int, uied_class string, role string")
    lines = spark.createDataFrame([(p, "vertical", 50 + 17 * p % 1000, 0, 900) for p in range(0, 60, 2)], "page_id long, direction string, position int, start int, end int")
    trees = layout.tree_rows(elements, lines, 1200, 900).collect()
    rows = lambda made: sorted(tuple(r) for r in made.collect())
    assert rows(layout.record_rows(elements, lines, 1200, 900)) == sorted((r.page_id, r.faults, r.score) for r in trees if r.node_id == 0)
    shared = sorted((r.page_id, r.node_id, r.owned) for r in trees if r.layout_type == "atomic" and "," in r.owned)
    assert shared and rows(layout.shared_rows(elements, lines, 1200, 900)) == shared
    spacers = Counter(r.page_id for r in trees if r.layout_type == "spacer")
    assert spacers and rows(layout.spacer_rows(elements, lines, 1200, 900)) == sorted(spacers.items())


def _plain_raster_tree(image):
    """Node rows of one image, a region at a time."""
    out, stack = [], [(-1, 0, 0, 0, image.shape[1], image.shape[0])]
    while stack:
        parent, depth, l, t, r, b = stack.pop()
        number, kind, part = len(out), 0, image[t:b, l:r]
        for axis, name in ((1, 1), (0, 2)) if depth < raster.DEPTH else ():
            at = raster.separators(part.swapaxes(0, 1) if axis else part)
            if len(at) > 2:
                kind = name
                stack += [(number, depth + 1, l + x, t, l + y, b) if axis else (number, depth + 1, l, t + x, r, t + y) for x, y in reversed(list(zip(at, at[1:])))]
                break
        out.append((number, parent, depth, l, t, r, b, kind))
    return out


def test_raster_trees_of_many_images_equal_those_of_each():
    """Also with lines at the threshold of uniform ones, with hard cuts, and with images too short for soft cuts."""
    rng = np.random.default_rng(4)
    tie = np.repeat(np.tile([0, 10, 10, 20], 20), 3).reshape(80, 3)  # variance 50 exactly
    hard = 0
    for height, width in ((45, 60), (40, 52), (9, 30), (1, 1)):
        images = []
        for k in range(60):
            image = np.full((height, width, 3), 255, np.int16)
            for _ in range(k % 9):
                y, x = rng.integers(height), rng.integers(width)
                image[y : y + rng.integers(1, 20), x : x + rng.integers(1, 30)] = rng.choice([0, 5, 37, 140, 250], (1, 3)) if k % 2 else rng.choice([0, 255, 248])
            for y in rng.integers(height, size=k % 4):
                image[y] = tie[:width] if k % 3 else rng.choice([0, 60, 255])
            images.append(image)
        images = np.stack(images)
        hard += sum(len(raster.hard_cuts(x)) for x in images)
        table = raster.tree_table(images.sum(-1), (images.astype(int) ** 2).sum(-1), images.astype(np.uint8).__getitem__)
        got = list(zip(*(c.tolist() for c in table)))
        assert got == [(i, *row) for i, image in enumerate(images) for row in _plain_raster_tree(image)]
    assert hard and tie[:60].var() == 50


def test_page_trees_equal_the_trees_of_painted_pages(spark):
    draw = random.Random(10)
    boxes = [(p, i * 41, x, y, x + draw.randrange(20, 180), y + draw.randrange(12, 110)) for p in range(60) for i in range(p % 9 + 1) for x, y in [(draw.randrange(1000), draw.randrange(780))]]
    elements = spark.createDataFrame(boxes, "page_id long, element_id int, l int, t int, r int, b int")
    rows = lambda made: sorted(tuple(str(x) for x in r) for r in made.collect())
    images = raster.images(elements)
    expected = [(r.page_id, *row) for r in images.collect() for row in _plain_raster_tree(raster.array_of(r.asDict()))]
    expected = sorted(tuple(map(str, (p, n, None if parent < 0 else parent, *rest, ("atomic", "row", "column")[kind]))) for p, n, parent, *rest, kind in expected)
    assert len(expected) > 300 and rows(raster.page_trees(elements)) == rows(raster.trees(images)) == expected


def test_similarities_and_assignments_equal_the_plain_ones(monkeypatch):
    """ratcliff against difflib, also where it leaves frequent characters out; assign() on lists against NumPy, with ties and more rows than columns."""
    from difflib import SequenceMatcher

    draw, rng = random.Random(11), np.random.default_rng(11)
    for n in (0, 1, 2, 9, 40, 199, 200, 230):
        for _ in range(60):
            a, b = ("".join(draw.choice("abc 12") for _ in range(k)) for k in (draw.randrange(60), n))
            assert similarity.ratcliff(a, b) == SequenceMatcher(None, a, b).ratio()
    costs = [rng.integers(0, 6, rng.integers(1, 9, 2)) / 5 for _ in range(300)]
    few = [similarity.assign(c) for c in costs]
    monkeypatch.setattr(similarity, "FEW", 0)
    assert [[x.tolist() for x in pair] for pair in few] == [[x.tolist() for x in similarity.assign(c)] for c in costs]


def test_joins_that_cannot_pay_are_not_compared(monkeypatch):
    """The merged blocks are those of trying every join, with far fewer texts compared."""
    draw = random.Random(12)
    block = lambda: {"x": draw.random(), "y": 0.0, "w": 0.05, "h": 0.1, "text": f"{draw.choice(['Text', 'Compo', 'Block'])} {draw.randrange(1000)} {draw.randrange(100)}", "R": 0, "G": 0, "B": 0}
    seen, plain = [], scoring.ratcliff
    monkeypatch.setattr(scoring, "ratcliff", lambda a, b: seen.append(a) or plain(a, b))

    def every(one, two):
        best = scoring.total(np.array([[plain(a["text"], b["text"]) for b in two] for a in one]))
        while len(one) > 1:
            ways = [[*one[:i], scoring.joined(one[i], one[i + 1]), *one[i + 2 :]] for i in range(len(one) - 1)]
            gain, i = max((scoring.total(np.array([[plain(a["text"], b["text"]) for b in two] for a in way])), -i) for i, way in enumerate(ways))
            if gain <= best + scoring.LEAST_GAIN:
                break
            one, best = ways[-i], gain
        return one

    joins = merged = 0
    for _ in range(150):
        one, two = [block() for _ in range(draw.randrange(1, 7))], [block() for _ in range(draw.randrange(1, 7))]
        if draw.random() < 0.4 and len(one) > 1:
            two[0] = scoring.joined(one[0], one[1])
        seen.clear()
        got = scoring.merge_search(one, two)
        assert got == every(one, two)
        merged += len(got) < len(one)
        joins += len(seen) > len(one) * len(two)
    assert merged > 20 and joins < 120


def test_a_search_measures_boxes_without_calls_for_each_of_them(monkeypatch):
    """Features equal plain ones, also of boxes without area, and only groups, and other boxes than texts, go through common_area()."""
    draw, seen, plain = random.Random(13), [], layout.common_area
    monkeypatch.setattr(layout, "common_area", lambda a, b: seen.append(a) or plain(a, b))
    for _ in range(60):
        boxes = [(x, y, x + draw.randrange(-2, 70), y + draw.randrange(-2, 50)) for x, y in [(draw.randrange(140), draw.randrange(160)) for _ in range(7)]]
        p = page([element(i, box, True) for i, box in enumerate(boxes)], [("vertical", 100, 0, 200)])
        p.groups.clear()
        seen.clear()
        layout.search(p)
        assert not seen
        for region, found in p.looks.items():
            size = max(1, (region[2] - region[0]) * (region[3] - region[1]))
            assert found.m["density"] == layout.unit(sum(plain(x, region) for x in boxes) / size)
            for axis in (0, 1):
                inside = [x for x in boxes if plain(x, region)]
                covered = {i for x in inside for i in range(max(x[axis], region[axis]), min(x[axis + 2], region[axis + 2]))}
                assert {i for a, b in layout.spans(boxes, axis, region) for i in range(a, b)} == covered
