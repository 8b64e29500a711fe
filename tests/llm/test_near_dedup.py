import random

from quoin.llm.near_dedup import near_duplicates

from . import helpers as H


def corpus():
    draw = random.Random(5)
    texts = {}
    for f in range(12):
        base = H.prose(draw, 120).split()
        for k in range(draw.randrange(1, 9)):
            own = list(base)
            for _ in range(draw.randrange(0, 4)):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
            texts[len(texts)] = " ".join(own)
    for t in ("", "   ", "short one", "Short  ONE", "a b c d e", "A B C D E f"):
        texts[len(texts)] = t
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    expected = H.near_components(texts)
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(H.shingles(texts[r.doc_id])) for r in rows)


def test_one_large_group_of_copies_and_of_near_copies(spark):
    draw = random.Random(6)
    base = H.prose(draw, 150).split()
    texts = {i: " ".join(base) for i in range(300)}
    for i in range(300, 900):
        own = list(base)
        own[draw.randrange(150)] = f"y{i}"
        texts[i] = " ".join(own)
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, kept string, h1 int, rep int"
    rows = [(None, "a b c", "x", 1, 1), (1, None, "x", 1, 1), (2, "a b c", None, 1, 1), (2, "a b c", "x", 1, 1), (3, "A  B\tC", "x", 1, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 1, None, False), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pairs_in_a_crowd_below_the_threshold(spark):
    draw = random.Random(8)
    form = H.prose(draw, 220, 100_000).split()
    texts = {i: " ".join(form + H.prose(draw, 31, 100_000).split()) for i in range(1500)}  # mutual similarity 0.78
    for k in range(40):  # each at 0.86 of a text half the crowd away
        own = texts[k * 17].split()
        own[-18:] = H.prose(draw, 18, 100_000).split()
        texts[800 + k * 17] = " ".join(own)
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    expected = {i: i for i in texts} | {800 + k * 17: k * 17 for k in range(40)}
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_candidates_reach_through_empty_and_short_partitions():
    import numpy as np
    import pyarrow as pa

    from quoin.llm import near_dedup as N

    def batch(ids):
        key, sig = b"k" * 4 * N.DEPTH, bytes(N.TREES * N.DEPTH)
        return pa.RecordBatch.from_pydict({"rep": pa.array(ids, pa.int64()), "tree": pa.array([0] * len(ids), pa.int32()), "key": [key] * len(ids), "sig": [sig] * len(ids)})

    def groups(parts):
        edges, pairs = [], set()
        for k, ids in enumerate(parts):
            for found in N.scan_part(iter([batch(ids)] if ids else []), k, 1):
                for r in found.to_pylist():
                    if r["part"] is None:
                        pairs.add((r["a"], r["b"]))
                    else:
                        edges.append(r)
        counts = {r["part"]: r["place"] + r["back"] + 1 for r in edges}
        for edge in counts:
            take = {p: n for p, e, n in N.borders(list(counts.items())) if e == edge}
            rows = [r for r in edges if r["back"] < take.get(r["part"], 0) or r["part"] == edge and r["place"] < N.REACH]
            crossing = pa.table({"rep": pa.array([r["a"] for r in rows]), "tree": pa.array([r["tree"] for r in rows], pa.int32()), "key": [r["key"] for r in rows], "sig": [r["sig"] for r in rows]})
            pairs |= {(r["a"], r["b"]) for r in N.across(1)(crossing).to_pylist()}
        return H.components(range(200), pairs)

    ids = list(range(200))
    for cuts in ([], [70], [1, 1, 6, 6, 6, 50, 51, 52], list(range(0, 200, 3)), [100, 100, 101, 133, 134]):
        edges = [0, *cuts, 200]
        assert set(groups([ids[a:b] for a, b in zip(edges, edges[1:])]).values()) == {0}, cuts
    rows = N.borders([(0, 5), (2, 1), (3, 500), (7, 2)])
    assert rows == [(0, 2, 5), (2, 3, 1), (0, 3, 5), (3, 7, 32)] and np.all([n > 0 for _, _, n in rows])
