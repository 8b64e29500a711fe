import random
from collections import Counter

from quoin.llm.common import table

from . import helpers as H

EN = "the of and to in is that it with as for be was on".split()


def folder(spark, tmp_path):
    draw = random.Random(12)
    items = {i: H.prose(draw, 25, 5000) for i in range(6)}
    texts = {i: " ".join(draw.choice(EN) + draw.choice(["", "ing", "ed", "er"]) + draw.choice("abcdefgh") for _ in range(draw.randrange(30, 90))) for i in range(150)}
    for i in range(150, 170):
        texts[i] = texts[i - 150]
    for i in range(170, 180):
        texts[i] = f"{texts[i - 100]} {items[i % 6]} {texts[i - 80]}"
    texts |= {300: None, 301: "", 302: "12 34 !!"}
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, items


def test_stages_follow_each_other_and_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    texts, items = folder(spark, tmp_path)
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = table(stage(spark, docs, str(tmp_path)), name)
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "shard":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    expected = {i: t for i, t in texts.items() if i < 300}
    assert ids[0] == Counter(expected.keys())
    near = H.near_components(expected)
    expected = {i: t for i, t in expected.items() if near[i] == i}
    assert ids[1] == Counter(expected.keys())
    expected = {i: t for i, t in expected.items() if not H.held_items(t, items)}
    assert ids[2] == Counter(expected.keys()) and len(expected) < 160
    assert set(ids[3]) <= set(expected) and max(ids[3].values()) <= 3 and ids[4] == ids[3]
    run = cp.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in run.select("doc_id").collect()) == ids[4]


def test_near_duplicates_go_from_four_fifths_on(spark, tmp_path):
    import corpus_pipeline as cp

    draw, texts = random.Random(14), {}
    for i in range(20):
        own = H.prose(draw, 100, 5000).split()
        texts[i] = " ".join(own)
        for at in (30, 60) if i % 2 else (20, 50, 80):  # similarity 0.81, or 0.73
            own[at] = f"x{at}"
        texts[100 + i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near = H.near_components(texts, 80)
    got = {r.doc_id for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i in texts if near[i] == i} and len(got) == 30


def test_null_ids_repeats_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    folder(spark, tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
    rows = [(1, "the of and to in is", "en", "a", 5, "x", "y"), (1, "the of and to in is", "en", "a", 5, "x", "y"), (None, "that it with as for be was", None, None, None, None, None), (7, None, "en", "b", 0, "x", "y")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES[:4]:
        docs = table(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    assert cp.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        empty = table(stage(spark, empty, str(tmp_path)), name)
    assert empty.count() == 0


def test_rows_that_share_an_id_but_not_the_text_and_rows_without_ids(spark, tmp_path):
    import corpus_pipeline as cp

    draw = random.Random(17)
    a, b = H.prose(draw, 60, 5000), H.prose(draw, 60, 5000)
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "w"), (1, b, "y"), (None, H.prose(draw, 60, 5000), None), (7, H.prose(draw, 60, 5000), "z")]
    rows += [(None, rows[5][1], "copy")]  # its group is led by the document that has an id
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.source) for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, a, "w"), (1, b, "y"), rows[4], rows[5]], key=str)


def test_run_leaves_its_result_only(spark, tmp_path):
    import corpus_pipeline as cp
    from quoin.llm import common

    folder(spark, tmp_path)
    before = common.written()
    made = cp.run(spark, str(tmp_path))
    assert common.written() == before + 1 and made.count() > 0
