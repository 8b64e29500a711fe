"""Readers and writers."""

from pyspark.sql import functions as F

from quoin.functions import html
from quoin.sources import relations, sinks


def test_html_folder_and_url_lists(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name, text in (("a.html", "<p>\n1"), ("b.html", "x"), ("skip_b.html", "y"), ("c.txt", "z")):
        (tmp_path / "p" / name).write_text(text)
    assert sorted((r.page, r.html) for r in relations.html_folder(spark, str(tmp_path / "p"), exclude=("skip",)).collect()) == [("a.html", "<p>\n1"), ("b.html", "x")]
    (tmp_path / "u.csv").write_text("url,n\nu1,1\nu2,2\nu3,3\n")
    assert [r.url for r in relations.url_list(spark, str(tmp_path / "u.csv"), 2).collect()] == ["u1", "u2"]
    (tmp_path / "s.jsonl").write_text('{"url": "a"}\n{"url": "b"}\n{"url": "a"}\n')
    assert sorted(r.url for r in relations.url_shard(spark, str(tmp_path / "s.jsonl")).collect()) == ["a", "b"]


def test_scores_and_data_urls(spark):
    rows = spark.createDataFrame([('{"m": {"1": 0.5, "2": 1.0}, "k": {"1": 0.25}}', "data:x;base64,aGk=")], "j string, u string")
    assert sorted((r.method, r.sample, r.score) for r in relations.score_maps(rows, "j").collect()) == [("k", "1", 0.25), ("m", "1", 0.5), ("m", "2", 1.0)]
    assert bytes(rows.select(relations.data_url_bytes(F.col("u")).alias("b")).first().b) == b"hi"


def test_identity_gate(spark):
    saved = spark.createDataFrame([(1, "h", "x"), (2, "old", "y")], "page int, hash string, html string")
    now = spark.createDataFrame([(1, "h"), (2, "new")], "page int, hash string")
    assert [r.page for r in relations.if_same_identity(saved, now, ["page"], ["hash"]).collect()] == [1]


def test_bundles_keep_other_runs_and_pages_get_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<p>a"), (2, "<p>b")], "page_id int, html string")
    for run in ("r1", "r2", "r1"):
        sinks.write_bundle({"t": rows}, str(tmp_path / "bundle"), run)
    assert spark.read.parquet(str(tmp_path / "bundle" / "t")).groupBy("run").count().count() == 2
    sinks.write_pages(rows, str(tmp_path / "pages"))
    assert sorted(p.name for p in (tmp_path / "pages").glob("page_id=*")) == ["page_id=1", "page_id=2"]
    for _ in range(2):
        sinks.append_checkpoint(rows, str(tmp_path / "ck"), {"model": "m"})
    assert spark.read.parquet(str(tmp_path / "ck")).count() == 4
    sinks.score_cache(spark.createDataFrame([("m", 1, 0.5)], "method string, sample int, score double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().method == "m"
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_base64_is_one_line(spark):
    import base64

    texts = ["", "a", "https://example.org/" + "x" * 57, "é" * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.base64_line(F.col("t")).alias("b"))
    assert {r.t: r.b for r in rows.collect()} == {t: base64.b64encode(t.encode()).decode() for t in texts}
