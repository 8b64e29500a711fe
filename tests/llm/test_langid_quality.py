import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from quoin.llm import langid, quality
from quoin.llm.common import fold

EN, FR = "the of and to in is that it with as for".split(), "le de la et les des en un une que".split()


def documents():
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(EN if i % 2 else FR) for _ in range(draw.randrange(3, 60))), "en" if i % 2 else "fr") for i in range(200)]
    return [*rows, (900, None, "en"), (901, "123 !!", "fr"), (902, "", None), (903, "the of and", None), (903, "the of and", None), (None, "la et les", "fr")]


def test_language_of_held_out_documents(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    rows = langid.identify(docs, fold(F.col("doc_id"), 5) != 0, ["doc_id", "lang"]).collect()
    assert len(rows) == len(documents())
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 200]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[903].lang_pred == "en" and by_id[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in rows)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0


def plain_bundle(text, letters):
    """The sum of a text's bound trigrams, one at a time."""
    line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = " " + " ".join(line.split()) + " "
    vector = lambda c: letters._draw(ord(c)) if c != " " else letters._draw(0)
    total, n = np.zeros(letters.dim), 0
    for a, b, c in zip(line, line[1:], line[2:]):
        if a + b != "  " and not (b == " " and " " in (a, c)):
            total += np.roll(vector(a), 2).astype(float) * np.roll(vector(b), 1) * vector(c)
            n += 1
    return total, n


def test_bundles_and_predictions_equal_a_plain_version(spark, monkeypatch):
    texts = ["abc", "cab", "", "12", "a", "Ab cd  ef-gh", "été à la mer"]
    for span, block in ((1 << 20, 1 << 13), (5, 2)):
        monkeypatch.setattr(langid, "SPAN", span)
        monkeypatch.setattr(langid, "BLOCK", block)
        letters = langid.Letters(64, 1)
        sums, total = letters.bundles(texts)
        for i, t in enumerate(texts):
            own, n = plain_bundle(t, letters)
            assert n == total[i] and (own == sums[i]).all(), t
    monkeypatch.undo()
    rows = documents()
    letters, prototypes = langid.Letters(langid.DIM, langid.SEED), {}
    learnt = [(t, lang) for i, t, lang in rows if t and lang and (i is not None and zlib.crc32(str(i).encode()) % 5 != 0)]
    for t, lang in learnt:
        own, n = plain_bundle(t, letters)
        if n:
            prototypes[lang] = prototypes.get(lang, 0) + np.round(own * (langid.UNIT / n))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, fold(F.col("doc_id"), 5) != 0, ["doc_id"]).collect()}
    for i, t, _ in rows:
        own, n = plain_bundle(t, letters)
        cosine = {lang: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for lang, p in prototypes.items()} if n else {}
        best = max(sorted(cosine), key=cosine.get) if n else "und"
        assert got[i].lang_pred == best and abs(got[i].score - max(0, cosine.get(best, 0))) < 1e-9


def test_language_of_a_long_text_of_many_letters_takes_little_memory():
    draw = random.Random(2)
    text = "".join(chr(draw.randrange(0x4E00, 0x9FA0)) for _ in range(600_000))
    tracemalloc.start()
    sums, total = langid.Letters(langid.DIM, langid.SEED).bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[0] == 600_000 and np.abs(sums).max() < 1 << 24 and peak < 500e6


def test_language_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "the of and to", "en", "x", 1.0), (1, "the of and to", "en", "x", 1.0), (2, "le de la", "fr", None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs.select("doc_id", "text", "lang"), F.lit(True), ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "und"), (1, "en"), (1, "en"), (2, "fr")]
    kept = langid.identify(docs, F.lit(True), docs.columns, names=("__a", "__b"))
    assert kept.columns == [*docs.columns, "__a", "__b"] and kept.count() == 4


def test_marginals_against_enumeration():
    draw = np.random.default_rng(0)
    odds, turn, bounds = draw.normal(size=7), draw.normal(size=(2, 2)), np.array([0, 3, 3, 7])
    good, joint, total = quality.marginals(odds, bounds, turn)
    expected, pairs, log = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in zip(bounds[:-1], bounds[1:]):
        n, z, part = b - a, 0.0, np.zeros(b - a)
        both = np.zeros((2, 2))
        for k in range(2**n) if n else []:
            y = [(k >> i) & 1 for i in range(n)]
            p = np.exp(sum(odds[a + i] * y[i] for i in range(n)) + sum(turn[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            part += p * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += p
        if n:
            expected[a:b], pairs, log = part / z, pairs + both / z, log + np.log(z)
    assert np.allclose(good, expected) and np.allclose(joint, pairs) and np.isclose(total, log)


def test_quality_of_held_out_documents_and_edge_cases(spark):
    draw = random.Random(8)
    good = lambda: ". ".join(" ".join(draw.choice(EN) + draw.choice("abcdef") for _ in range(8)) for _ in range(4)).capitalize() + "."
    bad = lambda: " ".join(draw.choice(EN).upper() + "!!" for _ in range(30))
    rows, labels = [], []
    for i in range(240):
        label = int(i % 3 > 0)
        rows.append((i, "\n".join((good if label else bad)() for _ in range(3))))
        labels.append((i, label))
    rows += [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "x " * 50_000), (5, rows[5][1]), (None, "the of and")]
    labels += [(7, None), (None, 1), (8, 5)]
    docs, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, labels_, fold(F.col("doc_id"), 4) != 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in own) >= 0.97 * len(own)
    assert all(r.predicted == 0 and r.n_lines == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.classify(docs, labels_.limit(0), F.lit(True)).count() == len(rows)
    assert quality.classify(docs.limit(0), labels_, F.lit(True)).count() == 0


def test_the_fitting_sample_is_bounded_and_does_not_depend_on_the_deal(spark):
    assert quality.within([3, 9, 2, 5, 0], 10) == [0, 2, 3, 4]
    draw = random.Random(9)
    rows = [(i, "\n".join(f"{draw.choice(EN)} {draw.choice(FR)} w{draw.randrange(50)}." for _ in range(draw.randrange(1, 9)))) for i in range(60)] + [(60, "a b\n" * 5000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id int, quality int")
    first = quality.train(docs, labels, F.lit(True), sample_lines=1000)
    again = quality.train(docs.repartition(7).unionAll(docs.limit(3)), labels.repartition(3), F.lit(True), sample_lines=1000)
    assert np.allclose(first["w"], again["w"]) and first["a"] == again["a"]


def test_scores_equal_a_plain_version(spark):
    """Marginals by enumeration of all label sequences, on the features of each text alone."""
    draw = random.Random(4)
    rows = [(i, "\n".join(" ".join(draw.choice([*EN, "BUY!!", "7|7"]) for _ in range(draw.randrange(1, 7))) for _ in range(draw.randrange(1, 7)))) for i in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, F.lit(True)).collect()}
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        made, size, _ = quality.lines(data, np.array([0, len(data)]))
        odds, n = made @ model["w"] + model["shift"], len(made)
        weight, good = 0.0, np.zeros(n)
        for k in range(2**n):
            y = np.array([(k >> j) & 1 for j in range(n)])
            p = np.exp((odds * y).sum() + sum(model["turn"][y[j], y[j + 1]] for j in range(n - 1)))
            weight, good = weight + p, good + p * y
        raw = np.clip((size * good / weight).sum() / size.sum(), 1e-4, 1 - 1e-4)
        assert abs(got[i] - 1 / (1 + np.exp(-(model["a"] * np.log(raw / (1 - raw)) + model["b"])))) < 1e-9


def test_quality_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x", 1.5), (1, "a b", 9, "x", 1.5), (2, None, None, None, None)], "doc_id long, text string, quality int, mark string, score double")
    labels = spark.createDataFrame([(1, 1, "t", 0), (2, 0, "u", 1)], "doc_id long, quality int, text string, mark int")
    got = quality.classify(docs, labels, F.lit(True)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and all(0 <= r.score <= 1 for r in got)


def test_odds_without_the_matrix_equal_those_with_it():
    draw = np.random.default_rng(4)
    texts = ["one line\nTwo  lines!\n\n \nx y z", "", "alone", "\n", "a\nb\nc\nd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = {"w": draw.normal(size=quality.WIDTH), "shift": 0.3}
    made, size, bounds = quality.lines(data, offsets)
    odds, size2, bounds2 = quality.odds_of(data, offsets, model)
    assert np.allclose(odds, made @ model["w"] + model["shift"]) and (size == size2).all() and (bounds == bounds2).all()
    tracemalloc.start()
    quality.odds_of(np.frombuffer(b"a\n" * 500_000, np.uint8), np.array([0, 1_000_000]), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
