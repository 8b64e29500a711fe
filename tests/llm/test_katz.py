import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import katz
from quoin.llm.common import fold

from . import helpers as H


def plain(texts, learn):
    seqs = {i: [*H.words(t), 0] for i, t in texts.items()}
    uni, bi = Counter(), defaultdict(Counter)
    for i in learn:
        h = 1
        for w in seqs[i]:
            uni[w] += 1
            bi[h][w] += 1
            h = w
    n = sum(uni.values())
    seen = lambda counts: [sum(c == r for c in counts) for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(seen(list(uni.values()))), katz.discounts(seen([c for h in bi for c in bi[h].values()]))
    cut = lambda c, d: c if c > katz.K else c * d[c]
    kept = sum(cut(c, d1) for c in uni.values())
    scale = n / (n + 1) if kept >= n else 1.0
    lower = lambda w: cut(uni[w], d1) * scale / n if uni[w] else 1 - kept * scale / n

    def chance(w, h):
        if h not in bi:
            return lower(w)
        total, mass = sum(bi[h].values()), sum(cut(c, d2) for c in bi[h].values())
        rest = 1 - sum(lower(x) for x in bi[h])
        factor = total / (total + 1) if mass >= total else 1.0
        if bi[h][w]:
            return cut(bi[h][w], d2) * factor / total
        return (1 - mass * factor / total) / rest * lower(w)

    return seqs, uni, n, chance


@pytest.mark.parametrize("chunk", [katz.CHUNK, 200])
def test_scores_equal_a_plain_model_that_sums_to_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "HOT", 5)
    monkeypatch.setattr(katz, "DICTIONARY", 40)
    draw = random.Random(2)
    texts = {i: " ".join(f"w{int(draw.paretovariate(0.7)) % 60}" for _ in range(draw.randrange(0, 60))) for i in range(90)}
    texts |= {90: "", 91: None, 92: "never seen words here", 93: texts[3]}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = katz.score_all(docs, fold(F.col("doc_id"), 7) != 2).collect()
    seqs, uni, n, chance = plain(texts, learn)
    assert len(rows) == len(texts)
    for r in rows:
        h, score, base = 1, 0.0, 0.0
        for w in seqs[r.doc_id]:
            score += math.log10(chance(w, h))
            base += math.log10((uni[w] + 1) / (n + len(uni) + 1))
            h = w
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seqs[r.doc_id]), sum(uni[w] > 0 for w in seqs[r.doc_id]), n)
    for h in ["w1", "w2", 1, "no such"]:
        assert sum(chance(w, h) for w in uni) + chance("unknown", h) == pytest.approx(1)


def test_edge_cases(spark):
    schema = "doc_id long, text string, score string, learn int"
    rows = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "c", None, None)], schema)
    got = katz.score_all(rows, F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in got) == [(0, 2, 8), (1, 3, 8), (1, 3, 8)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = katz.score_all(rows, F.lit(False)).collect()
    assert len(none) == 3
    assert none[0].score == 0 and none[0].n_known == 0 and none[0].train_tokens == 0
    assert katz.score_all(rows.limit(0), F.lit(True)).count() == 0


def test_rows_with_null_or_repeated_ids_are_scored_on_their_own(spark):
    texts = ["a b c a b", "a b c a b", "b c", None, "a b c", "b c a", "b c a", "c c"]
    ids = [None, None, 5, 5, 5, 6, 7, None]
    one = katz.score_all(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True)).collect()
    two = katz.score_all(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3), F.lit(True)).collect()
    figures = lambda rows, i: sorted((r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in rows if i(r))
    assert figures(one, lambda r: True) == figures(two, lambda r: True)
    assert figures(one, lambda r: r.doc_id in (2, 3, 4)) == figures(two, lambda r: r.doc_id == 5)


def test_a_very_long_text_with_one_hot_pair(spark):
    rows = [(1, "a b " * 200_000), (2, "a b"), (3, "b a")]
    got = {r.doc_id: r for r in katz.score_all(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert got[1].n_tokens == 400_001 == got[1].n_known and got[2].score > got[3].score


def test_packing_round_trip():
    draw = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64, np.int64, np.float64):
        for n in (0, 1, 77):
            x = draw.integers(0, 1 << 30, n).astype(kind)
            assert (katz.unpack(katz.pack(x), kind) == x).all()
