import random

import numpy as np
import pyarrow as pa

from quoin.llm import text as X
from quoin.llm.common import perhaps_among, release, table, without
from quoin.llm.graph import components

from . import helpers as H


def test_words_and_shingles_agree_with_plain_ones():
    draw = random.Random(1)
    texts = ["", None, " \t\n", "one", "a b c d", "a b c d e", "Ünï  cödé\x0bx\x0cy\r\nZ", *(H.prose(draw, draw.randrange(40), 6) for _ in range(40))]
    for _, _, data, offsets in X.chunks(pa.array(texts)):
        lower = X.LOWER[data]
        starts, ends, bounds = X.words(lower, offsets)
        hashes = X.word_hashes(lower, starts, ends)
        grams, at = X.shingles(hashes, bounds, 5)
        known = {}
        for i, t in enumerate(texts):
            own = [bytes(lower[a:b]).decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])]
            assert own == H.words(t)
            for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]]):
                assert known.setdefault(w, h) == h
            assert len(np.unique(grams[at[i] : at[i + 1]])) == len(H.shingles(t))
        assert len(set(known.values())) == len(known)


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_lose_nothing(spark):
    rows = spark.range(2000).selectExpr("id as k", "cast(id as string) as v")
    wanted = spark.range(0, 2000, 7).selectExpr("id as k")
    kept = {r.k for r in perhaps_among(rows, "k", wanted).collect()}
    assert set(range(0, 2000, 7)) <= kept and len(kept) < 400
    assert {r.k for r in without(rows, "k", wanted).collect()} == {i for i in range(2000) if i % 7}


def test_scratch_tables_can_be_released(spark):
    import os

    kept = table(spark.range(3).toDF("k"), "scratch")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 3 and os.path.isdir(path)
    release(spark)
    assert not os.path.isdir(path)
