import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import mixing, sharding

from . import helpers as H


def fill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over


def corpus():
    draw = random.Random(4)
    rows = []
    for i in range(3000):
        source = draw.choice(["a", "b", "b", "b", "b", "c", "z", None, "tiny"] if i % 50 else ["tiny"])
        rows.append((i, H.prose(draw, int(draw.paretovariate(1.2)) % 400 + 1), source))
    return [*rows, (5000, None, "a"), (5001, "", "b"), (5002, " \n", None)]


def test_targets_sizes_and_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(H.words(text))
    expected = fill(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(H.words(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
    largest = {s: max(len(H.words(t)) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def scale_of(words, rest):
    """chance of each class: min(1, scale * class) with rest words expected, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(1, middle * k) * w for k, w in words.items()) < rest else (low, middle)
    return {k: min(1, high * k) for k in words}


def test_inclusion_odds_differ_by_size_and_decide(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * (1 << draw.randrange(0, 9))), "ab"[i % 8 == 0]) for i in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    goal = mixing.targets(sized)
    chance = {(r.source, r["class"]): (r.chance, r.rest, r.whole) for r in mixing.chances(sized, goal).collect()}
    words = Counter()
    for _, t, source in rows:
        words[source, (n := len(t.split())).bit_length()] += n
    for source in "ab":
        rest = chance[source, 1][1]
        own = scale_of({k: w for (s, k), w in words.items() if s == source}, rest)
        assert all(chance[source, k][0] == pytest.approx(own[k]) for k in own) and len(set(own.values())) > 3
    got = mixing.mix(docs).collect()
    seen, taken = Counter(), Counter()
    for r in got:
        k = r.source, r.size.bit_length()
        seen[k], taken[k] = seen[k] + 1, taken[k] + r.copies - chance[k][2]
    for k, n in seen.items():
        p = chance[k][0]
        assert abs(taken[k] / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 0.01, k
    assert len({round(taken[k] / n, 1) for k, n in seen.items() if k[0] == "a"}) > 2


def test_other_odds_give_another_ranking(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("mark"), (F.lit(0.1) + F.col("id") % 7 / 10).alias("chance"))
    ranks = lambda chance: [r.doc_id for r in rows.orderBy(mixing.standing(chance, "s"), "doc_id").collect()]
    assert ranks(F.col("chance")) != ranks(F.lit(0.5)) and ranks(F.lit(0.4)) == ranks(F.lit(0.5))
    certain = rows.select(mixing.standing(F.lit(1.0), "s").alias("q")).distinct().collect()
    assert [r.q for r in certain] == [0.0]


def test_many_sources_are_numbered_in_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.format_string("h%05d", F.col("id")).alias("source"))
    got = {r.source: r for r in mixing.targets(rows.select("doc_id", "source", F.lit(2).cast("long").alias("size"))).collect()}
    expected = fill({f"h{i:05d}": 2 for i in range(1000)})
    assert all(got[s].target == pytest.approx(t) for s, t in expected.items())


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string, size string, target int"
    rows = spark.createDataFrame([(1, "a b", "s", "x", 1), (1, "a b", "s", "x", 1), (None, "c d", None, None, None), (None, None, None, None, None)], schema)
    got = mixing.mix(rows).collect()
    assert len(got) == 4 and len({r.taken for r in got if r.doc_id == 1}) == 1 and {r.size for r in got} == {2, 0}
    assert mixing.mix(rows.limit(0)).count() == 0
    nulls = mixing.mix(spark.createDataFrame([(None, f"w{i} x", "s") for i in range(300)] + [(1, "a", "t")], "doc_id long, text string, source string"))
    assert 1 < nulls.where("source = 's'").select("copies").distinct().count() or nulls.where("source = 's' and copies = 1").count() == 300
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")).collect()] == [0]


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, here = (low + high) // 2, 1, 0
        for s in sizes:
            if here + s > middle:
                used, here = used + 1, 0
            here += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def lined(keys, sizes, bits, big=()):
    """The line of at most 2**bits ranges, with the groups of big on their own."""
    place = (keys >> (60 - bits)) * 4 * len(keys) + sum((2 * (keys > k) + (keys == k) for k in big), np.zeros(len(keys), np.int64))
    own = [keys[place == p] for p in np.unique(place)], [sizes[place == p] for p in np.unique(place)]
    return sharding.Line([k[0] for k in own[0]], [k[-1] for k in own[0]], [s.sum() for s in own[1]], [s.max() for s in own[1]], [len(s) for s in own[1]]), own


def fetcher(keys, sizes, asked=None):
    def fetch(wanted):
        out = []
        for first, last in wanted:
            here = (keys >= first) & (keys <= last)
            part = (keys[here] - first) >> max(0, (last - first).bit_length() - 8)
            for p in np.unique(part):
                k, s = keys[here][part == p], sizes[here][part == p]
                out.append((k[0], k[-1], s.sum(), s.max(), len(k)))
        if asked is not None:
            asked.append(sum(x[4] for x in out))
        return tuple(np.array(x, np.int64) for x in zip(*out))

    return fetch


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_a_large_group_makes_the_driver_look_at_few_others(share):
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << 60, 400_000))
    sizes = draw.integers(500, 4000, len(keys))
    at = len(keys) // 3
    sizes[at] = int(share * sizes.sum() / 24)
    asked = []
    line, _ = lined(keys, sizes, 10, keys[[at]])
    _, cuts = sharding.partition(line, 24, fetcher(keys, sizes, asked))
    assert sum(asked) < 0.05 * len(keys)
    place = np.searchsorted(np.array(cuts), keys)
    capacity = least_capacity(sizes.tolist(), 24)
    assert max(sizes[place == k].sum() for k in range(24)) == capacity


@pytest.mark.parametrize("seed", range(6))
def test_partition_is_the_least_one_for_any_ranges(seed):
    draw = np.random.default_rng(seed)
    n, shards = int(draw.integers(1, 300)), int(draw.integers(1, 12))
    keys = np.unique(draw.integers(0, 1 << 60, n))
    sizes = (draw.pareto(1.0, len(keys)) * 20 + 8).astype(np.int64)
    line, _ = lined(keys, sizes, 3)
    capacity, cuts = sharding.partition(line, shards, fetcher(keys, sizes))
    assert capacity == least_capacity(sizes.tolist(), shards)
    at = np.searchsorted(np.array(cuts), keys)
    assert max(sizes[at == k].sum() for k in range(shards)) == capacity


def test_shards_keep_groups_together_and_slots_have_no_gaps(spark):
    draw = random.Random(1)
    rows = [(i, H.prose(draw, draw.randrange(1, 200))) for i in range(1500)] + [(2000 + i, "copied text " * 400) for i in range(100)] + [(9000, None), (9001, None), (9002, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    where, slots, total = {}, {}, Counter()
    for r in got:
        assert where.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < 24 and r.size == len((r.text or "").encode()) + 8
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    alone = where["copied text " * 400]
    rest = [v for k, v in total.items() if k != alone]
    assert {r.doc_id for r in got if r.shard == alone} == set(range(2000, 2100)) and max(rest) < 1.1 * min(rest)


def test_sharding_edge_cases(spark):
    schema = "doc_id long, text string, shard string, key int, size int"
    rows = spark.createDataFrame([(1, "a", "x", 1, 1), (1, "a", "x", 1, 1), (None, "é", None, None, None)], schema)
    got = sharding.shard(rows).collect()
    assert len(got) == 3 and {r.law for r in got} == {"bytes"} and {r.size for r in got} == {9, 10} and all(r.grown_shard is None for r in got)
    assert sharding.shard(rows.limit(0)).count() == 0
