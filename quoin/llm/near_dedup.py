"""MinHash near-duplicate detection with an LSH forest.

1. One pass over the texts gives each document the hash of its word sequence, the
   size of its set of word shingles and its MinHash values, TREES * DEPTH of them.
2. Equal word sequences form a class, represented by its smallest doc_id.
3. Every tree is one sorted order of the representatives by DEPTH of their MinHash
   values. All orders are laid out by one range partitioning on (tree, values, id),
   so a run of equal values, however long, is spread evenly. Neighbours in an order
   have the longest common prefixes: of the REACH rows on each side that share at
   least LEAST values, each document names the likeliest before and after it. How
   deep a prefix must be common to lie within REACH rows depends on the region: LEAST
   values in a thin one, more in a dense one. Rows by a partition's edges meet the
   REACH rows before that edge, through empty and short partitions. A document names
   2 * TREES candidates at most, however large its group is.
4. Candidates whose MinHash values agree too rarely for the similarity asked for are
   left out (five standard deviations below it). Links are confirmed on the full
   shingle sets of the whole texts and joined to components.
5. What that leaves open is joined exactly: the documents (the crowd) of runs that
   share LEAST values and hold more than one component, all of them where the run is
   longer than REACH + 1 rows, else those that have candidates. Their shingles are
   ordered by rarity, and two sets of the similarity asked for share one among the
   first n - ceil(2 t n / (1 + t)) + 1 of the smaller and the first
   n - ceil(t n) + 1 of the larger. All documents that share such a shingle and lie
   in different components are compared, those of a common one in blocks of about
   BLOCK rows spread over the tasks: by size, by MinHash agreement and by the
   parities of PARITIES places, which bound how far two sets differ. Links are
   confirmed on the full sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import mapped, perhaps_among, table
from .graph import components

WIDTH, PERCENT = 5, 85
TREES, DEPTH, LEAST, REACH = 10, 8, 2, 32
#: Hash ranges in which the crowd's shingles are counted, and rows of a block.
RANKS, BLOCK = 1 << 18, 1000
#: Places whose parities bound how much two sets of the crowd differ.
PARITIES = 1024
_PAGE = 1 << 12  # hash ranges counted in one row
_rng = np.random.default_rng(20240611)
_MUL = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)

SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, keys array<binary>"


def agreement(percent: int) -> int:
    """The least number of agreeing MinHash values of a candidate."""
    p, n = percent / 100, TREES * DEPTH
    return max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def sketcher(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in X.chunks(batch.column(1)):
                starts, ends, bounds = X.words(X.LOWER[data], offsets)
                tokens = X.word_hashes(X.LOWER[data], starts, ends)
                counts = np.diff(bounds)
                grams, at = X.shingles(tokens, bounds, width)
                place = np.arange(len(tokens)) - np.repeat(bounds[:-1], counts)
                up, down = X.powers(int(counts.max(initial=0)) + 2)
                filled = np.flatnonzero(counts)
                n = len(counts)
                h1, h2, sizes = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
                least = np.zeros((n, TREES * DEPTH), np.uint64)
                if len(filled):
                    for h, by, salt in ((h1, up, 7), (h2, down, 11)):
                        h[filled] = X.mix(np.add.reduceat(X.mix(tokens + np.uint64(salt)) * by[place + 1], bounds[:-1][filled]))
                    for k in range(TREES * DEPTH):
                        least[filled, k] = np.minimum.reduceat(grams * _MUL[k] + _ADD[k], at[:-1][filled])
                    for i in filled:
                        sizes[i] = len(np.unique(grams[at[i] : at[i + 1]]))
                top = (least >> np.uint64(32)).astype(">u4")
                sig = (top & 0xFF).astype(np.uint8)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(top))])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        pa.array(sizes),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(TREES * DEPTH), n, [None, pa.py_buffer(sig)]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), keys.cast(pa.binary())),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "keys"],
                )

    return sketch


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("back", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("sig", pa.binary())])
PAIR_SQL = "a long, b long, part int, place long, back long, tree int, key binary, sig binary"


def neighbours(tree, head, ids, sig, least: int, first: int) -> pa.RecordBatch:
    """Pairs of every row with its likeliest candidate before and after it, among REACH rows where tree and head are equal.

    Only rows from first on look back, so that rows seen before are not compared with each other again.
    """
    n = len(ids)
    most, other = np.zeros((2, n), np.int32), np.full((2, n), -1)
    for step in range(1, min(REACH, n - 1) + 1):
        lo = max(first, step)
        if lo >= n:
            break
        here = np.flatnonzero((tree[lo:] == tree[lo - step : n - step]) & (head[lo:] == head[lo - step : n - step]) & (ids[lo:] != ids[lo - step : n - step])) + lo
        for at in range(0, len(here), 50_000):
            i = here[at : at + 50_000]
            agree = (sig[i] == sig[i - step]).sum(1)
            good = agree >= least
            i, agree = i[good], agree[good]
            for side, own, near in ((0, i, i - step), (1, i - step, i)):
                better = agree > most[side, own]
                most[side, own[better]], other[side, own[better]] = agree[better], near[better]
    own = np.concatenate([np.flatnonzero(other[side] >= 0) for side in (0, 1)])
    near = np.concatenate([other[side][other[side] >= 0] for side in (0, 1)])
    pairs = np.unique(np.stack([np.minimum(ids[own], ids[near]), np.maximum(ids[own], ids[near])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(len(pairs), t) for t in PAIR.types[2:])], schema=PAIR)


def _arrays(rows: pa.Table):
    tree = rows.column("tree").to_numpy()
    keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)
    head = np.ascontiguousarray(keys[:, : 4 * LEAST]).view(f"V{4 * LEAST}").ravel() if 4 * LEAST != 8 else np.ascontiguousarray(keys[:, :8]).view(np.uint64).ravel()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
    return tree, head, rows.column("rep").to_numpy(), sig


def edge_rows(rows: pa.Table, part: int, places: np.ndarray, n: int) -> pa.RecordBatch:
    """The rows by a partition's edges, with their places from its start and from its end."""
    empty = pa.nulls(len(rows), pa.int64())
    columns = [rows.column("rep").combine_chunks(), empty, pa.array(np.full(len(rows), part, np.int32)), pa.array(places), pa.array(n - 1 - places)]
    return pa.RecordBatch.from_arrays([*columns, *(rows.column(c).combine_chunks().cast(t) for c, t in (("tree", pa.int32()), ("key", pa.binary()), ("sig", pa.binary())))], schema=PAIR)


def scan_part(batches: Iterator[pa.RecordBatch], part: int, least: int) -> Iterator[pa.RecordBatch]:
    """Candidates among a partition's sorted rows, then the rows by its edges."""
    head, tail, n = None, None, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        head = rows.slice(0, REACH) if head is None else pa.concat_tables([head, rows]).slice(0, REACH) if len(head) < REACH else head
        n += len(rows)
        held = 0 if tail is None else len(tail)
        rows = rows if tail is None else pa.concat_tables([tail, rows])
        yield neighbours(*_arrays(rows), least, held)
        tail = rows.slice(max(0, len(rows) - REACH))
    if tail is not None:
        more = min(len(tail), n - len(head))  # the others stand in head too
        places = np.concatenate([np.arange(len(head)), np.arange(n - more, n)]).astype(np.int64)
        yield edge_rows(pa.concat_tables([head, tail.slice(len(tail) - more)]), part, places, n)


def scanner(least: int):
    return lambda batches: scan_part(batches, TaskContext.get().partitionId(), least)


def borders(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(part, edge, take) from (part, rows): the rows from part's end that stand among the REACH before part edge.

    Empty parts have no rows and short ones are gone through, so REACH rows are found wherever there are as many.
    """
    out, counts = [], sorted(counts)
    for i, (edge, _) in enumerate(counts):
        need = REACH
        for part, rows in reversed(counts[:i]):
            out.append((part, edge, min(need, rows)))
            need -= rows
            if need <= 0:
                break
    return out


def across(least: int):
    """Pairs across a partition's edge, from the rows on both its sides."""

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.rename_columns(["rep", "tree", "key", "sig"]).sort_by([("tree", "ascending"), ("key", "ascending"), ("rep", "ascending")])
        return pa.Table.from_batches([neighbours(*_arrays(rows), least, 1)]).select(["a", "b"])

    return join


def verifier(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left, right = (list(gram_sets(batch.column(c), width)) for c in ("text_a", "text_b"))
                keep = []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and len(x):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return verify


def gram_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of every text."""
    for _, _, data, offsets in X.chunks(texts):
        lower = X.LOWER[data]
        starts, ends, bounds = X.words(lower, offsets)
        grams, at = X.shingles(X.word_hashes(lower, starts, ends), bounds, width)
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield np.unique(grams[i:j])


def tally(width: int):
    """How many of the crowd's shingles fall in each hash range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(RANKS, np.int64)
        for batch in batches:
            for grams in gram_sets(batch.column("text"), width):
                np.add.at(seen, (grams % np.uint64(RANKS)).astype(np.int64), 1)
        pages = [(k, zlib.compress(page.tobytes(), 1)) for k, page in enumerate(seen.reshape(-1, _PAGE)) if page.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int32()), pa.array([x for _, x in pages], pa.binary())], ["page", "counts"])

    return count


def added(rows: pa.Table) -> pa.Table:
    """The sum of a page's counts."""
    total = np.zeros(_PAGE, np.int64)
    for x in rows.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
    return pa.table({"page": rows.column("page").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


POST = pa.schema([("gram", pa.int64()), ("rep", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("front", pa.bool_()), ("sig", pa.binary())])
POST_SQL = "gram long, rep long, part long, n int, front boolean, sig binary"


def parities(grams: np.ndarray) -> bytes:
    """For each of PARITIES places of the shingles' hashes, whether an odd number falls there.

    Two sets' bits differ in no more places than the sets have shingles that are not common.
    """
    return np.packbits(np.bincount((grams >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1).tobytes()


def poster(width: int, percent: int, ranks):
    """The rarest shingles of the crowd's documents; front: those that suffice if the other set is not smaller."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 32):
                batch = whole.slice(first, 32)
                columns = [[] for _ in range(5)]
                sigs = []
                reps, groups = batch.column("rep").to_numpy(), batch.column("part").to_numpy()
                for i, grams in enumerate(gram_sets(batch.column("text"), width)):
                    n = len(grams)
                    if not n:
                        continue
                    keep, front = n + (-n * percent // 100) + 1, n + (-2 * n * percent // (100 + percent)) + 1
                    least = (grams[:, None] * _MUL + _ADD).min(0) if n <= 1 << 14 else np.array([(grams * m + a).min() for m, a in zip(_MUL, _ADD, strict=True)], np.uint64)
                    rare = grams[np.lexsort((grams, ranks.value[(grams % np.uint64(RANKS)).astype(np.int64)]))[:keep]]
                    for column, values in zip(columns, (rare.view(np.int64), np.full(keep, reps[i]), np.full(keep, groups[i]), np.full(keep, n, np.int32), np.arange(keep) < front), strict=True):
                        column.append(values)
                    sigs += [(least >> np.uint64(32)).astype(np.uint8).tobytes() + parities(grams)] * keep
                if sigs:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), t) for c, t in zip(columns, POST.types, strict=False)), pa.array(sigs, pa.binary())], schema=POST)

    return post


def meeter(percent: int, least: int):
    """Pairs of documents of different components among rows, sorted by gram, x and y, in which these are equal."""

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        gram, x, y, own, rep, part, n, front = (rows.column(c).to_numpy() for c in ("gram", "x", "y", "own", "rep", "part", "n", "front"))
        marks = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH + PARITIES // 8)
        sig, odd = marks[:, : TREES * DEPTH], np.ascontiguousarray(marks[:, TREES * DEPTH :]).view(np.uint64)
        n = n.astype(np.int64)
        found, step, alive = set(), 1, np.arange(1, len(gram))
        while len(alive):
            j = alive - step
            same = (gram[alive] == gram[j]) & (x[alive] == x[j]) & (y[alive] == y[j])
            alive, j = alive[same], j[same]
            small, large = np.minimum(n[alive], n[j]), np.maximum(n[alive], n[j])
            good = (part[alive] != part[j]) & ((x[alive] == y[alive]) | (own[alive] != own[j])) & (100 * small >= percent * large)
            good &= (front[alive] | (n[alive] > n[j])) & (front[j] | (n[j] > n[alive]))
            i, j = alive[good], j[good]
            good = (sig[i] == sig[j]).sum(1) >= least
            i, j = i[good], j[good]
            total = n[i] + n[j]
            good = np.bitwise_count(odd[i] ^ odd[j]).sum(1) <= total - 2 * -(-total * percent // (100 + percent))
            found.update(zip(np.minimum(rep[i], rep[j])[good].tolist(), np.maximum(rep[i], rep[j])[good].tolist(), strict=True))
            step += 1
            alive = alive[alive >= step]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not len(rows):
                continue
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = np.ones(len(rows), bool)
            for c in ("gram", "x", "y"):
                values = rows.column(c).to_numpy()
                last &= values == values[-1]
            cut = int(np.flatnonzero(last)[0])  # the last group may go on
            yield pairs_of(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield pairs_of(held)

    return meet


def crowd_pairs(slim: DataFrame, some: DataFrame, classes: DataFrame, joined: DataFrame, near: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) of different components of joined that may link beyond the candidates confirmed; none if there are none.

    slim: doc_id, text; some: the sketches; classes: rep; joined: node, component; near: rep of all that have a candidate.
    """
    spark = slim.sparkSession
    heads = some.select(F.col("doc_id").alias("rep"), F.transform("keys", lambda k: F.substring(k, 1, 4 * LEAST)).alias("heads"))
    heads = heads.join(classes.select("rep").distinct(), "rep", "left_semi").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(near.withColumn("near", F.lit(True)), "rep", "left")
    heads = heads.select("rep", F.coalesce("component", "rep").alias("part"), F.coalesce("near", F.lit(False)).alias("near"), F.posexplode("heads").alias("tree", "head"))
    own = F.when(F.col("near"), F.col("part"))
    runs = heads.groupBy("tree", "head").agg(F.count("*").alias("rows"), F.min("part").alias("low"), F.max("part").alias("high"), F.min(own).alias("near_low"), F.max(own).alias("near_high"))
    runs = runs.withColumn("long", (F.col("rows") > REACH + 1) & (F.col("low") != F.col("high")))
    runs = table(runs.where("long or near_low != near_high").select("tree", "head", "long"), "runs")
    if runs.isEmpty():
        return None
    crowd = table(heads.join(runs, ["tree", "head"]).where("long or near").select("rep", "part").distinct(), "crowd")
    texts = perhaps_among(slim.where("doc_id is not null"), "doc_id", crowd.select(F.col("rep").alias("doc_id")))
    texts = texts.join(crowd.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "part", "text")
    texts = table(texts, "crowd-texts")
    counts = np.zeros((RANKS // _PAGE, _PAGE), np.int64)
    tallied = texts.select("text").transform(mapped, tally(width), "page int, counts binary").groupBy("page").applyInArrow(added, "page int, counts binary")
    for page, x in tallied.collect():  # RANKS counts at most
        counts[page] = np.frombuffer(x, np.int64)
    ranks = spark.sparkContext.broadcast(counts.ravel())
    posts = table(texts.transform(mapped, poster(width, percent, ranks), POST_SQL), "posts")
    often = posts.groupBy("gram").agg(F.count("*").alias("c"), F.min("part").alias("low"), F.max("part").alias("high"), F.max("front").alias("any"))
    often = table(often.where("low != high and any").select("gram", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "often")
    shared = perhaps_among(posts, "gram", often).join(often, "gram")
    shared = shared.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    shared = shared.select("gram", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "part", "n", "front", "sig")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = shared.repartition(parts, "gram", "x", "y").sortWithinPartitions("gram", "x", "y")
    met = shared.transform(mapped, meeter(percent, agreement(percent)), "a long, b long")
    return table(met.distinct(), "crowd-pairs")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Each document's component of near-duplicates.

    docs: doc_id long, text string; other columns are ignored. Words are runs of
    characters other than space and 0x09-0x0D, A-Z lower-cased. Documents link if
    100 * |A & B| >= percent * |A | B| for their sets A, B of word shingles.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id). A null or empty text, or one of white space only, has
    no shingles, links with nothing and is its own component. A row whose doc_id
    is null has a null component and is not kept. Rows that repeat a doc_id share
    its component.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = table(slim.transform(mapped, sketcher(width), SKETCH), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = table(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    heads = some.select(F.col("doc_id").alias("rep"), "sig", "keys", "h1", "h2").join(classes.select("rep", "h1", "h2"), ["rep", "h1", "h2"], "left_semi")
    orders = heads.select("rep", "sig", F.posexplode("keys").alias("tree", "key"))
    rows = classes.count() * TREES
    parts = int(max(1, min(rows // (16 * REACH), max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    least = agreement(percent)
    ordered = orders.repartitionByRange(parts, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep").select("rep", "tree", "key", "sig")
    scanned = table(ordered.transform(mapped, scanner(least), PAIR_SQL), "scanned")
    edges = scanned.where("part is not null").select(F.col("a").alias("rep"), "tree", "key", "sig", "part", "place", "back")
    counts = [(r["part"], r["n"]) for r in edges.groupBy("part").agg(F.max(F.col("place") + F.col("back") + 1).alias("n")).collect()]  # a number for each partition
    # REACH rows for each partition at most are broadcast
    before = docs.sparkSession.createDataFrame(borders(counts), "part int, edge int, take long")
    sides = ["rep", "tree", "key", "sig", "edge"]
    tails = edges.join(F.broadcast(before), "part").where("back < take").select(*sides)
    sides = tails.union(edges.where(F.col("place") < REACH).withColumn("edge", F.col("part")).select(*sides))
    crossing = sides.groupBy("edge").applyInArrow(lambda rows: across(least)(rows.select(["rep", "tree", "key", "sig"])), "a long, b long")
    pairs = table(scanned.where("part is null").select("a", "b").union(crossing).distinct(), "pairs")

    def confirmed(wanted: DataFrame, name: str) -> DataFrame:
        ends = wanted.select(F.col("a").alias("doc_id")).union(wanted.select(F.col("b").alias("doc_id"))).distinct()
        texts = perhaps_among(slim.where("doc_id is not null"), "doc_id", ends)
        sided = wanted.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        sided = sided.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return table(sided.select("a", "b", "text_a", "text_b").transform(mapped, verifier(width, percent), "a long, b long"), name)

    links = confirmed(pairs, "links")
    joined = table(components(links), "joined")
    near = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    crowd = crowd_pairs(slim, some, classes, joined, near, width, percent)
    if crowd is not None:
        joined = table(components(links.union(confirmed(crowd, "crowd-links"))), "joined")
    found = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"), "n")
    found = table(found, "found")
    out = sketches.select("doc_id", "n_shingles", "h1", "h2").join(found.select("h1", "h2", "c"), ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
