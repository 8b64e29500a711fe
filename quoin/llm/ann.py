"""Approximate nearest neighbours with randomly rotated one-bit codes.

Equal vectors form a class, searched once. A class vector is made unit length, turned
by a random orthogonal map into EXPAND times its dimensions, and stored as the signs
of its coordinates (packed bits) with a correction scalar r: the inner product of the
turned vector with its own code. Queries are turned alike and rounded to LEVELS bits a
coordinate, so that their inner product with a code c is a sum of popcounts of c with
the bit planes. That over r estimates the cosine without bias; its error stays under
z * sqrt((1 / r**2 - 1) / (width - 1)) with a probability set by z, and the rounding,
whose errors the code's signs add up at random, adds z times their root mean square
over r in the same sense.

Every query block meets every block of codes. There the query's limit is the k-th best
of the block's lower bounds, or of the exact scores that its task has found so far if
that is higher. Only candidates whose upper bound reaches it are scored, from the
original vectors, which stand beside the codes; a task hands on the k best of each query.

Blocks of codes stay where they are and query blocks come to them, a bounded number at
once, so neither is copied for each meeting and no pair of vectors is shuffled, however
many near copies a vector has. Of a class only the k + 1 smallest ids can be among the
nearest, since its members score equally, so a common vector is no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, table

K, BOUND, ROWS, QUERIES, SEED = 5, 2.0, 8192, 4096, 11
#: Queries whose planes and vectors are broadcast at once: 37 MB at 64 dimensions in single precision.
ROUND = 65536
#: Code bits for each dimension, and bits of a query's coordinate.
EXPAND, LEVELS = 8, 4


@lru_cache(8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal rows that turn vectors into EXPAND * dim dimensions or a few more, from the QR decomposition of normal numbers."""
    width = -(-dim * EXPAND // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest number first, so that none overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the turned unit vectors, and their corrections."""
    bits = np.packbits(turned > 0, axis=1)
    return bits.view(np.uint64), (np.abs(turned).sum(1) / np.sqrt(turned.shape[1])).astype(np.float32)


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of turned queries, and for each its least number, step, sum and root mean square of rounding errors."""
    least = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - least) / (2**LEVELS - 1), 1e-30)
    level = np.rint((turned - least) / step)
    planes = np.stack([np.packbits(level.astype(np.int64) >> j & 1, axis=1).view(np.uint64) for j in range(LEVELS)], 1)
    rounded = least + step * level
    return planes, np.concatenate([least, step, rounded.sum(1, keepdims=True), np.sqrt(((turned - rounded) ** 2).mean(1, keepdims=True))], 1)


class Codes:
    """A block of codes, laid out word by word, with what its bounds need for every query."""

    def __init__(self, codes: np.ndarray, correction: np.ndarray, z: float):
        width, r = 64 * codes.shape[1], correction.astype(np.float64)
        self.words = np.ascontiguousarray(codes.T)
        self.ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        self.scale = 1 / np.sqrt(width) / r
        self.rounding = z / r
        self.spread = z * np.sqrt(np.maximum(1 / r**2 - 1, 0) / (width - 1))

    def bounds(self, planes: np.ndarray, figures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of one query's cosines, from popcounts."""
        least, step, total, rounding = figures
        count = np.uint16 if 64 * len(self.words) << LEVELS < 1 << 16 else np.uint32
        weighed, half = np.zeros(self.words.shape[1], count), len(self.words) // 2
        for plane in planes[::-1]:
            ones = np.bitwise_count(self.words & plane[:, None])
            if 2 * half == len(ones):
                ones = ones[:half] + ones[half:]  # 128 at most, so bytes hold it
            weighed = (weighed << count(1)) + ones.sum(0, dtype=count)
        estimate = (2 * (least * self.ones + step * weighed.astype(np.float64)) - total) * self.scale
        error = self.spread + rounding * self.rounding
        return estimate - error, estimate + error


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision, each on its own so that equal rows score equally."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", b, b)) / np.sqrt(np.einsum("ij,ij->i", a, a))


def vectors_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


CODES = "dim int, rb int, c binary, least binary, code binary, correction binary, v binary"
ASKED = "dim int, qb int, q binary, planes binary, figures binary, w binary"


def packed(v: np.ndarray) -> bytes:
    """Vectors in single precision if that holds them exactly, else in double."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single.tobytes() if (single == v).all() else v.tobytes()


def unpacked(v: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(v, np.float32 if len(v) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def coder(seed: int):
    def code(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        v = vectors_of(rows.column("v"), dim)
        bits, correction = encode(unit(v) @ rotation(dim, seed))
        ids, least = (np.ascontiguousarray(rows.column(c).to_numpy()) for c in ("cls", "least"))
        out = {"dim": dim, "rb": rows.column("rb")[0].as_py(), "c": ids.tobytes(), "least": least.tobytes(), "code": bits.tobytes(), "correction": correction.tobytes(), "v": packed(v)}
        return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in out.items()})

    return code


def asker(seed: int):
    def ask(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        v = vectors_of(rows.column("v"), dim)
        planes, figures = quantise(unit(v) @ rotation(dim, seed))
        ids = np.ascontiguousarray(rows.column("cls").to_numpy())
        out = {"dim": dim, "qb": rows.column("qb")[0].as_py(), "q": ids.tobytes(), "planes": planes.tobytes(), "figures": figures.tobytes(), "w": packed(v)}
        return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in out.items()})

    return ask


def scoring(k: int, z: float):
    """The k nearest classes that a task finds for each query, with exact scores; ties go to the class of the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {x: batch.column(x)[r].as_py() for x in batch.schema.names}
                dim, q, c, least = row["dim"], *(np.frombuffer(row[x], np.int64) for x in ("q", "c", "least"))
                planes, figures = np.frombuffer(row["planes"], np.uint64).reshape(len(q), LEVELS, -1), np.frombuffer(row["figures"]).reshape(len(q), 4)
                codes = Codes(np.frombuffer(row["code"], np.uint64).reshape(len(c), -1), np.frombuffer(row["correction"], np.float32), z)
                v, w = unpacked(row["v"], len(c), dim), unpacked(row["w"], len(q), dim)
                for i, own in enumerate(q.tolist()):
                    low, high = codes.bounds(planes[i], figures[i])
                    limit = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
                    if own in best and len(best[own][0]) == k:
                        limit = max(limit, best[own][0][-1])
                    near = np.flatnonzero(high >= limit)
                    if not len(near):
                        continue
                    found = cosine(np.repeat(w[i : i + 1], len(near), 0), v[near]), c[near], least[near]
                    if own in best:
                        found = tuple(np.concatenate(x) for x in zip(best[own], found, strict=True))
                    first = np.lexsort((found[2], -found[0]))[:k]
                    best[own] = tuple(x[first] for x in found)
        n = [len(x[0]) for x in best.values()]
        scores, classes = (np.concatenate([*(x[j] for x in best.values()), np.zeros(0, kind)]) for j, kind in ((0, np.float64), (1, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), n)), pa.array(classes), pa.array(scores)], ["q", "c", "score"])

    return run


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite numbers, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    """The first n rows of each group, with their rank; Spark cuts each task's rows to n before it shuffles them."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col(name) <= n)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, z: float = BOUND, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of every query row by cosine.

    vectors: vec_id long, embedding array; other columns are ignored. is_query: which
    rows to search for. Vectors that are null, empty, zero or hold a null or non-finite
    number take no part, nor rows whose vec_id is null; vectors meet only vectors of
    their own length. Ties go to the smaller vec_id. Every row but the query's own is a
    candidate, so rows that repeat a vec_id are found one by one, and each of them that
    is a query has its own result. With fewer candidates all are returned.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = table(rows.select("*", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"), F.monotonically_increasing_id().alias("uid")), "vectors")
    members = first_rows(rows.select("id", "uid", "h1", "h2"), ["h1", "h2"], [F.col("id"), F.col("uid")], k + 1, "n").groupBy("h1", "h2").agg(F.collect_list(F.struct("id", "uid")).alias("members"))
    classes = rows.groupBy("h1", "h2").agg(F.min("uid").alias("cls"), F.min("id").alias("least"), F.max("asked").alias("asked"))
    classes = table(classes.join(members, ["h1", "h2"]).join(rows.select(F.col("uid").alias("cls"), "v", "dim"), "cls"), "vector-classes")
    n, asked = classes.agg(F.count("*"), F.count_if("asked")).first()
    row_blocks, query_blocks = -(-n // ROWS) or 1, -(-asked // QUERIES) or 1
    block = lambda count: F.pmod(F.xxhash64("cls"), F.lit(count)).cast("int")
    codes = classes.select("cls", "least", "v", "dim", block(row_blocks).alias("rb")).groupBy("dim", "rb").applyInArrow(coder(seed), CODES)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = table(codes, "codes").repartition(min(row_blocks, 4 * parts)).drop("rb")
    queries = classes.where("asked").select("cls", "v", "dim", block(query_blocks).alias("qb")).groupBy("dim", "qb").applyInArrow(asker(seed), ASKED)
    queries, at_once, found = table(queries, "queries"), max(1, ROUND // QUERIES), None
    for first in range(0, query_blocks, at_once):
        # at_once blocks of QUERIES queries are broadcast
        asked_now = queries.where(F.col("qb").between(first, first + at_once - 1)).drop("qb")
        near = table(codes.join(F.broadcast(asked_now), "dim").transform(mapped, scoring(k + 1, z), "q long, c long, score double"), "scored")
        found = near if found is None else found.unionAll(near)
    found = found.join(classes.select(F.col("cls").alias("c"), "members"), "c").select("q", "score", F.inline("members"))
    found = first_rows(found, ["q"], [F.desc("score"), F.col("id"), F.col("uid")], k + 1, "n").select("q", "score", F.col("id").alias("vec_id"), F.col("uid").alias("found"))
    own = rows.where("asked").select(F.col("id").alias("query_id"), "uid", "h1", "h2").join(classes.select("h1", "h2", F.col("cls").alias("q")), ["h1", "h2"])
    pairs = own.join(found, "q").where("uid != found")
    return first_rows(pairs, ["uid"], [F.desc("score"), F.col("vec_id"), F.col("found")], k, "rank").select("query_id", "rank", "vec_id", "score")
