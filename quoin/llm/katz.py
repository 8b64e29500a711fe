"""Katz backoff language model over words: Good-Turing discounts, exactly normalised backoff weights.

P(w | h) = d * c(h w) / c(h) if the pair was seen in training, else alpha(h) * P(w);
P(w) = d * c(w) / N if the word was seen, else what the discounts leave, which one
symbol for all unknown words gets. alpha(h) is the mass that the discounts leave in
h over the unigram mass of the words not seen after h, so that every context sums
to one. An unseen context has alpha 1.

Counting and scoring share one exchange. Each chunk of texts makes its distinct
(context, word, text) entries, sorts them by bucket and packs every bucket's part
into a row of compressed columns. A bucket holds whole contexts, except hot ones
(over 1/HOT of all words, or more words than a bucket holds, DICTIONARY at most),
which are spread by word and whose few statistics are added up by task and context. Words that make up less than 1/DICTIONARY
of all pass through a bucket of their own first, where their counts are known; the
others' counts travel with the job. The pair table has one row a bucket, the
unigram table is partitioned by word; only sums of counts and the two bounded lists
reach the driver. Words are told apart by 63 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import flagged, mapped, table

K, DICTIONARY, HOT, BUCKET = 5, 1_000_000, 1000, 1_500_000
CHUNK = 4_000_000
POINT = float(1 << 32)  # logarithms travel as whole numbers of 1 / POINT
END, START, FIRST = np.uint64(2), np.uint64(1), np.uint64(16)  # below any word's code; frequent words count from FIRST
_WORD = np.uint64(1 << 63)


def pack(values: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts, each text's followed by END, and the bounds of texts."""
    lower = X.LOWER[data]
    starts, ends, bounds = X.words(lower, offsets)
    hashes = X.word_hashes(lower, starts, ends) | _WORD
    counts = np.diff(bounds) + 1
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    made = np.full(out[-1], END, np.uint64)
    last = np.zeros(out[-1], bool)
    last[out[1:] - 1] = True
    made[~last] = hashes
    return made, out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, learnt from, codes, bounds) of chunks of texts."""
    for batch in batches:
        ids, learn = batch.column("doc_id").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False)
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def joined(held=held, ids=ids, learn=learn):
            made, shift = [], 0
            bounds = [np.zeros(1, np.int64)]
            for _, _, c, b in held:
                made.append(c)
                bounds.append(b[1:] + shift)
                shift += len(c)
            rows = slice(held[0][0], held[-1][1])
            return ids[rows], learn[rows], np.concatenate(made), np.concatenate(bounds)

        for first, last, data, offsets in X.chunks(batch.column("text")):
            held.append((first, last, *codes(data, offsets)))
            size += len(data)
            if size >= CHUNK:
                yield joined()
                held.clear()
                size = 0
        if held:
            yield joined()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, learn, words, bounds in batches_of(batches):
        own = words[np.repeat(learn, np.diff(bounds))]
        distinct, n = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], ["w", "c"])


PART = "bucket int, docs binary, learn binary, h binary, w binary, c binary, each binary, doc binary, n binary"
_PART = ["bucket", "docs", "learn", "h", "w", "c", "each", "doc", "n"]


def parts(h, w, c, doc, n, bucket, docs, learn) -> Iterator[dict]:
    """Rows of PART from entries with their buckets; c: the counts of words that are not frequent, else 0."""
    order = np.lexsort((w, h, bucket))
    h, w, c, doc, n, bucket = (x[order] for x in (h, w, c, doc, n, bucket))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])
    head = np.flatnonzero(new)
    each = np.diff(np.append(head, len(h)))
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    pair_edges = np.searchsorted(head, edges)
    for i, a in enumerate(edges):
        b = edges[i + 1] if i + 1 < len(edges) else len(h)
        p, q = pair_edges[i], pair_edges[i + 1] if i + 1 < len(edges) else len(head)
        here = np.unique(doc[a:b])
        local = np.searchsorted(here, doc[a:b])
        yield {
            "bucket": int(bucket[a]), "docs": pack(docs[here]), "learn": pack(learn[here].astype(np.uint8)), "h": pack(np.diff(h[head[p:q]], prepend=np.uint64(0))), "w": pack(w[head[p:q]]),
            "c": pack(c[head[p:q]].astype(np.uint32)), "each": pack(each[p:q].astype(np.uint32)), "doc": pack(local.astype(np.uint32)), "n": pack(n[a:b].astype(np.uint32)),
        }


def length(data: bytes) -> int:
    """How many numbers are packed."""
    return int.from_bytes(data[:4], "little")


def opened(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries (h, w, c, doc, n) of several rows of PART, and the docs and learn flags they number."""
    column = {k: rows.column(k).to_pylist() for k in _PART[1:]}
    total = sum(map(length, column["n"]))
    h, w = np.empty(total, np.uint64), np.empty(total, np.uint64)
    c, doc, n = (np.empty(total, np.uint32) for _ in range(3))
    docs, learn, at, shift = [], [], 0, 0
    for i in range(rows.num_rows):
        each = unpack(column["each"][i], np.uint32)
        end = at + length(column["n"][i])
        h[at:end] = np.repeat(np.cumsum(unpack(column["h"][i], np.uint64), dtype=np.uint64), each)
        w[at:end], c[at:end] = (np.repeat(unpack(column[k][i], t), each) for k, t in (("w", np.uint64), ("c", np.uint32)))
        doc[at:end], n[at:end] = unpack(column["doc"][i], np.uint32) + np.uint32(shift), unpack(column["n"][i], np.uint32)
        docs.append(unpack(column["docs"][i], np.int64))
        learn.append(unpack(column["learn"][i], np.uint8).astype(bool))
        at, shift = end, shift + len(docs[-1])
    return h, w, c, doc, n, np.concatenate(docs), np.concatenate(learn)


def home(h: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair: by context, by pair for hot contexts."""
    is_hot = np.isin(h, hot)
    return (np.where(is_hot, X.mix(h + X.mix(w)), X.mix(h)) % np.uint64(buckets)).astype(np.int64)


def records(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.binary())) for k in _PART], _PART)


def recode(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with small numbers for the known ones, which pack well; and which are known."""
    place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    found = known[place] == words if len(known) else np.zeros(len(words), bool)
    return np.where(found, place.astype(np.uint64) + FIRST, words), found


def full_counts(w: np.ndarray, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of words in training: those of frequent words from the list, which rows leave out."""
    out = c.astype(np.int64)
    own = (w >= FIRST) & (w < _WORD)
    out[own] = counts[(w[own] - FIRST).astype(np.int64)]
    return out


def emitter(frequent, hot: np.ndarray, buckets: int, rare: bool):
    """Entries whose word is frequent, in their pairs' buckets; or those whose word is rare, in their words'.

    frequent.value: the frequent words in order, and their counts.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = frequent.value
        for docs, learn, words, bounds in batches_of(batches):
            words, is_known = recode(words, known)
            before = np.empty_like(words)
            before[1:] = words[:-1]
            before[bounds[:-1]] = START
            keep = np.flatnonzero(~is_known if rare else is_known)
            if not len(keep):
                continue
            doc = np.repeat(np.arange(len(docs)), np.diff(bounds))[keep]
            h, w = before[keep], words[keep]
            key = X.mix(h * np.uint64(3) + w)
            order = np.argsort(X.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            h, w, doc = h[order], w[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(h)))
            h, w, doc = h[head], w[head], doc[head]
            by_doc = np.argsort(doc, kind="stable")
            h, w, doc, n = (x[by_doc] for x in (h, w, doc, n))
            bucket = (X.mix(w) % np.uint64(buckets)).astype(np.int64) if rare else home(h, w, hot, buckets)
            yield records(list(parts(h, w, np.zeros(len(h), np.uint32), doc, n, bucket, docs, learn)))

    return emit


def counted(hot: np.ndarray, buckets: int):
    """The entries of a bucket of rare words, with the words' counts, in their pairs' buckets."""

    def run(rows: pa.Table) -> pa.Table:
        h, w, _, doc, n, docs, learn = opened(rows)
        distinct, place = np.unique(w, return_inverse=True)
        c = np.bincount(place, n * learn[doc], minlength=len(distinct))[place]
        return pa.Table.from_batches([records(list(parts(h, w, c, doc, n, home(h, w, hot, buckets), docs, learn)))])

    return run


TABLE = "bucket int, docs binary, learn binary, h binary, w binary, c1 binary, c2 binary, each binary, doc binary, n binary, seen array<long>, hot binary"


def merged(frequent, hot: np.ndarray, unigram: dict):
    """One row for a bucket: its pairs in order of context, with counts; how many pairs occur 1, 2, ... times; hot contexts' statistics."""

    def run(rows: pa.Table) -> pa.Table:
        h, w, c, doc, n, docs, learn = opened(rows)
        order = np.lexsort((w, h))
        h = h[order]  # one after the other, so that few copies are held at once
        w = w[order]
        c = c[order]
        doc = doc[order]
        n = n[order]
        del order
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        head = np.flatnonzero(new)
        each = np.diff(np.append(head, len(h)))
        c2 = np.add.reduceat(n * learn[doc], head).astype(np.int64)
        seen = np.bincount(np.minimum(c2, K + 2), minlength=K + 3)[1 : K + 2]
        ph = h[head]
        statistics = context_sums(ph, c2, full_counts(w[head], c[head], frequent.value[1]), unigram)
        is_hot = np.isin(statistics[0], hot)
        stats = b"".join([np.ascontiguousarray(statistics[0][is_hot]).tobytes(), np.ascontiguousarray(statistics[1][is_hot]).tobytes()])
        out = {
            "bucket": rows.column("bucket")[0].as_py(), "docs": pack(docs), "learn": pack(learn.astype(np.uint8)), "h": pack(np.diff(ph, prepend=np.uint64(0))), "w": pack(w[head]),
            "c1": pack(c[head].astype(np.uint32)), "c2": pack(c2.astype(np.uint32)), "each": pack(each.astype(np.uint32)), "doc": pack(doc), "n": pack(n), "seen": seen.tolist(), "hot": stats,
        }
        kinds = {"bucket": pa.int32(), "seen": pa.list_(pa.int64())}
        return pa.Table.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in out.items()], names=list(out))

    return run


def context_sums(h: np.ndarray, c2: np.ndarray, c1: np.ndarray, unigram: dict) -> tuple[np.ndarray, np.ndarray]:
    """For every context of sorted pairs: numbers of followers seen 1..K times, words after it that are seen more often, unigram mass of those seen."""
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    columns = [c2 == r for r in range(1, K + 1)] + [np.where(c2 > K, c2, 0), np.where(c2 > 0, word_chance(c1, unigram), 0.0)]
    return h[head], np.stack([np.add.reduceat(x.astype(np.float64), head) if len(head) else np.zeros(0) for x in columns], 1)


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0..K (0 unused) from numbers of types seen 1..K+1 times.

    The numbers are first smoothed by a line through their logarithms (simple
    Good-Turing), for which copies in the corpus make them uneven. A line that falls
    too slowly to discount, or fewer than two numbers, gives (r - 0.5) / r.
    """
    r = np.arange(1, K + 1)
    points = [(np.log(i), np.log(s)) for i, s in enumerate(seen, 1) if s > 0]
    slope = np.polyfit(*zip(*points, strict=True), 1)[0] if len(points) > 1 else 0.0
    if slope < -1.001:
        cut = (K + 1.0) ** (slope + 1)
        return np.append(1.0, ((1 + 1 / r) ** (slope + 1) - cut) / (1 - cut))
    return np.append(1.0, (r - 0.5) / r)


def word_chance(c: np.ndarray, unigram: dict) -> np.ndarray:
    """P(w) by the words' counts; 0 counts as the unknown word."""
    d = unigram["d"]
    scaled = np.where(c > K, c, c * d[np.minimum(c, K)])
    return np.where(c > 0, scaled * unigram["scale"] / max(unigram["n"], 1), unigram["unknown"])


def unigram_model(counts: list[int], n: int, v: int, seen: list[int]) -> dict:
    """counts: the numbers of words seen 1..K times weigh the discounts; what they leave is the unknown word's."""
    d = discounts(seen)
    kept = sum(d[r] * r * counts[r - 1] for r in range(1, K + 1)) + (n - sum(r * counts[r - 1] for r in range(1, K + 1)))
    left = 1 - kept / n if n else 1.0
    scale = 1.0
    if left <= 0:  # no word was seen K times or fewer: one more word's worth is left for unknown ones
        scale = n / (n + 1)
        left = 1 - kept / n * scale
    return {"d": d, "n": n, "v": v, "scale": scale, "unknown": left}


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(h), alpha(h) and the factor of seen pairs' chances, from contexts' statistics."""
    r = np.arange(1, K + 1)
    total = sums[:, :K] @ r + sums[:, K]
    kept = sums[:, :K] @ (d[1:] * r) + sums[:, K]
    factor = np.ones(len(sums))
    safe = np.maximum(total, 1)
    # nothing discounted: one more word's worth is left for unseen words
    factor = np.where((total > 0) & (kept >= total), total / (total + 1), factor)
    left = 1 - kept * factor / safe
    rest = 1 - sums[:, K + 1]
    # every word was seen after h: its seen words share all
    factor = np.where((total > 0) & (rest <= 1e-12), safe / np.maximum(kept, 1e-300), factor)
    alpha = np.where(total == 0, 1.0, np.where(rest <= 1e-12, 0.0, left / np.maximum(rest, 1e-300)))
    return total, alpha, factor


SCORE = "part int, docs binary, score binary, base binary, tokens binary, known binary, ends binary"
_SCORE = ["part", "docs", "score", "base", "tokens", "known", "ends"]


def scorer(frequent, d: np.ndarray, unigram: dict, hot: tuple[np.ndarray, np.ndarray], groups: int):
    """Sums of each key's entries in a bucket, dealt to groups by key; ends: how many rows share the key."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ("docs", "h", "w", "c1", "c2", "each", "doc", "n")}
                h = np.cumsum(unpack(r["h"], np.uint64), dtype=np.uint64)
                w = unpack(r["w"], np.uint64)
                c1 = full_counts(w, unpack(r["c1"], np.uint32), frequent.value[1])
                is_end = w == recode(np.array([END]), frequent.value[0])[0][0]
                c2 = unpack(r["c2"], np.uint32).astype(np.int64)
                contexts, sums = context_sums(h, c2, c1, unigram)
                at = np.searchsorted(contexts, hot[0])
                found = np.flatnonzero((at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == hot[0]))
                sums[at[found]] = hot[1][found]
                total, alpha, factor = backoff(sums, d)
                own = np.repeat(np.arange(len(contexts)), np.diff(np.append(np.searchsorted(h, contexts), len(h))))
                lower = word_chance(c1, unigram)
                kept = np.where(c2 > K, c2, c2 * d[np.minimum(c2, K)])
                chance = np.where(c2 > 0, kept * factor[own] / np.maximum(total[own], 1), alpha[own] * lower)
                with np.errstate(divide="ignore"):
                    logs = np.log10(chance)
                base = np.log10((c1 + 1) / (unigram["n"] + unigram["v"] + 1))
                pair = np.repeat(np.arange(len(h)), unpack(r["each"], np.uint32))
                doc, n, docs = unpack(r["doc"], np.uint32), unpack(r["n"], np.uint32), unpack(r["docs"], np.int64)
                ids, place = np.unique(docs, return_inverse=True)
                doc = place[doc]
                columns = [np.bincount(doc, x, minlength=len(ids)) for x in (logs[pair] * n, base[pair] * n, n, n * (c1 > 0)[pair], n * is_end[pair])]
                group = (X.mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                rows = []
                for g in np.unique(group).tolist():
                    mine = group == g
                    s, b, t, k, e = (x[mine] for x in columns)
                    rows.append((g, pack(np.diff(ids[mine], prepend=0)), *(pack(x.astype(np.int64)) for x in (np.rint(s * POINT), np.rint(b * POINT), t, k, e))))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int32() if j == 0 else pa.binary()) for j in range(7)], _SCORE)

    return score


def summed(rows: pa.Table) -> pa.Table:
    """Per key the sums over its buckets, shared among the rows of that key: of whole numbers, so in any order."""
    docs = np.concatenate([np.cumsum(unpack(x, np.int64)) for x in rows.column("docs").to_pylist()])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    head = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1))
    total = lambda column: np.add.reduceat(np.concatenate([unpack(x, np.int64) for x in rows.column(column).to_pylist()])[order], head)
    out, ends = {"key": docs[head]}, total("ends")
    for name, column in (("score", "score"), ("base_score", "base"), ("n_tokens", "tokens"), ("n_known", "known")):
        out[name] = total(column) / ends / POINT if column in ("score", "base") else total(column) // ends
    return pa.Table.from_pandas(pd.DataFrame(out), preserve_index=False)


def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hot contexts' statistics, added up over a task's buckets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for raw in batch.column("hot").to_pylist():
            size = len(raw) // (8 * (K + 3))
            keys, values = np.frombuffer(raw[: 8 * size], np.uint64), np.frombuffer(raw[8 * size :], np.float64).reshape(size, K + 2)
            for key, value in zip(keys.tolist(), values, strict=True):
                sums[key] = sums.get(key, 0) + value
    made = np.array(list(sums.values())).reshape(len(sums), K + 2)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(sums), np.uint64).view(np.int64)), *(pa.array(made[:, k]) for k in range(K + 2))], ["h", *(f"s{k}" for k in range(K + 2))])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key: the doc_id, or a hash of the text where the doc_id is null or may stand on several rows.

    Rows that get one key have one text, and so one score.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    repeated = table(ids.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    rows = flagged(docs, "doc_id", repeated)
    return rows.withColumn("key", F.when(F.col("doc_id").isNull() | F.col("__hit"), F.xxhash64("text")).otherwise(F.col("doc_id"))).drop("__hit")


def score_all(docs: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row's whole text.

    docs: doc_id, text; learn_from: which rows to learn from (null: not). Words are runs
    of characters other than space and 0x09-0x0D, A-Z lower-cased; one end follows each
    text and counts as a token. A null text is empty: its only token is the end. Every
    row is learnt from and scored on its own, also if its doc_id is null or repeated.
    An empty table gives none. Without training tokens every token is unknown and has
    probability 1.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn")))
    rows = every.select(F.col("key").alias("doc_id"), "text", "learn")
    words = rows.transform(mapped, count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    words = table(words, "unigrams")
    first = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *(F.count_if(F.col("c") == r).alias(f"c{r}") for r in range(1, K + 2))).first()
    n, v = int(first["n"] or 0), int(first["v"])
    seen = [int(first[f"c{r}"]) for r in range(1, K + 2)]
    unigram = unigram_model(seen[:K], n, v, seen)
    top = words.where(F.col("c") * DICTIONARY >= n).toPandas()  # DICTIONARY rows at most
    known = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    counts = top["c"].to_numpy(np.int64)[order]
    frequent = spark.sparkContext.broadcast((known[order], counts))
    # a context is hot if it has a large share of all words, or would fill a bucket; DICTIONARY at most
    hot = np.append(np.flatnonzero((counts * HOT >= max(n, 1)) | (counts >= BUCKET)).astype(np.uint64) + FIRST, START)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, -(-n // BUCKET))
    plain = rows.transform(mapped, emitter(frequent, hot, buckets, False), PART)
    rare = rows.transform(mapped, emitter(frequent, hot, buckets, True), PART).groupBy("bucket").applyInArrow(counted(hot, buckets), PART)
    pairs = table(plain.unionByName(rare).groupBy("bucket").applyInArrow(merged(frequent, hot, unigram), TABLE), "pairs")
    pair_counts = pairs.agg(*(F.sum(F.col("seen")[r]).alias(f"c{r}") for r in range(K + 1))).first()
    d = discounts([int(x or 0) for x in pair_counts])
    sums = pairs.select("hot").transform(mapped, hot_sums, "h long, " + ", ".join(f"s{k} double" for k in range(K + 2)))
    sums = sums.groupBy("h").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(K + 2))).toPandas()  # a row for each hot context
    keys = sums["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    merged_hot = (keys[order], sums[[f"s{k}" for k in range(K + 2)]].to_numpy(np.float64)[order])
    # as many groups as buckets, so that a group's entries do not grow with the corpus
    scored = pairs.select("docs", "h", "w", "c1", "c2", "each", "doc", "n").transform(mapped, scorer(frequent, d, unigram, merged_hot, buckets), SCORE)
    out = scored.groupBy("part").applyInArrow(summed, "key long, score double, base_score double, n_tokens long, n_known long")
    out = every.select("doc_id", "key").join(out, "key")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
