"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word
statistics and repetition of the line itself and of the lines before and after it.
Training maximises the conditional likelihood of the label sequences (each line of
a labelled document carries its document's label) with an L2 penalty. A document's
quality is the mean of its lines' forward-backward marginals, weighted by length,
mapped to a probability by a logistic curve fitted to the same sample.

The fitting sample is bounded by two parameters: SAMPLE labelled documents, those
whose ids hash lowest, and of these, in that order, as many as have SAMPLE_LINES
lines together; one that would go beyond is passed over. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import mapped

#: Bounds of the sample that the model is fitted on: labelled documents, and lines of all of them together.
SAMPLE, SAMPLE_LINES = 4000, 400_000
STEPS, RATE, RIDGE = 160, 0.1, 1e-3

CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~<>{}[]=+_/\\",
}
_CLASS = np.full(256, len(CLASSES) + 1, np.uint8)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[np.frombuffer(_v, np.uint8)] = _k
_CLASS[X.SPACE] = len(CLASSES)
NAMES = [*(f"share_{c}" for c in CLASSES), "share_other", "log_length", "log_words", "word_length", "distinct", "again", "again_2", "marked_words", "ends_stop"]
WIDTH = 3 * len(NAMES) + 3


def own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that has a word, without its neighbours'; whether a line stands before and after it; lengths in bytes; the bounds of each text's lines."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    finish = np.minimum(np.searchsorted(breaks, begin), len(breaks))
    finish = np.where(finish < len(breaks), np.append(breaks, len(data))[finish], len(data))
    finish = np.minimum(finish, offsets[np.searchsorted(offsets, begin, "right")])
    starts, ends, _ = X.words(data, offsets)
    first = np.searchsorted(starts, begin)
    last = np.searchsorted(starts, finish)
    some = last > first
    begin, finish, first, last = begin[some], finish[some], first[some], last[some]
    size = (finish - begin).astype(np.float64)
    kinds = _CLASS[data]
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    kinds = np.where(accent, 1, kinds)
    shares = []
    for k in (*range(len(CLASSES)), len(CLASSES) + 1):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        shares.append((total[finish] - total[begin]) / size)
    count = (last - first).astype(np.float64)
    hashes = X.word_hashes(X.LOWER[data], starts, ends)
    line = np.repeat(np.arange(len(first)), last - first)
    order = np.sort((line.astype(np.uint64) << np.uint64(40)) | (hashes[: len(line)] >> np.uint64(24)))
    new = np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.zeros(0, bool)
    distinct = np.bincount((order[new] >> np.uint64(40)).astype(np.int64), minlength=len(first)) / count
    repeats = []
    for lag in (1, 2):
        same = np.zeros(len(line))
        same[lag:] = (hashes[lag : len(line)] == hashes[: len(line) - lag]) & (line[lag:] == line[:-lag])
        repeats.append(np.bincount(line, same, minlength=len(first)) / count)
    tail = kinds[ends - 1] if len(ends) else np.zeros(0, np.int64)
    marked = np.bincount(line, (tail[: len(line)] >= 4) & (tail[: len(line)] <= 6), minlength=len(first)) / count
    closing = (kinds[ends[last - 1] - 1] == 3).astype(float) if len(last) else np.zeros(0)
    base = np.stack([*shares, np.log1p(size), np.log1p(count), np.minimum(size / count, 40) / 10, distinct, *repeats, marked, closing], 1)
    bounds = np.searchsorted(begin, offsets)
    head, tail = np.ones(len(base)), np.ones(len(base))
    filled = bounds[1:] > bounds[:-1]
    head[bounds[:-1][filled]] = 0
    tail[bounds[1:][filled] - 1] = 0
    return base, head, tail, size, bounds


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that have a word, neighbouring lines' among them, their lengths in bytes, and the bounds of each text's lines."""
    base, head, tail, size, bounds = own_features(data, offsets)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    return np.concatenate([base, before * head[:, None], after * tail[:, None], head[:, None], tail[:, None], np.ones((len(base), 1))], 1), size, bounds


def odds_of(data: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lines(...) weighed by the model, without making the matrix, which is large for texts of many short lines; lengths and bounds."""
    base, head, tail, size, bounds = own_features(data, offsets)
    n, w = len(NAMES), model["w"]
    out, before, after = base @ w[:n], base @ w[n : 2 * n], base @ w[2 * n : 3 * n]
    out[1:] += before[:-1] * head[1:]
    out[:-1] += after[1:] * tail[:-1]
    return out + head * w[3 * n] + tail * w[3 * n + 1] + w[3 * n + 2] + model["shift"], size, bounds


def marginals(odds: np.ndarray, bounds: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected counts of label pairs, and the sum of log partition functions.

    odds: each line's log potential of good (that of bad is 0); turn[i, j]: log
    potential of label j after label i. All texts advance together, one line a step.
    """
    counts = np.diff(bounds)
    texts = np.argsort(-counts, kind="stable")
    texts = texts[: int((counts > 0).sum())]
    n, pairs, total = len(odds), np.zeros((2, 2)), 0.0
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    scale = np.zeros(n)
    if not n:
        return np.zeros(0), pairs, total
    own = np.stack([np.zeros(n), odds], 1)
    top = own.max(1, keepdims=True)
    own, move = np.exp(own - top), np.exp(turn)
    active = [texts[: int(np.searchsorted(-counts[texts], -step, "left"))] for step in range(int(counts.max()))]
    for step, now in enumerate(active):
        at = bounds[:-1][now] + step
        value = own[at] if step == 0 else (fore[at - 1] @ move) * own[at]
        scale[at] = value.sum(1)
        fore[at] = value / scale[at][:, None]
    back[bounds[1:][texts] - 1] = 1
    for step in range(len(active) - 1, 0, -1):
        at = bounds[:-1][active[step]] + step
        back[at - 1] = ((own[at] * back[at]) @ move.T) / scale[at][:, None]
    both = fore * back
    both /= both.sum(1, keepdims=True)
    later = np.ones(n, bool)
    later[bounds[:-1][counts > 0]] = False
    at = np.flatnonzero(later)
    joint = fore[at - 1][:, :, None] * move[None] * (own[at] * back[at] / scale[at][:, None])[:, None, :]
    return both[:, 1], joint.sum(0), float(np.log(scale).sum() + top.sum())


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict:
    """Weights by Adam on the penalised conditional likelihood; labels are of texts."""
    mean, spread = features.mean(0), features.std(0)
    mean[-1], spread[-1] = 0, 1
    spread[spread < 1e-9] = 1
    x = (features - mean) / spread
    counts = np.diff(bounds)
    y = np.repeat(labels, counts).astype(float)
    share = np.where(labels == 1, (labels == 0).sum(), (labels == 1).sum()) / max(len(labels), 1)
    later = np.ones(len(x), bool)
    later[bounds[:-1][counts > 0]] = False
    at = np.flatnonzero(later)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        good, joint, _ = marginals(x @ w[:-4], bounds, w[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - good), (seen - joint).ravel()]) / max(len(x), 1) - RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"w": w[:-4] / spread, "shift": -float(w[:-4] @ (mean / spread)), "turn": w[-4:].reshape(2, 2), "share": share}


def quality(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the marginals weighted by length; nan without lines."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(doc, size, minlength=len(counts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, size * good, minlength=len(counts)) / weight


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0.05, so that order is kept) and shift of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        a, b = max(a + step[0], 0.05), b + step[1]
    return float(a), float(b)


def featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("quality").to_pylist()
        rows = []
        for first, last, data, offsets in X.chunks(batch.column("text")):
            made, size, bounds = lines(data, offsets)
            for i in range(last - first):
                a, b = bounds[i], bounds[i + 1]
                rows.append((int(b - a), labels[first + i], made[a:b].astype(np.float32).tobytes(), size[a:b].tobytes()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "mark": batch.column("mark"), "n": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "x": pa.array([r[2] for r in rows], pa.binary()), "size": pa.array([r[3] for r in rows], pa.binary())})


def within(sizes: list[int], most: int) -> list[int]:
    """Places taken in order while the sum of their sizes stays at most; those that would go beyond are passed over."""
    taken, total = [], 0
    for k, size in enumerate(sizes):
        if total + size <= most:
            taken.append(k)
            total += size
    return taken


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> dict:
    """Fit on at most sample labelled documents, those whose ids hash lowest, with at most sample_lines lines together.

    labels: doc_id and quality (0 or 1; other values and nulls are left out).
    learn_from: which rows of labels may be used. The sample does not depend on how
    rows are dealt; rows that repeat a doc_id and text count once.
    """
    some = labels.where(learn_from & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most sample rows of two numbers are broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id").withColumn("mark", F.xxhash64("text"))
    breaks = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    sizes = rows.select("doc_id", "quality", "mark", breaks.alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "mark").limit(2 * sample).collect()
    sizes = [sizes[k] for k in within([r["n"] for r in sizes], sample_lines)]
    # 2 * sample rows of three numbers are broadcast at most
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], r["mark"]) for r in sizes], some.schema.add("mark", "long"))
    picked = rows.join(F.broadcast(chosen), ["doc_id", "quality", "mark"], "left_semi").dropDuplicates(["doc_id", "quality", "mark"])
    got = picked.select("doc_id", "mark", "text", "quality").transform(mapped, featurer, "doc_id long, mark long, n long, label int, x binary, size binary").toPandas()
    got = got.sort_values(["doc_id", "label", "mark"], ignore_index=True)
    if not len(got):
        return {"w": np.zeros(WIDTH), "shift": 0.0, "turn": np.zeros((2, 2)), "a": 1.0, "b": 0.0, "empty": 0.5}
    bounds = np.concatenate([[0], np.cumsum(got["n"].to_numpy())])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH).astype(np.float64)
    size, label = np.frombuffer(b"".join(got["size"]), np.float64), got["label"].to_numpy()
    model = fit(x, bounds, label) if len(x) else {"w": np.zeros(WIDTH), "shift": 0.0, "turn": np.zeros((2, 2))}
    good, _, _ = marginals(x @ model["w"] + model["shift"], bounds, model["turn"])
    raw = quality(good, size, bounds)
    has = ~np.isnan(raw)
    a, b = curve(logit(raw[has]), label[has].astype(float)) if has.any() else (1.0, 0.0)
    # a text without lines: its labels in the sample, held down by one good and nine bad ones
    empty = (label[~has].sum() + 1) / ((~has).sum() + 10)
    return {"w": model["w"], "shift": model["shift"], "turn": model["turn"], "a": a, "b": b, "empty": float(empty)}


def scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, data, offsets in X.chunks(batch.column("text")):
                odds, size, bounds = odds_of(data, offsets, model)
                good, _, _ = marginals(odds, bounds, model["turn"])
                raw = quality(good, size, bounds)
                value = 1 / (1 + np.exp(-np.clip(model["a"] * logit(np.nan_to_num(raw, nan=0.5)) + model["b"], -30, 30)))
                out[first:last] = np.where(np.isnan(raw), model["empty"], value)
                count[first:last] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(count)], ["doc_id", "score", "n_lines"])

    return score


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from threshold on) and n_lines of every document's whole text.

    A null text, an empty one or one of white space only has no lines and gets the
    smoothed share of good ones among such texts in the sample. Repeated rows get
    equal scores; without labels every score is 0.5 or the shares' prior.
    """
    model = train(docs, labels, learn_from)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.transform(mapped, scorer(model), "doc_id long, score double, n_lines long")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
