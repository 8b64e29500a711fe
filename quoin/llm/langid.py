"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point and
the seed only. A letter n-gram is bound by multiplying its letters' vectors, each
rotated by its place; a document bundles (adds) the vectors of its n-grams, a
language prototype those of its training documents, each weighing the same. The
language whose prototype has the largest cosine with the document wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

DIM, ORDER, SEED, UNIT = 1024, 3, 7, 1 << 20
#: Most languages a model may learn; the prototypes that go to the driver have DIM numbers each.
LANGUAGES = 5000
CHARS, ROWS = 600_000, 256
#: n-grams counted at a time, and different ones bound at a time.
SPAN, BLOCK = 1 << 20, 1 << 13


class Letters:
    """Dense numbers of the letters met so far (0 stands between words) and their vectors."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.number = np.full(0x110000, -1, np.int32)
        self.vectors = self._draw(0)[None]

    def _draw(self, point: int) -> np.ndarray:
        return (np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.number[points]
        if (found < 0).any():
            new = []
            for p in np.unique(points[found < 0]).tolist():
                letter = chr(p).isalpha()
                self.number[p] = len(self.vectors) + len(new) if letter else 0
                new += [self._draw(p)] * letter
            if new:
                self.vectors = np.concatenate([self.vectors, np.array(new, np.int8)])
            found = self.number[points]
        return found

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the vectors of each text's n-grams, and how many n-grams it has.

        n-grams are counted SPAN at a time and bound BLOCK at a time, so memory does not
        follow the number of different n-grams. All sums are of whole numbers below 2**24.
        """
        n = len(texts)
        sums, total = np.zeros((n, self.dim)), np.zeros(n, np.int64)
        parts = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, n) + 2
        points = np.frombuffer((" " + "  ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n, dtype=np.int32), lengths)
        letter = self.of(points)
        keep = letter > 0
        keep[1:] |= letter[:-1] > 0
        new = row[1:] != row[:-1]
        keep[:-1] |= new
        keep[1:] |= new
        keep[[0, -1]] = True
        letter, row = letter[keep], row[keep]
        for first in range(0, max(len(letter) - ORDER + 1, 0), SPAN):
            here, owner = letter[first : first + SPAN + 2].astype(np.int64), row[first : first + SPAN + 2]
            a, b, c = here[:-2], here[1:-1], here[2:]
            whole = ((b > 0) | ((a > 0) & (c > 0))) & (owner[:-2] == owner[2:]) & ((a > 0) | (b > 0))
            a, b, c, owner = a[whole], b[whole], c[whole], owner[:-2][whole].astype(np.int64)
            if len(owner):
                total += np.bincount(owner, minlength=n)
                self._add(sums, owner, a, b, c)
        return sums, total

    def _add(self, sums: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        size, n = len(self.vectors), len(sums)
        code = (a * size + b) * size + c
        if size**3 <= 1 << 22:
            seen = np.zeros(size**3, bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(size**3, np.int32)
            place[distinct] = np.arange(len(distinct))
            code = place[code]
        else:
            distinct, code = np.unique(code, return_inverse=True)
        letters = np.stack([distinct // size // size, distinct // size % size, distinct % size], 1)
        if len(distinct) > BLOCK:
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
        edges = np.searchsorted(code, np.arange(0, len(distinct) + BLOCK, BLOCK)) if len(distinct) > BLOCK else [0, len(code)]
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = letters[k * BLOCK : (k + 1) * BLOCK]
            # a block of rare n-grams touches few texts, one of frequent ones all of them
            rows, at = np.unique(row[i:j], return_inverse=True)
            counts = np.bincount(at * len(part) + (code[i:j] - k * BLOCK), minlength=len(rows) * len(part)).reshape(len(rows), -1)
            sums[rows] += counts.astype(np.float32) @ self.bound(part).astype(np.float32)

    def bound(self, letters: np.ndarray) -> np.ndarray:
        """The n-grams' vectors."""
        out = self.vectors[letters[:, ORDER - 1]]
        for k in range(ORDER - 1):
            few = len(self.vectors) < len(letters)
            turned = np.roll(self.vectors, ORDER - 1 - k, 1)[letters[:, k]] if few else np.roll(self.vectors[letters[:, k]], ORDER - 1 - k, 1)
            out = out * turned
        return out


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about CHARS characters in all, ROWS rows at most."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and last - first < ROWS and (last == first or size + len(texts[last]) <= CHARS):
            size += len(texts[last])
            last += 1
        yield first, texts[first:last]
        first = last


def learner(dim: int, seed: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dim, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in pieces(batch, "text"):
                made, total = letters.bundles(texts)
                made = np.round(made * (UNIT / np.maximum(total, 1))[:, None])
                own = np.array(langs[first : first + len(texts)], object)
                for lang in set(own[total > 0].tolist()):
                    sums[lang] = sums.get(lang, 0) + made[own == lang].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total.astype(np.int64))], ["lang", "place", "value"])

    return learn


def train(docs: DataFrame, learn_from: Column, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """The languages of the rows where learn_from holds, and their unit prototypes.

    Sums are of whole numbers, so the model does not depend on how rows are dealt.
    """
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.transform(mapped, learner(dim, seed), "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.limit(LANGUAGES * dim + 1).toPandas()
    if len(found) > LANGUAGES * dim:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    langs = sorted(set(found["lang"]))
    made = np.zeros((len(langs), dim))
    made[[*map({k: i for i, k in enumerate(langs)}.get, found["lang"])], found["place"].to_numpy(int)] = found["value"]
    return langs, made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)


def predictor(langs: list[str], prototypes: np.ndarray, dim: int, seed: int, column: str, names_out: tuple[str, str]):
    profile = prototypes.T

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dim, seed)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for first, texts in pieces(batch, column):
                if not langs:
                    continue
                vectors, total = letters.bundles(texts)
                cosine = (vectors @ profile) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                for i in np.flatnonzero(total).tolist():
                    names[first + i] = langs[best[i]]
                    scores[first + i] = min(max(float(cosine[i, best[i]]), 0.0), 1.0)
            passed = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in passed), pa.array(names, pa.string()), pa.array(scores)], [*(batch.schema.names[i] for i in passed), *names_out])

    return predict


def identify(docs: DataFrame, learn_from: Column, keep: list[str], dim: int = DIM, seed: int = SEED, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep, lang_pred string and score double (the cosine, not below 0) of every document.

    docs has text and lang; keep names columns to pass on, names the new ones, which
    keep must not hold. A null text, or one without letters, gets und and 0, as does
    everything if nothing can be learnt. Texts count whole; ties go to the language
    that sorts first. Repeated rows get equal results. Nulls are passed on. lang may
    have up to LANGUAGES values to learn; more raise a ValueError, since every
    prototype goes to the driver. An empty table gives none.
    """
    langs, prototypes = train(docs, learn_from, dim, seed)
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").cast("string").alias("__text"))
    column = "text" if "text" in keep else "__text"
    fields = T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add(names[0], "string").add(names[1], "double")
    return rows.transform(mapped, predictor(langs, prototypes, dim, seed, column, names), fields)
