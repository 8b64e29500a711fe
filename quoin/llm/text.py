"""Vectorised text primitives over Arrow string buffers: words, hashes, shingles.

All functions work on the UTF-8 bytes of a whole batch at once, so no Python
string is made for a word. Memory is a small multiple of the chunk: texts are
taken together up to CHUNK bytes, and a longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and bounds: the words of text i are bounds[i] to bounds[i + 1]."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of width words, and their bounds.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(bounds)
    n = len(tokens)
    size = max(n - width + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for k in range(width):
        rolled += mix(tokens[k : k + size] + np.uint64(k + 1)) * np.uint64(2 * k + 0x632BE59BD9B4E019)
    rolled = mix(rolled)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    long = counts >= width
    whole = np.arange(n) + width <= np.repeat(bounds[1:], counts)
    result = np.empty(out[-1], np.uint64)
    result[np.repeat(long, made)] = rolled[whole[: len(rolled)]]
    for i in np.flatnonzero((counts > 0) & ~long):
        result[out[i]] = sequence_hash(tokens[bounds[i] : bounds[i + 1]])
    return result, out


def sequence_hash(tokens: np.ndarray) -> np.uint64:
    """One hash of a sequence of word hashes."""
    up, _ = powers(len(tokens) + 2)
    total = np.sum(mix(tokens + np.uint64(7)) * up[1 : len(tokens) + 1], dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(tokens))], np.uint64))[0]
