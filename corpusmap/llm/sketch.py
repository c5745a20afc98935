"""A two-row count-min sketch of 64-bit keys that counts 0, 1, or 2 and more.

Each task counts its own keys in two bit maps per row (cells hit, cells hit twice).  The
maps are cut into chunks, and the chunks of all tasks are merged chunk by chunk on the
executors.  Only the merged ``hit twice`` maps come to the driver: ``2 * cells`` bits,
which the caller bounds.  An estimate is never below the true count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions

ROWS = 2
CHUNK = 1 << 16  # bytes of a map's chunk
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def cells_for(keys: int, most: int) -> tuple[int, int]:
    """``(cells, rounds)``: a power of two of about ``keys`` cells a row, at most ``most``; more keys take more rounds."""
    cells = 1 << 16
    while cells < min(keys, most):
        cells *= 2
    return cells, max(1, -(-int(keys) // int(most)))


def _cells(keys: np.ndarray, cells: int):
    mask = U(cells - 1)
    return (keys & mask).astype(np.int64), ((keys >> U(32)) & mask).astype(np.int64)


class Counter:
    """The maps of one task."""

    def __init__(self, cells: int):
        self.cells = cells
        self.one = np.zeros((ROWS, cells // 8), np.uint8)
        self.two = np.zeros((ROWS, cells // 8), np.uint8)

    def add(self, keys: np.ndarray):
        for row, at in enumerate(_cells(keys, self.cells)):
            at, n = np.unique(at, return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            again = (n > 1) | ((self.one[row, byte] & bit) > 0)
            np.bitwise_or.at(self.two[row], byte[again], bit[again])
            np.bitwise_or.at(self.one[row], byte, bit)

    def chunks(self):
        for i, (one, two) in enumerate(zip(self.one.reshape(-1, min(CHUNK, self.cells // 8)), self.two.reshape(-1, min(CHUNK, self.cells // 8)))):
            if one.any():
                yield i, zlib.compress(one.tobytes(), 1), zlib.compress(two.tobytes(), 1)


def _merge(batches):
    held = {}
    for b in batches:
        for i, one, two in zip(*(c.to_pylist() for c in b.columns)):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two))
            if i in held:
                a, z = held[i]
                z |= two | (a & one)
                a |= one
            else:
                held[i] = (one.copy(), two.copy())
    for i, (_, two) in held.items():
        if two.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int64()), "two": [zlib.compress(two.tobytes(), 1)]})


class Repeated:
    """The merged sketch: which keys are estimated to occur twice or more."""

    def __init__(self, cells: int, chunks: list[tuple[int, bytes]]):
        self.cells = cells
        self.two = np.zeros((ROWS, cells // 8), np.uint8)
        view = self.two.reshape(-1, min(CHUNK, cells // 8))
        for i, data in chunks:
            view[i] = np.frombuffer(zlib.decompress(data), np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for row, at in enumerate(_cells(keys, self.cells)):
            found &= (self.two[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found


def count_keys(rows: DataFrame, keys, cells: int) -> Repeated:
    """Sketch the keys that ``keys(batch)`` yields as arrays for each Arrow batch of ``rows``."""
    def job(batches):
        counter = Counter(cells)
        for b in batches:
            for k in keys(b):
                counter.add(k)
        for i, one, two in counter.chunks():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int64()), "one": [one], "two": [two]})

    parts = rows.mapInArrow(job, "chunk long, one binary, two binary")
    merged = parts.repartition(partitions(rows.sparkSession), "chunk").mapInArrow(_merge, "chunk long, two binary")
    return Repeated(cells, [(r["chunk"], bytes(r["two"])) for r in merged.collect()])


def rolling(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """The polynomial hash of each run of ``length`` values, by doubling."""
    b, n = base, 1
    h, out, have = x, None, 0
    while True:
        if length & n:  # the runs found so far, then this power of two
            out, have = (h, n) if out is None else (h[:len(h) - have] * U(pow(base, have, 1 << 64)) + out[n:][:max(0, len(h) - have)], have + n)
        if n * 2 > length:
            return out
        h = h[:-n] * U(b) + h[n:] if len(h) > n else h[:0]
        b, n = b * b % (1 << 64), n * 2


def sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``span`` values."""
    n = 1
    while n * 2 <= span:
        x, n = op(x[:-n], x[n:]) if len(x) > n else x[:0], n * 2
    rest = span - n
    return x if not rest else (op(x[:-rest], x[rest:]) if len(x) > rest else x[:0])


def anchors(grams: np.ndarray, span: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(least, chosen)``: the least key of each window of ``span`` grams, and which grams are the least of a window ``inside``."""
    least = sliding(grams, span, np.minimum)
    if not len(least):
        return least, np.zeros(len(grams), bool)
    pad = np.zeros(span - 1, np.uint64)  # a gram equals the largest least of its windows only if it is one
    return least, sliding(np.concatenate([pad, np.where(inside, least, U(0)), pad]), span, np.maximum) == grams
