"""Substring dedup of word windows with a count-min prefilter.

A window is ``window`` successive words of one document.  A repeated window repeats all of
its parts, so the count of the least of its half-length grams (by hash) is an upper bound
of its own count.

1. Each task sketches the least grams of its windows; the sketches are merged (sketch.py).
2. Windows whose estimate is 1 are unique and go no further.  The others, and no window is
   lost here, are grouped exactly by a 96-bit hash of their words.  A task first groups
   its own: all but the earliest of equal windows are repeats at once, and only that one
   shuffles.  So a passage that a third of all documents hold is one row per task.
3. The runs of repeats go to their documents, which drop the words they cover.

The sketch has at most ``max_cells`` cells a row; larger corpora are done in rounds, each
for its part of the grams.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, picked, small
from .sketch import U, anchors, cells_for, count_keys, mix, rolling

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SLICE_WORDS = 500_000  # words hashed at once
FLUSH = 1_000_000  # windows grouped at once in a task


class _Words(dict):
    """Word -> place of its two hashes."""

    def __init__(self):
        super().__init__()
        self.lanes = []

    def __missing__(self, word):
        import xxhash

        n = self[word] = len(self.lanes)
        self.lanes.append(xxhash.xxh3_128_intdigest(word))
        return n


def _slices(texts: pa.Array, words: _Words):
    """``(first, lengths, lanes)``: runs of documents of about SLICE_WORDS words with the two hashes of each word."""
    first, places, total = 0, [], 0
    for i, t in enumerate(texts):
        w = t.as_py().encode().split()
        if len(words) > 400_000 and not places:
            words.clear()
            words.lanes = []
        places.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
        total += len(w)
        if total >= SLICE_WORDS or i == len(texts) - 1:
            raw = b"".join(x.to_bytes(16, "little") for x in words.lanes)
            lanes = np.frombuffer(raw, np.uint64).reshape(-1, 2)[np.concatenate(places)]
            yield first, np.array([len(p) for p in places]), lanes
            first, places, total = i + 1, [], 0


class _Windows:
    """The windows of a run of documents."""

    def __init__(self, lengths: np.ndarray, lanes: np.ndarray, window: int):
        self.window, gram = window, (window + 1) // 2
        span = window - gram + 1
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.begin = np.cumsum(lengths) - lengths
        self.lanes = lanes
        n = max(0, len(lanes) - window + 1)
        self.inside = self.doc[:n] == self.doc[window - 1:][:n]
        grams = mix(rolling(lanes[:, 0], gram, BASES[0])) if len(lanes) >= gram else np.zeros(0, np.uint64)
        # grams across documents and their windows never count
        self.grams, self.span = grams, span
        self.least, chosen = anchors(grams, span, self.inside)
        self.chosen = grams[chosen]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (rolling(self.lanes[:, i], self.window, BASES[i])[at] for i in (0, 1))
        return mix(a).view(np.int64), (mix(b) >> U(33)).astype(np.int64)


def _runs(order_doc: np.ndarray, start: np.ndarray):
    """``(first index, length)`` of runs of successive starts in one document; sorted by both."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero((order_doc[1:] != order_doc[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first = np.concatenate([[0], edge])
    return first, np.diff(np.append(first, len(start)))


def _first_and_later(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Among rows equal in ``keys``: one that comes first by ``order``, and all that come later than it."""
    by = np.lexsort([*reversed(order), *reversed(keys)])
    new, later = np.ones(len(by), bool), np.zeros(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
        start = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        later = np.any([o[by] != o[start] for o in order], axis=0)  # a repeated row is not later than itself
    out = np.empty((2, len(by)), bool)
    out[:, by] = new, later
    return out[0], out[1]


NULL_ID = -(1 << 63)  # stands for a null id in comparisons, before all others


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID)).astype(np.int64)


WINDOW_ROWS = "k1 long, k2 long, id long, tag long, start long, n long"


def _rows(k1, k2, doc, tag, start, n):
    names = [x.split()[0] for x in WINDOW_ROWS.split(", ")]
    cols = [pa.array(k1) if k1 is not None else pa.nulls(len(start), pa.int64()),
            pa.array(k2) if k2 is not None else pa.nulls(len(start), pa.int64()),
            pa.array(doc, mask=doc == NULL_ID), pa.array(tag), pa.array(start), pa.array(n)]
    return pa.RecordBatch.from_arrays(cols, names=names)


def repeated_starts(rows: DataFrame, window: int, max_cells: int) -> DataFrame:
    """``(id, tag, start, n)``: ``n`` successive windows of a document, from ``start``, that also start earlier elsewhere."""
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cells, rounds = cells_for(size // 8, max_cells)
    parts = []
    for r in range(rounds):
        parts.append(_one_round(rows, window, cells, r, rounds))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _one_round(rows: DataFrame, window: int, cells: int, r: int, rounds: int) -> DataFrame:
    def mine(keys):
        return (keys >> U(8)) % U(rounds) == U(r) if rounds > 1 else np.ones(len(keys), bool)

    def grams(batch):
        words = _Words()
        for _, lengths, lanes in _slices(batch.column("text"), words):
            keys = _Windows(lengths, lanes, window).chosen
            yield keys[mine(keys)]

    sent = rows.sparkSession.sparkContext.broadcast(count_keys(rows, grams, cells))

    def emit(batches):
        held = []

        def grouped():
            k1, k2, doc, tag, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            first, later = _first_and_later([k1, k2], [doc, tag, start])
            yield _rows(k1[first], k2[first], doc[first], tag[first], start[first], np.ones(first.sum(), np.int64))
            doc, tag, start = (x[later] for x in (doc, tag, start))
            by = np.lexsort((start, tag, doc))
            doc, tag, start = doc[by], tag[by], start[by]
            new = np.zeros(len(doc), np.int64)
            if len(doc):
                new[1:] = np.cumsum((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
            at, n = _runs(new, start)
            yield _rows(None, None, doc[at], tag[at], start[at], n)

        words = _Words()
        for b in batches:
            ids, tags = _ids(b.column("id")), np.asarray(b.column("tag"))
            for first, lengths, lanes in _slices(b.column("text"), words):
                w = _Windows(lengths, lanes, window)
                at = np.flatnonzero(w.inside & mine(w.least) & sent.value(w.least))
                if len(at):
                    d = w.doc[at]
                    held.append((*w.hashes(at), ids[first + d], tags[first + d], at - w.begin[d]))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from grouped()
        if held:
            yield from grouped()

    def settle(batches):
        cols = []
        for b in batches:
            found = pc.is_null(b.column("k1"))
            known = b.filter(found)
            if len(known):
                yield known
            cols.append([_ids(c) for c in b.filter(pc.invert(found)).columns[:5]])
        if cols:
            k1, k2, doc, tag, start = (np.concatenate(x) for x in zip(*cols))
            _, later = _first_and_later([k1, k2], [doc, tag, start])
            yield _rows(None, None, doc[later], tag[later], start[later], np.ones(later.sum(), np.int64))

    seen = rows.mapInArrow(emit, WINDOW_ROWS)
    # at most one row of a window per task (and FLUSH windows) meets here; what is settled passes through
    dealt = seen.repartition(partitions(rows.sparkSession), F.coalesce("k1", F.xxhash64("id", "start")))
    return dealt.mapInArrow(settle, WINDOW_ROWS).select("id", "tag", "start", "n")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    max_cells: int = 1 << 28) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, kept_sha256, kept`` (the words kept, joined by one space).

    Words are runs of anything but ASCII white space.  A word goes if a window that covers
    it also starts earlier: in a document with a smaller id (a null id is the smallest),
    or in the same one before.  Rows that share an id are ordered by a hash of their text;
    rows that repeat id and text are the same document and get the same result.  Null,
    empty and short texts lose nothing; an empty table gives an empty result.
    """
    rows = picked(df, id_col, text_col)
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    runs = repeated_starts(rows, window, max_cells).groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = runs.select(F.col("id").alias("rid"), F.col("tag").alias("rtag"), F.transform("runs", lambda r: r["start"]).alias("starts"),
                       F.transform("runs", lambda r: r["n"]).alias("ns"))
    joined = rows.join(runs, rows.id.eqNullSafe(runs.rid) & (rows.tag == runs.rtag), "left")

    def keep(batches):
        for b in small(batches):
            out = []
            for text, starts, ns in zip(b.column(1), b.column(2), b.column(3)):
                words = text.as_py().encode().split()
                if starts.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    a, n = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ns))
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + n + window - 1, -1)
                    kept = [w for w, c in zip(words, np.cumsum(cover[:-1])) if c <= 0]
                else:
                    kept = words
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                              pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                                             names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.select("id", "text", "starts", "ns").mapInArrow(
        keep, "id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words over the whole of ``documents``."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL = {}
