"""Suffix-array dedup of byte strings by external induced sorting.

A string of ``length`` bytes that starts anywhere else is removed wherever it starts.

1. A count-min sketch (sketch.py) over the least half-length grams of all windows of
   ``length`` bytes drops the windows that occur once; none that repeats is lost.
2. The windows left travel as segments: successive windows that share their least gram,
   so equal windows always meet in one shard.  Equal segments become one, first in each
   task, then in the shard; all windows of a segment held twice are repeats.
3. A shard's different segments are written to a scratch file and their suffixes sorted
   by external induced sorting (induced.py).  Neighbours in that order that share
   ``length`` bytes are repeats.  The common prefixes are compared at the end, for the
   window starts only, and not carried through the recursion.
4. The covered bytes go back to their documents.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, picked, small
from .induced import Scratch, same_prefix, suffix_order
from .sketch import U, cells_for, count_keys, mix
from .substring import _Windows

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
SLICE_BYTES = 1 << 18
FLUSH_BYTES = 64 << 20  # of segments compared with each other in a task


def _slices(texts: pa.Array):
    """``(first, lengths, data)``: runs of documents of about SLICE_BYTES bytes."""
    raw = pc.cast(texts, pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(raw):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, np.diff(offsets[first:last + 1]), data[offsets[first]:offsets[last]]
        first = last


SEGMENTS = "g long, c1 long, c2 long, many boolean, again boolean, id long, tag long, start long, n long, data binary"
SPANS = "id long, tag long, start long, n long"


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def _emit(length, mine, repeated):
    """Segments of the windows estimated repeated; those equal to one before in the task carry no data."""
    def job(batches):
        import xxhash

        held, size = {}, 0  # content -> [g, many, again, id, tag, start, n, data]
        extra = []

        def flush():
            nonlocal size
            if held:
                rows = [(g, c1, c2, *rest) for (c1, c2), (g, *rest) in held.items()]
                yield _batch(SEGMENTS, list(zip(*rows)))
            if extra:
                yield _batch(SEGMENTS, list(zip(*extra)))
            held.clear()
            extra.clear()
            size = 0

        for b in batches:
            ids, tags = b.column("id").to_pylist(), b.column("tag").to_pylist()
            for first, lengths, data in _slices(b.column("text")):
                w = _Windows(lengths, _TABLE[data][:, None], length)
                at = np.flatnonzero(w.inside & mine(w.least) & repeated.value(w.least))
                if not len(at):
                    continue
                g = w.least[at]
                edge = np.flatnonzero((np.diff(at) != 1) | (g[1:] != g[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])) + 1
                begin = np.concatenate([[0], edge])
                for k, n in zip(begin.tolist(), np.diff(np.append(begin, len(at))).tolist()):
                    a = int(at[k])
                    d = int(w.doc[a])
                    text = data[a:a + n + length - 1].tobytes()
                    key = xxhash.xxh3_128_intdigest(text)
                    key = ((key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63))
                    row = (ids[first + d], tags[first + d], a - int(w.begin[d]), n)
                    if key in held:
                        held[key][1] = True
                        extra.append((None, None, None, True, False, *row, None))
                    else:
                        again = int((w.grams[a:a + n + w.span - 1] == g[k]).sum()) > 1
                        held[key] = [int(g[k].view(np.int64)), False, again, *row, text]
                        size += len(text)
                if size > FLUSH_BYTES or len(extra) > 500_000:
                    yield from flush()
        yield from flush()
    return job


def _settle(length, memory):
    """Spans of repeated windows, from segments sorted by gram and content; spans already found pass through."""
    def job(batches):
        folder = tempfile.mkdtemp(prefix="suffixes-")
        scratch = Scratch(folder, memory)
        path = scratch.path()
        try:
            out = open(path, "wb")
            at, known = 0, []  # segments in the file: place, windows, and their document if nothing else holds them
            last = [None, None]  # gram and content of the row before
            waiting, written = None, False  # the content before: [data, rows, many, again]; whether its gram has more contents
            spans = []

            def close(shared):
                """End the content before; write it if its gram has another content."""
                nonlocal at
                if waiting is None:
                    return
                data, rows, many, again = waiting
                many = many or len(rows) > 1
                if many:
                    spans.extend(rows)
                if shared or again:  # a content that holds its gram twice may repeat within itself
                    out.write((np.frombuffer(data, np.uint8).astype(np.uint16) + 2).tobytes() + b"\1\0")
                    known.append((at, len(data), None if many else rows[0]))
                    at += len(data) + 1

            for b in batches:
                for g, c1, c2, many, again, i, t, s, n, data in zip(*(c.to_pylist() for c in b.columns)):
                    if g is None:
                        spans.append((i, t, s, n))
                    elif [g, (c1, c2)] == last:
                        waiting[1].append((i, t, s, n))
                        waiting[2] |= many
                    else:
                        if last[0] == g:
                            close(True)
                            written = True
                        else:
                            close(written)
                            written = False
                        last = [g, (c1, c2)]
                        waiting = [data, [(i, t, s, n)], many, again]
                    if len(spans) > 100_000:
                        yield _batch(SPANS, list(zip(*spans)))
                        spans.clear()
            close(written)
            out.write(b"\0\0")
            out.close()
            if known:
                begin, size = (np.array([k[j] for k in known], np.int64) for j in (0, 1))
                text = np.memmap(path, np.uint16, "r", shape=(at + 1,))
                text = np.array(text) if text.nbytes <= memory else text
                order = suffix_order(text, scratch)
                last_start = begin + size - length
                before = None
                step = 1 << 20
                marks = scratch.array(at + 1, bool)
                for a in range(0, len(order), step):
                    some = np.asarray(order[a:a + step])
                    owner = np.searchsorted(begin, some, "right") - 1
                    some = some[some <= last_start[np.maximum(owner, 0)]]
                    if before is not None:
                        some = np.append(before, some)
                    if len(some) > 1:
                        same = same_prefix(text, some[:-1], some[1:], length)
                        marks[some[:-1][same]] = True
                        marks[some[1:][same]] = True
                    before = some[-1:] if len(some) else before
                for (a, size, row) in known:
                    if row is not None:
                        hit = np.flatnonzero(marks[a:a + size])
                        if len(hit):
                            edge = np.concatenate([[0], np.flatnonzero(np.diff(hit) != 1) + 1])
                            for k, n in zip(hit[edge], np.diff(np.append(edge, len(hit)))):
                                spans.append((row[0], row[1], row[2] + int(k), int(n)))
                                if len(spans) > 100_000:
                                    yield _batch(SPANS, list(zip(*spans)))
                                    spans.clear()
            if spans:
                yield _batch(SPANS, list(zip(*spans)))
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    return job


def repeated_spans(rows: DataFrame, length: int, max_cells: int, memory: int) -> DataFrame:
    """``(id, tag, start, n)``: ``n`` successive windows of a document, from byte ``start``, that also start elsewhere."""
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cells, rounds = cells_for(size // 16, max_cells)
    found = None
    for r in range(rounds):
        def mine(keys, r=r):
            return (keys >> U(8)) % U(rounds) == U(r) if rounds > 1 else np.ones(len(keys), bool)

        def grams(batch, mine=mine):
            for _, lengths, data in _slices(batch.column("text")):
                keys = _Windows(lengths, _TABLE[data][:, None], length).chosen
                yield keys[mine(keys)]

        repeated = rows.sparkSession.sparkContext.broadcast(count_keys(rows, grams, cells))
        segments = rows.mapInArrow(_emit(length, mine, repeated), SEGMENTS)
        shard = F.coalesce(F.col("g"), F.xxhash64("id", "start"))
        dealt = segments.repartition(partitions(rows.sparkSession), shard).sortWithinPartitions("g", "c1", "c2")
        now = dealt.mapInArrow(_settle(length, memory), SPANS)
        found = now if found is None else found.unionByName(now)
    return found


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 max_cells: int = 1 << 28, memory: int = 64 << 20) -> DataFrame:
    """One row per document: ``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay, joined).

    Texts are UTF-8 bytes; strings never cross documents and may overlap.  Rows that share
    an id are told apart by a hash of their text; a row that repeats id and text is one
    more place where its strings start, so both lose them.  Null, empty and short texts
    lose nothing; an empty table gives an empty result.
    """
    rows = picked(df, id_col, text_col)
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    spans = repeated_spans(rows, length, max_cells, memory).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("s"))
    spans = spans.select(F.col("id").alias("rid"), F.col("tag").alias("rtag"), F.transform("s", lambda r: r["start"]).alias("starts"),
                         F.transform("s", lambda r: r["n"]).alias("ns"))
    joined = rows.join(spans, rows.id.eqNullSafe(spans.rid) & (rows.tag == spans.rtag), "left")

    def keep(batches):
        for b in small(batches):
            out = []
            for text, starts, ns in zip(b.column(1), b.column(2), b.column(3)):
                raw = text.as_py().encode()
                removed, spans, left = 0, 0, raw
                if starts.is_valid:
                    cover = np.zeros(len(raw) + 1, np.int64)
                    a, n = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ns))
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + n + length - 1, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("id", "text", "starts", "ns").mapInArrow(
        keep, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes over the whole of ``documents``."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL = {}
