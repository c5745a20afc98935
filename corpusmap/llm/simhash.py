"""SimHash near-dedup with deletion-variant signatures.

Fingerprints link at ``max_bits`` or fewer differing bits.  A fingerprint is cut into
``max_bits // 2 + 1`` segments, so that two linked fingerprints differ by at most one bit
in one of them.  Each segment is indexed once for each of its bits, with that bit as a
wildcard; an equality join on (segment, wildcard, rest) finds all candidates, and the
number of differing bits of the whole fingerprint verifies them.

Only different fingerprints take part; documents with equal ones are one node.  A key with
many fingerprints is dealt out in pairs of parts of about ``part`` fingerprints, so that
every pair still meets in some task, and a task gives back links enough to connect what it
found, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.util import cut_lineage, temporary_tables
from .common import partitions, picked, small
from .components import connected_components
from .lookup import opened, write_sorted

BITS = 64


def fingerprint(words: list[bytes], shingle: int) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    import xxhash

    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    n = len(words) - last
    xxh = xxhash.xxh64_intdigest
    hashes = np.fromiter((xxh(text[a:z], 42) for a, z in zip(starts[:n].tolist(), ends[last:].tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, carry: bool = False) -> DataFrame:
    """``(id, fp)`` (and ``row``): A-Z lower-cased, words between ASCII white space, ``fp`` as a signed 64-bit number."""
    def job(batches):
        for b in small(batches):
            fps = np.array([fingerprint(t.encode().lower().split(), shingle) for t in b.column("text").to_pylist()], np.uint64)
            cols = [b.column("id"), pa.array(fps.view(np.int64))] + ([b.column("row")] if carry else [])
            yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", *(["row"] if carry else [])])

    rows = picked(df, id_col, text_col, carry)
    kind = rows.schema
    schema = "id long, fp long" + (f", row {kind['row'].dataType.simpleString()}" if carry else "")
    return rows.mapInArrow(job, schema)


def variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(key, fp)``: each segment of ``fp`` with each of its bits left out."""
    segments = max_bits // 2 + 1
    edges = [BITS * i // segments for i in range(segments + 1)]
    keys = []
    for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
        part = F.shiftrightunsigned("fp", a)
        part = part.bitwiseAND(F.lit((1 << (z - a)) - 1)) if z - a < BITS else part
        for bit in range(z - a):  # the place first, then the segment without that bit
            low = part.bitwiseAND(F.lit((1 << bit) - 1))
            high = F.shiftleft(F.shiftrightunsigned(part, bit + 1), bit)
            keys.append(F.struct(F.lit(a + bit).cast("short").alias("place"), high.bitwiseOR(low).alias("rest")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.col("k.place").alias("place"), F.col("k.rest").alias("rest"), "fp")


def _spanning(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``max_bits`` connect among ``fps``."""
    left, links = np.unique(fps), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= max_bits
            found = left[near]
            left = left[~near]
            links += [(int(node), int(x)) for x in found]
            queue += list(found)
    return links


def _groups(batches, width: int):
    """``(columns, edges, more)`` of successive Arrow batches sorted by their first ``width`` columns.

    ``columns`` are numpy arrays; ``edges`` bound the groups in them.  All but the last
    group are whole; ``more`` tells whether the last may go on in the next batch, whose
    columns then begin with the rows that the caller leaves in ``columns``.
    """
    rest = None
    for b in _then_none(batches):
        if b is not None:
            now = [np.asarray(c).astype(np.int64) for c in b.columns]
            rest = now if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, now)]
        if rest is None or not len(rest[0]):
            continue
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rest[:width]], axis=0)) + 1
        edges = np.concatenate([[0], new, [len(rest[0])]]).astype(np.int64)
        left = yield rest, edges, b is not None
        rest = [x[left:] for x in rest]


def _then_none(batches):
    yield from batches
    yield None


def _links_of(fp: np.ndarray, edges: np.ndarray, max_bits: int) -> np.ndarray:
    """Links that connect each group of fingerprints, as rows ``(a, b)``, signed and ordered."""
    size = np.diff(edges)
    two = edges[:-1][size == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
    found = [np.stack([fp[two[near]], fp[two[near] + 1]], axis=1)]
    for a, n in zip(edges[:-1][size > 2], size[size > 2]):
        if pairs := _spanning(fp[a:a + n], max_bits):
            found.append(np.array(pairs, np.uint64))
    out = np.concatenate(found).view(np.int64)
    return np.stack([out.min(axis=1), out.max(axis=1)], axis=1)


def links(fps: DataFrame, max_bits: int = 3, part: int = 4096) -> DataFrame:
    """``(a, b)`` with ``a < b``: links that connect all of ``fps(fp)`` at ``max_bits`` or fewer differing bits.

    One shuffle brings the fingerprints of a key together.  Groups of up to ``part`` are
    verified there; the rows of larger ones go on to be dealt out in pairs of parts.
    """
    spark = fps.sparkSession
    schema = "place long, rest long, a long, b long"

    def rows(place, rest, a, b):
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(rest), pa.array(a), b], names=["place", "rest", "a", "b"])

    def first(batches):
        groups, left, hot = _groups(batches, 2), None, None
        try:
            cols, edges, more = next(groups)
            while True:
                place, rest, fp = cols
                last = int(edges[-2])
                if more and len(fp) - last <= part and (place[last], rest[last]) != hot:
                    edges, left = edges[:-1], last  # wait for the rest of the last group
                else:
                    left = len(fp)
                size = np.diff(edges)
                big = size > part
                if hot is not None and len(size) and (place[0], rest[0]) == hot:
                    big[0] = True
                if len(size) and big[-1] and left == len(fp) and more:
                    hot = (place[last], rest[last])
                mine = np.repeat(big, size)
                if mine.any():
                    x = fp[:edges[-1]][mine]
                    yield rows(place[:edges[-1]][mine], rest[:edges[-1]][mine], x, pa.nulls(len(x), pa.int64()))
                keep = ~mine
                small = np.concatenate([[0], np.cumsum(size[~big])]).astype(np.int64)
                pairs = _links_of(fp[:edges[-1]][keep].view(np.uint64), small, max_bits)
                if len(pairs):
                    zero = np.zeros(len(pairs), np.int64)
                    yield rows(zero, zero, pairs[:, 0], pa.array(pairs[:, 1]))
                cols, edges, more = groups.send(left)
        except StopIteration:
            return

    def second(batches):
        groups = _groups(batches, 4)
        try:
            cols, edges, more = next(groups)
            while True:
                edges = edges[:-1] if more else edges
                pairs = _links_of(cols[4].view(np.uint64), edges, max_bits)
                if len(pairs):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})
                cols, edges, more = groups.send(int(edges[-1]))
        except StopIteration:
            return

    keyed = variants(fps, max_bits)
    dealt = keyed.repartition(partitions(spark), "place", "rest").sortWithinPartitions("place", "rest")
    found = cut_lineage(dealt.mapInArrow(first, schema))
    hot = found.filter("b is null").select("place", "rest", F.col("a").alias("fp"))
    sizes = cut_lineage(hot.groupBy("place", "rest").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")))
    some = hot.join(sizes, ["place", "rest"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    some = some.select("place", "rest", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    group = ["place", "rest", "lo", "hi"]
    more = some.repartition(partitions(spark), *group).sortWithinPartitions(*group).mapInArrow(second, "a long, b long")
    return found.filter("b is not null").select("a", "b").unionByName(more).filter("a < b").distinct()


def simhash_components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(fp, component_id)`` of ``prints(id, fp)``: the smallest id among all rows whose fingerprints are connected.

    A component without any id has null.
    """
    with temporary_tables() as made:
        # spread anew: a small table would be read by a few tasks, which would make all variants
        nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")).repartition(partitions(prints.sparkSession), "fp"))
        found = connected_components(cut_lineage(links(nodes.select("fp"), max_bits)))
        rooted = cut_lineage(nodes.join(found, nodes.fp == found.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return made.keep(cut_lineage(rooted.join(ids, "root").select("fp", "component_id")))


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``id, fp, component_id``.

    Null and empty texts have fingerprint 0 and link like any other; a text of fewer than
    ``shingle`` words is one shingle.  Repeated rows fall in one component.  An empty table
    gives an empty result.
    """
    prints = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    return prints.join(simhash_components(prints, max_bits), "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``df`` with one of each component kept: that of the smallest id (null is largest), one if it is repeated."""
    rows = cut_lineage(fingerprints(df, id_col, text_col, shingle, carry=True).withColumn("rid", F.monotonically_increasing_id()))
    nodes = rows.select("id", "fp", "rid")
    found = simhash_components(nodes.select("id", "fp"), max_bits)
    # a component is named by its id; those without any id are told apart by fingerprint
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    named = nodes.join(found, "fp").withColumn("also", F.when(F.col("component_id").isNull(), F.col("fp")))
    best = named.groupBy("component_id", "also").agg(F.min(place).alias("best"))
    kept = cut_lineage(best.select(F.col("best.rid").alias("rid")))
    uri = write_sorted(kept, "rid", "kept")
    return rows.filter(_listed(uri)(F.col("rid"))).select("row.*")


def _listed(uri: str):
    """Whether a row number is in the files at ``uri``: only the numbers go to Python, and no row moves to another task."""
    @F.arrow_udf("boolean")
    def listed(rid: pa.Array) -> pa.Array:
        return pa.array(opened(uri, "rid").find(np.asarray(rid))[0])
    return listed


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of the whole of ``documents``: 3-word shingles, 3 bits."""
    out = simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, max_bits=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
SQL = {}
