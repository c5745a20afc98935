"""Blocks of points as files: the shared plan for exact all-pairs work without replication.

Points are shuffled once, to the block they belong to, and each block is written as one
file in the checkpoint folder.  A task then takes one block and opens the other blocks
itself, one after the other, so a point never travels once per block and a shuffle grows
with the points only.  The files of a run are listed in an index file, a row for each
block.  Blocks are sized by bytes and never beyond MOST_ROWS, so larger tables make more tasks
and not longer or larger ones; a task looks at them a strip of rows at a time.

Blocks for searches hold neighbours: a point goes to the nearest of at most MAX_PIVOTS
sampled points, and cells with more points than a block may have are split by ranges of
ids.  The index then has a centre and a radius for each block, by which the triangle
inequality tells which blocks need not be opened.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.util import cut_lineage, shared_folder
from .blocks import sq_dists

BLOCK_BYTES = 16 << 20
LEAST_ROWS = 64        # of a block, unless asked for fewer: more tasks than that don't pay
MOST_ROWS = 2048       # of a block, unless asked for more: a task's work grows with the points only, its memory not at all
MAX_PIVOTS = 1024      # sampled points of a run that every task holds
STRIP_VALUES = 1 << 20  # distances a task holds at once
QUANTILES = 256        # ranges of ids into which a large cell is cut; beyond them by a hash
INDEX_SCHEMA = "run_id string, block long, n long, uri string, center array<double>, radius double, least_id long"


def rows_per_block(points: int, values: float, cores: int, block_rows: int | None = None) -> int:
    """Rows of a block: ``block_rows``, or as many as BLOCK_BYTES hold, but fewer where all cores would not get work."""
    if block_rows is not None:
        return max(1, block_rows)
    by_bytes = max(1, int(BLOCK_BYTES / (8 * max(1.0, values))))
    return min(by_bytes, MOST_ROWS, max(LEAST_ROWS, math.ceil(points / (2 * cores))))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column, which must be of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length")
    return np.asarray(column.flatten(), np.float64).reshape(len(sizes), -1)


def write_file(uri: str, table: pa.Table) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    packed = pa.ipc.IpcWriteOptions(compression="zstd" if "terms" in table.column_names else None)  # sparse rows shrink to a third
    with fs.open_output_stream(path) as f, pa.ipc.new_file(f, table.schema, options=packed) as w:
        w.write_table(table)


def read_file(uri: str) -> pa.Table:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(pa.BufferReader(f.read())).read_all()


def _written(rows: DataFrame) -> DataFrame:
    """A file for each block of ``rows(run_id, block, id, ...)``; with a ``key`` column also centre, radius and least id."""
    uri = shared_folder(rows.sparkSession, "blocks")
    keyed = "key" in rows.columns

    def save(group: pa.Table) -> pa.Table:
        run, block = group["run_id"][0].as_py(), group["block"][0].as_py()
        table = group.drop_columns(["run_id", "block"]).combine_chunks()
        center = radius = least = None
        if keyed:
            table = table.sort_by("id")
            key = matrix(table["key"])
            off = ((key - key.mean(axis=0)) ** 2).sum(axis=1)
            center = key[int(off.argmin())]
            radius, least = float(np.sqrt(((key - center) ** 2).sum(axis=1).max())), table["id"][0].as_py()
            center = center.tolist()
        # a task run again has a file of its own
        name = f"{uri}/{hashlib.md5(str(run).encode()).hexdigest()}-{block}-{uuid.uuid4().hex}"
        write_file(name, table)
        return pa.table({"run_id": pa.array([run], pa.string()), "block": pa.array([block], pa.int64()), "n": pa.array([len(table)], pa.int64()),
                         "uri": [name], "center": pa.array([center], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64()),
                         "least_id": pa.array([least], pa.int64())})

    return cut_lineage(rows.groupBy("run_id", "block").applyInArrow(save, INDEX_SCHEMA))


def _tasks(blocks: DataFrame, n: int) -> DataFrame:
    """``(run_id, block, uri, index)``: the work of one task for each of about ``n`` blocks, with the index file of its run."""
    uri = shared_folder(blocks.sparkSession, "index")

    def save(group: pa.Table) -> pa.Table:
        run = group["run_id"][0].as_py()
        name = f"{uri}/{uuid.uuid4().hex}"
        write_file(name, group.drop_columns(["run_id"]).combine_chunks().sort_by("block"))
        return pa.table({"run_id": pa.array([run], pa.string()), "index": [name]})

    index = blocks.groupBy("run_id").applyInArrow(save, "run_id string, index string")
    work = blocks.select("run_id", "block", "uri").join(F.broadcast(index), "run_id")  # one row for each run
    return work.repartition(max(1, min(n, 20_000)))


def _sizes(rows: DataFrame, values, block_rows: int | None) -> tuple[int, dict]:
    """``(rows of a block, blocks of each run)``; ``values``: the numbers that a row holds."""
    found = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(values).alias("values")).collect()  # a row for each run
    total = sum(r.n for r in found)
    mean = sum(r["values"] or 0 for r in found) / max(1, total)
    per = rows_per_block(total, mean, rows.sparkSession.sparkContext.defaultParallelism, block_rows)
    return per, {r.run_id: math.ceil(r.n / per) for r in found}


def by_hash(rows: DataFrame, values, block_rows: int | None = None) -> DataFrame:
    """Tasks over blocks of ``rows(run_id, id, ...)`` by a hash of the id."""
    _, blocks = _sizes(rows, values, block_rows)
    of_run = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map()
    block = F.pmod(F.xxhash64("id"), of_run[F.col("run_id")]) if blocks else F.lit(0)
    return _tasks(_written(rows.withColumn("block", block.cast("long"))), sum(blocks.values()))


def by_pivots(rows: DataFrame, values, block_rows: int | None = None) -> DataFrame:
    """Tasks over blocks of ``rows(run_id, id, key, ...)`` that hold points with near keys."""
    spark = rows.sparkSession
    per, blocks = _sizes(rows, values, block_rows)
    want = {run: min(MAX_PIVOTS, n) for run, n in blocks.items()}
    first = Window.partitionBy("run_id").orderBy(F.xxhash64("id"), "id")
    sample = (rows.select("run_id", "id", "key", F.row_number().over(first).alias("r"))
              .filter(F.col("r") <= max(want.values(), default=1)).collect())  # at most MAX_PIVOTS points of a run
    pivots = {run: np.array([r.key for r in sample if r.run_id == run and r.r <= n], np.float64) for run, n in want.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            run = np.array(b.column("run_id").to_pylist(), object)
            cell = np.zeros(len(b), np.int64)
            for name in set(run.tolist()):
                at, p = np.flatnonzero(run == name), sent.value[name]
                step = max(1, STRIP_VALUES // len(p))
                for i in range(0, len(at), step):
                    part = at[i:i + step]
                    cell[part] = sq_dists(matrix(b.column("key").take(pa.array(part))), p).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "_cell"])

    schema = StructType([*rows.schema.fields, StructField("_cell", LongType())])
    celled = rows.mapInArrow(assign, schema)
    cut = [i / QUANTILES for i in range(1, QUANTILES)]
    cells = celled.groupBy("run_id", "_cell").agg(F.ceil(F.count(F.lit(1)) / per).alias("_parts"), F.percentile_approx("id", cut).alias("_cut"))
    cells = cells.withColumn("_cut", F.when(F.col("_parts") > 1, F.col("_cut")))  # at most MAX_PIVOTS rows of a run
    dealt = celled.join(F.broadcast(cells), ["run_id", "_cell"])
    rank = F.size(F.filter("_cut", lambda c: c < F.col("id"))).cast("long")
    more = F.ceil(F.col("_parts") / QUANTILES)
    part = F.when(F.col("_parts") == 1, F.lit(0)).when(more == 1, F.floor(rank * F.col("_parts") / QUANTILES)).otherwise(
        rank * more + F.pmod(F.xxhash64("id"), more))
    block = F.col("_cell") * F.lit(1 << 32) + part
    return _tasks(_written(dealt.withColumn("block", block).drop("_cell", "_parts", "_cut")), sum(blocks.values()))


class Index:
    """The blocks of a run, in ascending order of ``block``."""

    def __init__(self, uri: str):
        table = read_file(uri)
        self.block = np.asarray(table["block"])
        self.uris = table["uri"].to_pylist()
        if table["center"].null_count == 0:
            self.center = matrix(table["center"])
            self.radius, self.least = np.asarray(table["radius"]), np.asarray(table["least_id"])

    def partners(self, block: int) -> list[int]:
        """Places of the blocks that ``block`` is paired with, itself first: every pair falls to one of its two blocks, evenly."""
        m, i = len(self.block), int(np.searchsorted(self.block, block))
        last = m // 2 if m % 2 or i < m // 2 else m // 2 - 1
        return [(i + t) % m for t in range(last + 1)]
