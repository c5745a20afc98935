"""Matrix preparation and exact nearest neighbours.

``knn`` runs on block files (:mod:`.block_files`).  A task holds the k best of the points
of one block and opens the other blocks in the order of their distance, one GEMM for each,
skipping those that the triangle inequality rules out.  Of a GEMM block all that are nearer
than the k-th exact distance count, and of those at that distance the smallest ids.  The
task's k best are the result: no candidates are shuffled.  Self is excluded by id, ties are
broken by ``dst``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_files import STRIP_VALUES, Index, by_pivots, matrix, read_file  # by name: functions go to the workers with the globals they use
from .blocks import DensePoints, SparsePoints, pair_dists

KNN_SCHEMA = "run_id string, src long, dst long, d2 double, rank int"


def sq_euclidean(a: Column, b: Column) -> Column:
    """V4: Σ (a_i - b_i)² (no square root)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def _prep(points: DataFrame, id_col: str, vec_col: str, run_col: str | None) -> DataFrame:
    run = F.col(run_col).cast("string") if run_col else F.lit("default")
    return points.select(run.alias("run_id"), F.col(id_col).cast("long").alias("id"),
                         F.col(vec_col).cast("array<double>").alias("vec"))


def column_stats(points: DataFrame, id_col: str = "id", vec_col: str = "vec",
                 run_col: str | None = "run_id") -> DataFrame:
    """V1+V2 statistics per run: ``mean array<double>`` and ``max_x`` = largest centred value (floor 0)."""
    p = _prep(points, id_col, vec_col, run_col)
    cols = (p.select("run_id", F.posexplode("vec").alias("pos", "x"))
             .groupBy("run_id", "pos").agg(F.avg("x").alias("mean"), F.max("x").alias("mx")))
    return cols.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"),
        F.greatest(F.lit(0.0), F.max(F.col("mx") - F.col("mean"))).alias("max_x"))


def center(points: DataFrame, id_col: str = "id", vec_col: str = "vec", run_col: str | None = "run_id",
           scale: bool = False) -> DataFrame:
    """V1 (and V2 with ``scale=True``): subtract column means; optionally divide by ``max_x``.

    The per-run statistics are one row per run (a bounded side), joined by broadcast.
    """
    p = _prep(points, id_col, vec_col, run_col)
    st = column_stats(p, "id", "vec", "run_id")
    out = p.join(F.broadcast(st), "run_id")
    if scale:
        out = out.withColumn("_s", F.when(F.col("max_x") > 0, F.col("max_x")).otherwise(
            F.raise_error(F.lit("max scaling: largest centred value is 0"))))
    else:
        out = out.withColumn("_s", F.lit(1.0))
    vec = F.zip_with("vec", "mean", lambda x, m: (x - m) / F.col("_s"))
    return out.select("run_id", "id", vec.alias("vec"))


def _exact_top(d, xs, xt, idt, k, least):
    """Per row of ``d`` the k best: ``(rows, cols, exact d2)``; ties at the k-th place go to the smallest ids.

    ``d`` (one GEMM) is off by rounding, so every column within that error of
    the k-th value is compared by its exact distance.  Columns beyond ``least``, the k-th
    distance of each row so far, are left out.
    """
    k = min(k, d.shape[1])
    slack = 1e-9 * (xs.norms + xt.norms.max())
    most = least + slack + 1e-12 * np.where(np.isfinite(least), least, 0.0)
    near, step = None, len(d)
    if np.isfinite(least).all():
        near = d <= most[:, None]
    if near is None or np.count_nonzero(near) > k * len(d):
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        most = np.minimum(most, kth + slack + 1e-12 * np.where(np.isfinite(kth), kth, 0.0))
        near = (d <= most[:, None]) & np.isfinite(d)
        step = 64  # a few rows at a time: a tie may hold every column
    out = []
    for a in range(0, len(d), step):
        rows, cols = np.nonzero(near[a:a + step])
        rows += a
        exact = xs.exact(rows, xt, cols)
        by = np.lexsort((idt[cols], exact, rows))
        rows, cols, exact = rows[by], cols[by], exact[by]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k  # rows are sorted
        out.append((rows[keep], cols[keep], exact[keep]))
    return [np.concatenate(x) for x in zip(*out)]


def _points(table):
    """The points of a block file."""
    if "terms" not in table.column_names:
        return DensePoints(matrix(table["key"]))
    terms, ws = (table[c].combine_chunks() for c in ("terms", "ws"))
    return SparsePoints.flat(pc.fill_null(pc.list_value_length(terms), 0), terms.flatten(), ws.flatten())


class _Best:
    """The k best of each point of a block so far, ties to the smallest ids."""

    def __init__(self, n: int, k: int):
        self.d2, self.dst = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows, dst, d2):
        """Candidates of a block; ``rows`` ascending."""
        k = self.d2.shape[1]
        better = (d2 < self.d2[rows, -1]) | (d2 == self.d2[rows, -1]) & (dst < self.dst[rows, -1])
        rows, dst, d2 = rows[better], dst[better], d2[better]
        mine = np.unique(rows)
        if not len(mine):
            return
        row = np.concatenate([np.repeat(mine, k), rows])
        d2, dst = np.concatenate([self.d2[mine].ravel(), d2]), np.concatenate([self.dst[mine].ravel(), dst])
        by = np.lexsort((dst, d2, row))
        row, d2, dst = row[by], d2[by], dst[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        self.d2[mine], self.dst[mine] = d2[keep].reshape(-1, k), dst[keep].reshape(-1, k)


def _search(task: dict, index, k: int):
    """``(ids, best, blocks opened, blocks skipped)`` of the block of a task.

    Keys are never further apart than the points themselves.  A block is opened for the
    points whose k-th distance so far reaches its ball of keys; at a k-th distance of 0 only
    smaller ids could still count.
    """
    table = read_file(task["uri"])
    ids, key, x = np.asarray(table["id"]), matrix(table["key"]), _points(table)
    best, opened = _Best(len(ids), k), 0
    me = int(np.searchsorted(index.block, task["block"]))
    size = np.sqrt((index.center ** 2).sum(axis=1))
    apart = np.sqrt(((index.center - index.center[me]) ** 2).sum(axis=1))
    order = np.lexsort((index.least, np.maximum(apart - index.radius - index.radius[me], 0.0), np.arange(len(apart)) != me))
    for j in order.tolist():
        away = np.sqrt(((key - index.center[j]) ** 2).sum(axis=1))
        slack = 1e-9 * (away + index.radius[j]) + 1e-12 * size[j]  # rounding
        reach = away - index.radius[j] - slack <= np.sqrt(best.d2[:, -1]) * (1 + 1e-9)
        reach &= ~((best.d2[:, -1] == 0) & (best.dst[:, -1] < index.least[j]))
        todo = np.flatnonzero(reach)
        if not len(todo):
            continue
        opened += 1
        other = table if j == me else read_file(index.uris[j])
        their, y = np.asarray(other["id"]), x if j == me else _points(other)
        if "terms" in other.column_names:  # rows without terms are all at one place, say
            lead = y.leading(their, k)
            their, y = their[lead], y.take(lead)
        step = max(1, STRIP_VALUES // max(1, len(their)))
        for i in range(0, len(todo), step):
            rows = todo[i:i + step]
            part = x.take(rows)
            d = pair_dists(part, y)
            own = np.searchsorted(their, ids[rows]), np.searchsorted(their, ids[rows], side="right")  # files are in the order of ids
            for a in np.flatnonzero(own[1] > own[0]).tolist():
                d[a, own[0][a]:own[1][a]] = np.inf  # never one's own neighbour
            least = best.d2[rows, -1] if x.even and y.even else np.full(len(rows), np.inf)
            r, c, exact = _exact_top(d, part, y, their, k, least)
            best.add(rows[r], their[c], exact)
    return ids, best, opened, len(index.block) - opened


def _knn_job(k: int, emit: bool):
    def job(batches):
        known = {}  # index files of this task
        for b in batches:
            for task in b.to_pylist():
                if task["index"] not in known:
                    known = {task["index"]: Index(task["index"])}
                ids, best, opened, skipped = _search(task, known[task["index"]], k)
                if not emit:
                    yield pa.RecordBatch.from_pydict({"run_id": pa.array([task["run_id"]], pa.string()), "opened": [opened], "skipped": [skipped]})
                    continue
                there = np.isfinite(best.d2)
                row, rank = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array([task["run_id"]] * len(row), pa.string()), pa.array(ids[row]), pa.array(best.dst[there]),
                                                  pa.array(best.d2[there]), pa.array((rank + 1).astype(np.int32))],
                                                 names=["run_id", "src", "dst", "d2", "rank"])
    return job


def knn(points: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", run_col: str | None = "run_id",
        block_rows: int | None = None) -> DataFrame:
    """``(run_id, src, dst, d2, rank)``: the k nearest other points of every point (squared distance)."""
    return _nearest(knn_tasks(points, id_col, vec_col, run_col, block_rows), k)


def knn_tasks(points: DataFrame, id_col: str = "id", vec_col: str = "vec", run_col: str | None = "run_id",
              block_rows: int | None = None) -> DataFrame:
    """Points as block files, a row for each block."""
    p = _prep(points, id_col, vec_col, run_col).withColumnRenamed("vec", "key")
    return by_pivots(p, F.size("key"), block_rows)


def knn_sparse(rows: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """N1 on ``rows(run_id, id, terms array<bigint>, ws array<double>)``: sparse vectors stay sparse until a
    task makes a few columns of two blocks dense.  Blocks are ranges of lengths |v|."""
    length = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * w))
    p = rows.select("run_id", F.col("id").cast("long").alias("id"), F.array(length).alias("key"), "terms", "ws")
    return _nearest(by_pivots(p, F.size("ws") * 2 + 1, block_rows), k)


def _nearest(tasks: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be >= 1")
    return tasks.mapInArrow(_knn_job(int(k), True), KNN_SCHEMA)


def knn_pairs(tasks: DataFrame, k: int) -> DataFrame:
    """``(run_id, opened, skipped)``: how many other blocks the search of each block of :func:`knn_tasks` opens, and how many not."""
    return tasks.mapInArrow(_knn_job(int(k), False), "run_id string, opened long, skipped long")


def sparse_max_scale(weights: DataFrame, base: DataFrame, n_points: DataFrame) -> DataFrame:
    """V2 of a sparse matrix: ``(run_id, max_x)`` = largest centred value, floor 0.

    ``weights(run_id, doc_id, term_id, w)`` has the present cells, ``base(run_id,
    term_id, base)`` the value of the absent ones, ``n_points(run_id, n)`` the rows.
    """
    cols = weights.drop("base").groupBy("run_id", "term_id").agg(F.sum("w").alias("s"), F.max("w").alias("mx"), F.count(F.lit(1)).alias("nnz"))
    c = base.join(cols, ["run_id", "term_id"], "left").join(F.broadcast(n_points), "run_id")  # one row per run
    nnz, absent = F.coalesce("nnz", F.lit(0)), F.col("base")
    mean = (F.coalesce("s", F.lit(0.0)) + (F.col("n") - nnz) * absent) / F.col("n")
    top = F.when(nnz < F.col("n"), F.greatest(F.coalesce("mx", absent), absent)).otherwise(F.col("mx"))
    return c.groupBy("run_id").agg(F.greatest(F.lit(0.0), F.max(top - mean)).alias("max_x"))


def sparse_rows(weights: DataFrame, base: DataFrame, docs: DataFrame) -> DataFrame:
    """``(run_id, id, terms, ws)``: per doc its cells less the absent value, which cancels in every difference.

    ``docs(run_id, doc_id)`` lists the rows; one without cells has empty arrays.  Cells that come with
    their absent value (a column ``base``) are not joined with ``base``.
    """
    cells = weights if "base" in weights.columns else weights.join(base, ["run_id", "term_id"])
    delta = cells.select("run_id", "doc_id", F.struct("term_id", (F.col("w") - F.col("base")).alias("w")).alias("c"))
    per = delta.groupBy("run_id", "doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    out = docs.join(per, ["run_id", "doc_id"], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<term_id:bigint,w:double>>")))
    return out.select("run_id", F.col("doc_id").cast("long").alias("id"), F.transform("c", lambda x: x["term_id"]).alias("terms"),
                      F.transform("c", lambda x: x["w"]).alias("ws"))
