"""Kernels of exact all-pairs work on two blocks of points, and the number of blocks.

The kernels emit only aggregates or top-k candidates -- never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1024
RECOMPUTE_VALUES = 1 << 22  # values of a block recomputed at once


def choose_blocks(n_points: int, block_rows: int = DEFAULT_BLOCK_ROWS, min_groups: int = 16) -> int:
    """Blocks so that a block holds about ``block_rows`` points, with enough groups for parallelism."""
    nb = max(1, math.ceil(n_points / max(1, block_rows)))
    while nb * (nb + 1) // 2 < min_groups and nb < max(1, n_points):
        nb += 1
    return nb


def vec_matrix(series) -> np.ndarray:
    """Stack a pandas Series of equal-length arrays into a float64 matrix."""
    if isinstance(series, np.ndarray) and series.ndim == 2:
        return series.astype(np.float64, copy=False)
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in getattr(series, "values", series)])


class DensePoints:
    """Rows of equal length."""

    even = True

    def __init__(self, vecs):
        self.x = vec_matrix(vecs)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.width = self.x.shape[1]

    def __len__(self):
        return len(self.x)

    def take(self, rows) -> DensePoints:
        out = DensePoints.__new__(DensePoints)
        out.x, out.norms, out.width = self.x[rows], self.norms[rows], self.width
        return out

    def dots(self, other) -> np.ndarray:
        return self.x @ other.x.T

    def exact(self, rows, other, cols) -> np.ndarray:
        """Squared distances of the pairs, from differences, in bounded memory."""
        out = np.empty(len(rows))
        step = max(1, RECOMPUTE_VALUES // max(1, self.width))
        for k in range(0, len(rows), step):
            diff = self.x[rows[k:k + step]] - other.x[cols[k:k + step]]
            out[k:k + step] = np.einsum("ij,ij->i", diff, diff)
        return out


PRODUCTS = 1 << 20  # products, or values of pairs, made at once


class SparsePoints:
    """Rows as (columns, values); products run over the columns that two rows have in common."""

    def __init__(self, columns, values):
        sizes = np.array([len(c) for c in columns], np.int64)
        self._set(sizes, np.concatenate([*columns, np.zeros(0)]).astype(np.int64), np.concatenate([*values, np.zeros(0)]).astype(np.float64))

    @classmethod
    def flat(cls, sizes, columns, values) -> SparsePoints:
        """Rows of the given sizes, one after the other in ``columns`` and ``values``."""
        out = cls.__new__(cls)
        out._set(np.asarray(sizes, np.int64), np.asarray(columns, np.int64), np.asarray(values, np.float64))
        return out

    def _set(self, sizes, col, val):
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)
        self.norms = np.bincount(row, val * val, self.n)
        by = np.lexsort((row, col))
        row, col, val = row[by], col[by], val[by]
        last = np.concatenate([(row[1:] != row[:-1]) | (col[1:] != col[:-1]), np.ones(min(1, len(row)), bool)])  # of a column given twice
        self.row, self.col, self.val = row[last], col[last], val[last]
        self.even = bool(last.all())  # no column twice, so the norms are those of the values
        self._rows = None

    def __len__(self):
        return self.n

    def take(self, rows) -> SparsePoints:
        """The points at ascending ``rows``."""
        if len(rows) == self.n:
            return self
        place = np.full(self.n, -1, np.int64)
        place[rows] = np.arange(len(rows))
        there = place[self.row] >= 0
        out = SparsePoints.__new__(SparsePoints)
        out.row, out.col, out.val = place[self.row[there]], self.col[there], self.val[there]
        out.n, out.norms, out.even = len(rows), self.norms[rows], self.even
        first, count, col, val = self._by_row()
        out._rows = first[rows], count[rows], col, val
        return out

    def dots(self, other) -> np.ndarray:
        out = np.zeros(self.n * other.n)
        first = np.searchsorted(other.col, self.col)
        count = np.searchsorted(other.col, self.col, side="right") - first
        for a, z in _stretches(count):
            mine = np.repeat(np.arange(a, z), count[a:z])
            theirs = _runs(first[a:z], count[a:z])
            out += np.bincount(self.row[mine] * other.n + other.row[theirs], self.val[mine] * other.val[theirs], len(out))
        return out.reshape(self.n, other.n)

    def _by_row(self):
        """``(first, count, columns, values)`` of the rows, which :meth:`take` may have picked; made once."""
        if self._rows is None:
            by = np.argsort(self.row, kind="stable")
            count = np.bincount(self.row, minlength=self.n)
            self._rows = np.cumsum(count) - count, count, self.col[by], self.val[by]
        return self._rows

    def leading(self, ids, k: int) -> np.ndarray:
        """Places of the rows that may be among the k nearest others of any point: of equal rows
        those with the k + 1 smallest ids (one may be the point itself).  ``ids`` ascending."""
        first, count, col, val = self._by_row()
        seen, keep = {}, np.ones(self.n, bool)
        for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
            what = col[a:a + n].tobytes(), val[a:a + n].tobytes(), float(self.norms[i])
            many, latest = seen.get(what, (0, None))
            many += latest != ids[i]  # an id given twice counts once
            keep[i] = many <= k + 1
            seen[what] = many, ids[i]
        return np.flatnonzero(keep)

    def exact(self, rows, other, cols) -> np.ndarray:
        out = np.zeros(len(rows))
        (f1, n1, c1, v1), (f2, n2, c2, v2) = self._by_row(), other._by_row()
        least = min(int(c.min(initial=0)) for c in (c1, c2))
        width = max(int(c.max(initial=0)) for c in (c1, c2)) - least + 1
        for a, z in _stretches(n1[rows] + n2[cols]):
            i, j, pair = rows[a:z], cols[a:z], np.arange(z - a)
            one, two = _runs(f1[i], n1[i]), _runs(f2[j], n2[j])
            pair = np.concatenate([np.repeat(pair, n1[i]), np.repeat(pair, n2[j])])
            if not len(pair):
                continue
            col, val = np.concatenate([c1[one], c2[two]]), np.concatenate([v1[one], -v2[two]])
            if (z - a) * width < 1 << 62:
                by = np.argsort(pair * width + (col - least), kind="stable")  # a merge: both halves are in this order
            else:
                by = np.lexsort((col, pair))
            pair, col, val = pair[by], col[by], val[by]
            begin = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (col[1:] != col[:-1])]))
            diff = np.add.reduceat(val, begin)
            out[a:z] = np.bincount(pair[begin], diff * diff, z - a)
        return out


def _runs(first, count) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` of ``count[i]`` numbers each, one run after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _stretches(count):
    """Ranges of places whose counts add up to about PRODUCTS."""
    ends, a = np.cumsum(count), 0
    while a < len(count):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PRODUCTS, side="right")))
        yield a, z
        a = z


def pair_dists(a, b) -> np.ndarray:
    """Squared Euclidean distances |a|²+|b|²-2ab, clamped at 0.

    Entries that are tiny relative to the norms (cancellation territory,
    e.g. duplicate points) are recomputed exactly from differences.
    """
    d = a.dots(b)
    d *= -2.0
    d += a.norms[:, None]
    d += b.norms
    np.maximum(d, 0.0, out=d)
    if d.size:
        # rows that may have such entries, by the largest norm; then the entries
        rows = np.flatnonzero(d.min(axis=1) <= 1e-9 * (a.norms + b.norms.max()))
        if len(rows):
            ii, jj = np.nonzero(d[rows] <= 1e-9 * (a.norms[rows, None] + b.norms))
            if len(ii):
                d[rows[ii], jj] = a.exact(rows[ii], b, jj)
    return d


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """V3: :func:`pair_dists` of two matrices."""
    return pair_dists(DensePoints(a), DensePoints(b))


BLOCK_VALUES = 1 << 16  # values of a dense block, so that it stays in a core's cache
DENSE_COLUMNS = 1024    # of a dense block, so that it has many rows


def dense(y, mean, weight, own, r, z):
    """Add to ``r``, ``z`` the repulsion of ``weight`` points at each place ``mean``; column ``own[i]`` (if any) counts one less for row i.

    Distances and sums are matrix products.  1 + d² is never below 1, so what the products
    round off (about 1e-16 of the squared positions) hardly matters; a row's own column has d = 0.
    """
    if len(mean) > DENSE_COLUMNS:
        for b in range(0, len(mean), DENSE_COLUMNS):
            here = np.where((own >= b) & (own < b + DENSE_COLUMNS), own - b, -1)
            dense(y, mean[b:b + DENSE_COLUMNS], weight[b:b + DENSE_COLUMNS], here, r, z)
        return
    left = np.column_stack([y, (y * y).sum(axis=1), np.ones(len(y))])
    right = np.stack([-2.0 * mean[:, 0], -2.0 * mean[:, 1], np.ones(len(mean)), 1.0 + (mean * mean).sum(axis=1)])
    sums = np.column_stack([weight, weight * mean[:, 0], weight * mean[:, 1]])
    step = max(1, BLOCK_VALUES // max(1, len(mean)))
    for a in range(0, len(y), step):
        q = left[a:a + step] @ right
        np.reciprocal(q, out=q)
        mine = own[a:a + step]
        rows = np.flatnonzero(mine >= 0)
        z[a:a + step] += q @ weight
        z[a + rows] -= q[rows, mine[rows]]
        np.square(q, out=q)
        got = q @ sums
        r[a:a + step] += y[a:a + step] * got[:, :1] - got[:, 1:]


MAX_PAIR_PARTITIONS = 20_000  # of the plan only: beyond it several groups share a task


def spread_groups(rows: DataFrame, n_blocks: int, n_runs: int = 1, keys=("run_id", "_bi", "_bj")) -> DataFrame:
    """Hash-partition block-pair rows into about one partition per group.

    Block-pair groups are few but CPU-heavy; left to AQE, a small shuffle
    would be coalesced into a single task that runs every GEMM serially.
    An explicit repartition on the grouping keys is kept as is and already
    satisfies the following ``groupBy(...).applyInPandas``.
    """
    groups = max(1, int(n_runs)) * n_blocks * (n_blocks + 1) // 2
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(groups, max(cores * 4, min(groups, MAX_PAIR_PARTITIONS)), MAX_PAIR_PARTITIONS))
    return rows.repartition(n, *keys)
