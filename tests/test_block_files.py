"""Exact neighbours and class sums on block files: pruning, hot cells, runs, strips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import block_files as B
from corpusmap.operators import distance as D
from corpusmap.operators import separation as separation_module
from corpusmap.operators.separation import label_pair_sums, separation


def frame(spark, points):
    return spark.createDataFrame([(r, int(i), [float(x) for x in v]) for r, i, v in points], "run_id string, id long, vec array<double>")


def brute(points, k):
    """(run, src) -> the k nearest ``(d2, dst)``, ties to the smallest ids."""
    out = {}
    for run in {r for r, _, _ in points}:
        ids = np.array([i for r, i, _ in points if r == run])
        x = np.array([v for r, _, v in points if r == run], float)
        for i, v in zip(ids, x):
            d = ((x - v) ** 2).sum(axis=1)
            by = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[run, int(i)] = [(int(ids[j]), float(d[j])) for j in by]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.run_id, r.src), []).append((r.dst, r.d2))
    return out


def same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for key, near in got.items():
        assert [j for j, _ in near] == [j for j, _ in want[key]], key
        assert [d for _, d in near] == pytest.approx([d for _, d in want[key]])


def test_clusters_are_pruned_and_exact(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6)) * 50
    points = [("a", i, centers[i % 12] + rng.normal(size=6)) for i in range(600)]
    tasks = D.knn_tasks(frame(spark, points), block_rows=20).cache()
    same(found(D._nearest(tasks, 7)), brute(points, 7))
    opened, skipped = D.knn_pairs(tasks, 7).agg(F.sum("opened"), F.sum("skipped")).first()
    blocks = tasks.count()
    assert opened + skipped == blocks * blocks and skipped > 0.6 * blocks * blocks
    tasks.unpersist()


def test_a_hot_cell_is_split_and_skipped(spark):
    """A third of all points at one place: blocks stay small, and blocks of larger ids are not opened."""
    rng = np.random.default_rng(6)
    points = [("a", i, [3.0, 4.0] if i % 3 == 0 else rng.normal(size=2)) for i in rng.permutation(900)]
    tasks = D.knn_tasks(frame(spark, points), block_rows=15).cache()
    same(found(D._nearest(tasks, 4)), brute(points, 4))
    sizes = [B.read_file(r.uri).num_rows for r in tasks.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 60
    assert D.knn_pairs(tasks, 4).agg(F.sum("skipped")).first()[0] > 0
    tasks.unpersist()


def test_runs_and_small_runs(spark):
    rng = np.random.default_rng(7)
    points = [("a", i, rng.normal(size=3)) for i in range(90)] + [("b", i, rng.normal(size=3)) for i in range(3)] + [("c", 5, [1.0, 1.0, 1.0])]
    for rows in (8, 1000, None):
        same(found(D.knn(frame(spark, points), 5, block_rows=rows)), brute(points, 5))
    assert D.knn(frame(spark, points).limit(0), 5).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3, 6, 7])
def test_every_block_pair_once(blocks):
    index = B.Index.__new__(B.Index)
    index.block = np.arange(blocks) * 5
    pairs = [frozenset((i, j)) for i in range(blocks) for j in index.partners(5 * i)]
    assert len(pairs) == len(set(pairs)) == blocks * (blocks + 1) // 2


def test_class_sums_by_strips(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3)], "abc"[i % 3]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    x, lab = np.array([v for _, v, _ in rows]), np.array([label for _, _, label in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    eq, off = lab[:, None] == lab[None, :], ~np.eye(70, dtype=bool)
    monkeypatch.setattr(separation_module, "STRIP_VALUES", 30)  # a few rows a strip
    got = separation(df, run_col=None, block_rows=9).first()
    assert (got.within, got.between) == pytest.approx((d[eq & off].mean(), d[~eq].mean()))
    sums = {(r.l1, r.l2): (r.sum_dist, r.n_pairs) for r in label_pair_sums(df, run_col=None, block_rows=9).collect()}
    for a in "abc":
        for b in "abc":
            if a <= b:
                part = np.triu(d, 1)[(lab == a)[:, None] & (lab == b)[None] | (lab == b)[:, None] & (lab == a)[None]]
                assert sums[a, b][0] == pytest.approx(part.sum())
    assert sum(n for _, n in sums.values()) == 70 * 69 // 2


def test_inside_temporary_tables(spark):
    """Nothing of the session goes to the workers."""
    from corpusmap.plans.util import temporary_tables

    points = [("a", i, [float(i), float(i % 3)]) for i in range(40)]
    with temporary_tables():
        same(found(D.knn(frame(spark, points), 3, block_rows=10)), brute(points, 3))
        labelled = frame(spark, points).withColumn("label", F.col("id") % 2)
        assert separation(labelled, block_rows=10).count() == 1


def test_shuffled_rows_do_not_grow_with_the_blocks(spark):
    """Each point goes to one block file."""
    rng = np.random.default_rng(9)
    points = [("a", i, rng.normal(size=2)) for i in range(200)]
    for rows in (10, 50):
        files = [B.read_file(r.uri) for r in D.knn_tasks(frame(spark, points), block_rows=rows).collect()]
        assert sorted(i for f in files for i in f["id"].to_pylist()) == list(range(200))
