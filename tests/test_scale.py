"""Work per task and per shuffle must not grow with the table."""

import math

import numpy as np
import pytest

from corpusmap.operators import all_pairs as P
from corpusmap.operators import blocks as B
from corpusmap.operators import layout as L
from corpusmap.operators import terms as T
from corpusmap.operators.block_files import MOST_ROWS, by_hash, rows_per_block
from corpusmap.operators.distance import knn
from corpusmap.operators.separation import separation


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_do_not_grow_with_the_table():
    """A larger table makes more blocks."""
    assert rows_per_block(100_000, 64, 12) == rows_per_block(10_000_000, 64, 12) == MOST_ROWS


def test_later_blocks_and_ties(spark):
    """Blocks after the first are cut at the k-th distance so far; ties at the k-th place still go to the smallest ids."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(120, 3)).astype(float)  # many equal distances and copies
    got = {}
    for r in knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), 4, run_col=None, block_rows=7).collect():
        got.setdefault(r.src, []).append((r.d2, r.dst))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(len(x)):
        assert sorted(got[i]) == sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]


def test_class_sums_over_blocks_in_label_order(spark):
    rng = np.random.default_rng(9)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 4, size=90)
    s = separation(spark.createDataFrame([(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, label))], "id long, vec array<double>, label string"),
                   run_col=None, block_rows=11).first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    same = (label[:, None] == label[None]) & ~np.eye(90, dtype=bool)
    assert s.within == pytest.approx(d[same].mean(), rel=1e-12)
    assert s.between == pytest.approx(d[label[:, None] != label[None]].mean(), rel=1e-12)


def test_exact_pass_replicates_no_point(spark):
    """places are written once; rows with one id count as points of their own."""
    rng = np.random.default_rng(10)
    y = rng.normal(size=(50, 2))
    y[7] = y[6]
    state = spark.createDataFrame([("default", 6 if i == 7 else i, float(a), float(b)) for i, (a, b) in enumerate(y)],
                                  "run_id string, id long, y0 double, y1 double")
    edges = spark.createDataFrame([("default", 6, 3, 0.5), ("default", 3, 6, 0.25)], "run_id string, src long, dst long, p double")
    made = L.exact_forces(state, L.edges_by_block(edges, 5), 5)
    assert "Generate" not in plan(made)
    per_point, z = L.sum_forces(made)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d ** 2).sum(-1))
    np.fill_diagonal(q, 0)
    r = ((q * q)[:, :, None] * d).sum(1)
    assert z.first().Z == pytest.approx(q.sum(), rel=1e-12)
    got = {p.id: p for p in per_point.collect()}
    assert got[6].r0 == pytest.approx(r[6, 0] + r[7, 0], rel=1e-9) and got[3].r1 == pytest.approx(r[3, 1], rel=1e-9)
    assert got[6].a0 == pytest.approx(0.5 * q[6, 3] * d[6, 3, 0], rel=1e-12)
    assert got[3].a1 == pytest.approx(0.25 * q[3, 6] * d[3, 6, 1], rel=1e-12) and got[4].a0 == 0


def test_points_without_a_place_leave_the_sums_of_other_blocks(spark):
    """Null places make null partial sums, which add nothing."""
    rows = [("default", i, None if i == 0 else float(i), float(i)) for i in range(30)]
    state = spark.createDataFrame(rows, "run_id string, id long, y0 double, y1 double")
    empty = spark.createDataFrame([], "run_id string, src long, dst long, p double")
    per_point, z = L.sum_forces(L.exact_forces(state, L.edges_by_block(empty, 3), 3))
    assert z.first().Z > 0 and {r.id: r.r0 for r in per_point.collect()}[0] is None


def test_dense_block_by_columns(monkeypatch):
    rng = np.random.default_rng(11)
    y = rng.normal(size=(20, 2))
    r, z, own = np.zeros((20, 2)), np.zeros(20), np.arange(20)
    B.dense(y, y, np.ones(20), own, r, z)
    monkeypatch.setattr(B, "DENSE_COLUMNS", 6)
    r2, z2 = np.zeros((20, 2)), np.zeros(20)
    B.dense(y, y, np.ones(20), own, r2, z2)
    assert np.allclose(r, r2, atol=1e-13) and np.allclose(z, z2, atol=1e-13)


def test_a_task_for_each_block_and_betas_by_strips(spark):
    """The calibration goes over the blocks once for each strip of rows, and tasks grow in number with the blocks."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3))
    points = spark.createDataFrame([("default", i, v.tolist()) for i, v in enumerate(x)], "run_id string, id long, vec array<double>")
    blocks = P.write_blocks(points, 40)
    assert P._work(blocks).rdd.getNumPartitions() == blocks.count() > 2 * spark.sparkContext.defaultParallelism
    betas = P.beta_all_pairs(blocks, 5.0, 2.0).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(-1) / 2.0
    for r in betas:
        p = np.exp(-r.beta * d[r.id])
        p[r.id] = 0
        assert r.sum == pytest.approx(p.sum(), rel=1e-9)
        assert r.beta * (d[r.id] * p).sum() / p.sum() + np.log(p.sum()) == pytest.approx(np.log(5.0), abs=2e-5)


def test_stems_are_counted_in_as_many_tasks_as_the_postings_need(spark, monkeypatch):
    """the partitions of the second count go with the postings."""
    monkeypatch.setattr(T, "ROWS_PER_TASK", 4)
    doc = spark.createDataFrame([(i, " ".join(f"word{j}s" for j in range(i, i + 10))) for i in range(20)], "doc_id long, text string")
    tf = T.term_freqs(doc, stem=True)
    assert tf.rdd.getNumPartitions() == 50
    assert tf.count() == 200


def test_sparse_dots_and_exact_distances():
    """products run over the common columns only, however wide the vocabulary."""
    rng = np.random.default_rng(13)
    width = 50_000_000
    cols = [np.sort(rng.choice(300, size=k, replace=False)) * (width // 300) for k in rng.integers(0, 60, size=70)]
    vals = [rng.normal(size=len(c)) for c in cols]
    a, b = B.SparsePoints(cols[:30], vals[:30]), B.SparsePoints([*cols[30:], cols[3]], [*vals[30:], vals[3]])
    full = np.zeros((71, 300))
    for i, (c, v) in enumerate(zip([*cols, cols[3]], [*vals, vals[3]])):
        full[i, c // (width // 300)] = v
    assert np.allclose(a.dots(b), full[:30] @ full[30:].T, atol=1e-12)
    d = ((full[:30, None] - full[None, 30:]) ** 2).sum(-1)
    assert np.allclose(B.pair_dists(a, b), d, atol=1e-12) and B.pair_dists(a, b)[3, 40] == 0
    part = a.take(np.array([3, 4, 9]))
    assert np.allclose(part.dots(b), full[[3, 4, 9]] @ full[30:].T, atol=1e-12)
    i, j = np.nonzero(np.ones((30, 41)))
    assert np.allclose(a.exact(i, b, j), d.ravel(), atol=1e-12)


def test_matrix_round_trip_stores_no_wide_rows(spark, tmp_path):
    """a stored wide row is read back in batches of 4,096, so tables of them outgrow any executor."""
    import glob

    import pyarrow.parquet as pq

    from corpusmap.plans import registered
    from corpusmap.session import ensure_checkpoint_dir
    rows = [(i, f"alpha beta{i % 2} " + "gamma " * (i % 3)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables = lambda: set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix("file:")}/**/*.parquet", recursive=True))
    before = tables()
    got = {r.id: (r.width, r.total) for r in registered.QUERIES["k1_s6_matrix_round_trip"](spark, str(tmp_path)).collect()}
    assert len(got) == 60 and {w for w, _ in got.values()} == {4}  # alpha, beta0, beta1, gamma
    lines = {r._key: r.value.split(" ") for r in registered.QUERIES["w10_k1_dense_matrix"](spark, str(tmp_path)).collect()}
    assert lines.pop(-1) == ["60", "4"]
    assert got == {i: (4, pytest.approx(sum(map(float, v)), abs=6e-4)) for i, v in lines.items()}
    made = [set(pq.read_schema(f).names) for f in tables() - before if "/part-" in f]
    assert made and not any({"vec", "line", "tok", "value"} & names for names in made)


def test_sweep_weights_are_made_once_for_a_posting(spark):
    """no setting computes a term's or a document's weight again."""
    from corpusmap.operators.weighting import tfidf_sweep, weighting_grid
    tf = spark.createDataFrame([(1, "a", 3, 4), (2, "a", 1, 1), (2, "b", 1, 1)], "doc_id long, term string, tf long, max_tf long")
    vocab = spark.createDataFrame([("a", 0, 2), ("b", 1, 1)], "term string, term_id long, df long")
    out = tfidf_sweep(tf, vocab, spark.createDataFrame([(5,)], "n_docs long"), weighting_grid(spark))
    idf, tfw = (1 + math.log(5 / 3), math.log(5 / 2), 5 / 2, 1.0), (math.sqrt(3), 3.0, math.log(4), 0.5 + 0.5 * 3 / 4)
    got = {r.run_id: r.w for r in out.filter("doc_id = 1").collect()}
    assert got == {f"tfCalc{t}idfCalc{i}": pytest.approx(tfw[t] * idf[i]) for t in range(4) for i in range(4)}
    above = plan(out).split("Generate explode")[0]
    assert out.count() == 48 and "LOG" not in above.upper() and "SQRT" not in above.upper()
