"""Costs of the fourth round's findings on small rows: what is computed, shuffled and kept."""

import numpy as np
import pyarrow as pa

from corpusmap.operators import all_pairs as P
from corpusmap.operators import block_files as BF
from corpusmap.operators import blocks as B
from corpusmap.operators import distance as D
from corpusmap.operators import layout_team as T


def sparse_table(ids, columns, values):
    key = [[float(np.sqrt(np.sum(np.square(v))))] for v in values]
    return pa.table({"id": pa.array(ids, pa.int64()), "key": pa.array(key, pa.list_(pa.float64())),
                     "terms": pa.array(columns, pa.list_(pa.int64())), "ws": pa.array(values, pa.list_(pa.float64()))})


def test_equal_sparse_rows_are_compared_once(monkeypatch, tmp_path):
    """hundreds of rows without terms are at the k-th place of most others; k + 1 of them can count."""
    rng = np.random.default_rng(5)
    cols = [[] for _ in range(400)] + [np.sort(rng.choice(500, 9, replace=False)).tolist() for _ in range(100)]
    vals = [(1.0 + rng.random(len(c))).tolist() for c in cols]
    cols[450], vals[450] = cols[451], vals[451]
    ids = np.sort(rng.choice(10_000, 500, replace=False))
    mixed = rng.permutation(500)
    cols, vals = [cols[i] for i in mixed], [vals[i] for i in mixed]
    table = sparse_table(ids, cols, vals)
    uri = f"file://{tmp_path}/block"
    BF.write_file(uri, table)
    index = type("Index", (), {"block": np.array([0]), "uris": [uri], "center": np.zeros((1, 1)), "radius": np.array([1e9]), "least": ids[:1]})
    pairs, exact = [], B.SparsePoints.exact
    monkeypatch.setattr(B.SparsePoints, "exact", lambda self, rows, other, cols: pairs.append(len(rows)) or exact(self, rows, other, cols))
    got, best, _, _ = D._search({"uri": uri, "block": 0}, index, 3)
    full = np.zeros((500, 500))
    for i, (c, v) in enumerate(zip(cols, vals)):
        full[i, c] = v
    d = ((full[:, None] - full[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(500):
        order = np.lexsort((ids, d[i].round(9)))[:3]
        assert got[i] == ids[i] and best.dst[i].tolist() == ids[order].tolist() and np.allclose(best.d2[i], d[i][order])
    assert sum(pairs) < 40 * 500  # before: over 500 * 400


def test_leading_rows_with_ids_given_twice():
    x = B.SparsePoints([[1], [], [1], [], [1], [1], []], [[2.0], [], [2.0], [], [2.0], [2.5], []])
    assert x.leading(np.array([1, 2, 3, 4, 5, 6, 7]), 1).tolist() == [0, 1, 2, 3, 5]
    assert x.leading(np.array([1, 1, 1, 2, 3, 4, 4]), 1).tolist() == [0, 1, 2, 3, 4, 5]


def test_exact_distances_of_far_apart_columns():
    """Columns may be any bigint: where one key can't hold pair and column, both are sorted."""
    a, b = B.SparsePoints([[-(1 << 62), 5], [7]], [[1.0, 2.0], [3.0]]), B.SparsePoints([[5, 1 << 62], []], [[1.0, 4.0], []])
    assert a.exact(np.array([0, 0, 1, 1]), b, np.array([0, 1, 0, 1])).tolist() == [18.0, 5.0, 26.0, 9.0]


def test_sparse_rows_need_no_join_and_little_disk(spark, tmp_path):
    """the absent weight comes with a cell; blocks of sparse rows are written compressed."""
    from corpusmap.operators.weighting import weighting_grid
    from corpusmap.plans import sweep as X
    doc = spark.createDataFrame([(i, "") for i in range(6)], "doc_id long, text string")
    tf = spark.createDataFrame([(i, f"t{j}", 1 + j, 3) for i in range(5) for j in range(3) if i != j], "doc_id long, term string, tf long, max_tf long")
    weights, base, docs = X.sweep_matrices(doc, tf, weighting_grid(spark, (0, 3), (0, 1)), 1, None, None)
    joined = {(r.run_id, r.id): (r.terms, r.ws) for r in D.sparse_rows(weights.drop("base"), base, docs).collect()}
    rows = D.sparse_rows(weights, base, docs)
    assert {(r.run_id, r.id): (r.terms, r.ws) for r in rows.collect()} == joined and len(joined) == 20
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the list of documents
    table = sparse_table(range(200), [list(range(300))] * 200, [[1.5] * 300] * 200)
    BF.write_file(f"file://{tmp_path}/rows", table)
    assert (tmp_path / "rows").stat().st_size < table.nbytes / 4
    assert BF.read_file(f"file://{tmp_path}/rows").equals(table)


def test_cells_are_opened_where_walks_cost_more(monkeypatch):
    """at theta 0.001 a walk meets about as many cells as there are points, each dearer than a point."""
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(1500, 2)) * 30
    near = np.repeat(rng.normal(size=(3, 2)) * 30, 500, axis=0)
    near[:, 0] += np.tile(np.repeat([0.0, 1e-9], 250), 3)  # points at a few places
    assert not T.walks_pay(spread, 0.001) and T.walks_pay(near, 0.001)
    trees, made = [], T.Cells
    monkeypatch.setattr(T, "Cells", lambda y: trees.append(len(y)) or made(y))
    for y, most in ((spread, 3), (near, 40)):
        ids, state = np.arange(1500), np.column_stack([y, np.zeros((1500, 2)), np.ones((1500, 2))])
        src = np.arange(1500)
        s = T._Slice("a", 0, ids, state, src, (src + 1) % 1500, np.full(1500, 1 / 1500), 0, [0], None)
        s.meet()
        trees.clear()
        for it in range(20):
            s.push(0.001, f"z{it}", it % T.LOOK_EVERY == 0)
        assert len(trees) <= most  # before: one for each pass
        walked, all_pairs = T.repulsion(y, ids, 0.001), T.repulsion(y, ids, None)
        assert np.abs(s.r - walked[0]).max() <= 1e-6 * np.abs(walked[0]).max() and abs(s.z / walked[1].sum() - 1) < 1e-6
        assert np.abs(s.r - all_pairs[0]).max() <= 1e-6 * np.abs(walked[0]).max()
    s = T._Slice("a", 0, ids, np.column_stack([near, state[:, 2:]]), src, src, np.full(1500, 1 / 1500), 0, [0], None)
    s.meet()
    s.push(0.5, "z0", True)  # at a theta where cells differ from their points, walks are always made
    assert np.array_equal(s.r, T.repulsion(near, ids, 0.5)[0])


def test_costs_within_a_segment_and_segments_that_grow(spark, monkeypatch):
    """a quick segment is followed by a longer one, with the same layout and costs."""
    from corpusmap.plans import tsne as P
    rng = np.random.default_rng(2)
    rows = [("a", i, rng.normal(size=4).tolist()) for i in range(60)]
    points = spark.createDataFrame(rows, "run_id string, id long, vec array<double>")
    cfg = P.TsneConfig(max_iter=23, eval_every=5, segment=3, perplexity=4.0)
    stages, advance = [], P.advance
    monkeypatch.setattr(P, "advance", lambda state, edges, first, last, *a, **k: stages.append((first, last)) or advance(state, edges, first, last, *a, **k))
    got = []
    for seconds in (0, 1e9):
        monkeypatch.setattr(P, "SEGMENT_SECONDS", seconds)
        layout, metrics = P.tsne(points, cfg)
        got.append(({r.id: (r.y0, r.y1) for r in layout.collect()}, [(r.iter, r.cost) for r in metrics.collect()]))
    assert stages == [(a, min(a + 2, 22)) for a in range(0, 23, 3)] + [(0, 2), (3, 8), (9, 20), (21, 22)]
    assert [i for i, _ in got[0][1]] == [5, 10, 15, 20, 22] and np.allclose([c for _, c in got[0][1]], [c for _, c in got[1][1]], rtol=1e-9)
    assert all(np.allclose(y, got[1][0][i], rtol=1e-7, atol=1e-12) for i, y in got[0][0].items())


def test_betas_take_few_passes_over_a_row(monkeypatch):
    """The same betas as by stepping over the whole row, of isolated, crowded, twin and odd points."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1500, 8)), rng.normal(size=(300, 8)) * 1e-3, rng.normal(size=(100, 8)) * 40])
    x[1850:1856] = x[1850]                         # 5 others at distance 0, below the perplexity of 6
    x[1860:1870] = x[1860]                         # 9 others: no beta has that entropy
    stepped, by_steps = [], P._beta_by_steps
    target = float(np.log(6.0))
    for i in range(0, len(x), 1 if len(x) < 100 else 7):
        d = ((x - x[i]) ** 2).sum(axis=1)
        got, want = P._beta_near_root(d, i, target, 1e-5, 200), by_steps(d, i, target, 1e-5, 200)
        stepped.append(got is None)
        assert got is None or (got[0] == want[0] and abs(got[1] / want[1] - 1) < 1e-12)
    assert np.mean(stepped) < 0.1
    for d in (np.zeros(40), np.full(40, 2.0), np.full(40, 1e6) + np.arange(40), np.array([0.0, np.nan, 1.0, 2.0]), np.array([0.0, 1.0])):
        got = P._beta_near_root(d, 0, target, 1e-5, 200)
        want = by_steps(d, 0, target, 1e-5, 200)
        assert got is None or (got[0] == want[0] and abs(got[1] / want[1] - 1) < 1e-12)
    exps, exp = [], np.exp
    monkeypatch.setattr(P.np, "exp", lambda v, *a, **k: exps.append(np.size(v) * (np.asarray(v).dtype == np.float64)) or exp(v, *a, **k))
    d = ((x - x[3]) ** 2).sum(axis=1)
    assert P._beta_near_root(d, 3, target, 1e-5, 200) and sum(exps) <= 2 * len(d)  # before: about 20 passes in double
    exps.clear()
    by_steps(d, 3, target, 1e-5, 200)
    assert sum(exps) > 10 * len(d)
