"""Sources and sinks (S, K) and the experiment operators (X)."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmap.plans import sweep as X
from corpusmap.sources.corpus import (build_index, corpus_from_table, doc_field, lenient_utf8, open_index,
                                      read_corpus_dir, read_corpus_list)
from corpusmap.sources.files import read_labelled_points, read_matrix, read_results
from corpusmap.sources.sinks import (layout_lines, write_by_label, write_layout, write_matrix, write_paths,
                                     write_scores, write_stats)
from corpusmap.operators.terms import corpus_stats, term_freqs


def read_parts(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts)


def test_d10_lenient_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\x61\xfe\x62"),)], "b binary")
    assert df.select(lenient_utf8("b").alias("t")).first().t == "ab"


def test_corpus_dir_and_list(spark, tmp_dir):
    root = os.path.join(tmp_dir, "corpus")
    os.makedirs(os.path.join(root, "g1"))
    os.makedirs(os.path.join(root, ".hidden"))
    for name, text in [("g1/a.txt", "mary harry"), ("g1/b.txt", "harry"), ("c.md", "skip"),
                       (".hidden/d.txt", "no"), (".e.txt", "no")]:
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    doc = read_corpus_dir(spark, root, suffix=".txt")
    assert sorted(os.path.basename(r.path) for r in doc.collect()) == ["a.txt", "b.txt"]
    assert sorted(r.doc_id for r in doc.collect()) == [0, 1]
    assert read_corpus_dir(spark, os.path.join(tmp_dir, "missing")).count() == 0
    lst = os.path.join(tmp_dir, "list.txt")
    with open(lst, "w") as f:
        f.write(os.path.join(root, "g1/b.txt") + "\n" + os.path.join(root, "g1/a.txt") + "\n")
    got = {r.doc_id: os.path.basename(r.path) for r in read_corpus_list(spark, lst).collect()}
    assert got == {0: "b.txt", 1: "a.txt"}


def test_listed_paths_and_hidden_files(spark, tmp_dir, monkeypatch):
    names = ["plain.txt", "_under.txt", ".dot.txt", "_folder/x.txt", ".folder/y.txt", "a b%20é.txt"]
    for n in names:
        os.makedirs(os.path.dirname(os.path.join(tmp_dir, "c", n)), exist_ok=True)
        with open(os.path.join(tmp_dir, "c", n), "w") as f:
            f.write(n)
    root = os.path.join(tmp_dir, "c")
    assert sorted(r.text for r in read_corpus_dir(spark, root).collect()) == sorted(n for n in names if not n.startswith("."))
    assert sorted(r.text for r in read_corpus_dir(spark, root, skip_hidden=False).collect()) == sorted(names)
    lst = os.path.join(tmp_dir, "list.txt")
    lines = [f"file:{root}/plain.txt", f"file://{root}/_under.txt", "c/.dot.txt", "./c/_folder/x.txt", f"{root}/plain.txt"]
    with open(lst, "w") as f:
        f.write("\n".join(lines) + "\n")
    monkeypatch.chdir(tmp_dir)
    got = sorted((r.doc_id, r.path, r.text) for r in read_corpus_list(spark, lst).collect())
    assert [t for *_, t in got] == ["plain.txt", "_under.txt", ".dot.txt", "_folder/x.txt", "plain.txt"] and [p for _, p, _ in got] == lines
    with open(lst, "a") as f:
        f.write("c/not-there.txt\n")
    with pytest.raises(Exception, match="not-there"):
        read_corpus_list(spark, lst).collect()


def test_matrix_of_several_parts(spark, tmp_dir):
    out = os.path.join(tmp_dir, "m")
    rows = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vec"))
    write_matrix(rows.repartition(5), out)
    m = read_matrix(spark, out)
    assert m.count() == 6000 and m.filter(F.col("id") != F.col("vec")[0]).count() == 0


def test_corpus_job(spark, tmp_dir):
    """The reference's own matrix and path text through the default analysis, from a folder and from the stored index."""
    from corpusmap.plans.termvect import TermVectConfig, corpus_job

    os.makedirs(os.path.join(tmp_dir, "docs"))
    for name, text in (("doc1", "fred sally mary"), ("doc2", "sally mary harry"), ("doc3", "mary harry higgs")):
        with open(os.path.join(tmp_dir, "docs", name), "w") as f:
            f.write(text)
    cfg = TermVectConfig(tf_calc=1, idf_calc=3)
    index = os.path.join(tmp_dir, "index")
    corpus_job(spark, index, os.path.join(tmp_dir, "o1"), cfg, doc_dir=os.path.join(tmp_dir, "docs"))
    assert read_parts(os.path.join(tmp_dir, "o1", "matrix")) == "3 3\n0.0 1.0 1.0\n1.0 1.0 1.0\n1.0 1.0 0.0\n"
    assert [os.path.basename(x) for x in read_parts(os.path.join(tmp_dir, "o1", "paths")).split()] == ["doc1", "doc2", "doc3"]
    corpus_job(spark, index, os.path.join(tmp_dir, "o2"), cfg)
    assert read_parts(os.path.join(tmp_dir, "o1", "matrix")) == read_parts(os.path.join(tmp_dir, "o2", "matrix"))
    assert read_parts(os.path.join(tmp_dir, "o2", "stats")) == "fred 1 1\nharri 2 2\nhigg 1 1\nmari 3 3\nsalli 2 2\n"


def test_index_round_trip_and_field(spark, tmp_dir):
    doc = corpus_from_table(spark.createDataFrame([(5, "x y"), (6, "y")], "id long, body string"), "id", "body")
    tf = term_freqs(doc)
    build_index(doc, tf, os.path.join(tmp_dir, "idx"))
    d2, tf2 = open_index(spark, os.path.join(tmp_dir, "idx"))
    assert sorted(tf2.collect()) == sorted(tf.collect()) and d2.count() == 2
    assert doc_field(doc, "path", 6).first().path == "6"


def test_matrix_and_paths_round_trip(spark, tmp_dir):
    dense = spark.createDataFrame([(0, [0.0, 0.5]), (1, [1.0e-4, 2.0])], "doc_id long, vec array<double>")
    out = os.path.join(tmp_dir, "terms")
    write_matrix(dense, out)
    assert read_parts(out) == "2 2\n0.0 0.5\n1.0E-4 2.0\n"
    m = read_matrix(spark, out)
    assert [r.vec for r in m.orderBy("id").collect()] == [[0.0, 0.5], [1.0e-4, 2.0]]
    doc = spark.createDataFrame([(0, "p0", ""), (1, "p1", "")], "doc_id long, path string, text string")
    write_paths(doc, os.path.join(tmp_dir, "paths"))
    assert read_parts(os.path.join(tmp_dir, "paths")) == "p0\np1\n"
    bad = os.path.join(tmp_dir, "bad.txt")
    with open(bad, "w") as f:
        f.write("3 2\n1 2\n3 4\n")
    with pytest.raises(ValueError):
        read_matrix(spark, bad)


def test_layout_sink_and_points(spark, tmp_dir):
    lay = spark.createDataFrame([(0, 1.0, -2.5), (1, 0.1234567, 3.0)], "id long, y0 double, y1 double")
    out = os.path.join(tmp_dir, "lay")
    write_layout(lay, out)
    assert read_parts(out) == "2\n2\n1.000000 -2.500000 \n0.123457 3.000000 \n"
    pts = os.path.join(tmp_dir, "run1.withGroup")
    with open(pts, "w") as f:
        f.write(" 1 2 a\n3 5 a\n6 9 b\n10 14 b\n")
    lp = read_labelled_points(spark, pts)
    from corpusmap.operators.separation import separation
    assert separation(lp).first().ratio == pytest.approx(0.5003827426342798)
    lab = lay.withColumn("label", F.lit("g"))
    write_by_label(lab, os.path.join(tmp_dir, "bylabel"))
    assert os.path.isdir(os.path.join(tmp_dir, "bylabel", "label=g"))
    write_scores(spark.createDataFrame([("r", 0.5)], "run_id string, ratio double"), os.path.join(tmp_dir, "s"))
    assert read_parts(os.path.join(tmp_dir, "s")) == "r 0.5\n"


RESULTS = """0 0 6.0 0.9
3 0 6.0 0.6
3 0 3.0 0.7
3 1 6.0 0.8
1 0 6.0 0.95
3 0 30.0 0.75
"""


def test_results_best_sensitivity(spark, tmp_dir):
    p = os.path.join(tmp_dir, "res.txt")
    with open(p, "w") as f:
        f.write(RESULTS)
    res = read_results(spark, p)
    b = X.best(res).collect()
    assert len(b) == 1 and (b[0].tf_calc, b[0].idf_calc, b[0].perplexity) == (3, 0, 6.0)
    sens = {(r.param, r.x): r.dist_ratio for r in X.sensitivity(res).collect()}
    assert sens[("tf_calc", 0.0)] == 0.9 and sens[("tf_calc", 1.0)] == 0.95 and sens[("tf_calc", 3.0)] == 0.6
    assert sens[("idf_calc", 1.0)] == 0.8 and sens[("perplexity", 30.0)] == 0.75
    r = X.rescale_perplexity(res).filter("perplexity = 3.0").count()
    assert r == 1  # 30 -> 3.0
    names = spark.createDataFrame([("./tfCalc3idfCalc0/perp6.0.matrix.withGroup",)], "run_id string")
    n = X.parse_run_name(names).first()
    assert (n.tf_calc, n.idf_calc, n.perplexity) == (3, 0, 6.0)
    g = X.grid(spark)
    assert g.count() == 64 and g.filter(F.col("run_id") == "tfCalc3idfCalc0/perp6.0").count() == 1
    paths = spark.createDataFrame([("data/20news-18828/sci.med/58045",)], "path string")
    assert X.label_from_path(paths, 3).first().label == "sci.med"
    assert X.label_from_path(paths, 9).first().label == ""
    assert X.parse_run_name(spark.createDataFrame([("other",)], "run_id string")).first().tf_calc is None


def test_sweep_query_runs_the_whole_experiment(spark, monkeypatch):
    import inspect

    from corpusmap.plans import registered, sweep
    from corpusmap.plans.termvect import TermVectConfig
    seen = {}
    sig = inspect.signature(sweep.sweep)

    def record(*args, **options):
        call = sig.bind(*args, **options)
        call.apply_defaults()
        seen.update(call.arguments)
        return None, None
    monkeypatch.setattr(registered.X, "sweep", record)
    monkeypatch.setattr(registered, "documents", lambda *a: None)
    monkeypatch.setattr(registered, "table", lambda *a: spark.createDataFrame([(1, "en")], "doc_id long, lang string"))
    registered.QUERIES["x3_x4_sweep_4x4x4"](spark, "")
    settings = {(r.tf_calc, r.idf_calc, r.perplexity) for r in seen["params"].collect()}
    assert settings == {(t, i, p) for t in range(4) for i in range(4) for p in (6.0, 3.0, 1.0, 30.0)}
    assert (seen["cfg"].max_iter, seen["cfg"].start_iter, seen["cfg"].method, seen["cfg"].theta) == (500, 0, "bh", 0.001)
    assert seen["analysis"] == TermVectConfig() and (seen["min_df"], seen["max_df"]) == (20, 1000)
