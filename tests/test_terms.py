"""Corpus analysis, term statistics, vocabulary and weighting (A, T, F, W, K1-K3)."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmap.functions.stem import porter_stem
from corpusmap.functions.text import analyze_tokens, tokenize
from corpusmap.operators.terms import corpus_size, corpus_stats, doc_length, max_tf, term_freqs
from corpusmap.operators.vocab import filter_paths, sample_docs, vocabulary
from corpusmap.operators.weighting import baseline, densify, tfidf, tfidf_sweep, weighting_grid
from corpusmap.functions.weights import idf_weight, tf_weight
from corpusmap.plans.termvect import TermVectConfig, dense_matrix, term_vectors
from corpusmap.sources.sinks import matrix_lines, stats_lines

R1 = [(0, "doc1", "fred sally mary"), (1, "doc2", "sally mary harry"), (2, "doc3", "mary harry higgs")]


@pytest.fixture()
def r1(spark):
    return spark.createDataFrame(R1, "doc_id bigint, path string, text string")


def test_r1_matrix_golden(spark, r1):
    tf = term_freqs(r1, stem=True)
    vocab = vocabulary(corpus_stats(tf), min_df=2)
    n = corpus_size(r1)
    w = tfidf(tf, vocab, n, tf_calc=1, idf=lambda df, nd: 1.0 / df)
    base = baseline(vocab, n, 1, idf=lambda df, nd: 1.0 / df)
    dense = densify(w.select("doc_id", "term_id", "w"), base, tf.select("doc_id").distinct())
    text = "".join(r.value + "\n" for r in matrix_lines(dense).orderBy("_key").collect())
    assert text == ("3 3\n0.0 0.3333333333333333 0.5\n0.5 0.3333333333333333 0.5\n"
                    "0.5 0.3333333333333333 0.0\n")
    assert [r.term for r in vocab.orderBy("term_id").collect()] == ["harri", "mari", "salli"]


def test_d1_corpus_stats(spark, r1):
    stemmed = {r.term: (r.df, r.ttf) for r in corpus_stats(term_freqs(r1, stem=True)).collect()}
    assert stemmed == {"fred": (1, 1), "harri": (2, 2), "higg": (1, 1), "mari": (3, 3), "salli": (2, 2)}
    plain = {r.term for r in corpus_stats(term_freqs(r1)).collect()}
    assert plain == {"fred", "harry", "higgs", "mary", "sally"}
    lines = sorted(r.value for r in stats_lines(corpus_stats(term_freqs(r1))).collect())
    assert lines[0] == "fred 1 1"


def test_d2_d3_weights(spark):
    df = spark.createDataFrame([(2, 3), (3, 3)], "df long, n long")
    rows = df.select(*[idf_weight(c, F.col("df"), F.col("n")).alias(f"i{c}") for c in range(4)]).collect()
    assert rows[0].i0 == pytest.approx(1.0) and rows[0].i1 == pytest.approx(math.log(1.5))
    assert rows[0].i2 == pytest.approx(1.5) and rows[0].i3 == 1.0
    assert rows[1].i0 == pytest.approx(1 + math.log(0.75)) and rows[1].i1 == pytest.approx(0.0)
    t = spark.createDataFrame([(0, 1), (1, 1)], "tf long, m long").select(
        *[tf_weight(c, F.col("tf"), F.col("m")).alias(f"t{c}") for c in range(4)]).collect()
    assert [t[0].t0, t[0].t1, t[0].t2, t[0].t3] == [0.0, 0.0, 0.0, 0.5]
    assert [t[1].t0, t[1].t1, t[1].t3] == [1.0, 1.0, 1.0] and t[1].t2 == pytest.approx(math.log(2))


def test_q8_unknown_code_raises():
    with pytest.raises(ValueError):
        tf_weight(7, F.col("tf"), F.col("m"))
    with pytest.raises(ValueError):
        idf_weight(-1, F.col("df"), F.col("n"))


def test_d4_max_tf_before_filter(spark):
    doc = spark.createDataFrame([(0, "d0", "rare rare rare mary"), (1, "d1", "mary")], "doc_id bigint, path string, text string")
    tf = term_freqs(doc)
    vocab = vocabulary(corpus_stats(tf), min_df=2)
    w = tfidf(tf, vocab, corpus_size(doc), tf_calc=3, idf=3)
    got = {r.doc_id: r.w for r in w.collect()}
    assert got[0] == pytest.approx(0.5 + 0.5 * 1 / 3) and got[1] == pytest.approx(1.0)
    assert {r.doc_id: r.max_tf for r in max_tf(tf).collect()} == {0: 3, 1: 1}


def test_empty_docs_counted_but_dropped(spark):
    doc = spark.createDataFrame([(0, "a", "mary had"), (1, "b", ""), (2, "c", "the and of"), (3, "d", "mary")],
                                "doc_id bigint, path string, text string")
    cfg = TermVectConfig(min_df=2)
    tv = term_vectors(doc, cfg)
    assert tv.n_docs.first().n_docs == 4
    assert sorted(r.doc_id for r in dense_matrix(tv, cfg).collect()) == [0, 3]
    assert sorted(r.doc_id for r in dense_matrix(tv, cfg, on_empty="zero").collect()) == [0, 1, 2, 3]
    assert {r.doc_id: r.length for r in doc_length(tv.tf).collect()} == {0: 2, 3: 1}


def test_tokenizer_modes_and_possessive(spark):
    df = spark.createDataFrame([("John's U.S.A. costs 3,500.25 at O’Neil's 東京",)], "text string")
    simple = df.select(tokenize("text")).first()[0]
    assert simple[:3] == ["John", "s", "U"]
    words = df.select(analyze_tokens("text", mode="words")).first()[0]
    assert words == ["john", "u.s.a", "costs", "3,500.25", "o’neil", "東", "京"]


def test_stop_words_and_long_tokens(spark):
    df = spark.createDataFrame([("The cat AND the " + "x" * 256 + " hat",)], "text string")
    assert df.select(analyze_tokens("text")).first()[0] == ["cat", "x" * 256, "hat"]
    assert df.select(analyze_tokens("text", max_length=255)).first()[0] == ["cat", "hat"]


def test_porter_published_examples(spark):
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop",
             "filing": "file", "relational": "relat", "generalizations": "gener", "happy": "happi", "be": "be"}
    df = spark.createDataFrame([(w,) for w in cases], "w string")
    assert {r.w: r.s for r in df.select("w", porter_stem("w").alias("s")).collect()} == cases


def test_sweep_matches_single_settings(spark, r1):
    tf = term_freqs(r1)
    vocab = vocabulary(corpus_stats(tf), min_df=2)
    n = corpus_size(r1)
    sw = tfidf_sweep(tf, vocab, n, weighting_grid(spark))
    for t, i in [(0, 0), (3, 1), (2, 2)]:
        one = {(r.doc_id, r.term): r.w for r in tfidf(tf, vocab, n, t, i).collect()}
        many = {(r.doc_id, r.term): r.w for r in sw.filter(F.col("run_id") == f"tfCalc{t}idfCalc{i}").collect()}
        assert one.keys() == many.keys()
        assert all(one[k] == pytest.approx(many[k]) for k in one)


def test_filters(spark, r1):
    assert filter_paths(r1, "doc[12]").count() == 2
    a = [r.doc_id for r in sample_docs(r1, 2, seed=3).collect()]
    assert a == [r.doc_id for r in sample_docs(r1, 2, seed=3).collect()] and len(a) == 2
    stats = corpus_stats(term_freqs(r1))
    assert vocabulary(stats, min_df=1, max_df=2, exclude="h.*").count() == 2  # fred, sally


@pytest.mark.parametrize("tile,max_tiles", [(1, 100), (3, 100), (4, 0), (1024, 100)])
def test_dense_rows_by_tiles(spark, tile, max_tiles):
    base = [0.5 * i for i in range(10)]
    cells = {1: {0: 7.0, 1: 8.0, 9: -1.0}, 2: {2: 3.0, 3: 0.0, 5: 4.0}, 3: {}, 4: {i: -float(i) for i in range(10)}}
    got = densify(spark.createDataFrame([(d, t, w) for d, row in cells.items() for t, w in row.items()], "doc_id long, term_id long, w double"),
                  spark.createDataFrame(list(enumerate(base)), "term_id long, base double"),
                  spark.createDataFrame([(d,) for d in cells], "doc_id long"), tile=tile, max_tiles=max_tiles)
    assert got.columns == ["doc_id", "vec"]
    assert {r.doc_id: r.vec for r in got.collect()} == {d: [row.get(t, b) for t, b in enumerate(base)] for d, row in cells.items()}


def test_dense_rows_without_columns(spark):
    got = densify(spark.createDataFrame([], "doc_id long, term_id long, w double"), spark.createDataFrame([], "term_id long, base double"),
                  spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert sorted((r.doc_id, r.vec) for r in got.collect()) == [(1, []), (2, [])]
