"""The registered queries: one Spark builder and (where SQL can say it) one
DuckDB-runnable SQL string per operator of SURVEY §2.

Every query reads the given test tables (whole tables, whole texts).  Double
outputs are rounded to 6 places (``+ 0.0`` removes -0.0) on both sides so the
order-insensitive comparison is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, TOKEN_PATTERNS
from ..operators import terms as T
from ..operators import vocab as V
from ..operators import weighting as W
from ..sources.corpus import corpus_from_table
from .util import cut_lineage

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c):
    return (F.round(c, 6) + F.lit(0.0))


def documents(spark, sf_dir):
    return corpus_from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def postings(doc):
    """The analysed corpus materialised once, read by every later stage."""
    return cut_lineage(T.term_freqs(doc))


# ----------------------------------------------------------------- SQL fragments
_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
_TOKEN_RE = TOKEN_PATTERNS["simple"]

SQL_TERMS = f"""
  raw_tok AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKEN_RE}')) AS t FROM documents),
  tok AS (
    SELECT doc_id, lower(t) AS term FROM raw_tok),
  postings AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok
    WHERE term NOT IN ({_STOP}) AND length(term) > 0 GROUP BY doc_id, term),
  tfm AS (
    SELECT doc_id, term, tf, max(tf) OVER (PARTITION BY doc_id) AS max_tf FROM postings),
  stats AS (
    SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM postings GROUP BY term),
  ndocs AS (SELECT count(*)::BIGINT AS n_docs FROM documents)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _vocab_cte(where: str) -> str:
    return f"""
  vocab AS (
    SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, ttf FROM stats WHERE {where})"""


# ----------------------------------------------------------------- T1-T7
@register("t1_t2_term_freqs", _with(SQL_TERMS) + """
SELECT doc_id, term, tf, max_tf FROM tfm""")
def q_term_freqs(spark, sf_dir):
    return T.term_freqs(documents(spark, sf_dir))


@register("t3_t6_corpus_stats", _with(SQL_TERMS) + """
SELECT term, df, ttf FROM stats""")
def q_corpus_stats(spark, sf_dir):
    return T.corpus_stats(T.term_freqs(documents(spark, sf_dir)))


@register("t5_corpus_size", """SELECT count(*)::BIGINT AS n_docs FROM documents""")
def q_corpus_size(spark, sf_dir):
    return T.corpus_size(documents(spark, sf_dir))


@register("t7_doc_length", _with(SQL_TERMS) + """
SELECT doc_id, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS length FROM postings GROUP BY doc_id""")
def q_doc_length(spark, sf_dir):
    return T.doc_length(T.term_freqs(documents(spark, sf_dir)))


# ----------------------------------------------------------------- F1-F7
@register("f1_f5_vocabulary", _with(SQL_TERMS, _vocab_cte("df >= 2")) + """
SELECT term_id, term, df, ttf FROM vocab""")
def q_vocabulary(spark, sf_dir):
    tf = postings(documents(spark, sf_dir))
    return V.vocabulary(T.corpus_stats(tf), min_df=2).select("term_id", "term", "df", "ttf")


BAND_EXCLUDE = r"[0-9.,-]+"


@register("f2_f4_vocabulary_band", _with(
    SQL_TERMS, _vocab_cte(f"df >= 20 AND df <= 1000 AND NOT regexp_full_match(term, '{BAND_EXCLUDE}')")) + """
SELECT term_id, term, df, ttf FROM vocab""")
def q_vocabulary_band(spark, sf_dir):
    tf = T.term_freqs(documents(spark, sf_dir))
    return V.vocabulary(T.corpus_stats(tf), min_df=20, max_df=1000, exclude=BAND_EXCLUDE).select(
        "term_id", "term", "df", "ttf")


@register("f6_filter_paths", """
SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(fr|de)/[0-9]+')""")
def q_filter_paths(spark, sf_dir):
    return V.filter_paths(table(spark, sf_dir, "pages"), r"/(fr|de)/[0-9]+", col="url").select("page_id", "url")


@register("f7_sample_docs", """
SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 100""")
def q_sample_docs(spark, sf_dir):
    return V.sample_docs(table(spark, sf_dir, "documents"), 100, seed=7).select("doc_id", "lang")


# ----------------------------------------------------------------- W1-W11
def _tfidf_sql(tf_expr: str, idf_expr: str, where: str = "df >= 2") -> str:
    return _with(SQL_TERMS, _vocab_cte(where)) + f"""
SELECT t.doc_id, v.term_id, t.term,
       round(({tf_expr}) * ({idf_expr}), 6) + 0.0 AS w
FROM tfm t JOIN vocab v ON t.term = v.term CROSS JOIN ndocs"""


_TF_SQL = {0: "sqrt(t.tf)", 1: "t.tf::DOUBLE", 2: "ln(t.tf + 1.0)", 3: "0.5 + 0.5 * t.tf / t.max_tf"}
_IDF_SQL = {0: "1.0 + ln(n_docs / (v.df + 1.0))", 1: "ln(n_docs::DOUBLE / v.df)",
            2: "n_docs::DOUBLE / v.df", 3: "1.0"}


@register("w9_tfidf_default", _tfidf_sql(_TF_SQL[0], _IDF_SQL[0]))
def q_tfidf_default(spark, sf_dir):
    doc = documents(spark, sf_dir)
    tf = postings(doc)
    vocab = V.vocabulary(T.corpus_stats(tf), min_df=2)
    w = W.tfidf(tf, vocab, T.corpus_size(doc), tf_calc=0, idf=0)
    return w.select("doc_id", "term_id", "term", r6(F.col("w")).alias("w"))


_SWEEP_SQL = _with(SQL_TERMS, _vocab_cte(f"df >= 20 AND df <= 1000 AND NOT regexp_full_match(term, '{BAND_EXCLUDE}')"),
                   """
  params AS (
    SELECT 'tfCalc' || tc || 'idfCalc' || ic AS run_id, tc, ic
    FROM range(4) a(tc) CROSS JOIN range(4) b(ic))""") + f"""
SELECT p.run_id, t.doc_id, v.term_id, t.term,
       round((CASE p.tc WHEN 0 THEN {_TF_SQL[0]} WHEN 1 THEN {_TF_SQL[1]} WHEN 2 THEN {_TF_SQL[2]} ELSE {_TF_SQL[3]} END)
           * (CASE p.ic WHEN 0 THEN {_IDF_SQL[0]} WHEN 1 THEN {_IDF_SQL[1]} WHEN 2 THEN {_IDF_SQL[2]} ELSE {_IDF_SQL[3]} END), 6) + 0.0 AS w
FROM tfm t JOIN vocab v ON t.term = v.term CROSS JOIN ndocs CROSS JOIN params p"""


@register("w11_tfidf_sweep16", _SWEEP_SQL)
def q_tfidf_sweep(spark, sf_dir):
    doc = documents(spark, sf_dir)
    tf = postings(doc)
    vocab = V.vocabulary(T.corpus_stats(tf), min_df=20, max_df=1000, exclude=BAND_EXCLUDE)
    w = W.tfidf_sweep(tf, vocab, T.corpus_size(doc), W.weighting_grid(spark))
    return w.select("run_id", "doc_id", "term_id", "term", r6(F.col("w")).alias("w"))


for _t in range(4):
    for _i in range(4):
        def _mk(t=_t, i=_i):
            def q(spark, sf_dir):
                doc = documents(spark, sf_dir)
                tf = postings(doc)
                vocab = V.vocabulary(T.corpus_stats(tf), min_df=2)
                w = W.tfidf(tf, vocab, T.corpus_size(doc), tf_calc=t, idf=i)
                return w.select("doc_id", "term_id", "term", r6(F.col("w")).alias("w"))
            return q
        register(f"w_tf{_t}_idf{_i}", _tfidf_sql(_TF_SQL[_t], _IDF_SQL[_i]))(_mk())


# ----------------------------------------------------------------- points (embeddings)
from ..operators import affinity as N  # noqa: E402
from ..operators import distance as D  # noqa: E402
from ..operators import separation as C  # noqa: E402


def embeddings(spark, sf_dir):
    """Labelled points: ``(id, vec array<double>, label)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label").cast("string").alias("label"))


SQL_POINTS = """
  pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(label AS VARCHAR) AS label FROM embeddings)"""
SQL_PAIRS = """
  pairs AS (
    SELECT a.id AS src, b.id AS dst, a.label AS la, b.label AS lb,
           list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
    FROM pts a JOIN pts b ON a.id <> b.id)"""
SQL_KNN = """
  knn AS (
    SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank
    FROM pairs QUALIFY rank <= 18)"""


@register("c7_label_pair_sums", _with(SQL_POINTS, SQL_PAIRS) + """
SELECT least(la, lb) AS l1, greatest(la, lb) AS l2,
       round(sum(sqrt(d2)), 4) + 0.0 AS sum_dist, count(*)::BIGINT AS n_pairs
FROM pairs WHERE src < dst GROUP BY 1, 2""")
def q_label_pair_sums(spark, sf_dir):
    s = C.label_pair_sums(embeddings(spark, sf_dir), run_col=None)
    return s.select("l1", "l2", (F.round("sum_dist", 4) + F.lit(0.0)).alias("sum_dist"), "n_pairs")


_SQL_SEP = """
SELECT run_id, round(w, 6) + 0.0 AS within, round(b, 6) + 0.0 AS between, round(w / b, 6) + 0.0 AS ratio
FROM (SELECT run_id,
             sum(CASE WHEN la = lb THEN sqrt(d2) END) / count(CASE WHEN la = lb THEN 1 END) AS w,
             sum(CASE WHEN la < lb THEN sqrt(d2) END) / count(CASE WHEN la < lb THEN 1 END) AS b
      FROM runs GROUP BY run_id)"""


@register("c6_separation", _with(SQL_POINTS, SQL_PAIRS, """
  runs AS (SELECT 'default' AS run_id, * FROM pairs)""") + _SQL_SEP)
def q_separation(spark, sf_dir):
    s = C.separation(embeddings(spark, sf_dir), run_col=None)
    return s.select("run_id", r6(F.col("within")).alias("within"), r6(F.col("between")).alias("between"),
                    r6(F.col("ratio")).alias("ratio"))


@register("c8_separation_many_runs", _with("""
  pts AS (
    SELECT 'by_label' AS run_id, vec_id AS id, embedding::DOUBLE[] AS v, CAST(label AS VARCHAR) AS label FROM embeddings
    UNION ALL
    SELECT 'by_parity', vec_id, embedding::DOUBLE[], CAST(label % 2 AS VARCHAR) FROM embeddings)""", """
  runs AS (
    SELECT a.run_id, a.label AS la, b.label AS lb,
           list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
    FROM pts a JOIN pts b ON a.run_id = b.run_id AND a.id <> b.id)""") + _SQL_SEP)
def q_separation_runs(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    runs = e.withColumn("run_id", F.lit("by_label")).unionByName(
        e.withColumn("run_id", F.lit("by_parity")).withColumn("label", (F.col("label").cast("int") % 2).cast("string")))
    s = C.separation(runs)
    return s.select("run_id", r6(F.col("within")).alias("within"), r6(F.col("between")).alias("between"),
                    r6(F.col("ratio")).alias("ratio"))


@register("c6_separation_unique_labels", _with("""
  pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(vec_id // 2 AS VARCHAR) AS label FROM embeddings)""", SQL_PAIRS, """
  runs AS (SELECT 'default' AS run_id, * FROM pairs)""") + _SQL_SEP)
def q_separation_unique(spark, sf_dir):
    """C6 with a label for every two points: the work doesn't grow with the number of labels."""
    e = embeddings(spark, sf_dir).withColumn("label", F.floor(F.col("id") / 2).cast("string"))
    s = C.separation(e, run_col=None)
    return s.select("run_id", r6(F.col("within")).alias("within"), r6(F.col("between")).alias("between"),
                    r6(F.col("ratio")).alias("ratio"))


@register("v1_column_means", _with(SQL_POINTS) + """
SELECT pos, round(avg(x), 6) + 0.0 AS mean
FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM pts) GROUP BY pos""")
def q_column_means(spark, sf_dir):
    st = D.column_stats(embeddings(spark, sf_dir), run_col=None)
    return st.select(F.posexplode("mean").alias("pos", "mean")).select(
        F.col("pos").cast("long").alias("pos"), r6(F.col("mean")).alias("mean"))


@register("v2_max_scale", _with(SQL_POINTS) + """
SELECT round(greatest(0.0, max(mx - mean)), 6) + 0.0 AS max_x
FROM (SELECT pos, avg(x) AS mean, max(x) AS mx
      FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM pts) GROUP BY pos)""")
def q_max_scale(spark, sf_dir):
    st = D.column_stats(embeddings(spark, sf_dir), run_col=None)
    return st.select(r6(F.col("max_x")).alias("max_x"))


@register("n1_knn_k18", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN) + """
SELECT src, dst, rank::BIGINT AS rank, round(d2, 6) + 0.0 AS d2 FROM knn""")
def q_knn(spark, sf_dir):
    k = D.knn(embeddings(spark, sf_dir), 18, run_col=None)
    return k.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6(F.col("d2")).alias("d2"))


@register("n1_knn_duplicates", _with("""
  pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(label AS VARCHAR) AS label FROM embeddings
          UNION ALL
          SELECT vec_id + (1 + k) * 1000000, embedding::DOUBLE[], CAST(label AS VARCHAR)
          FROM embeddings CROSS JOIN range(0, 40) r(k) WHERE vec_id % 100 = 0)""", SQL_PAIRS, SQL_KNN) + """
SELECT src, dst, rank::BIGINT AS rank, round(d2, 6) + 0.0 AS d2 FROM knn""")
def q_knn_duplicates(spark, sf_dir):
    """N1 on the embeddings united with 40 copies of every hundredth: ties at the k-th place go to the smallest ids."""
    e = embeddings(spark, sf_dir)
    copies = e.filter("id % 100 = 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).select(
        (F.col("id") + F.col("k") * 1000000).alias("id"), "vec", "label")
    k = D.knn(e.unionByName(copies), 18, run_col=None)
    return k.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6(F.col("d2")).alias("d2"))


_SQL_SYM = """
  sym AS (
    SELECT src, dst, sum(v) / 2.0 AS p FROM (
      SELECT src, dst, d2 AS v FROM knn UNION ALL SELECT dst AS src, src AS dst, d2 AS v FROM knn)
    GROUP BY src, dst)"""


def _knn_graph(spark, sf_dir):
    return D.knn(embeddings(spark, sf_dir), 18, run_col=None).select("run_id", "src", "dst", F.col("d2").alias("p"))


@register("n5_symmetrize", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, _SQL_SYM) + """
SELECT src, dst, round(p, 6) + 0.0 AS p FROM sym""")
def q_symmetrize(spark, sf_dir):
    s = N.symmetrize(_knn_graph(spark, sf_dir))
    return s.select("src", "dst", r6(F.col("p")).alias("p"))


@register("n6_n7_symmetrize_sum_normalize", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, _SQL_SYM) + """
SELECT src, dst, round(1e6 * p / sum(p) OVER (), 6) + 0.0 AS p_ppm FROM sym""")
def q_normalize(spark, sf_dir):
    s = N.normalize(N.symmetrize(_knn_graph(spark, sf_dir), halve=False))
    return s.select("src", "dst", r6(F.lit(1e6) * F.col("p")).alias("p_ppm"))


@register("n8_sparsity", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, _SQL_SYM) + """
SELECT count(*)::BIGINT AS n_edges, round(count(*) / ((SELECT count(*) FROM pts)::DOUBLE ^ 2), 6) + 0.0 AS sparsity
FROM sym""")
def q_sparsity(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    s = N.symmetrize(_knn_graph(spark, sf_dir))
    n = e.agg(F.count(F.lit(1)).alias("n")).withColumn("run_id", F.lit("default"))
    return N.sparsity(s, n).select("n_edges", r6(F.col("sparsity")).alias("sparsity"))


@register("n2_calibrate_perp6", "WITH RECURSIVE " + ",".join([SQL_POINTS, SQL_PAIRS, SQL_KNN]) + """,
  scale AS (SELECT pow(greatest(0.0, max(mx - mean)), 2) AS s2
            FROM (SELECT avg(x) AS mean, max(x) AS mx
                  FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM pts) GROUP BY pos)),
  near AS (SELECT src, list(dst ORDER BY d2, dst) AS dsts, list(d2 / s2 ORDER BY d2, dst) AS ds FROM knn CROSS JOIN scale GROUP BY src),
  steps AS (
    SELECT src, ds, 0 AS step, 1.0::DOUBLE AS beta, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, false AS done, NULL::DOUBLE AS used FROM near
    UNION ALL
    SELECT src, ds, step + 1,
           CASE WHEN ok THEN beta WHEN diff > 0 THEN CASE WHEN hi IS NULL THEN beta * 2 ELSE (beta + hi) / 2 END
                ELSE CASE WHEN lo IS NULL THEN beta / 2 ELSE (beta + lo) / 2 END END,
           CASE WHEN NOT ok AND diff > 0 THEN beta ELSE lo END, CASE WHEN NOT ok AND NOT diff > 0 THEN beta ELSE hi END, ok, beta
    FROM (SELECT *, abs(diff) < 1e-5 AS ok
          FROM (SELECT *, beta * sd / s + ln(s) - ln(6.0) AS diff
                FROM (SELECT *, 2.2250738585072014e-308 + list_sum(list_transform(ds, lambda d: exp(-beta * d))) AS s,
                             list_sum(list_transform(ds, lambda d: d * exp(-beta * d))) AS sd
                      FROM steps WHERE NOT done AND step < 200)))),
  found AS (SELECT src, arg_max(used, step) AS beta FROM steps GROUP BY src),
  parts AS (SELECT n.src, unnest(n.dsts) AS dst, unnest(n.ds) AS d, f.beta FROM near n JOIN found f ON f.src = n.src)
SELECT src, dst, round(exp(-beta * d) / sum(exp(-beta * d)) OVER (PARTITION BY src), 6) + 0.0 AS p FROM parts""")
def q_calibrate(spark, sf_dir):
    """N2 (+N9 guard): perplexity-6 affinities on the 18-NN graph of max-scaled embeddings."""
    e = embeddings(spark, sf_dir)
    n = e.count()
    N.check_perplexity(n, 6.0)
    st = D.column_stats(e, run_col=None).first()
    k = D.knn(e, N.neighbours_for(6.0), run_col=None)
    return N.calibrate(k, perplexity=6.0, scale2=float(st.max_x) ** 2).select("src", "dst", r6(F.col("p")).alias("p"))


# ----------------------------------------------------------------- layout pieces on a data-derived map
from ..operators import layout as L  # noqa: E402
from ..operators.blocks import choose_blocks  # noqa: E402
from . import sweep as X  # noqa: E402


def embedding_map(spark, sf_dir):
    """A 2-D state derived from the table: position and velocity are projections of all 64 embedding values, gains 1 or 2."""
    e = table(spark, sf_dir, "embeddings")

    def project(period, of, times):
        part = F.filter(F.transform(F.col("embedding"), lambda x, i: F.when(i % period == of, x.cast("double"))), lambda x: x.isNotNull())
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) * F.lit(times)
    return e.select(F.lit("default").alias("run_id"), F.col("vec_id").alias("id"),
                    project(2, 0, 4.0).alias("y0"), project(2, 1, 4.0).alias("y1"),
                    project(3, 0, 1.0).alias("u0"), project(3, 1, 1.0).alias("u1"),
                    (F.col("vec_id") % 2 + 1).cast("double").alias("g0"), (F.col("vec_id") % 3 * 0.01).cast("double").alias("g1"))


def knn_edges(spark, sf_dir):
    """Edges of the 18-NN graph of the embeddings with p = exp(-d2)."""
    return D.knn(embeddings(spark, sf_dir), 18, run_col=None).select(
        "run_id", "src", "dst", F.exp(-F.col("d2")).alias("p"))


SQL_MAP = """
  lay AS (SELECT vec_id AS id,
                 4.0 * list_sum(list_transform(range(0, 32), lambda k: embedding[2 * k + 1]::DOUBLE)) AS y0,
                 4.0 * list_sum(list_transform(range(0, 32), lambda k: embedding[2 * k + 2]::DOUBLE)) AS y1,
                 list_sum(list_transform(range(0, 22), lambda k: embedding[3 * k + 1]::DOUBLE)) AS u0,
                 list_sum(list_transform(range(0, 21), lambda k: embedding[3 * k + 2]::DOUBLE)) AS u1,
                 (vec_id % 2 + 1)::DOUBLE AS k0, (vec_id % 3 * 0.01)::DOUBLE AS k1 FROM embeddings),
  qq AS (SELECT a.id, a.y0 - b.y0 AS dx, a.y1 - b.y1 AS dy,
                1.0 / (1.0 + (a.y0 - b.y0) ^ 2 + (a.y1 - b.y1) ^ 2) AS q
         FROM lay a JOIN lay b ON a.id <> b.id),
  rep AS (SELECT id, sum(q * q * dx) AS r0, sum(q * q * dy) AS r1 FROM qq GROUP BY id),
  zz AS (SELECT sum(q) AS z FROM qq)"""
SQL_EDGES = """
  edges AS (SELECT src, dst, exp(-d2) AS p FROM knn),
  att AS (
    SELECT e.src AS id,
           sum(e.p / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2) * (s.y0 - t.y0)) AS a0,
           sum(e.p / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2) * (s.y1 - t.y1)) AS a1
    FROM edges e JOIN lay s ON s.id = e.src JOIN lay t ON t.id = e.dst GROUP BY e.src)"""


def _exact_pass(spark, sf_dir, with_edges=True):
    state = embedding_map(spark, sf_dir)
    edges = knn_edges(spark, sf_dir) if with_edges else spark.createDataFrame(
        [], "run_id string, src long, dst long, p double")
    nb = choose_blocks(state.count())
    return state, L.sum_forces(L.exact_forces(state, L.edges_by_block(edges, nb), nb))


@register("l2_attractive_forces", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, SQL_MAP, SQL_EDGES) + """
SELECT id, round(a0, 6) + 0.0 AS a0, round(a1, 6) + 0.0 AS a1 FROM att""")
def q_attractive(spark, sf_dir):
    a = L.attractive_forces(embedding_map(spark, sf_dir), knn_edges(spark, sf_dir))
    return a.select("id", r6(F.col("a0")).alias("a0"), r6(F.col("a1")).alias("a1"))


@register("l3_exact_repulsion", _with(SQL_MAP) + """
SELECT id, round(r0, 6) + 0.0 AS r0, round(r1, 6) + 0.0 AS r1 FROM rep""")
def q_repulsion(spark, sf_dir):
    _, (per_point, _) = _exact_pass(spark, sf_dir, with_edges=False)
    return per_point.select("id", r6(F.col("r0")).alias("r0"), r6(F.col("r1")).alias("r1"))


@register("l3_normaliser_z", _with(SQL_MAP) + """
SELECT round(z, 4) + 0.0 AS z FROM zz""")
def q_normaliser(spark, sf_dir):
    _, (_, z) = _exact_pass(spark, sf_dir, with_edges=False)
    return z.select((F.round("Z", 4) + F.lit(0.0)).alias("z"))


@register("l2_l3_fused_block_pass", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, SQL_MAP, SQL_EDGES) + """
SELECT r.id, round(coalesce(a.a0, 0.0), 6) + 0.0 AS a0, round(coalesce(a.a1, 0.0), 6) + 0.0 AS a1,
       round(r.r0, 6) + 0.0 AS r0, round(r.r1, 6) + 0.0 AS r1
FROM rep r LEFT JOIN att a ON a.id = r.id""")
def q_fused(spark, sf_dir):
    _, (per_point, _) = _exact_pass(spark, sf_dir)
    return per_point.select("id", *[r6(F.col(c)).alias(c) for c in ("a0", "a1", "r0", "r1")])


@register("l9_l11_gradient_step", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, SQL_MAP, SQL_EDGES, """
  grad AS (
    SELECT r.id, l.y0, l.y1, l.u0, l.u1, l.k0, l.k1,
           12.0 * coalesce(a.a0, 0.0) - r.r0 / (SELECT z FROM zz) AS g0,
           12.0 * coalesce(a.a1, 0.0) - r.r1 / (SELECT z FROM zz) AS g1
    FROM rep r JOIN lay l ON l.id = r.id LEFT JOIN att a ON a.id = r.id),
  gains AS (
    SELECT id, y0, y1, u0, u1, g0, g1,
           greatest(CASE WHEN sign(g0) <> sign(u0) THEN k0 + 0.2::DOUBLE ELSE k0 * 0.8::DOUBLE END, 0.01::DOUBLE) AS k0,
           greatest(CASE WHEN sign(g1) <> sign(u1) THEN k1 + 0.2::DOUBLE ELSE k1 * 0.8::DOUBLE END, 0.01::DOUBLE) AS k1
    FROM grad)""") + """
SELECT id, round(y0 + 0.5 * u0 - 200.0 * k0 * g0, 6) + 0.0 AS y0, round(y1 + 0.5 * u1 - 200.0 * k1 * g1, 6) + 0.0 AS y1,
       round(0.5 * u0 - 200.0 * k0 * g0, 6) + 0.0 AS u0, round(0.5 * u1 - 200.0 * k1 * g1, 6) + 0.0 AS u1,
       round(k0, 6) + 0.0 AS g0, round(k1, 6) + 0.0 AS g1
FROM gains""")
def q_step(spark, sf_dir):
    state, (per_point, z) = _exact_pass(spark, sf_dir)
    new = L.gradient_step(state, per_point, z, L.exaggeration_at(0), L.momentum_at(0))
    return new.select("id", *[r6(F.col(c)).alias(c) for c in ("y0", "y1", "u0", "u1", "g0", "g1")])


@register("l12_recenter", _with(SQL_MAP) + """
SELECT id, round(y0 - avg(y0) OVER (), 6) + 0.0 AS y0, round(y1 - avg(y1) OVER (), 6) + 0.0 AS y1 FROM lay""")
def q_recenter(spark, sf_dir):
    s = L.recenter(embedding_map(spark, sf_dir))
    return s.select("id", r6(F.col("y0")).alias("y0"), r6(F.col("y1")).alias("y1"))


@register("l14_kl_cost", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, SQL_MAP, """
  edges AS (SELECT src, dst, exp(-d2) AS p FROM knn)""") + """
SELECT round(sum(e.p * ln((e.p + 1e-9) /
             ((1.0 / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2)) / (SELECT z FROM zz) + 1e-9))), 6) + 0.0 AS cost
FROM edges e JOIN lay s ON s.id = e.src JOIN lay t ON t.id = e.dst""")
def q_kl(spark, sf_dir):
    state, (_, z) = _exact_pass(spark, sf_dir, with_edges=False)
    c = L.kl_cost(state, knn_edges(spark, sf_dir), z)
    return c.select(r6(F.col("cost")).alias("cost"))


@register("l4_bounding_cell", _with(SQL_MAP) + """
SELECT round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy,
       round(greatest(mx0 - cx, cx - mn0) + 1e-5, 6) + 0.0 AS hw,
       round(greatest(mx1 - cy, cy - mn1) + 1e-5, 6) + 0.0 AS hh
FROM (SELECT avg(y0) AS cx, avg(y1) AS cy, min(y0) AS mn0, max(y0) AS mx0, min(y1) AS mn1, max(y1) AS mx1 FROM lay)""")
def q_box(spark, sf_dir):
    b = L.bounding_cell(embedding_map(spark, sf_dir))
    return b.select(*[r6(F.col(c)).alias(c) for c in ("cx", "cy", "hw", "hh")])


# a cell with two different places is split, on and on; DuckDB walks down one level at a time
_SQL_PYRAMID = "WITH RECURSIVE " + SQL_MAP + """,
  box AS (SELECT avg(y0) AS cx, avg(y1) AS cy,
                 greatest(max(y0) - avg(y0), avg(y0) - min(y0)) + 1e-5 AS hw,
                 greatest(max(y1) - avg(y1), avg(y1) - min(y1)) + 1e-5 AS hh FROM lay),
  rel AS (SELECT p.id, p.y0, p.y1, (p.y0 - (b.cx - b.hw)) / (2.0 * b.hw) AS rx, (p.y1 - (b.cy - b.hh)) / (2.0 * b.hh) AS ry
          FROM lay p CROSS JOIN box b),
  bins AS (
    SELECT 0 AS level, id, y0, y1, rx, ry, 0::BIGINT AS ix, 0::BIGINT AS iy FROM rel
    UNION ALL
    SELECT level + 1, id, y0, y1, rx, ry,
           least(greatest(floor(rx * pow(2.0, level + 1)), 0), pow(2.0, level + 1) - 1)::BIGINT,
           least(greatest(floor(ry * pow(2.0, level + 1)), 0), pow(2.0, level + 1) - 1)::BIGINT
    FROM (SELECT *, max(y0) OVER w > min(y0) OVER w OR max(y1) OVER w > min(y1) OVER w AS many
          FROM bins WINDOW w AS (PARTITION BY level, ix, iy)) WHERE many AND level < 59),
  cells AS (SELECT level, ix, iy, count(*)::BIGINT AS n, avg(y0) AS m0, avg(y1) AS m1,
                   NOT (max(y0) > min(y0) OR max(y1) > min(y1)) AS leaf FROM bins GROUP BY 1, 2, 3)"""


@register("l5_l6_cell_pyramid", _SQL_PYRAMID + """
SELECT level::INTEGER AS level, ix, iy, n, round(m0, 6) + 0.0 AS m0, round(m1, 6) + 0.0 AS m1, leaf FROM cells""")
def q_pyramid(spark, sf_dir):
    c = L.cell_pyramid(embedding_map(spark, sf_dir))
    return c.select("level", "ix", "iy", "n", r6(F.col("m0")).alias("m0"), r6(F.col("m1")).alias("m1"), "leaf")


@register("l7_pyramid_depth", _SQL_PYRAMID + """
SELECT (max(level) + 1)::INTEGER AS depth FROM cells""")
def q_depth(spark, sf_dir):
    return L.pyramid_depth(L.cell_pyramid(embedding_map(spark, sf_dir))).select(F.col("depth").cast("int").alias("depth"))


@register("l8_barnes_hut_repulsion", _SQL_PYRAMID + """,
  walk AS (
    SELECT r.id, r.y0, r.y1, r.rx, r.ry, c.level, c.ix, c.iy, c.n, c.m0, c.m1, c.leaf,
           c.leaf OR greatest(b.hw, b.hh) / pow(2.0, c.level) < 0.5 * sqrt((r.y0 - c.m0) ^ 2 + (r.y1 - c.m1) ^ 2) AS done
    FROM rel r JOIN cells c ON c.level = 0 CROSS JOIN box b
    UNION ALL
    SELECT w.id, w.y0, w.y1, w.rx, w.ry, c.level, c.ix, c.iy, c.n, c.m0, c.m1, c.leaf,
           c.leaf OR greatest(b.hw, b.hh) / pow(2.0, c.level) < 0.5 * sqrt((w.y0 - c.m0) ^ 2 + (w.y1 - c.m1) ^ 2)
    FROM walk w JOIN cells c ON c.level = w.level + 1 AND c.ix // 2 = w.ix AND c.iy // 2 = w.iy CROSS JOIN box b
    WHERE NOT w.done),
  hits AS (
    SELECT id, y0 - m0 AS dx, y1 - m1 AS dy,
           n - CASE WHEN leaf AND least(greatest(floor(rx * pow(2.0, level)), 0), pow(2.0, level) - 1)::BIGINT = ix
                         AND least(greatest(floor(ry * pow(2.0, level)), 0), pow(2.0, level) - 1)::BIGINT = iy
                    THEN 1 ELSE 0 END AS k,
           1.0 / (1.0 + (y0 - m0) ^ 2 + (y1 - m1) ^ 2) AS q
    FROM walk WHERE done)
SELECT id, round(sum(k * q * q * dx), 6) + 0.0 AS r0, round(sum(k * q * q * dy), 6) + 0.0 AS r1,
       round((SELECT sum(k * q) FROM hits), 4) + 0.0 AS z
FROM hits GROUP BY id""")
def q_bh(spark, sf_dir):
    """Barnes-Hut repulsion (theta 0.5) on the data-derived map."""
    state = embedding_map(spark, sf_dir)
    box = L.bounding_cell(state)
    rep, z = L.bh_forces(state, cut_lineage(L.cell_pyramid(state, box)), 0.5, box)
    return rep.join(z, "run_id").select("id", r6(F.col("r0")).alias("r0"), r6(F.col("r1")).alias("r1"),
                                        (F.round("Z", 4) + F.lit(0.0)).alias("z"))


@register("l15_kl_cost_edges", _with(SQL_POINTS, SQL_PAIRS, SQL_KNN, SQL_MAP, """
  edges AS (SELECT src, dst, exp(-d2) AS p FROM knn)""") + """
SELECT round(sum(e.p * ln((e.p + 1.17549435e-38) /
             ((1.0 / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2)) / (SELECT z FROM zz) + 1.17549435e-38))), 6) + 0.0 AS cost
FROM edges e JOIN lay s ON s.id = e.src JOIN lay t ON t.id = e.dst""")
def q_kl_edges(spark, sf_dir):
    state, (_, z) = _exact_pass(spark, sf_dir, with_edges=False)
    c = L.kl_cost(state, knn_edges(spark, sf_dir), z, eps=L.FLT_MIN)
    return c.select(r6(F.col("cost")).alias("cost"))


def _three_steps_sql() -> str:
    """Three optimiser iterations from the data-derived state, each from the tables of the one before."""
    ctes = [SQL_POINTS, SQL_PAIRS, SQL_KNN, """
  e0 AS (SELECT src, dst, exp(-d2) AS v FROM knn),
  two AS (SELECT src, dst, v FROM e0 UNION ALL SELECT dst, src, v FROM e0),
  sym AS (SELECT src, dst, sum(v) / 2.0 AS v FROM two GROUP BY src, dst),
  edges AS (SELECT src, dst, v / (SELECT sum(v) FROM sym) AS p FROM sym)""", SQL_MAP.split("  qq AS")[0].rstrip().rstrip(","), """
  s0 AS (SELECT id, y0, y1, u0, u1, k0, k1 FROM lay)"""]
    for i in range(3):
        ctes.append(f"""
  q{i} AS (SELECT a.id, a.y0 - b.y0 AS dx, a.y1 - b.y1 AS dy, 1.0 / (1.0 + (a.y0 - b.y0) ^ 2 + (a.y1 - b.y1) ^ 2) AS q
           FROM s{i} a JOIN s{i} b ON a.id <> b.id),
  r{i} AS (SELECT id, sum(q * q * dx) AS r0, sum(q * q * dy) AS r1 FROM q{i} GROUP BY id),
  a{i} AS (SELECT e.src AS id, sum(e.p * (s.y0 - t.y0) / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2)) AS a0,
                  sum(e.p * (s.y1 - t.y1) / (1.0 + (s.y0 - t.y0) ^ 2 + (s.y1 - t.y1) ^ 2)) AS a1
           FROM edges e JOIN s{i} s ON s.id = e.src JOIN s{i} t ON t.id = e.dst GROUP BY e.src),
  g{i} AS (SELECT s.*, 12.0 * coalesce(a0, 0.0) - r0 / (SELECT sum(q) FROM q{i}) AS g0,
                  12.0 * coalesce(a1, 0.0) - r1 / (SELECT sum(q) FROM q{i}) AS g1
           FROM s{i} s JOIN r{i} USING (id) LEFT JOIN a{i} USING (id)),
  n{i} AS (SELECT id, y0, y1, u0, u1, g0, g1,
                  greatest(CASE WHEN sign(g0) <> sign(u0) THEN k0 + 0.2::DOUBLE ELSE k0 * 0.8::DOUBLE END, 0.01::DOUBLE) AS k0,
                  greatest(CASE WHEN sign(g1) <> sign(u1) THEN k1 + 0.2::DOUBLE ELSE k1 * 0.8::DOUBLE END, 0.01::DOUBLE) AS k1 FROM g{i}),
  s{i + 1} AS (SELECT id, y0 + 0.5 * u0 - 200.0 * k0 * g0 AS y0, y1 + 0.5 * u1 - 200.0 * k1 * g1 AS y1,
                      0.5 * u0 - 200.0 * k0 * g0 AS u0, 0.5 * u1 - 200.0 * k1 * g1 AS u1, k0, k1 FROM n{i})""")
    return _with(*ctes) + """
SELECT id, round(y0 - avg(y0) OVER (), 4) + 0.0 AS y0, round(y1 - avg(y1) OVER (), 4) + 0.0 AS y1 FROM s3"""


@register("l17_three_iterations", _three_steps_sql())
def q_three_iterations(spark, sf_dir):
    """Three iterations of the optimiser on a given graph from a given start."""
    from .tsne import TsneConfig, tsne
    edges = N.normalize(N.symmetrize(knn_edges(spark, sf_dir)))
    layout, _ = tsne(cfg=TsneConfig(max_iter=3, method="exact", eval_every=100), edges=edges, init=embedding_map(spark, sf_dir))
    return layout.select("id", (F.round("y0", 4) + F.lit(0.0)).alias("y0"), (F.round("y1", 4) + F.lit(0.0)).alias("y1"))


@register("l1_l17_tsne_layout")
def q_tsne(spark, sf_dir):
    """T-SNE as the reference runs it by default (1,000 iterations, Barnes-Hut, perplexity 6) on the embeddings
    from the seeded start (no SQL)."""
    from .tsne import TsneConfig, tsne
    layout, _ = tsne(embeddings(spark, sf_dir), TsneConfig(), run_col=None)
    return layout


# ----------------------------------------------------------------- experiment operators
@register("x1_label_from_path", """
SELECT page_id, split_part(url, '/', 4) AS label FROM pages""")
def q_label_from_path(spark, sf_dir):
    return X.label_from_path(table(spark, sf_dir, "pages"), 4, col="url").select("page_id", "label")


@register("x2_attach_labels", _with(SQL_MAP) + """
SELECT l.id, CAST(e.label AS VARCHAR) AS label, round(l.y0, 6) + 0.0 AS y0, round(l.y1, 6) + 0.0 AS y1
FROM lay l JOIN embeddings e ON e.vec_id = l.id""")
def q_attach(spark, sf_dir):
    lay = embedding_map(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"),
                                                      F.col("label").cast("string").alias("label"))
    out = X.attach_labels(lay, labels)
    return out.select("id", "label", r6(F.col("y0")).alias("y0"), r6(F.col("y1")).alias("y1"))


# ----------------------------------------------------------------- dense matrix, sweep
PLAIN = dict(mode="simple", stem=False)  # the plain analysis
_DENSE_SQL = _with(SQL_TERMS, _vocab_cte(f"df >= 20 AND df <= 1000 AND NOT regexp_full_match(term, '{BAND_EXCLUDE}')"), """
  docs AS (SELECT DISTINCT doc_id, max_tf FROM tfm),
  cells AS (
    SELECT d.doc_id, v.term_id, (0.5 + 0.5 * coalesce(t.tf, 0) / d.max_tf) * (1.0 + ln(n_docs / (v.df + 1.0))) AS w
    FROM docs d CROSS JOIN vocab v CROSS JOIN ndocs LEFT JOIN tfm t ON t.doc_id = d.doc_id AND t.term = v.term)""")


def _dense(spark, sf_dir):
    from .termvect import TermVectConfig, dense_matrix, term_vectors
    cfg = TermVectConfig(min_df=20, max_df=1000, exclude=BAND_EXCLUDE, tf_calc=3, idf_calc=0, **PLAIN)
    return dense_matrix(term_vectors(documents(spark, sf_dir), cfg), cfg, digits=6)


@register("w10_k1_dense_matrix", _DENSE_SQL + """
SELECT doc_id AS _key, string_agg((round(w, 6))::VARCHAR, ' ' ORDER BY term_id) AS value FROM cells GROUP BY doc_id
UNION ALL SELECT -1, (SELECT count(*) FROM docs)::VARCHAR || ' ' || (SELECT count(*) FROM vocab)::VARCHAR""")
def q_dense(spark, sf_dir):
    """W10 + K1: dense tf-3 × idf-0 rows (absent terms take 0.5·idf) as matrix text lines."""
    from ..sources.sinks import matrix_lines
    return matrix_lines(_dense(spark, sf_dir))


@register("x3_x4_sweep_4x4x4")
def q_sweep(spark, sf_dir):
    """The reference's whole experiment, 4 tf × 4 idf × 4 perplexities with 500 iterations, docs labelled by lang."""
    doc = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    result, _ = X.sweep(doc, labels, X.grid(spark))
    return result


from . import registered_more, registered_pairs, registered_text  # noqa: E402,F401
