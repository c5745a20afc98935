"""Registered queries of sources, sinks, the sparse path and the experiment operators.

Each calls the library's own function; what it writes goes to a new folder in the
session's checkpoint folder and is read back.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import distance as D
from ..operators import terms as T
from ..session import ensure_checkpoint_dir
from ..sources import corpus as S
from ..sources import files as R
from ..sources import sinks as K
from . import sweep as X
from .registered import (BAND_EXCLUDE, PLAIN, SQL_MAP, SQL_POINTS, SQL_TERMS, _DENSE_SQL, _IDF_SQL, _TF_SQL, _dense, _vocab_cte, _with,
                         documents, embedding_map, embeddings, postings, r6, register, table)
from .termvect import TermVectConfig
from .util import cut_lineage, shared_folder, temporary_tables


def folder(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ----------------------------------------------------------------- sources and the index
@register("s3_lenient_utf8", """
SELECT doc_id, md5(replace(coalesce(text, ''), chr(65533), '')) AS digest FROM documents""")
def q_lenient(spark, sf_dir):
    """S3: a malformed byte after every text is dropped, the rest is kept."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.unhex(F.lit("FE")))
    return d.select("doc_id", F.md5(S.lenient_utf8(raw)).alias("digest"))


@register("s4_s5_stored_field", """
SELECT page_id AS doc_id, url AS path FROM pages""")
def q_field(spark, sf_dir):
    return S.doc_field(S.corpus_from_table(table(spark, sf_dir, "pages"), "page_id", "html", "url"), "path")


@register("s9_reopened_index", _with(SQL_TERMS) + """
SELECT term, df, ttf FROM stats""")
def q_index(spark, sf_dir):
    """Corpus statistics of an index that was written and opened again."""
    doc, path = documents(spark, sf_dir), folder(spark, "index")
    S.build_index(doc, T.term_freqs(doc), path)
    _, tf = S.open_index(spark, path)
    return T.corpus_stats(tf)


# ----------------------------------------------------------------- sinks, read back
@register("k1_s6_matrix_round_trip", _DENSE_SQL + """
SELECT dense_rank() OVER (ORDER BY doc_id) - 1 AS id, count(*)::BIGINT AS width, round(sum(round(w, 6)::DECIMAL(18, 6)), 3)::DOUBLE AS total
FROM cells GROUP BY doc_id""")
def q_matrix(spark, sf_dir):
    """The matrix as text in several parts, read back in order."""
    path = folder(spark, "matrix")
    K.write_matrix(_dense(spark, sf_dir), path, ordered=True)
    # exact sums: sums of doubles depend on their order, which DuckDB doesn't fix
    total = F.aggregate("vec", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x.cast("decimal(18,6)")).cast("decimal(38,6)"))
    return R.read_matrix(spark, path).select("id", F.size("vec").cast("long").alias("width"), F.round(total, 3).cast("double").alias("total"))


@register("k2_paths_in_order", """
SELECT row_number() OVER (ORDER BY page_id) - 1 AS line_no, url AS line FROM pages""")
def q_paths(spark, sf_dir):
    path = folder(spark, "paths")
    K.write_paths(S.corpus_from_table(table(spark, sf_dir, "pages"), "page_id", "html", "url"), path)
    return R.ordered_lines(spark, path).select("line_no", "line")


@register("k3_statistics_lines", _with(SQL_TERMS) + """
SELECT row_number() OVER (ORDER BY term) - 1 AS line_no, term || ' ' || df || ' ' || ttf AS line FROM stats""")
def q_stats_lines(spark, sf_dir):
    path = folder(spark, "stats")
    K.write_stats(T.corpus_stats(T.term_freqs(documents(spark, sf_dir))), path)
    return R.ordered_lines(spark, path).select("line_no", "line")


@register("k4_layout_lines", _with(SQL_MAP) + """
SELECT row_number() OVER (ORDER BY id) + 1 AS line_no, format('{:.6f} {:.6f}', round(y0, 3), round(y1, 3)) AS line FROM lay
UNION ALL SELECT 0, count(*)::VARCHAR FROM lay UNION ALL SELECT 1, '2'""")
def q_layout_lines(spark, sf_dir):
    path = folder(spark, "layout")
    K.write_layout(embedding_map(spark, sf_dir).withColumn("y0", F.round("y0", 3)).withColumn("y1", F.round("y1", 3)), path)
    return R.ordered_lines(spark, path).select("line_no", "line")


@register("s7_k6_labelled_points", _with(SQL_MAP) + """
SELECT CAST(e.label AS VARCHAR) AS label, count(*)::BIGINT AS n, round(sum(round(y0, 3)), 3) + 0.0 AS s0, round(sum(round(y1, 3)), 3) + 0.0 AS s1
FROM lay l JOIN embeddings e ON e.vec_id = l.id GROUP BY 1""")
def q_labelled(spark, sf_dir):
    """K6 then S7: points partitioned by label as text, read back as labelled points."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"))
    lay = X.attach_labels(embedding_map(spark, sf_dir), e).withColumn("y0", F.round("y0", 3)).withColumn("y1", F.round("y1", 3))
    path, lines = folder(spark, "by-label"), folder(spark, "labelled")
    K.write_by_label(lay, path)
    spark.read.text(path).select(F.concat_ws(" ", "value", F.col("label").cast("string")).alias("value")).write.text(lines)
    p = R.read_labelled_points(spark, lines)
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("vec")[0]), 3) + F.lit(0.0)).alias("s0"),
                                  (F.round(F.sum(F.col("vec")[1]), 3) + F.lit(0.0)).alias("s1"))


# ----------------------------------------------------------------- text
@register("a1_words_resplit", """
SELECT doc_id, lower(t) AS term, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+')) AS t FROM documents)
GROUP BY 1, 2""")
def q_words_resplit(spark, sf_dir):
    """A1 ``words``: its tokens, cut at the characters that may join, are the plain runs of word characters."""
    d = documents(spark, sf_dir)
    parts = F.flatten(F.transform(tokenize("text", "words"), lambda t: F.split(t, "['’.:·,;]")))
    return d.select("doc_id", F.explode(parts).alias("t")).groupBy("doc_id", F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@register("a5_stem_join_regroup", _with(SQL_TERMS, """
  stemmed AS (SELECT doc_id, regexp_replace(term, 's$', '') AS term, sum(tf)::BIGINT AS tf FROM postings GROUP BY 1, 2)""") + """
SELECT doc_id, term, tf, max(tf) OVER (PARTITION BY doc_id) AS max_tf FROM stemmed""")
def q_stem_flow(spark, sf_dir):
    """A5's flow (distinct words stemmed once, joined back, counted again) with a stemmer that SQL can state."""
    return T.term_freqs(documents(spark, sf_dir), stem=lambda w: F.regexp_replace(w, r"s\z", ""))


# ----------------------------------------------------------------- points
@register("v1_centred_scaled", _with(SQL_POINTS, """
  cells AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM pts),
  cols AS (SELECT pos, avg(x) AS mean, max(x) AS mx FROM cells GROUP BY pos)""") + """
SELECT id, c.pos, round((x - mean) / (SELECT max(mx - mean) FROM cols), 6) + 0.0 AS x FROM cells c JOIN cols USING (pos)""")
def q_center(spark, sf_dir):
    c = D.center(embeddings(spark, sf_dir), run_col=None, scale=True)
    return c.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("x"))


@register("v4_squared_distance", _with(SQL_POINTS) + """
SELECT a.id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) + 0.0 AS d2
FROM pts a JOIN pts b ON b.id = a.id + 1""")
def q_squared(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return e.join(nxt, "id").select("id", r6(D.sq_euclidean(F.col("vec"), F.col("other"))).alias("d2"))


# ----------------------------------------------------------------- the sparse path: tf 0 and tf 3 (absent terms weigh 0.5·idf)
_SPARSE_SQL = _with(SQL_TERMS, _vocab_cte(f"df >= 20 AND df <= 1000 AND NOT regexp_full_match(term, '{BAND_EXCLUDE}')"), f"""
  runs AS (SELECT * FROM (VALUES ('tfCalc0idfCalc0', 0), ('tfCalc3idfCalc0', 3)) r(run_id, tc)),
  docs AS (SELECT DISTINCT doc_id FROM tfm),
  w AS (
    SELECT r.run_id, t.doc_id, v.term_id,
           (CASE r.tc WHEN 0 THEN {_TF_SQL[0]} ELSE {_TF_SQL[3]} END) * ({_IDF_SQL[0]}) AS w,
           CASE r.tc WHEN 0 THEN 0.0 ELSE 0.5 * ({_IDF_SQL[0]}) END AS base
    FROM tfm t JOIN vocab v ON v.term = t.term CROSS JOIN ndocs CROSS JOIN runs r)""")


def _sparse(spark, sf_dir):
    doc = documents(spark, sf_dir)
    settings = spark.createDataFrame([("tfCalc0idfCalc0", 0, 0), ("tfCalc3idfCalc0", 3, 0)], "run_id string, tf_calc int, idf_calc int")
    return X.sweep_matrices(doc, postings(doc), settings, X.SWEEP_MIN_DF, X.SWEEP_MAX_DF, X.SWEEP_EXCLUDE)


@register("v2_max_scale_tfidf", _SPARSE_SQL + """,
  n AS (SELECT count(*) AS n FROM docs),
  cols AS (SELECT run_id, term_id, sum(w) AS s, max(w) AS mx, count(*) AS nnz, max(base) AS base FROM w GROUP BY 1, 2)
SELECT run_id, round(max(CASE WHEN nnz < n THEN greatest(mx, base) ELSE mx END - (s + (n - nnz) * base) / n), 6) + 0.0 AS max_x
FROM cols CROSS JOIN n GROUP BY run_id""")
def q_sparse_scale(spark, sf_dir):
    weights, base, docs = _sparse(spark, sf_dir)
    n = docs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return D.sparse_max_scale(weights, base, n).select("run_id", r6(F.col("max_x")).alias("max_x"))


@register("n1_knn_tfidf", _SPARSE_SQL + """,
  delta AS (SELECT run_id, doc_id, term_id, w - base AS x FROM w),
  norms AS (SELECT r.run_id, d.doc_id, coalesce(sum(x * x), 0.0) AS nn FROM docs d CROSS JOIN runs r
            LEFT JOIN delta USING (run_id, doc_id) GROUP BY 1, 2),
  dots AS (SELECT a.run_id, a.doc_id AS src, b.doc_id AS dst, sum(a.x * b.x) AS dot
           FROM delta a JOIN delta b ON a.run_id = b.run_id AND a.term_id = b.term_id AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3),
  dist AS (SELECT a.run_id, a.doc_id AS src, b.doc_id AS dst, greatest(a.nn + b.nn - 2.0 * coalesce(dot, 0.0), 0.0) AS d2
           FROM norms a JOIN norms b ON a.run_id = b.run_id AND a.doc_id <> b.doc_id
           LEFT JOIN dots d ON d.run_id = a.run_id AND d.src = a.doc_id AND d.dst = b.doc_id),
  best AS (SELECT run_id, src, round(d2, 4) + 0.0 AS d2, row_number() OVER (PARTITION BY run_id, src ORDER BY d2) AS rank FROM dist)
SELECT run_id, src, rank::BIGINT AS rank, d2 FROM best WHERE rank <= 18""")
def q_sparse_knn(spark, sf_dir):
    """N1 on sparse tf-idf rows: the distances of the 18 nearest (ties make the partners ambiguous across engines)."""
    with temporary_tables() as made:  # the index and the weights go as soon as there are rows
        rows = made.keep(cut_lineage(D.sparse_rows(*_sparse(spark, sf_dir))))
    k = D.knn_sparse(rows, 18)
    return k.select("run_id", "src", F.col("rank").cast("long").alias("rank"), (F.round("d2", 4) + F.lit(0.0)).alias("d2"))


# ----------------------------------------------------------------- experiment results (a stand-in: one score per embedding dimension)
_RESULT_SQL = """WITH score AS (
    SELECT pos, avg(abs(x)) AS r FROM (SELECT unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY pos),
  result AS (SELECT (pos // 16)::INTEGER AS tf_calc, (pos // 4 % 4)::INTEGER AS idf_calc, [6.0, 3.0, 1.0, 30.0][pos % 4 + 1]::DOUBLE AS perplexity,
                    round(r, 6) AS dist_ratio FROM score)"""


def _results(spark, sf_dir):
    """``result`` rows written as text and read by the results source."""
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    s = e.groupBy("pos").agg(F.round(F.avg(F.abs(F.col("x").cast("double"))), 6).alias("r"))
    perp = F.element_at(F.array(*[F.lit(p) for p in X.PERPLEXITIES]), (F.col("pos") % 4 + 1).cast("int"))
    line = F.concat_ws(" ", F.floor(F.col("pos") / 16), F.floor(F.col("pos") / 4) % 4, perp, "r")
    path = folder(spark, "results")
    s.select(line.alias("value")).write.text(path)
    return R.read_results(spark, path)


def _result_columns(df):
    return df.select("tf_calc", "idf_calc", r6(F.col("perplexity")).alias("perplexity"), r6(F.col("dist_ratio")).alias("dist_ratio"))


@register("s8_x8_rescaled_results", _RESULT_SQL + """
SELECT tf_calc, idf_calc, round((perplexity - 1.0) / (29.0 / 3.0), 6) + 0.0 AS perplexity, dist_ratio FROM result""")
def q_rescaled(spark, sf_dir):
    return _result_columns(X.rescale_perplexity(_results(spark, sf_dir)))


@register("x6_best_setting", _RESULT_SQL + """
SELECT tf_calc, idf_calc, perplexity, dist_ratio FROM result WHERE dist_ratio = (SELECT min(dist_ratio) FROM result)""")
def q_best(spark, sf_dir):
    return _result_columns(X.best(_results(spark, sf_dir)))


@register("x7_sensitivity", _RESULT_SQL + """,
  b AS (SELECT * FROM result ORDER BY dist_ratio, tf_calc, idf_calc, perplexity LIMIT 1)
SELECT 'tf_calc' AS param, r.tf_calc::DOUBLE AS x, r.dist_ratio FROM result r JOIN b ON r.idf_calc = b.idf_calc AND r.perplexity = b.perplexity
UNION ALL SELECT 'idf_calc', r.idf_calc, r.dist_ratio FROM result r JOIN b ON r.tf_calc = b.tf_calc AND r.perplexity = b.perplexity
UNION ALL SELECT 'perplexity', r.perplexity, r.dist_ratio FROM result r JOIN b ON r.tf_calc = b.tf_calc AND r.idf_calc = b.idf_calc""")
def q_sensitivity(spark, sf_dir):
    return X.sensitivity(_results(spark, sf_dir))


@register("k5_x3_x5_named_scores", _RESULT_SQL + """
SELECT tf_calc, idf_calc, perplexity, dist_ratio FROM result""")
def q_named(spark, sf_dir):
    """X3 names every setting, K5 writes ``name ratio`` lines, X5 reads the parameters back from the names."""
    named = _results(spark, sf_dir).join(X.grid(spark), ["tf_calc", "idf_calc", "perplexity"])
    path = folder(spark, "scores")
    K.write_scores(named.select("run_id", F.col("dist_ratio").alias("ratio")), path)
    lines = spark.read.text(path).select(F.split_part("value", F.lit(" "), F.lit(1)).alias("run_id"),
                                         F.split_part("value", F.lit(" "), F.lit(2)).cast("double").alias("dist_ratio"))
    return _result_columns(X.parse_run_name(lines))


@register("x9_plot_series", _with(SQL_MAP) + """
SELECT 'default' AS run_id, CAST(e.label AS VARCHAR) AS label, round(y0, 6) + 0.0 AS x, round(y1, 6) + 0.0 AS y
FROM lay l JOIN embeddings e ON e.vec_id = l.id""")
def q_plot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"))
    p = X.plot_frame(X.attach_labels(embedding_map(spark, sf_dir), e))
    return p.select("run_id", "label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


# ------------------------------------------------------------------------- S1, S2
def _as_files(spark, sf_dir):
    """``documents`` as one text file each, written by the tasks: the folder and ``(doc_id, uri)``."""
    root = shared_folder(spark, "corpus")

    def write(batches):
        for b in batches:
            uris = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                uris.append(f"{root}/{i % 16:02d}/{i:019d}.txt")
                fs, path = pafs.FileSystem.from_uri(uris[-1])
                fs.create_dir(path.rsplit("/", 1)[0])
                with fs.open_output_stream(path) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(uris, pa.string())], names=["doc_id", "uri"])

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return root, cut_lineage(rows.mapInArrow(write, "doc_id long, uri string"))


_SQL_FILES = "SELECT (row_number() OVER (ORDER BY {order})) - 1 AS doc_id, doc_id AS file, md5(replace(coalesce(text, ''), chr(65533), '')) AS text_md5 FROM documents"


def _files_read(df):
    return df.select("doc_id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("file"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("s1_corpus_folder", _SQL_FILES.format(order="doc_id % 16, doc_id"))
def q_s1(spark, sf_dir):
    """``documents`` as text files in folders, read back by their folder; ids are ranks of the paths."""
    return _files_read(S.read_corpus_dir(spark, _as_files(spark, sf_dir)[0], suffix=".txt"))


@register("s2_corpus_list", _SQL_FILES.format(order="doc_id DESC"))
def q_s2(spark, sf_dir):
    """The same files named in a list, which runs backwards; ids are places in the list."""
    root, files = _as_files(spark, sf_dir)
    files.orderBy(F.desc("doc_id")).select("uri").write.text(f"{root}/list")
    return _files_read(S.read_corpus_list(spark, f"{root}/list"))
