"""Term statistics.

``term_freqs`` is the index-building step: documents -> (doc_id, term, tf,
max_tf).  Without stemming it needs **no shuffle**: a document is one row, so
its tokens are sorted and run-length counted inside the row and then
exploded.  ``max_tf`` (T2) is taken over all of the doc's terms, before any
vocabulary filter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import porter_stem
from ..functions.text import ENGLISH_STOP_WORDS, analyze_tokens, run_counts, run_ends
from ..plans.util import bounded_broadcast, cut_lineage

ROWS_PER_TASK = 500_000  # postings that a task counts again after stemming
MAX_PARTITIONS = 20_000  # of the plan only


def _row_term_counts(doc: DataFrame, id_col: str, text_col: str, mode: str, possessive: bool,
                     stop_words, max_length) -> DataFrame:
    d = doc.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    d = d.select("doc_id", F.sort_array(analyze_tokens("_text", mode=mode, possessive=possessive,
                                                       stop_words=stop_words, max_length=max_length)).alias("_tok"))
    d = d.withColumn("_end", run_ends(F.col("_tok")))
    d = d.select("doc_id", run_counts(F.col("_tok"), F.col("_end")).alias("_runs"))
    d = d.withColumn("max_tf", F.array_max(F.transform("_runs", lambda r: r["tf"])))
    # explode_outer + explicit null filter: a plain explode makes the optimizer
    # infer ``size(_runs) > 0`` and push it below the projections, inlining the
    # sorted array into every lambda call (quadratic per document).
    return (d.select("doc_id", "max_tf", F.explode_outer("_runs").alias("_r"))
            .filter(F.col("_r").isNotNull())
            .select("doc_id", F.col("_r.term").alias("term"), F.col("_r.tf").alias("tf"), "max_tf"))


def stem_table(words: DataFrame, word_col: str = "word", stemmer=porter_stem) -> DataFrame:
    """(word, term): A5 applied once per distinct word (in the JVM)."""
    return words.select(F.col(word_col).alias("word")).distinct().select("word", stemmer(F.col("word")).alias("term"))


def term_freqs(doc: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "simple",
               possessive: bool = True, stop_words=ENGLISH_STOP_WORDS, stem=False, max_length: int | None = None) -> DataFrame:
    """T1+T2: (doc_id, term, tf, max_tf); docs without terms have no rows.

    With ``stem=True`` (or a column function of your own) the documents are
    tokenised once and written, the distinct words are stemmed once (A5), joined
    back (broadcast only when the checked word table is small) and re-counted per
    doc; that path shuffles the postings once, by ``doc_id`` only, so the
    per-doc ``max_tf`` window reuses the same partitioning.  The number of its partitions
    goes with the counted postings (ROWS_PER_TASK), so a task's memory doesn't grow with the corpus.
    """
    tf = _row_term_counts(doc, id_col, text_col, mode, possessive, stop_words, max_length)
    if not stem:
        return tf
    tf = cut_lineage(tf.select("doc_id", F.col("term").alias("word"), "tf"))
    words = cut_lineage(stem_table(tf, stemmer=stem if callable(stem) else porter_stem))
    words, _ = bounded_broadcast(words)
    cores = tf.sparkSession.sparkContext.defaultParallelism
    parts = min(MAX_PARTITIONS, max(cores, math.ceil(tf.count() / ROWS_PER_TASK)))  # a count of a table
    stemmed = (tf.join(words, "word")
               .repartition(parts, "doc_id")
               .groupBy("doc_id", "term").agg(F.sum("tf").cast("long").alias("tf")))
    return stemmed.withColumn("max_tf", F.max("tf").over(Window.partitionBy("doc_id")))


def corpus_stats(tf: DataFrame) -> DataFrame:
    """T3+T4+T6: (term, df, ttf) before any term filter (partial/final aggregate)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("ttf"))


def corpus_size(doc: DataFrame) -> DataFrame:
    """T5: one-row frame ``n_docs``; counts documents without terms too."""
    return doc.agg(F.count(F.lit(1)).alias("n_docs"))


def max_tf(tf: DataFrame) -> DataFrame:
    """T2 as its own frame: (doc_id, max_tf) over all terms of the doc."""
    return tf.groupBy("doc_id").agg(F.max("tf").alias("max_tf"))


def doc_length(tf: DataFrame) -> DataFrame:
    """(doc_id, n_terms distinct, length = total tf)."""
    return tf.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"),
                                    F.sum("tf").cast("long").alias("length"))
