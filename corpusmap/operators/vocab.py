"""Vocabulary and corpus filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.util import cut_lineage, dense_ids


def term_predicate(min_df: int = 2, max_df: int | None = None, exclude: str | None = None) -> Column:
    """F1 ∧ F2 ∧ F3 as one conjunction (cheap df tests first, then the regex).

    ``exclude`` drops terms the pattern matches in full (anchored at both ends).
    """
    pred = F.col("df") >= F.lit(int(min_df))
    if max_df is not None:
        pred = pred & (F.col("df") <= F.lit(int(max_df)))
    if exclude:
        pred = pred & ~F.col("term").rlike("^(?:" + exclude + r")\z")
    return pred


def vocabulary(stats: DataFrame, min_df: int = 2, max_df: int | None = None,
               exclude: str | None = None, with_ids: bool = True) -> DataFrame:
    """surviving terms; ``term_id`` = position in lexical (UTF-8 byte) order."""
    vocab = stats.filter(term_predicate(min_df, max_df, exclude))
    if with_ids:
        # materialise the (small) surviving terms once, so ranking never re-runs the analysis
        vocab = dense_ids(cut_lineage(vocab), "term", "term_id")
    return vocab


def filter_paths(doc: DataFrame, pattern: str, col: str = "path") -> DataFrame:
    """keep rows whose ``col`` matches ``pattern`` anywhere (find semantics)."""
    return doc.filter(F.col(col).rlike(pattern))


def sample_docs(doc: DataFrame, n: int, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """a reproducible shuffled sample of ``n`` docs.

    Order is ``md5("<id>:<seed>")`` (independent of partitioning and
    portable to other engines), ties by id; Spark plans ``orderBy().limit()``
    as a distributed top-k (``TakeOrderedAndProject``).
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{int(seed)}")))
    return doc.orderBy(key, F.col(id_col)).limit(int(n))
