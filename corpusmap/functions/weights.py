"""tf and idf formulas as Column expressions.

Codes follow the reference's numbering; an unknown code raises instead of
silently meaning 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TF_CODES = {0: "sqrt", 1: "raw", 2: "log", 3: "augmented"}
IDF_CODES = {0: "smooth log + 1", 1: "log", 2: "ratio", 3: "none"}


def check_code(code: int, table: dict, what: str) -> int:
    if int(code) not in table:
        raise ValueError(f"unknown {what} code {code!r}; expected one of {sorted(table)}")
    return int(code)


def tf_weight(code: int, tf: Column, max_tf: Column) -> Column:
    """W1-W4 for one fixed code."""
    code = check_code(code, TF_CODES, "tf")
    tf = tf.cast("double")
    if code == 1:
        return tf
    if code == 2:
        return F.log(tf + F.lit(1.0))
    if code == 3:
        return F.lit(0.5) + F.lit(0.5) * tf / max_tf.cast("double")
    return F.sqrt(tf)


def idf_weight(code: int, df: Column, n_docs: Column) -> Column:
    """W5-W8 for one fixed code."""
    code = check_code(code, IDF_CODES, "idf")
    n = n_docs.cast("double")
    d = df.cast("double")
    if code == 1:
        return F.log(n / d)
    if code == 2:
        return n / d
    if code == 3:
        return F.lit(1.0)
    return F.lit(1.0) + F.log(n / (d + F.lit(1.0)))


def tf_weight_by_code(code: Column, tf: Column, max_tf: Column) -> Column:
    """W1-W4 chosen per row by an integer code column (W11 sweep)."""
    out = None
    for c in sorted(TF_CODES):
        branch = tf_weight(c, tf, max_tf)
        out = F.when(code == c, branch) if out is None else out.when(code == c, branch)
    return out


def idf_weight_by_code(code: Column, df: Column, n_docs: Column) -> Column:
    """W5-W8 chosen per row by an integer code column (W11 sweep)."""
    out = None
    for c in sorted(IDF_CODES):
        branch = idf_weight(c, df, n_docs)
        out = F.when(code == c, branch) if out is None else out.when(code == c, branch)
    return out


def absent_tf_weight(code: Column | int) -> Column:
    """Weight factor of a vocabulary term *absent* from a doc: 0.5 for tf code 3, else 0."""
    if isinstance(code, int):
        check_code(code, TF_CODES, "tf")
        return F.lit(0.5 if code == 3 else 0.0)
    return F.when(code == 3, F.lit(0.5)).otherwise(F.lit(0.0))
