"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 counts how many rows set each bit of a blocked Bloom filter and keeps the bits
set at least twice; copies set the same bits, so every copy finds all of its bits there.
The counts are the only thing that shuffles (partial sums per bit and task).  Pass 2
tests each row against those bits: rows with a bit set once are unique and pass straight
through; only the others shuffle, as ``(id, digest)`` rows, to be grouped exactly.

The filter holds at most ``max_filter_mb`` whatever the input, which is what makes its
broadcast safe.  Past that size more unique rows are taken for repeated ones and are
grouped like copies; the result stays the same.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.util import cut_lineage
from .common import picked

BLOCK_BITS = 32768  # of bitmap_construct_agg
BLOCK_BYTES = BLOCK_BITS // 8


def _bits(h):
    """Two bit positions inside the row's block, from a second hash of the row's hash."""
    g = F.xxhash64(h)
    return [F.shiftrightunsigned(g, s).bitwiseAND(F.lit(BLOCK_BITS - 1)) for s in (0, 15)]


def _bit_set(bitmap, pos):
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(pos, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, pos.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """``(block, bitmap)``: the filter bits that at least two rows of ``rows(h)`` set."""
    p1, p2 = _bits(F.col("h"))
    hits = rows.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(p1, p2))).alias("pos"))
    return (hits.groupBy("block", "pos").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
            .groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bitmap")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16,
                max_filter_mb: int = 64, carry: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256`` (and ``row`` with ``carry``).

    Rows with identical text form a group (null counts as empty text); the row with the
    largest id stays, a null id being the smallest.  Where that id and text are repeated,
    one of the repeated rows stays.  ``keep_id`` is null only for a group without any id.
    An empty table gives an empty result.  Texts are compared by their SHA-256.
    """
    base = picked(df, id_col, text_col, carry).withColumn("h", F.xxhash64("text"))
    n = df.count()
    blocks = max(1, min(math.ceil(n * bits_per_row / BLOCK_BITS), max_filter_mb * (1 << 20) // BLOCK_BYTES))
    bits = cut_lineage(repeated_bits(base.select("h"), blocks))
    p1, p2 = _bits(F.col("h"))
    tested = base.withColumn("block", F.pmod("h", F.lit(blocks))).join(F.broadcast(bits), "block", "left")
    tested = tested.withColumn("maybe", F.col("bitmap").isNotNull() & _bit_set(F.col("bitmap"), p1)
                               & _bit_set(F.col("bitmap"), p2))
    extra = ["row"] if carry else []
    sha = F.sha2("text", 256).alias("text_sha256")
    alone = tested.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, *extra)
    some = cut_lineage(tested.filter("maybe").select("id", F.monotonically_increasing_id().alias("rid"), sha, *extra))
    groups = cut_lineage(some.groupBy("text_sha256").agg(
        F.max(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    together = some.join(groups, "text_sha256").select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256", *extra)
    return alone.unionByName(together)


def op3_exact_dedup(spark, sf_dir):
    """Exact dedup of the whole of ``documents``."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("id", "doc_id")


SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
