"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: every source gets its weight's share of the words still to be given; sources
above their cap (``max_epochs`` times their size) are clamped to it and the excess is
shared again by weight among the rest, until none is above.  Each round is one
aggregation over the table of sources; only its sums reach the driver.

Sampling: a source whose target is ``f`` times its size takes every document ``floor(f)``
times and a seeded part of its documents once more.  That part is cut where the
documents, in the order of a seeded hash, reach the missing words: first the large
documents at their share, then the small ones for the rest.  Each cut is found by three rounds of a 1,024-way histogram of the hash per source, so no source, however
large, is ever sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.util import cut_lineage, dense_ids
from .common import word_count

LEVELS, LEVEL_BITS = 3, 10
HASH_BITS = LEVELS * LEVEL_BITS
LARGE = 0.01  # a document of at least this part of the missing words is a large one


def source_key(source: Column) -> Column:
    """A key that sorts by code point with null last, and that joins null to null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source.cast("string")))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources(key, ...)`` with ``rank``: 0-based place of the key, null ('n') after all others ('k...')."""
    return dense_ids(sources, "key", "rank")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``target`` for each row of ``sources(key, source_size, weight)``.

    Weights must be positive.  When all caps together are below ``total``, every source
    is at its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, left = 0.0, float(total)
    while True:  # each round clamps at least one more source, or is the last
        free = sources.filter(cap > F.lit(level) * F.col("weight"))
        got = sources.filter(cap <= F.lit(level) * F.col("weight")).agg(F.sum(cap)).first()[0] or 0.0
        weight = free.agg(F.sum("weight")).first()[0]
        if not weight:
            break
        rise = (left - float(got)) / float(weight)
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, cut, short)``: documents of ``docs(key, u, size)`` with ``u < cut`` come nearest to the
    words ``want`` of ``wanted(key, want)``; ``short`` is what they leave missing (negative: too many)."""
    state = wanted.select("key", F.lit(0).cast("long").alias("base"), "want")
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = docs.join(state, "key").filter(F.shiftright("u", shift + LEVEL_BITS) == F.shiftright("base", shift + LEVEL_BITS))
        hist = inside.groupBy("key", "want", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").alias("words"))
        # at most 1,024 cells for a source
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
        last = F.col("cell") == F.max("cell").over(Window.partitionBy("key"))
        hist = hist.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).withColumn("last", last)
        hit = hist.filter((F.col("upto") > F.col("want")) | F.col("last"))
        state = cut_lineage(hit.groupBy("key").agg(F.min_by(F.struct("cell", "want", "before", "words"), "cell").alias("s")).select(
            "key", F.shiftleft("s.cell", shift).alias("base"), (F.col("s.want") - F.col("s.before")).alias("want"),
            F.col("s.words").alias("words")))
        if level < LEVELS - 1:
            state = state.drop("words")
    # what is left shares one hash value: a document, which is taken if that comes nearer
    taken = F.col("want") * 2 >= F.col("words")
    return state.select("key", (F.col("base") + F.when(taken, 1).otherwise(0)).alias("cut"),
                        (F.col("want") - F.when(taken, F.col("words")).otherwise(0)).alias("short"))


def mix(df: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_epochs: int = 3, share: float = 1.0, seed: int = 7, carry: bool = False) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, repeats, taken`` (and ``row`` with ``carry``).

    ``weights`` maps a source's place in code point order (null last) to a positive weight
    as a Column function.  ``size`` counts words (null text: 0); ``taken`` is
    ``repeats * size`` with ``repeats <= max_epochs``.  Documents without words take part
    like others and change no sum; a source of such documents alone has target 0 and no
    repeats.  Rows that repeat id and text are taken together.  The same input and seed
    give the same result.  An empty table gives an empty result.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                     source_key(F.col(source_col)).alias("key"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []))
    u = F.shiftrightunsigned(F.xxhash64("id", F.xxhash64("text"), F.lit(int(seed))), 64 - HASH_BITS)
    docs = base.withColumn("size", word_count(F.col("text"))).withColumn("u", u).drop("text")
    docs = cut_lineage(docs)
    sources = docs.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = cut_lineage(_ranked(sources).withColumn("weight", weights(F.col("rank")).cast("double")))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    filled = water_fill(ranked, total, max_epochs)
    size = F.col("source_size").cast("double")
    filled = filled.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    filled = cut_lineage(filled.withColumn("more", F.col("target") - F.col("whole") * size))
    # large documents first, at their share, then small ones for all that is still missing
    split = filled.select("key", "source_size", "target", "whole", "more",
                          F.ceil(F.col("more") * LARGE).cast("long").alias("large"))
    parts = docs.join(split.select("key", "large"), "key").withColumn("is_large", F.col("size") >= F.col("large"))
    large = parts.filter("is_large").select("key", "u", "size")
    share_large = large.groupBy("key").agg(F.sum("size").alias("words")).join(split, "key").filter("words > 0").select(
        "key", (F.col("more") * F.col("words") / F.col("source_size")).alias("want"), "words")
    share_large = cut_lineage(share_large)
    cut1 = cut_lineage(_cut(large, share_large.select("key", "want")))
    taken1 = share_large.join(cut1, "key").select("key", (F.col("want") - F.col("short")).alias("given"), F.col("cut").alias("cut_large"))
    plan = cut_lineage(split.join(taken1, "key", "left").withColumn(
        "want", F.col("more") - F.coalesce("given", F.lit(0.0))))
    small = parts.filter(~F.col("is_large")).select("key", "u", "size")
    cut2 = _cut(small, plan.filter("want > 0").select("key", "want"))
    plan = cut_lineage(plan.join(cut2.select("key", F.col("cut").alias("cut_small")), "key", "left").select(
        "key", "source_size", "target", "whole", "more", "large", "cut_large", "cut_small"))
    cut = F.when(F.col("size") >= F.col("large"), F.col("cut_large")).otherwise(F.col("cut_small"))
    again = (F.col("more") > 0) & (F.col("u") < F.coalesce(cut, F.lit(0)))
    repeats = F.least(F.col("whole") + F.when(again, 1).otherwise(0), F.lit(int(max_epochs))).cast("long")
    out = docs.join(plan, "key").withColumn("repeats", repeats)
    return out.select("id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "repeats",
                      (F.col("repeats") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def repeating(*values: float):
    """Weights that repeat along the places: ``repeating(5, 2, 1)``."""
    return lambda rank: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def op7_mix_sources(spark, sf_dir):
    """Mix the whole of ``documents`` at weights 5, 2, 1, up to 3 epochs."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeating(5, 2, 1))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}
SQL = {}
