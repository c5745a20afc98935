"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may differ by ``k = floor(error_rate * m)`` edits.  Cut into
``k + 1`` pieces, any text within ``k`` edits holds at least one piece unchanged.  All
pieces are searched at once with an Aho-Corasick automaton; around each hit, Myers'
bit-parallel distance finds the best end of the whole item.  Items below ``MIN_CHARS``
characters are found unchanged only, as whole words.

Items and texts are compared lower-cased, with every run of other characters than
letters and digits as one space.  Benchmarks are sent to the tasks in blocks of at most
``block_chars`` characters; a larger benchmark takes more passes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked

OTHER = re.compile(r"[\W_]+")
ERROR_RATE = 1 / 16
MIN_CHARS = 30


def normalise(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, each with its place in the item."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(edges[:-1], edges[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and the first end of such a part."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        d0 = (((eq & pv) + pv) ^ pv) | eq | mv
        hp = mv | (~(d0 | pv) & full)
        hn = pv & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        pv = hn | (~(d0 | hp) & full)
        mv = hp & d0
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, places = [], {}
        self.pad = int(any(len(text) < min_chars for _, text in items))  # spaces around a text, for words at its ends
        for item_id, text in items:
            short = len(text) < min_chars
            errors = 0 if short else int(error_rate * len(text))
            n = len(self.items)
            self.items.append((item_id, text, errors, short))
            for at, piece in [(-1, f" {text} ")] if short else pieces(text, errors):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """``(item_id, distance, start, end)`` of the best match of each item; the start is a lower bound."""
        starts: dict[int, set] = {}
        if self.any and text:
            for last, (size, where) in self.automaton.iter(f" {text} " if self.pad else text):
                for n, at in where:
                    starts.setdefault(n, set()).add(last + 1 - size - at - self.pad)
        found = []
        for n, places in starts.items():
            item_id, item, errors, short = self.items[n]
            if short:
                found.append((item_id, 0, min(places), min(places) + len(item)))
                continue
            best = None
            lo = hi = None
            for s in [*sorted(places), None]:  # hits whose windows meet are searched once
                if lo is not None and (s is None or s - errors > hi):
                    a = max(0, lo)
                    distance, end = myers(item, text[a:hi])
                    if distance <= errors and (best is None or distance < best[1]):
                        best = (item_id, distance, max(a, a + end - len(item) - errors), a + end)
                    lo = None
                if s is not None:
                    lo = s - errors if lo is None else lo
                    hi = s + len(item) + errors
            if best:
                found.append(best)
        return found


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()),
                                  T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(T.StringType())
def _normalised(texts: pa.Array) -> pa.Array:
    return pa.array([normalise(t.as_py()) for t in texts], pa.string())


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Lists of ``(item_id, normalised text)``; empty items are left out, repeated ones come once, ids may be null."""
    items = picked(benchmark, id_col, text_col).select("id", _normalised("text").alias("text")).filter("text <> ''").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // block_chars)
    for i in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()
        yield sorted(((r["id"], r["text"]) for r in block), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def with_matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "matches",
                 error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, item_id_col: str = "item_id",
                 item_text_col: str = "text", block_chars: int = 16_000_000) -> DataFrame:
    """``df`` with ``out_col``: array of ``(item_id, distance, start, end)``, positions in the normalised text.

    Null and empty texts match nothing, and an empty benchmark finds nothing.  Items below
    ``min_chars`` normalised characters match unchanged, between spaces or the text's ends;
    items without an id are found with a null ``item_id``.  Only items without any letter
    or digit are not searched for.
    """
    out = F.array().cast(MATCH)
    for items in item_blocks(benchmark, item_id_col, item_text_col, block_chars):
        out = F.concat(out, _finder(items, error_rate, min_chars)(F.col(f"`{text_col}`")))
    return df.withColumn(out_col, out)


def _finder(items, error_rate, min_chars):
    held = {}

    @F.arrow_udf(MATCH)
    def find(texts: pa.Array) -> pa.Array:
        if not held:  # once for each Python worker and query
            held["m"] = Matcher(items, error_rate, min_chars)
        found = [held["m"].find(normalise(t.as_py())) if t.is_valid else [] for t in texts]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "start", "end")]))
        return pa.array([[dict(zip(("item_id", "distance", "start", "end"), x)) for x in f] for f in found], kind)
    return find


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, item_id, distance, start, end)``: a row for each document and benchmark item found in it."""
    rows = with_matches(picked(df, id_col, text_col), benchmark, **options)
    return rows.select("id", F.explode("matches").alias("m")).select("id", "m.item_id", "m.distance", "m.start", "m.end")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item of ``benchmark``, over the whole of both tables."""
    read = spark.read.parquet
    out = contaminated(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op6_decontaminate": op6_decontaminate}
SQL = {}
