"""Helpers shared by the training-data operators.

Every operator picks the columns it needs by name and renames them at once, so extra
columns of the input, whatever they are called, never clash with internal names.  When
the caller wants whole rows back, they travel as one struct column named ``row``.
"""

from __future__ import annotations

import sys
import types
import uuid

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.util import track
from ..session import ensure_checkpoint_dir

#: The words of the contracts: maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def picked(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``(id bigint, text string)`` with null texts as empty, and ``row`` if asked for."""
    cols = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return df.select(*cols, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")) if carry else df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def unsigned_hash(*cols) -> Column:
    """A 62-bit non-negative hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def task_number() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def kept_in_worker(key, make):
    """``make()`` once for each Python worker: what a task learns, such as encoded pieces of text, serves the next one.

    Functions are sent to the workers by value, so their modules' globals last for one task only.
    """
    home = sys.modules.setdefault("_corpusmap_worker", types.ModuleType("_corpusmap_worker"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_folder(spark: SparkSession, kind: str, folder: str | None = None) -> str:
    """The URI of a folder that all executors share: ``folder``, or a new one in the checkpoint folder."""
    uri = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    uri = uri if "://" in uri else f"file://{uri}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path)
    return uri if folder else track(spark, uri)


def small(batches, rows: int = 1000):
    """The rows of Arrow batches, a few at a time, so that little of a batch is unpacked at once."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)
