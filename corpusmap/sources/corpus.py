"""Corpus sources.

A corpus is ``doc(doc_id bigint, path string, text string)``.  Ids are
explicit: every later stage joins on ``doc_id`` instead of relying on line
position.
"""

from __future__ import annotations

import os
import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.util import cut_lineage, dense_ids

DOC_SCHEMA = "doc_id bigint, path string, text string"


def lenient_utf8(content) -> F.Column:
    """S3: bytes -> string, malformed or unmappable bytes dropped (a real U+FFFD is dropped too)."""
    return F.replace(F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str)
                                       else content.cast("string")), F.lit("�"), F.lit(""))


def to_uri(path: str, base: str) -> str:
    """``path`` as a URI: ``file:`` forms are made alike, relative paths are taken from ``base``."""
    if path.startswith("file:"):
        return "file:///" + path[len("file:"):].lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return path
    return "file://" + quote(os.path.normpath(os.path.join(base, path)))


def _children(batches):
    """The entries of each folder, listed by the executors."""
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            where = uri[:len(uri) - len(quote(path))]  # scheme and host
            found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            yield pa.RecordBatch.from_pydict({
                "uri": pa.array([where + quote(f.path) for f in found], pa.string()),
                "path": pa.array([where.removeprefix("file://") + f.path for f in found], pa.string()), "name": pa.array([f.base_name for f in found], pa.string()),
                "folder": pa.array([f.type == pafs.FileType.Directory for f in found], pa.bool_())})


def list_files(spark: SparkSession, root: str, suffix: str = "", skip_hidden: bool = True) -> DataFrame:
    """``(uri, path)`` of all regular files under ``root``, one listing job per level of folders.

    ``skip_hidden`` leaves out files and folders whose name begins with a dot; no other
    name is special.  A missing root has no files.
    """
    level = spark.createDataFrame([(to_uri(root.rstrip("/"), os.getcwd()),)], "uri string")
    files = spark.createDataFrame([], "uri string, path string")
    while True:
        found = level.repartition(max(1, spark.sparkContext.defaultParallelism), "uri").mapInArrow(
            _children, "uri string, path string, name string, folder boolean")
        if skip_hidden:
            found = found.filter(~F.col("name").startswith("."))
        found = cut_lineage(found)
        files = files.unionByName(found.filter(~F.col("folder") & F.col("name").endswith(suffix)).select("uri", "path"))
        level = found.filter("folder").select("uri")
        if not level.limit(1).count():
            return files


def _contents(batches):
    for b in batches:
        for doc_id, path, uri in zip(*(c.to_pylist() for c in b.columns)):
            fs, name = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(name, compression=None) as f:  # a file that is not there raises
                content = f.read()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "path": [path], "content": pa.array([content], pa.binary())})


def _read_files(files: DataFrame) -> DataFrame:
    """Documents of ``files(doc_id, path, uri)``; opened by the executors, so no name rule of Spark's file source applies."""
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "doc_id")
    raw = spread.select("doc_id", "path", "uri").mapInArrow(_contents, "doc_id long, path string, content binary")
    return raw.select("doc_id", "path", lenient_utf8("content").alias("text"))


def read_corpus_dir(spark: SparkSession, root: str, suffix: str = "", skip_hidden: bool = True) -> DataFrame:
    """Every regular file under ``root`` whose name ends with ``suffix``; see :func:`list_files`.

    ``doc_id`` is the rank of the path, so ids are stable across runs.
    """
    return _read_files(dense_ids(cut_lineage(list_files(spark, root, suffix, skip_hidden)), "path", "doc_id"))


def read_corpus_list(spark: SparkSession, list_path: str, base: str | None = None) -> DataFrame:
    """Files named one per line in ``list_path``; ``doc_id`` = line order, ``path`` = the line.

    Lines may be absolute or relative paths (from ``base``, default: the working folder)
    or URIs.  A listed file that can't be read raises; one listed twice is read twice.
    """
    from .files import ordered_lines

    base = base or os.getcwd()
    lines = ordered_lines(spark, list_path)
    uri = F.udf(lambda p: to_uri(p, base), "string")  # short strings, once per file
    return _read_files(lines.select(F.col("line_no").alias("doc_id"), F.col("line").alias("path"), uri("line").alias("uri")))


def read_corpus(spark: SparkSession, doc_dir: str | None = None, doc_list: str | None = None, suffix: str = "",
                skip_hidden: bool = True) -> DataFrame:
    """The list if there is one, else the folder."""
    if doc_list:
        return read_corpus_list(spark, doc_list)
    if doc_dir:
        return read_corpus_dir(spark, doc_dir, suffix, skip_hidden)
    raise ValueError("doc_dir or doc_list is needed")


def corpus_from_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      path_col: str | None = None) -> DataFrame:
    """Any table with an id and a text column as a corpus."""
    path = F.col(path_col).cast("string") if path_col else F.col(id_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def doc_field(doc: DataFrame, field: str, doc_id: int | None = None) -> DataFrame:
    """Value of one stored field, for one doc or (``doc_id=None``) all docs."""
    out = doc.select("doc_id", F.col(field).alias(field))
    return out if doc_id is None else out.filter(F.col("doc_id") == F.lit(int(doc_id)))


def build_index(doc: DataFrame, tf: DataFrame, path: str) -> None:
    """Persist the analysed corpus as two Parquet tables (``doc`` and ``tf``), overwriting."""
    doc.select("doc_id", "path").write.mode("overwrite").parquet(path.rstrip("/") + "/doc")
    tf.write.mode("overwrite").parquet(path.rstrip("/") + "/tf")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read back ``(doc, tf)`` written by :func:`build_index`."""
    base = path.rstrip("/")
    return spark.read.parquet(base + "/doc"), spark.read.parquet(base + "/tf")
