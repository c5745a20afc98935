"""Plan-level helpers shared by the operators: size-checked broadcast,
lineage cuts and dense ids."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

# Default row bound below which a derived side table may be broadcast.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The check is a bounded count (``limit(max_rows + 1)``), so it never scans
    more than needed; callers pass a materialised (checkpointed) frame.  Beyond
    the bound the frame is returned as is and the join falls back to a shuffle
    join (with AQE skew handling).
    """
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the session's checkpoint folder and read it back.

    One job (no recomputation, unlike an un-persisted RDD checkpoint), a
    plan that starts fresh from a file scan, and data in the shared folder
    the cluster names -- so a lost executor never forces a replay of the
    lineage.  The write is eager.  Inside :func:`temporary_tables` the table
    is dropped at the end of the block.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/corpusmap-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmap_table = path  # only frames made here may be dropped by drop_table_files
    if _BLOCKS:
        _BLOCKS[-1].paths[path] = spark
    return out


def track(spark: SparkSession, path: str) -> str:
    """Have :func:`temporary_tables` treat a folder that was written by other means like a table of :func:`cut_lineage`."""
    if _BLOCKS:
        _BLOCKS[-1].paths[path] = spark
    return path


def as_uri(path: str) -> str:
    """A folder's path as tasks that open files themselves need it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return path if "://" in path else f"file://{path}"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a new folder in the checkpoint folder, for files that tasks write themselves."""
    uri = as_uri(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    fs, place = pafs.FileSystem.from_uri(uri)
    fs.create_dir(place)
    return track(spark, uri)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # noqa: BLE001 - best effort clean-up
        pass


def drop_unread(tables: dict, df: DataFrame) -> dict:
    """Drop the ``tables`` that ``df`` doesn't read; gives back the others."""
    read = df.inputFiles() if tables else []
    names = {path: path.rstrip("/").rsplit("/", 1)[-1] for path in tables}  # unique folder names
    used = {path for path, name in names.items() if any(f"/{name}/" in f for f in read)}
    for path, spark in tables.items():
        if path not in used:
            _delete(spark, path)
    return {path: tables[path] for path in used}


def drop_table_files(df: DataFrame) -> None:
    """Delete the table behind a frame returned by :func:`cut_lineage` (other frames: no-op)."""
    path = getattr(df, "_corpusmap_table", None)
    if path:
        _delete(df.sparkSession, path)


class _Block:
    """The tables that :func:`cut_lineage` made in a block."""

    def __init__(self):
        self.paths: dict = {}
        self.kept: set = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave the table behind ``df`` in place at the end of the block."""
        self.kept.add(getattr(df, "_corpusmap_table", None))
        return df

    def keep_all(self) -> dict:
        """Leave all tables in place at the end of the block; gives them back as ``{path: session}``."""
        self.kept |= set(self.paths)
        return dict(self.paths)

    def drop_but(self, *frames: DataFrame) -> None:
        """Drop all tables made so far but those behind ``frames``."""
        stay = {getattr(f, "_corpusmap_table", None) for f in frames}
        for path in [p for p in self.paths if p not in stay]:
            _delete(self.paths.pop(path), path)


_BLOCKS: list[_Block] = []


@contextmanager
def temporary_tables():
    """Drop every table :func:`cut_lineage` makes in the block when it ends, but those given to ``keep``.

    Results must be used (written, collected) inside the block.
    """
    block = _Block()
    _BLOCKS.append(block)
    try:
        yield block
    finally:
        _BLOCKS.remove(block)
        for path, spark in block.paths.items():
            if path not in block.kept:
                _delete(spark, path)
            elif _BLOCKS:
                _BLOCKS[-1].paths[path] = spark


def dense_ids(df: DataFrame, order_col: str, id_col: str = "id") -> DataFrame:
    """Attach ``id_col`` = 0-based rank of ``order_col`` (distinct values) without a single-task sort.

    Only the values are ranked: range-partitioned and sorted locally (as many
    partitions as their size asks for), then per-partition counts are turned
    into offsets, so one row per partition is all that ever meets in one place.
    The other columns join back by value.
    """
    keys = (df.select(F.col(order_col).alias("_key")).repartitionByRange(F.col("_key"))
            .sortWithinPartitions("_key").withColumn("_mid", F.monotonically_increasing_id()))
    keys = cut_lineage(keys)  # ids must be identical for both uses below
    keys = keys.select("_key", F.shiftright("_mid", 33).alias("_pid"),
                       F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_rn"))
    counts = keys.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: a proven bound, safe to broadcast
    ranked = keys.join(F.broadcast(offsets), "_pid").select("_key", (F.col("_off") + F.col("_rn")).cast("long").alias("_rank"))
    out = df.join(ranked, F.col(order_col).eqNullSafe(F.col("_key")))
    return out.withColumn(id_col, F.col("_rank")).drop("_key", "_rank")
