"""tf-idf weighting.

Canonical output is the long/sparse form ``(doc_id, term_id, term, w)``
keyed by ids.  tf code 3 gives absent vocabulary terms a non-zero weight
``0.5·idf``; that per-column *baseline* is kept apart (:func:`baseline`)
instead of densifying the matrix, and only :func:`densify` (small
vocabularies, matrix output) fills it in.
"""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyarrow.dataset import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.weights import absent_tf_weight, check_code, idf_weight, tf_weight, TF_CODES, IDF_CODES
from ..plans.util import as_uri, bounded_broadcast, cut_lineage

IdfSpec = int | Callable[[Column, Column], Column]
ROW_VALUES = 1 << 20    # numbers of dense rows that a task makes at once
PART_BYTES = 256 << 20  # of dense rows made by a task in all
MAX_PARTITIONS = 20_000  # of the plan only


def with_idf(vocab: DataFrame, n_docs: DataFrame, idf: IdfSpec = 0) -> DataFrame:
    """vocab + ``n_docs`` + ``idf``; ``idf`` is a code (W5-W8) or ``f(df, n_docs) -> Column``."""
    v = vocab.crossJoin(F.broadcast(n_docs.select("n_docs")))  # one row: a fixed bound
    expr = idf(F.col("df"), F.col("n_docs")) if callable(idf) else idf_weight(idf, F.col("df"), F.col("n_docs"))
    return v.withColumn("idf", expr.cast("double"))


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: DataFrame, tf_calc: int = 0,
          idf: IdfSpec = 0, tf_expr: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(doc_id, term_id, term, w) for the terms present in each doc.

    ``tf`` must carry ``max_tf`` taken over *all* the doc's terms (see
    :func:`corpusmap.operators.terms.term_freqs`).  The vocabulary side is
    broadcast only when its checked row count is small; otherwise the join
    shuffles on ``term`` (AQE splits hot terms).
    """
    v, _ = bounded_broadcast(with_idf(vocab, n_docs, idf).select("term", "term_id", "idf"))
    tfw = tf_expr(F.col("tf"), F.col("max_tf")) if tf_expr else tf_weight(tf_calc, F.col("tf"), F.col("max_tf"))
    return tf.join(v, "term").select("doc_id", "term_id", "term", (tfw * F.col("idf")).alias("w"))


def weighting_grid(spark, tf_calcs=(0, 1, 2, 3), idf_calcs=(0, 1, 2, 3)) -> DataFrame:
    """The tf × idf settings as ``params(run_id, tf_calc, idf_calc)``; run names ``tfCalcTidfCalcI``."""
    rows = [(f"tfCalc{t}idfCalc{i}", check_code(t, TF_CODES, "tf"), check_code(i, IDF_CODES, "idf"))
            for t in tf_calcs for i in idf_calcs]
    return spark.createDataFrame(rows, "run_id string, tf_calc int, idf_calc int")


def tfidf_sweep(tf: DataFrame, vocab: DataFrame, n_docs: DataFrame, params: DataFrame, with_base: bool = False) -> DataFrame:
    """Every (tf_calc, idf_calc) setting of ``params`` in one pass, keyed by ``run_id``.

    ``with_base`` adds the term's :func:`baseline` weight as a column ``base``."""
    # the vocabulary joins once; all weights of a term and of a posting are made before a setting's row, which picks two
    idfs = F.array(*(idf_weight(c, F.col("df"), F.col("n_docs")) for c in range(len(IDF_CODES))))
    v, _ = bounded_broadcast(vocab.crossJoin(F.broadcast(n_docs.select("n_docs"))).select("term", "term_id", idfs.alias("idfs")))
    settings = params.agg(F.collect_list(F.struct("run_id", "tf_calc", "idf_calc")).alias("settings"))  # one row: the grid
    tfs = F.array(*(tf_weight(c, F.col("tf"), F.col("max_tf")) for c in range(len(TF_CODES))))
    rows = (tf.select("doc_id", "term", tfs.alias("tfs")).join(v, "term").crossJoin(F.broadcast(settings))
            .select("doc_id", "term_id", "term", "tfs", "idfs", F.explode("settings").alias("s")))
    w = F.get("tfs", F.col("s.tf_calc")) * F.get("idfs", F.col("s.idf_calc"))
    base = [(absent_tf_weight(F.col("s.tf_calc")) * F.get("idfs", F.col("s.idf_calc"))).alias("base")] if with_base else []
    return rows.select(F.col("s.run_id").alias("run_id"), "doc_id", "term_id", "term", w.alias("w"), *base)


def baseline(vocab: DataFrame, n_docs: DataFrame, tf_calc: int = 0, idf: IdfSpec = 0) -> DataFrame:
    """(term_id, term, base): weight of a vocabulary term absent from a doc (0, or 0.5·idf for tf 3)."""
    v = with_idf(vocab, n_docs, idf)
    return v.select("term_id", "term", (absent_tf_weight(tf_calc) * F.col("idf")).alias("base"))


def densify(weights: DataFrame, base: DataFrame, docs: DataFrame, keys=("doc_id",), tile: int = 1024,
            max_tiles: int = 2_000) -> DataFrame:
    """One ``vec array<double>`` per doc in column (term_id) order; the rows come in the order of ``keys``.

    ``docs`` lists the rows to emit (e.g. docs with at least one term); a
    vocabulary term missing from a doc takes ``base``.  Only the cells that a doc has are
    shuffled and written; a row is widened where it is used, so no wide row is ever shuffled or stored
    here.  The base values are files of tiles of ``tile`` columns in the checkpoint folder.  A task
    reads them itself and makes few rows at a time (ROW_VALUES numbers, or one row); up to
    ``max_tiles`` tiles stay in the task, beyond that they are read again for each few rows.
    """
    keys = list(keys)
    tiles = cut_lineage(base.groupBy(F.floor(F.col("term_id") / tile).cast("long").alias("tile"))
                        .agg(F.array_sort(F.collect_list(F.struct("term_id", "base"))).alias("base"))
                        .select("tile", F.transform("base", lambda x: x["base"]).alias("base")))
    size = tiles.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("base")), F.lit(0)).alias("width")).first()  # one row
    n_tiles, width, uri = size.n, size.width, as_uri(tiles._corpusmap_table)
    cells = weights.groupBy(*keys).agg(F.collect_list(F.struct("term_id", "w")).alias("_cells"))
    rows = cut_lineage(docs.select(*keys).distinct().join(cells, keys, "left").select(
        *keys, F.transform("_cells", lambda c: c["term_id"].cast("long")).alias("_at"),
        F.transform("_cells", lambda c: c["w"].cast("double")).alias("_w")))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(MAX_PARTITIONS, max(2 * cores, math.ceil(rows.count() * width * 8 / PART_BYTES)))
    step = max(1, ROW_VALUES // max(1, width))

    def read():
        fs, path = pafs.FileSystem.from_uri(uri)
        for b in dataset(path, filesystem=fs, format="parquet").to_batches(columns=["tile", "base"], batch_size=64):
            for t, values in zip(b.column("tile").to_pylist(), b.column("base")):
                yield t * tile, np.asarray(values.values, np.float64)

    def widened(batches):
        held = list(read()) if n_tiles <= max_tiles else None
        for b in (x.slice(i, step) for x in batches for i in range(0, len(x), step)):
            out = np.empty((len(b), width))
            for first, values in read() if held is None else held:
                out[:, first:first + len(values)] = values
            n = np.asarray(pc.fill_null(pc.list_value_length(b.column("_at")), 0)).astype(np.int64)
            at = np.repeat(np.arange(len(b)) * width, n) + np.asarray(b.column("_at").flatten(), np.int64)
            if len(np.unique(at)) < len(at):
                raise ValueError("a document has a weight of one term twice")
            out.reshape(-1)[at] = np.asarray(b.column("_w").flatten(), np.float64)
            edges = pa.array(np.arange(len(b) + 1) * width, pa.int32())
            vec = pa.ListArray.from_arrays(edges, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), vec], names=[*keys, "vec"])

    schema = StructType([*docs.select(*keys).schema.fields, StructField("vec", ArrayType(DoubleType()))])
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(widened, schema)
