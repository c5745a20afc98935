"""Look-up tables as sorted files in the shared folder, for tables that may be too large to broadcast.

Each file holds a range of keys.  A task opens only the files whose ranges meet its own
keys, one after the other, so what it holds is bounded whatever the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from .common import kept_in_worker, new_folder

FILE_ROWS = 2_000_000
KEEP_FILES = 3


def write_sorted(df: DataFrame, key: str, kind: str, file_rows: int | None = None) -> str:
    """Write ``df`` in files of about ``file_rows`` rows by ascending ``key`` (unique, bigint); the folder's URI.

    ``df`` is read twice: hand in a written table.
    """
    uri = new_folder(df.sparkSession, kind) + "/sorted"
    n = max(1, math.ceil(df.count() / (file_rows or FILE_ROWS)))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(uri)
    return uri


class SortedFiles:
    """The files of :func:`write_sorted`; the last few read are kept."""

    def __init__(self, uri: str, key: str, columns: tuple = ()):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.columns, self.kept, self.files = [key, *columns], {}, []
        for info in self.fs.get_file_info(pafs.FileSelector(path)):
            if info.path.endswith(".parquet"):
                with self.fs.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                    at = meta.schema.names.index(key)
                    parts = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
                    if parts:
                        self.files.append((min(p.min for p in parts), max(p.max for p in parts), info.path))

    def _load(self, name):
        if name not in self.kept:
            while len(self.kept) >= KEEP_FILES:
                self.kept.pop(next(iter(self.kept)))
            with self.fs.open_input_file(name) as f:
                t = pq.read_table(f, columns=self.columns)
            self.kept[name] = [np.asarray(t[c]) for c in self.columns]
        return self.kept[name]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """``(which keys are there, their values by column)``; a missing key has zeros."""
        there, values = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in self.columns[1:]]
        by = np.argsort(keys, kind="stable")
        ordered = keys[by]
        for lo, hi, name in self.files:
            i, j = np.searchsorted(ordered, lo), np.searchsorted(ordered, hi, "right")
            if j > i:
                known, *more = self._load(name)
                at = np.searchsorted(known, ordered[i:j])
                hit = known[at] == ordered[i:j]
                there[by[i:j]] = hit
                for out, column in zip(values, more):
                    out[by[i:j]] = np.where(hit, column[at], 0)
        return there, values


def opened(uri: str, key: str, columns: tuple = ()) -> SortedFiles:
    """The table at ``uri``; a Python worker keeps the last two open."""
    tables = kept_in_worker("sorted files", dict)
    if uri not in tables:
        while len(tables) >= 2:
            tables.pop(next(iter(tables)))
        tables[uri] = SortedFiles(uri, key, columns)
    return tables[uri]
