"""Helpers shared by the corpus operators: the shared folder, written tables, batches.

Every intermediate table that is read more than once is written as Parquet under the
folder that the cluster names in ``spark.checkpoint.dir``.  A written table survives the
loss of any executor and cuts the lineage; nothing is kept in an executor's own folder.
"""

from __future__ import annotations

import ctypes
import gc
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from lorebase.operators.shared import drop_written, scratch_path, short_batches, written

__all__ = ["SPACE", "as_scan", "drop_written", "forget_kept", "free_name", "kept_by_worker", "scratch_path", "short_batches", "written"]

#: ``[\x20\x09-\x0D]+`` as a Java regular expression: the white space of all word rules here.
SPACE = "[\\x20\\x09-\\x0D]+"

_KEPT: list = []


def kept_by_worker(size: int = 1):
    """As ``lru_cache``, for what the tasks of a Python worker share, until :func:`forget_kept`."""

    def cached(f):
        _KEPT.append(lru_cache(maxsize=size)(f))
        return _KEPT[-1]

    return cached


def forget_kept() -> None:
    """Let go what this worker keeps for another operator's tasks, as Spark uses workers again and again."""
    if any(f.cache_info().currsize for f in _KEPT):
        for f in _KEPT:
            f.cache_clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # else the C library keeps what was freed
            trim(0)


def as_scan(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` itself if it is a plain scan of files, else written and read again.

    Row numbers and locators of a scan are the same each time it is read.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException as e:
        if "UNRESOLVED" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        return written(docs, name)
    return docs


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until it clashes with no column that the caller brings."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
