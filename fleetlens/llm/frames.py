"""Small helpers on DataFrames."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. The same pattern works in DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def give_back() -> None:
    """Return memory that this worker has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterable[pa.RecordBatch]


def lean(made: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``made`` for ``mapInArrow``, leaving no peak behind: Python workers outlive their tasks and stages."""

    def rows(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:
            give_back()

    return rows


def lean_group(made: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``made`` for ``applyInArrow``, leaving no peak behind after a group."""

    def table_of(group: pa.Table) -> pa.Table:
        try:
            return made(group)
        finally:
            give_back()

    return table_of
