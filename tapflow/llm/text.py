"""Running a text kernel over the rows of a DataFrame.

Kernels receive a list of Python strings and return one Arrow array per
output column. A null text is handed over as the empty string. Rows are cut
into slices of bounded size, so one task never holds more than a slice (or a
single very long text) in Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20  # text bytes handed to a kernel at once (one row at least)

Kernel = Callable[[list[str]], list[pa.Array]]


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` with about ``max_bytes`` of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    part = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a Python worker goes on to other operators


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column, null as ''."""
    return pc.fill_null(column, "").to_pylist()


def map_texts(df: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, T.DataType]],
              kernel: Callable[[], Kernel]) -> DataFrame:
    """One row per input row: the id column and the kernel's columns. Only the
    id and text columns are read, so other columns of ``df`` never clash with
    the result. ``kernel`` is called once per task and returns the function
    applied to each slice."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]
                          + [T.StructField(n, t) for n, t in fields])
    names = [id_col, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = kernel()
        for batch in batches:
            for part in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(strings(part.column(1)))], names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, kernel: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of ``df`` (all columns, whatever their names) for which the
    kernel's boolean is true."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = kernel()
        for batch in batches:
            for part in text_slices(batch, at):
                yield part.filter(pa.array(np.asarray(fn(strings(part.column(at))), dtype=bool)))

    return df.mapInArrow(run, df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hash of
    ``key``: the same rows at every run, however the table is partitioned.
    A hash threshold from the row count thins the rows before they are ranked."""
    total = df.count()
    h = F.xxhash64(F.col(key))
    span = 1 << 30
    thin = df if total <= 2 * rows else df.filter(F.pmod(h, F.lit(span)) < F.lit(max(1, 2 * rows * span // total)))
    return thin.orderBy(F.pmod(h, F.lit(span)), F.col(key)).limit(rows)
