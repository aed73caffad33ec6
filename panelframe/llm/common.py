"""Helpers shared by the operators: shared-folder tables, Arrow row mapping, bounded memo tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest key that a memo table keeps; longer ones are computed each time.
MEMO_KEY_CHARS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new local one for a local session (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder.

    This cuts the lineage: a lost executor costs no more than the stages since the last such table, and
    a later join starts from a plain scan, so that adaptive execution can split its skewed partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Memo(dict):
    """A table of computed values in two generations: at `limit` entries the table becomes the old
    generation, from which what is asked for again moves on, and the former old one goes."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > MEMO_KEY_CHARS:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# Rows, and bytes of texts, that a worker turns into Python objects at once; one longer text is taken alone.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most SLICE_ROWS rows and SLICE_BYTES bytes of strings and binaries."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    end, first = np.cumsum(size), 0
    while first < batch.num_rows:
        held = int(end[first - 1]) if first else 0
        last = max(first + 1, min(first + SLICE_ROWS, int(np.searchsorted(end, held + SLICE_BYTES, "right"))))
        yield batch.slice(first, last - first)
        first = last


def slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of source, cut small: what a task holds at once does not grow with Arrow's batch size.

    At the end the worker, which lives on for other tasks, gives its free memory back.
    """
    for batch in source:
        yield from cut(batch)
    give_back()


# Bytes of a batch that goes to a Python worker; one larger row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches() -> None:
    """From now on the session's batches for Python workers are bounded in bytes: what the JVM, the worker and the
    pipe between them hold does not grow with the texts."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    small_batches()
    return df.mapInArrow(function, schema)


def text_column(column, out: T.DataType, values: Callable[[list], list]) -> F.Column:
    """A column of values(texts) -> as many values, null texts among them; texts are taken in slices."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches()
    arrow = to_arrow_type(out)

    @F.arrow_udf(out)
    def mapped(texts: pa.Array) -> pa.Array:
        parts = [pa.array(values(part.column(0).to_pylist()), arrow) for part in cut(pa.RecordBatch.from_arrays([texts], names=["t"]))]
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return mapped(column)


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what is free


def map_rows(df: DataFrame, columns: dict[str, str], out: T.StructType, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Apply rows(*column values) -> iterable of output tuples to each Arrow batch of df.

    columns maps internal names to column names of df, so extra columns of any name never clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            made = list(rows(*(c.to_pylist() for c in batch.columns)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    narrow = df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    return map_batches(narrow, batches, out)


def typed(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType, True)


def crc32(column) -> F.Column:
    """Unsigned CRC-32 of a column's UTF-8 text."""
    return F.crc32(column.cast("string").cast("binary"))
