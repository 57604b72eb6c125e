"""Shared plumbing: inputs, shared folder for intermediate tables, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import WIDE, shared_dir

#: The word class of all contracts: maximal runs free of space and of U+0009..U+000D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_scopes: list[list[str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go when it ends; only what is written or counted before then may use them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing uses any more."""
    if table in _paths:
        _remove(table.sparkSession, _paths.pop(table))


def stored(df: DataFrame, name: str, outlives: bool = False, wide: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table: cuts lineage, survives lost executors. outlives: it
    stays when the scratch it is stored in ends. wide: its rows are large, so a task holds few of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub('[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    df.write.options(**WIDE if wide else {}).parquet(path)
    if _scopes and not outlives:
        _scopes[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for a mapInArrow; at a task's end the worker gives memory back, as workers wait for others with what they hold."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def parts(n_bytes: int | None, each: int) -> int:
    """How many parts of about each bytes n_bytes make; at least one."""
    return max(1, -(-int(n_bytes or 0) // each))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, counted over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def byte_texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def by_size(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about most bytes of text each (a longer single row stays whole)."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < len(lengths):
            yield batch.slice(begin)
