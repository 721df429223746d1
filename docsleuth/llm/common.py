"""What the training-data operators share: tables, shared folders, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.sources.shared import shared_dir, written

__all__ = ["by_hash", "map_texts", "shared_dir", "slices", "table", "unused", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def by_hash(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """All rows if there are at most so many, else about as many, by a hash of the id: one count, then a filter.

    The share is set from the count, so the result's size is bounded whatever the input's, up to chance (a
    twentieth more is out of the question for a thousand rows or more) and to rows that share an id.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


#: What a slice of a batch may hold, unless it is a single row.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, and bytes of texts, so that what Python makes of a piece stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(total)
        at, before = 0, 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, side="right"))))
            yield batch.slice(at, stop - at)
            at, before = stop, int(total[min(stop, batch.num_rows) - 1])


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], schema: str, names: list[str]) -> DataFrame:
    """One row per input row: its id, and the columns that make()'s function computes from a batch of texts, in UTF-8.

    Only the two columns are read, so other columns of any name do no harm. There is no shuffle.
    """
    # selected by position afterwards, so that an id column called like a result column is no problem either
    inner = df.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__text"))
    id_type = inner.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(batch.column(1).to_pylist())], names=["__id", *names])

    return inner.mapInArrow(run, f"__id {id_type}, {schema}").withColumnRenamed("__id", id_col)
