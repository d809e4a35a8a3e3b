"""Columns and filters computed from texts inside tasks, with all other columns left as they are.

The input's columns pass as Arrow data under plain names, so large ids beside nulls and odd column names survive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Called once a task; gives a function from the texts of a batch (and an extra column's array) to a list of arrays.
Compute = Callable[[], Callable[..., list]]


def small_batches(spark: SparkSession, most: str = "2m") -> None:
    """From here on the session passes rows to Python in Arrow batches of about ``most`` bytes, so that a worker and the
    buffers of its task stay small whatever the length of texts (one row at least, however long).  A limit that
    the session has been given stays."""
    if spark.conf.get(name := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(name, most)


def _numbered(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("*", *more).toDF(*(f"c{i}" for i in range(len(df.columns) + len(more))))


def with_columns(df: DataFrame, fields: list[StructField], text: str, compute: Compute) -> DataFrame:
    """The rows of ``df`` with further columns, an array of ``compute`` each; columns of the same names are replaced."""
    small_batches(df.sparkSession)
    kept = df.drop(*(f.name for f in fields))
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compute()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own(batch.column(at).to_pylist()))], names=schema.names)

    return _numbered(kept).mapInArrow(run, schema)


def filtered(df: DataFrame, text: str, extra: Column, compute: Compute) -> DataFrame:
    """The rows of ``df`` for which the one array of ``compute``, of the texts and of ``extra``, is true."""
    small_batches(df.sparkSession)
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compute()
        for batch in batches:
            (keep,) = own(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1))
            rows = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=schema.names)

    return _numbered(df, extra.alias("extra")).mapInArrow(run, schema)
