"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.storage import new_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows that Python turns into objects at once; documents can be long.
ARROW_ROWS = 256
#: Rows of the batches that go to Python while a table is written; else Spark's limit in bytes holds.
WRITE_ROWS = 1024


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Bound the rows of a batch for Python while a table is written; the session's own setting
    comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(WRITE_ROWS, int(before)) if int(before) > 0 else WRITE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: this cuts the lineage
    and survives lost executors, whose tasks are simply run again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists").option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, without a copy; Spark bounds its own by bytes, and
    what Python makes of the rows at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    # workers live on after a task; what Arrow has kept for it goes back
    pa.default_memory_pool().release_unused()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
