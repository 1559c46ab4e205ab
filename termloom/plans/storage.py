"""Tables written in the folder that all executors share, which cuts the lineage of a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written by this process and not dropped yet.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in this machine alone, as in tests, is a
    temporary folder made; on a cluster its absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that lives as long as this process or the :func:`scratch` around it."""
    path = f"{shared_folder(spark)}/termloom/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _drop(since: int) -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    jvm = context._jvm
    for path in _written[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since:]
    # shuffles of plans that nothing refers to any more are deleted when the plans are collected
    jvm.System.gc()


@contextmanager
def scratch() -> Iterator[None]:
    """Drop the tables written inside; what was read from them must be written elsewhere by then."""
    since = len(_written)
    try:
        yield
    finally:
        _drop(since)


@atexit.register
def _drop_all() -> None:
    try:
        _drop(0)
    except Exception:  # noqa: BLE001
        # the gateway may be gone already; the folder's owner clears what is left
        return


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write a table under the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
