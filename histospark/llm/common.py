"""Shared helpers: reading tables, tables written to the shared folder, row ids."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm.arrays import release
from histospark.session import workspace_dir

#: Words are runs of anything but the six ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"

#: Internal column that identifies a row of a written table.
ROW = "__hs_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors, and every later use reads the same rows."""
    path = workspace_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: list = []


def share(spark: SparkSession, value):
    """Broadcast ``value``; :func:`settle` takes it from the executors again."""
    _SHARED.append(spark.sparkContext.broadcast(value))
    return _SHARED[-1]


def settle(spark: SparkSession) -> None:
    """After a step whose result is written: broadcasts leave the executors
    (one that is still in use is sent again), the driver's Python gives its
    free memory back, and the driver's JVM collects its garbage, upon which
    Spark deletes the shuffle files of finished steps (else they stay until it
    happens to)."""
    while _SHARED:
        with contextlib.suppress(Exception):  # its session has ended
            _SHARED.pop().unpersist()
    release()
    spark.sparkContext._jvm.System.gc()


def with_row_id(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` with a unique long per row, stored so that the ids cannot change
    when a task runs again. It holds the texts, so it is packed tightly."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name, "zstd")
