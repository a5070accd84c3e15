"""Incremental ingest (A7) with Structured Streaming.

A file stream finds the files that are new in a folder; each micro-batch reads
them as a batch frame with *their own* schema, merged over the files of the
batch, so that a column that a later file brings becomes a stream from then
on (files whose schemas can't be merged are read apart). The frame is adapted
to a feed, normalised by the same code as the batch path and added to a
readings store (:mod:`histospark.sources.readings_store`), together with its
streams and summaries, as one published version. The checkpoint hands out each
file once; a micro-batch that runs again after a crash has the same number, and
the store adds a number once.

The ``availableNow`` trigger processes everything present and stops, so the
job can run on a schedule. Any of the three feed shapes can come in; asset,
signal, domain and unit come from the stream's name, so a stream that no
catalog knows yet is ingested like any other.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions import names as N
from histospark.session import workspace_dir
from histospark.sources.feeds import CLASSIC, LONG, WIDE, Feed
from histospark.sources.readings_store import ReadingsStore

OUT_COLUMNS = ["feed", "stream", "asset", "signal", "domain", "unit", "ts", "raw_value", "numeric_value",
               "string_value", "is_questionable", "row_id"]


def frames(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """The files as one frame with their merged schema, or, where their types
    disagree, a frame for each schema (footers only are read here)."""
    try:
        return [spark.read.option("mergeSchema", True).parquet(*files)]
    except (PySparkException, Py4JJavaError):
        alike: dict[str, list[str]] = {}
        for f in files:
            alike.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
        return [spark.read.parquet(*same) for same in alike.values()]


def incremental_ingest(h, source_dir: str, adapter, feed_name: str, table_path: str | None = None,
                       checkpoint: str | None = None, file_glob: str = "*.parquet",
                       max_files_per_trigger: int = 64, unit: str = "day") -> tuple[str, str]:
    """Run one scheduled ingest: every file of ``source_dir`` matching
    ``file_glob`` not yet seen by ``checkpoint`` is adapted (``adapter``:
    source frame -> feed frame), normalised and added to the readings store in
    ``table_path``. Returns (table, checkpoint)."""
    spark: SparkSession = h.spark
    table_path = table_path or workspace_dir(spark, "readings")
    checkpoint = checkpoint or workspace_dir(spark, "ingest-ckpt")
    store = ReadingsStore(spark, table_path, unit)
    ordinal = next((f.ordinal for f in h.feeds if f.name == feed_name), len(h.feeds) + 1)

    def add(found: DataFrame, batch: int) -> None:
        files = sorted(r["path"] for r in found.distinct().collect())  # max_files_per_trigger at most
        for i, df in enumerate(frames(spark, files) if files else []):
            store.append(Feed(feed_name, ordinal, adapter(df)), source=f"{checkpoint}#{i}", batch=batch)

    names = (spark.readStream.schema("`_` string").option("maxFilesPerTrigger", max_files_per_trigger)
             .option("pathGlobFilter", file_glob).parquet(source_dir).select(F.col("_metadata.file_path").alias("path")))
    q = names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table_path, checkpoint


def named(rows: DataFrame, fmt: str) -> DataFrame:
    """Readings with asset, signal, domain and unit parsed from the stream name."""
    feed, stream = F.col("feed"), F.col("stream")
    if fmt == LONG:
        asset, signal = N.parse_long_field(stream, feed)
    elif fmt == WIDE:
        asset, signal = N.parse_wide_column(stream, feed)
    else:
        asset, signal = feed, F.lit("VALUE")
    unit = N.extract_unit(stream) if fmt != CLASSIC else F.lit(None).cast("string")
    rows = rows.withColumn("asset", asset).withColumn("signal", signal).withColumn("unit", unit)
    return rows.withColumn("domain", N.domain_of(F.col("asset"), F.col("signal")))


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The named readings of a store; they need no raw feed."""
    store = ReadingsStore(spark, table_path)
    parts = []
    for feed, facts in store.feeds().items():
        rows = named(store.readings(feed), facts["format"])
        parts.append(rows.withColumns({"unit": F.coalesce("uom", "unit"), "string_value": F.when(F.col("numeric_value").isNull(), F.col("raw_value"))}).select(*OUT_COLUMNS))
    if not parts:
        return spark.createDataFrame([], "feed string, stream string, asset string, signal string, domain string, unit string, ts timestamp_ntz, "
                                         "raw_value string, numeric_value double, string_value string, is_questionable boolean, row_id bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)
