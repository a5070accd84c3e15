"""Hourly trend as a stream (E8 in event time).

Files of a feed come in as a stream; readings are normalised and named by the
batch code, and averaged per signal and hour in event-time windows. The
watermark says how late a reading may come: an hour is written once, when the
watermark has passed its end (append mode), and its state is dropped then.
Readings that come later are counted in the query's progress and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.operators.readings import feed_readings
from histospark.session import workspace_dir
from histospark.sources.feeds import Feed
from histospark.streaming.ingest import named


def source_stream(spark: SparkSession, source_dir: str, file_glob: str, max_files_per_trigger: int) -> DataFrame:
    """The rows of new files in a folder, with the schema of those there now."""
    schema = spark.read.option("pathGlobFilter", file_glob).option("mergeSchema", True).parquet(source_dir).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", file_glob).parquet(source_dir))


def hourly_means(rows: DataFrame, fmt: str, delay: str) -> DataFrame:
    """(asset, signal, hour, avg_value, readings) of closed hours. The
    TIMESTAMP_NTZ wall clock is taken as UTC for the window, and back."""
    r = named(rows, fmt).withColumn("at", F.expr("timestamp_millis(0) + (ts - timestamp_ntz'1970-01-01')"))
    g = r.withWatermark("at", delay).groupBy("asset", "signal", F.window("at", "1 hour")).agg(
        F.avg("numeric_value").alias("avg_value"), F.count(F.lit(1)).alias("readings"))
    hour = F.expr("timestamp_ntz'1970-01-01' + (window.start - timestamp_millis(0))").cast("timestamp_ntz")
    return g.select("asset", "signal", hour.alias("hour"), "avg_value", "readings")


def stream_hourly_trend(spark: SparkSession, source_dir: str, adapter, feed_name: str, delay: str = "1 hour", table_path: str | None = None,
                        checkpoint: str | None = None, file_glob: str = "*.parquet", max_files_per_trigger: int = 64) -> tuple[str, str, int]:
    """Run one scheduled pass over the files not seen by ``checkpoint``: closed
    hours are added to the parquet table ``table_path``. Returns (table,
    checkpoint, readings that came too late in this pass)."""
    table_path = table_path or workspace_dir(spark, "hourly")
    checkpoint = checkpoint or workspace_dir(spark, "hourly-ckpt")
    feed = Feed(feed_name, 1, adapter(source_stream(spark, source_dir, file_glob, max_files_per_trigger)))
    rows = feed_readings(feed, numeric_only=True)
    q = (hourly_means(rows, feed.format, delay).writeStream.outputMode("append").format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    return table_path, checkpoint, late


def read_hourly(spark: SparkSession, table_path: str) -> DataFrame:
    """The closed hours."""
    return spark.read.schema("asset string, signal string, hour timestamp_ntz, avg_value double, readings bigint").parquet(table_path)
