"""Rolling z-score anomalies as a stream (F2 on arrival).

Each signal keeps the last FRAME values in the state store; a new reading is
scored against them and then takes its place among them. Readings of one
micro-batch are taken in (time, row id) order; a reading that is older than
the newest one scored is scored against what the signal has by then, as a live
monitor does, and one behind the watermark is left out. On input in order the
rows equal the batch operator's. State of a signal that is silent for
``expiry_hours`` (in event time) is dropped. The state is in the checkpoint: a
restarted query goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from histospark.operators.anomaly import FRAME_ROWS, MIN_READINGS, Z_THRESHOLD
from histospark.operators.readings import feed_readings
from histospark.session import workspace_dir
from histospark.sources.feeds import Feed
from histospark.streaming.ingest import named
from histospark.streaming.trend import source_stream

OUT = ("asset string, signal string, ts timestamp_ntz, row_id bigint, numeric_value double, rolling_avg double, rolling_std double, "
       "anomaly_score double, is_anomaly boolean, seen bigint")
STATE = "frame array<double>, seen bigint, newest_ms bigint"


def frame_stats(values: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample standard deviation of the ``frame`` values before each
    place from ``frame`` on (NaN: a row without number), summed in row order;
    NaN where there are too few numbers."""
    n = len(values) - frame
    mean, m2, count = np.zeros(n), np.zeros(n), np.zeros(n)
    total = np.zeros(n)
    for k in range(frame):
        x = values[k : k + n]
        there = ~np.isnan(x)
        v = np.where(there, x, 0.0)
        count += there
        total += v
        step = np.where(there, v - mean, 0.0)
        part = np.divide(step, count, out=np.zeros(n), where=count > 0)
        mean = mean + part
        m2 += np.where(there, step * (step - part), 0.0)
    none = np.full(n, np.nan)
    return np.divide(total, count, out=none.copy(), where=count > 0), np.sqrt(np.divide(m2, count - 1, out=none.copy(), where=count > 1))


def scorer(frame: int, threshold: float, expiry_ms: int):
    """The function that scores a signal's new readings and keeps its state."""

    def score(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, seen, newest = ([np.nan] * frame, 0, 0) if not state.exists else state.get
        rows = pd.concat(list(parts)).sort_values(["ts", "row_id"], kind="stable", ignore_index=True)
        values = np.concatenate((np.array([np.nan if v is None else v for v in held], float), rows["numeric_value"].to_numpy(float)))
        mean, std = frame_stats(values, frame)
        z = np.abs(np.divide(values[frame:] - mean, std, out=np.zeros(len(rows)), where=std > 0))
        newest = max(newest, int(rows["at_ms"].max()))
        state.update(([None if np.isnan(v) else float(v) for v in values[-frame:]], seen + len(rows), newest))
        state.setTimeoutTimestamp(max(newest + expiry_ms, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame({"asset": key[0], "signal": key[1], "ts": rows["ts"], "row_id": rows["row_id"], "numeric_value": rows["numeric_value"], "rolling_avg": mean,
                            "rolling_std": std, "anomaly_score": np.where(np.isnan(values[frame:]) & (std > 0), np.nan, z), "is_anomaly": z > threshold,
                            "seen": np.arange(seen + 1, seen + len(rows) + 1)})
        yield out[out["rolling_avg"].notna()]

    return score


def stream_anomalies(spark: SparkSession, source_dir: str, adapter, feed_name: str, delay: str = "1 day", expiry_hours: int = 24 * 30,
                     table_path: str | None = None, checkpoint: str | None = None, file_glob: str = "*.parquet",
                     max_files_per_trigger: int = 64, frame: int = FRAME_ROWS, threshold: float = Z_THRESHOLD) -> tuple[str, str]:
    """Run one scheduled pass over the files not seen by ``checkpoint``: the
    scored readings are added to the parquet table ``table_path``. The
    watermark is ``delay`` behind the newest reading. Returns (table, checkpoint)."""
    table_path = table_path or workspace_dir(spark, "stream-anomalies")
    checkpoint = checkpoint or workspace_dir(spark, "stream-anomalies-ckpt")
    feed = Feed(feed_name, 1, adapter(source_stream(spark, source_dir, file_glob, max_files_per_trigger)))
    rows = named(feed_readings(feed, numeric_only=True), feed.format)
    rows = rows.select("asset", "signal", "ts", "row_id", "numeric_value", F.expr("timestamp_millis(0) + (ts - timestamp_ntz'1970-01-01')").alias("at"))
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    scored = rows.withWatermark("at", delay).groupBy("asset", "signal").applyInPandasWithState(
        scorer(frame, threshold, expiry_hours * 3_600_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    q = (scored.writeStream.outputMode("append").format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return table_path, checkpoint


def read_scored(spark: SparkSession, table_path: str, min_readings: int = MIN_READINGS) -> DataFrame:
    """The scored readings of the signals that have ``min_readings`` by now, as in the batch operator."""
    rows = spark.read.schema(OUT).parquet(table_path)
    enough = rows.groupBy("asset", "signal").agg(F.max("seen").alias("_n")).where(F.col("_n") >= min_readings)
    return rows.join(enough.drop("_n"), ["asset", "signal"], "left_semi").drop("seen")
