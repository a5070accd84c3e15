"""Rolling statistics and z-score anomaly detection.

All signals are scored in one distributed pass. The rolling frame is "the
previous 24 rows, current row excluded", ordered by (ts, row_id).

Skew: a plain ``Window.partitionBy(signal)`` sends a whole signal to one task,
so one hot signal (a third of all rows, say) would serialise the job. Instead
rows get an exact per-signal row number without a per-signal sort:

1. one range exchange on (asset, signal, ts, row_id) deals the rows out in
   order; parts begin anywhere, also within one instant;
2. running offsets over the rows of each signal in each part (a window over
   a table of one row per signal and part);
3. row number = offset + place in the part;
4. chunk = (rn - 1) div C; the last 24 rows of every chunk are copied into
   the next chunk as a halo; the frame is evaluated per (signal, chunk) and
   halo copies are dropped. Every task holds at most C + 24 rows of a signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from histospark.operators.readings import lookback_days, streams_of, unified_readings
from histospark.session import workspace_dir

FRAME_ROWS = 24          # previous rows in the rolling frame
MIN_READINGS = 12        # detection guard (rows inside the lookback)
Z_THRESHOLD = 3.0
CANDIDATE_MIN_ROWS = 50  # auto-candidate guard
CHUNK_ROWS = 1 << 20       # rows per window task for one signal (~50 MB)
NUMERIC_TYPES = ["FLOAT", "NUMBER", "DOUBLE", "NUMERIC"]


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rn`` (1-based, ordered by ts, row_id) and ``n_rows`` per key
    without a task that holds a whole key, or all rows of one instant.

    One range exchange on (keys, ts, row_id) deals the rows out in order, in
    parts of like size wherever a key or an instant begins; each part is sorted
    and numbered where it lies and written once to the shared folder (range
    bounds come from a sample, so that the parts must not be made twice). What
    a part holds of a key, a row per key and part, gives the number at which
    the part begins."""
    path = workspace_dir(df.sparkSession, "hot-rows")
    parts = df.repartitionByRange(*keys, "ts", "row_id").sortWithinPartitions(*keys, "ts", "row_id")
    place = F.monotonically_increasing_id()  # the part's number, and the place in it
    parts.withColumn("_at", place).withColumn("_part", F.shiftright("_at", 33)).write.parquet(path)
    b = df.sparkSession.read.parquet(path)
    counts = b.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"))
    wk = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(wk.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offs = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), (before - F.col("_lo") + 1).alias("_off"), F.sum("_n").over(wk).alias("n_rows"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = b.join(offs, [F.col("_part") == F.col("_p"), *same])
    return j.withColumn("rn", F.col("_at") + F.col("_off")).drop("_at", "_part", "_p", "_off", *[f"_{k}" for k in keys])


def chunked_window(df: DataFrame, keys: list[str], frame: int, columns,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Evaluate window columns that look back at most ``frame`` rows per key,
    exactly, with every task holding at most ``chunk_rows + frame`` rows of
    one key. ``columns(w)`` returns the columns to add for window spec ``w``
    (partitioned by key + chunk, ordered by the row number ``rn``)."""
    assert chunk_rows >= frame
    n = numbered(df, keys)
    chunk = F.floor((F.col("rn") - 1) / chunk_rows)
    in_tail = ((F.col("rn") - 1) % chunk_rows) >= (chunk_rows - frame)
    copies = n.withColumn("_own", chunk).withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))))
    w = W.partitionBy(*keys, "_chunk").orderBy("rn")
    out = copies.select("*", *columns(w))
    return out.where(F.col("_chunk") == F.col("_own")).drop("_chunk", "_own")


def plain_window(df: DataFrame, keys: list[str], columns) -> DataFrame:
    """The same columns with one window per key (one exchange); only for
    keys known to fit a task (at most one chunk of rows)."""
    w = W.partitionBy(*keys).orderBy("ts", "row_id")
    return df.select("*", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("n_rows"), *columns(w))


def signal_window(h, df: DataFrame, keys: list[str], frame: int, columns,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Route by stream size (``n_readings`` from the metadata, an upper
    bound for any time window): signals within one chunk take the plain
    window, larger ("hot") ones the chunk + halo path. When the metadata
    holds no hot stream the plan has the plain branch only."""
    if h is None:
        return chunked_window(df, keys, frame, columns, chunk_rows)
    if not h.has_hot_streams(chunk_rows):
        return plain_window(df, keys, columns)
    hot = F.coalesce(F.col("n_readings") > chunk_rows, F.lit(True))
    small = plain_window(df.where(~hot), keys, columns)
    big = chunked_window(df.where(hot), keys, frame, columns, chunk_rows)
    return small.unionByName(big)


def _rolling_columns(value: str, frame: int):
    def cols(w):
        wf = w.rowsBetween(-frame, -1)
        return [F.avg(value).over(wf).alias("rolling_avg"), F.stddev_samp(value).over(wf).alias("rolling_std")]
    return cols


def rolling_stats(df: DataFrame, keys: list[str], value: str = "numeric_value",
                  frame: int = FRAME_ROWS, chunk_rows: int = CHUNK_ROWS, h=None) -> DataFrame:
    """mean and sample stddev of the previous ``frame`` rows per key
    (current row excluded); adds ``rolling_avg``, ``rolling_std``, ``rn`` and
    ``n_rows``. Exact for any key size: without a Historian ``h`` every key
    takes the chunk + halo path; with one, keys are routed by size."""
    return signal_window(h, df, keys, frame, _rolling_columns(value, frame), chunk_rows)


def score(rolled: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """F2 scoring: rows with a previous mean; z = |v-mean|/std when std > 0
    else 0; anomaly iff z > threshold; bounds mean ± threshold·std."""
    v, m, s = F.col("numeric_value"), F.col("rolling_avg"), F.col("rolling_std")
    z = F.when(s > 0, F.abs((v - m) / s)).otherwise(F.lit(0.0))
    return (rolled.where(m.isNotNull())
            .withColumn("anomaly_score", z)
            .withColumn("is_anomaly", F.coalesce(z > threshold, F.lit(False)))
            .withColumn("lower_bound", m - threshold * s)
            .withColumn("upper_bound", m + threshold * s))


RESULT_COLUMNS = ["asset", "signal", "domain", "ts", "numeric_value", "is_anomaly", "anomaly_score",
                  "forecast_value", "lower_bound", "upper_bound", "model_type"]


def detect_anomalies(h, lookback=None, asset: str | None = None, signal: str | None = None,
                     as_of=None, min_readings: int = MIN_READINGS, frame: int = FRAME_ROWS,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """F2 for every numeric signal at once (or one asset / one signal).

    Rows: readings inside the lookback (non-null raw value; non-numeric text
    counts towards the guard and stays, unscored). Signals with fewer than
    ``min_readings`` rows in the window are skipped."""
    days = lookback_days(lookback)
    meta = h.streams.where(F.col("data_type").isin(NUMERIC_TYPES)) if signal is None else h.streams
    if asset is not None:
        meta = meta.where(F.col("asset") == asset)
    if signal is not None:
        meta = meta.where(F.col("signal") == signal)
    targeted = streams_of(meta) if (asset is not None or signal is not None) else None
    r = unified_readings(h, days=days, as_of=as_of, meta=meta, numeric_only=signal is None,
                         streams_by_feed=targeted)
    rolled = rolling_stats(r.select("asset", "signal", "domain", "ts", "row_id", "numeric_value", "n_readings"),
                           ["asset", "signal"], frame=frame, chunk_rows=chunk_rows, h=h)
    scored = score(rolled.where(F.col("n_rows") >= min_readings))
    out = scored.select(
        "asset", "signal", "domain", "ts",
        "numeric_value", "is_anomaly", "anomaly_score",
        F.col("rolling_avg").alias("forecast_value"), "lower_bound", "upper_bound",
        F.lit("ANOMALY").alias("model_type"))
    return out


def signal_window_stats(h, lookback=None, as_of=None) -> DataFrame:
    """Per numeric signal inside the lookback: readings, sample stddev and
    mean of the numeric values (NULL -> 0), one grouped aggregation."""
    days = lookback_days(lookback)
    meta = h.streams.where(F.col("data_type").isin(NUMERIC_TYPES))
    r = unified_readings(h, days=days, as_of=as_of, meta=meta, numeric_only=True)
    return r.groupBy("asset", "signal").agg(
        F.count(F.lit(1)).alias("readings"),
        F.coalesce(F.stddev_samp("numeric_value"), F.lit(0.0)).alias("stddev"),
        F.coalesce(F.avg("numeric_value"), F.lit(0.0)).alias("avg_value"))


def anomaly_candidates(h, lookback=None, asset: str | None = None, scan_first: int | None = None,
                       keep_first: int | None = None, as_of=None) -> DataFrame:
    """numeric signals with >= 50 readings and std > 0 in the lookback, by
    std descending. ``scan_first`` examines only the first signals in (asset,
    signal) order, ``keep_first`` keeps the first of those found."""
    days = lookback_days(lookback)
    meta = h.streams.where(F.col("data_type").isin(NUMERIC_TYPES))
    if asset is not None:
        meta = meta.where(F.col("asset") == asset)
    targeted = None
    if scan_first is not None:
        # top-k: every partition keeps its first k, one task merges k x partitions;
        # then only those streams are read
        first = meta.select("asset", "signal").distinct().orderBy("asset", "signal").limit(scan_first)
        meta = meta.join(first, ["asset", "signal"])
        targeted = streams_of(meta)
    elif asset is not None:
        targeted = streams_of(meta)
    r = unified_readings(h, days=days, as_of=as_of, meta=meta, numeric_only=True, streams_by_feed=targeted)
    stats = r.groupBy("asset", "signal").agg(
        F.count(F.lit(1)).alias("readings"),
        F.stddev_samp("numeric_value").alias("_std"),
        F.avg("numeric_value").alias("_avg"))
    ok = stats.where((F.col("readings") >= CANDIDATE_MIN_ROWS) & (F.coalesce(F.col("_std"), F.lit(0.0)) > 0))
    if keep_first is not None:
        ok = ok.orderBy("asset", "signal").limit(keep_first)
    return ok.select("asset", "signal", "readings", F.col("_std").alias("stddev"),
                     F.coalesce("_avg", F.lit(0.0)).alias("avg_value")).orderBy(F.desc("stddev"), "asset", "signal")
