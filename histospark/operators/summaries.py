"""Answers from the summaries of a readings store alone (E2, E3, E8, E9, F4,
G3, L4, Q1, Q3, Q6): no reading is scanned.

Each function gives the rows of the operator of the same name over the
readings, from the store that the Historian reads (``use_readings``,
``materialise`` or ``from_store``). Hours add up: their numbers, sums, second
moments and extremes, of all streams of a signal. Forecasts, latest readings
and tail statistics read the tails, at most 500 rows a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histospark.functions.timecalc import trunc_ntz
from histospark.operators import events as EV
from histospark.operators import forecast as G
from histospark.operators import stats as S
from histospark.operators.anomaly import NUMERIC_TYPES
from histospark.sources.readings_store import NUMERIC_TAIL, TAIL

KEYS = ["asset", "signal"]


def _store(h):
    if h.store is None:
        raise ValueError("this Historian reads no readings store")
    if h.not_after is not None:
        raise ValueError("summaries hold all readings: they can't leave out those after not_after")
    return h.store


def _named(h, df: DataFrame, numeric: bool = True) -> DataFrame:
    """``df`` (feed, stream, ...) with the names of its streams."""
    m = h.streams.where(F.col("data_type").isin(NUMERIC_TYPES)) if numeric else h.streams
    return df.join(h.small(m.select("feed", "stream", *KEYS, "domain"), h.metadata_rows), ["feed", "stream"])


def _hours(h, numeric: bool = True) -> DataFrame:
    return _named(h, _store(h).hours(), numeric)


def _tails(h, kind: str = "all", n: int | None = None, numeric: bool = True) -> DataFrame:
    return _named(h, _store(h).tails(kind, n), numeric)


def series_profile(h) -> DataFrame:
    """Count, first and last time, mean and sample standard deviation."""
    hours = _hours(h)
    w = W.partitionBy(*KEYS)
    # second moments about the signal's mean: own moment + n * (own mean - mean)^2
    mean = F.sum("total").over(w) / F.sum("n_numeric").over(w)
    shift = F.when(F.col("n_numeric") > 0, F.col("m2") + F.col("n_numeric") * F.pow(F.col("total") / F.col("n_numeric") - mean, F.lit(2.0)))
    n = F.sum("n_numeric")
    g = hours.withColumn("moved", shift).groupBy(*KEYS).agg(
        F.sum("n").alias("readings"), F.when(n > 0, F.sum("total") / n).alias("avg_value"),
        F.when(n > 1, F.sqrt(F.sum("moved") / (n - 1))).alias("stddev"))
    first = _tails(h, "first").groupBy(*KEYS).agg(F.min("ts").alias("first_ts"))
    last = _tails(h, "all", 1).groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    return g.join(first, KEYS).join(last, KEYS).select(*KEYS, "readings", "first_ts", "last_ts", "avg_value", "stddev")


def feed_volume(h) -> DataFrame:
    """Rows, earliest, latest and number of signals per feed, from the manifest and the catalog."""
    facts = [(name, f["rows"], f["first"], f["last"]) for name, f in _store(h).feeds().items()]
    v = h.spark.createDataFrame(facts, "feed string, rows bigint, first string, last string")
    signals = h.metadata.groupBy("feed").agg(F.count(F.lit(1)).alias("signals"))
    return v.join(signals, "feed", "left").select("feed", "rows", F.col("first").cast("timestamp_ntz").alias("earliest"),
                                                  F.col("last").cast("timestamp_ntz").alias("latest"), F.coalesce("signals", F.lit(0)).alias("signals"))


def hourly_trend(h, hours: int = S.TREND_HOURS) -> DataFrame:
    """Hourly mean per numeric signal, its first hours with readings."""
    n = F.sum("n_numeric")
    g = _hours(h).groupBy(*KEYS, "hour").agg(F.when(n > 0, F.sum("total") / n).alias("avg_value"))
    return S.first_hours(g, hours)


def avg_signal_by_asset(h) -> DataFrame:
    """Q1: average of each signal by asset."""
    n = F.sum("n_numeric")
    return _hours(h).groupBy("signal", "asset").agg(F.when(n > 0, F.sum("total") / n).alias("avg_value"))


def total_over_time(h, unit: str = "day") -> DataFrame:
    """Q3: total of each signal per day (or hour)."""
    g = _hours(h).groupBy(*KEYS, trunc_ntz(unit, F.col("hour")).alias("period"))
    return g.agg(F.when(F.sum("n_numeric") > 0, F.sum("total")).alias("total_value"), F.sum("n").alias("readings"))


def data_dictionary(h) -> DataFrame:
    """L4: the dictionary with each signal's range, number of readings and first reading."""
    st = _hours(h, numeric=False).groupBy(*KEYS).agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("n").alias("readings"))
    first = S.best_row(_tails(h, "first", numeric=False), KEYS, F.asc("ts"), F.asc("row_id"))
    st = st.join(first.select(*KEYS, F.col("numeric_value").alias("example_value")), KEYS)
    return EV.dictionary_of(h, EV.described(h), st)


def latest_reading(h) -> DataFrame:
    """Q6: latest reading of every signal (ties by row id)."""
    last = S.best_row(_tails(h, "all", 1, numeric=False), KEYS, F.desc("ts"), F.desc("row_id"))
    return last.select(*KEYS, "ts", "numeric_value", F.when(F.col("numeric_value").isNull(), F.col("raw_value")).alias("string_value"))


def trend_summary(h, rows: int = TAIL) -> DataFrame:
    """Min / max / mean / sample std of the latest ``rows`` readings (500 at most)."""
    return S.tail_summary(G.last_n(_tails(h, "all", rows), rows))


def forecast(h, horizon=None) -> DataFrame:
    """Forecast every numeric signal from the stored tails."""
    kinds = [_tails(h, "all", G.TRAIN_ROWS + 1).withColumn("_kind", F.lit("all")), _tails(h, "numeric", NUMERIC_TAIL).withColumn("_kind", F.lit("numeric"))]
    rows = kinds[0].unionByName(kinds[1])
    k = F.row_number().over(W.partitionBy(*KEYS, "_kind").orderBy(F.desc("ts"), F.desc("row_id")))
    rows = rows.withColumn("_k", k).where(F.col("_k") <= F.when(F.col("_kind") == "all", G.TRAIN_ROWS + 1).otherwise(G.TRAIN_ROWS))
    return G.forecast_of(G.gathered(rows), horizon)
