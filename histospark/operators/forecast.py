"""Series profile, gaps, sampling interval and damped-trend forecasts
(E2, E15, F3, F4, G1–G5) for every numeric signal in one pass.

Per signal only bounded state is ever gathered: the latest 201 rows for the
sampling interval and the latest 200 numeric values for the Holt fit
(``row_number`` <= k is planned as a map-side WindowGroupLimit, so a hot
signal ships at most k rows per map partition). The recursion itself is a
SQL higher-order ``aggregate`` over that 200-element array (JVM, no UDF).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histospark.functions.timecalc import add_minutes, boundary_diff
from histospark.operators.anomaly import MIN_READINGS, NUMERIC_TYPES, signal_window
from histospark.operators.readings import streams_of, unified_readings

# Fixed model parameters (must equal the reference's).
ALPHA, BETA, PHI = 0.3, 0.1, 0.98
TRAIN_ROWS = 200
MIN_TRAIN = 5
DEFAULT_GAP_MINUTES = 60.0
BAND_Z = 1.96
DEFAULT_HORIZON_DAYS = 7
TAIL_PARTS = 32

KEYS = ["asset", "signal"]


def horizon_days(n) -> int:
    return int(n) if n is not None and n > 0 else DEFAULT_HORIZON_DAYS


def numeric_readings(h, meta: DataFrame | None = None) -> DataFrame:
    """All-history readings of numeric signals (non-null raw values)."""
    m = meta if meta is not None else h.streams.where(F.col("data_type").isin(NUMERIC_TYPES))
    targeted = streams_of(meta) if meta is not None else None  # read only the chosen streams
    return unified_readings(h, meta=m, numeric_only=True, streams_by_feed=targeted).select(
        "asset", "signal", "domain", "ts", "row_id", "numeric_value", "n_readings")


def series_profile(r: DataFrame) -> DataFrame:
    """Count, first/last ts, mean and sample stddev over all history."""
    return r.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg("numeric_value").alias("avg_value"),
        F.stddev_samp("numeric_value").alias("stddev"))


def reading_gaps(r: DataFrame, h=None) -> DataFrame:
    """minutes since the previous reading of the same signal (boundary
    count); exact lag for any series length (hot signals via chunk + halo
    of one row, see ``signal_window``)."""
    def cols(w):
        return [F.lag("ts").over(w).alias("prev_ts")]
    src = r.select(*KEYS, "ts", "row_id", *(["n_readings"] if "n_readings" in r.columns else []))
    g = signal_window(h if "n_readings" in r.columns else None, src, KEYS, 1, cols)
    return g.select(*KEYS, "ts", "row_id", "prev_ts",
                    boundary_diff("minute", F.col("prev_ts"), F.col("ts")).alias("gap_minutes"))


def last_n(r: DataFrame, n: int, value_filter: bool = False) -> DataFrame:
    """latest ``n`` rows per signal (by ts, row_id), with ``k`` = 1 for
    the newest, in two levels: every scan task sends at most n rows per signal
    (a partial WindowGroupLimit), those meet in TAIL_PARTS parts per signal,
    and only TAIL_PARTS * n rows of a signal in its last task, however many
    scan tasks there are. The parts don't influence the result."""
    src = r.where(F.col("numeric_value").isNotNull()) if value_filter else r
    order = [F.col("ts").desc(), F.col("row_id").desc()]
    src = src.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(TAIL_PARTS)))
    some = src.withColumn("k", F.row_number().over(W.partitionBy(*KEYS, "_part").orderBy(*order))).where(F.col("k") <= n).drop("k", "_part")
    return some.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy(*order))).where(F.col("k") <= n)


def median_gaps(r: DataFrame, extra: bool = False) -> DataFrame:
    """Exact median of the positive minute gaps among the latest 200 rows
    (each gap measured to its predecessor, hence 201 rows); signals without
    a positive gap have a NULL median. ``extra`` adds the tail size
    (min(readings, 201)) and the domain."""
    tail = last_n(r, TRAIN_ROWS + 1)
    w = W.partitionBy(*KEYS).orderBy(F.col("k").desc())
    gaps = tail.withColumn("gap", boundary_diff("minute", F.lag("ts").over(w), F.col("ts")))
    positive = (F.col("k") <= TRAIN_ROWS) & (F.col("gap") > 0)
    aggs = [F.median(F.when(positive, F.col("gap"))).alias("med")]
    if extra:
        aggs += [F.count(F.lit(1)).alias("n_tail")]
        return gaps.groupBy(*KEYS, "domain").agg(*aggs)
    return gaps.groupBy(*KEYS).agg(*aggs)


def both_tails(r: DataFrame) -> DataFrame:
    """One row per signal: ``times`` of its latest 201 rows and ``pts`` (ts,
    row_id, numeric_value) of its latest 200 numeric ones, in order, and the
    domain. Both tails come from one reading of the source: a numeric row
    counts once for either, and each is cut in two levels like :func:`last_n`."""
    all_rows, numeric = F.lit("all"), F.lit("numeric")
    src = r.select(*KEYS, "domain", "ts", "row_id", "numeric_value",
                   F.explode(F.when(F.col("numeric_value").isNotNull(), F.array(all_rows, numeric)).otherwise(F.array(all_rows))).alias("_kind"))
    order = [F.col("ts").desc(), F.col("row_id").desc()]
    src = src.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(TAIL_PARTS)))
    for keys in ([*KEYS, "_kind", "_part"], [*KEYS, "_kind"]):
        src = src.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= TRAIN_ROWS + 1)
    return gathered(src.where((F.col("_kind") == "all") | (F.col("_k") <= TRAIN_ROWS)))


def gathered(src: DataFrame) -> DataFrame:
    """The arrays of :func:`both_tails` from the rows of both (``_kind``)."""
    point = F.struct("ts", "row_id", "numeric_value")
    rows = lambda kind: F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, point)))
    g = src.groupBy(*KEYS).agg(F.max("domain").alias("domain"), rows("all").alias("times"), rows("numeric").alias("pts"))
    return g.withColumn("times", F.transform("times", lambda p: p["ts"]))


def positive_gaps(times: F.Column) -> F.Column:
    """The positive minute gaps between neighbours of an ordered array of times, in order of size."""
    n = F.size(times)
    gap = lambda i: F.when(i <= n, boundary_diff("minute", F.element_at(times, i - 1), F.element_at(times, i)))
    gaps = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), gap)
    return F.array_sort(F.filter(gaps, lambda g: g > 0))


def middle(gaps: F.Column) -> F.Column:
    """Median of an ordered array; NULL of an empty one."""
    m = F.size(gaps)
    at = lambda i: F.element_at(gaps, F.floor(i).cast("int"))
    return F.when(m > 0, (at((m + 1) / 2) + at(m / 2 + 1)) / F.lit(2.0))


def interval_of(med: F.Column) -> F.Column:
    return F.coalesce(med.cast("double"), F.lit(DEFAULT_GAP_MINUTES))


def sampling_interval(r: DataFrame) -> DataFrame:
    """Median positive gap per signal; none -> 60 minutes."""
    return median_gaps(r).select(*KEYS, interval_of(F.col("med")).alias("interval_minutes"))


def forecast_steps(interval: F.Column, horizon: int, max_steps: int | None = None) -> F.Column:
    """max(int(1440 / interval), 1) * horizon, so that the whole horizon is
    covered; ``max_steps`` limits it where the caller asks for that."""
    steps = F.greatest(F.floor(F.lit(1440.0) / interval), F.lit(1)) * F.lit(horizon)
    return (steps if max_steps is None else F.least(steps, F.lit(max_steps))).cast("int")


_ERR = f"(x - (a.l + {PHI}D * a.t))"
_HOLT = f"""
aggregate(slice(v, 2, size(v) - 1),
  named_struct('l', v[0], 't', CASE WHEN size(v) > 1 THEN (v[size(v) - 1] - v[0]) / (size(v) - 1) ELSE 0D END,
               'n', 0, 'm', 0D, 'q', 0D),
  (a, x) -> named_struct(
     'l', {ALPHA}D * x + (1D - {ALPHA}D) * (a.l + {PHI}D * a.t),
     't', {BETA}D * (({ALPHA}D * x + (1D - {ALPHA}D) * (a.l + {PHI}D * a.t)) - a.l) + (1D - {BETA}D) * {PHI}D * a.t,
     'n', a.n + 1,
     'm', a.m + ({_ERR} - a.m) / (a.n + 1),
     'q', a.q + ({_ERR} - a.m) * ({_ERR} - (a.m + ({_ERR} - a.m) / (a.n + 1)))))
"""

# Residuals: count, mean and sum of squared deviations are carried along.
_RSTD = "CASE WHEN fit.n > 1 THEN sqrt(fit.q / (fit.n - 1)) END"


def holt_fit(r: DataFrame) -> DataFrame:
    """G1: damped double exponential smoothing on the latest 200 numeric
    values (non-numeric rows dropped first): final level, trend, residual
    sample stddev, training size and the last training timestamp."""
    tail = last_n(r, TRAIN_ROWS, value_filter=True)
    return fitted(tail.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ts", "row_id", "numeric_value"))).alias("pts")))


def fitted(g: DataFrame, *more: str) -> DataFrame:
    """The fit of each row's ``pts`` (in order); columns ``more`` are kept."""
    g = g.select(*KEYS, *more, F.expr("transform(pts, p -> p.numeric_value)").alias("v"),
                 F.element_at("pts", -1).getField("ts").alias("last_ts"))
    fit = g.withColumn("fit", F.expr(_HOLT))
    return fit.select(*KEYS, *more, F.size("v").alias("train_rows"), "last_ts",
                      F.col("fit.l").alias("level"), F.col("fit.t").alias("trend"),
                      F.expr(_RSTD).alias("residual_std"))


def forecast(h, horizon=None, meta: DataFrame | None = None) -> DataFrame:
    """Forecast every numeric signal (or the signals of ``meta``).

    Guards: >= 12 readings over all history and >= 5 training values. For
    h = 1..steps: value = level + trend·φ(1-φ^h)/(1-φ), band ±1.96·σ·√h,
    ts = last + interval·h minutes."""
    return forecast_of(both_tails(numeric_readings(h, meta)), horizon)


def forecast_of(tails: DataFrame, horizon=None) -> DataFrame:
    """The forecast from each signal's two tails (:func:`both_tails`)."""
    hz = horizon_days(horizon)
    # The 201-row tail gives the interval and the ">= 12 readings" guard (tail
    # size = min(readings, 201) and 12 < 201), the numeric tail the fit.
    tails = tails.where((F.size("times") >= MIN_READINGS) & (F.size("pts") >= MIN_TRAIN))
    tails = tails.withColumn("gaps", positive_gaps(F.col("times"))).withColumn("med", middle(F.col("gaps")))
    base = fitted(tails, "domain", "med").withColumn("interval_minutes", interval_of(F.col("med")))
    # >= 5 training values give >= 4 residuals, so the residual std always
    # exists; the whole-series fallback of a one-residual fit cannot occur.
    sigma = F.col("residual_std")
    steps = base.select(*KEYS, F.coalesce("domain", F.lit("general")).alias("domain"), "level", "trend",
                        sigma.alias("sigma"), "last_ts", "interval_minutes",
                        F.explode(F.sequence(F.lit(1), forecast_steps(F.col("interval_minutes"), hz))).alias("step"))
    phi = F.lit(PHI)
    cum = phi * (F.lit(1.0) - F.pow(phi, F.col("step"))) / (F.lit(1.0) - phi)
    fc = F.col("level") + cum * F.col("trend")
    band = F.lit(BAND_Z) * F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    return steps.select(
        *KEYS, "domain", "step",
        add_minutes(F.col("last_ts"), F.col("interval_minutes") * F.col("step")).alias("ts"),
        fc.alias("forecast_value"), (fc - band).alias("lower_bound"),
        (fc + band).alias("upper_bound"), F.lit("FORECAST").alias("model_type"))


def auto_forecast(h, horizon=None) -> DataFrame:
    """No signal given -> the first numeric signal by name (asset breaks
    ties); the pick is a top-1 over the metadata."""
    pick = (h.metadata.where(F.col("data_type").isin(NUMERIC_TYPES))
            .orderBy("signal", "asset").limit(1).select("asset", "signal"))
    return forecast(h, horizon, meta=h.streams.join(pick, ["asset", "signal"]))


def data_sufficiency(h, lookback: int = 7, as_of=None) -> DataFrame:
    """Per numeric signal, counts against the guards of detection (12 in
    the lookback), candidates (50 in the lookback and std > 0) and forecasts
    (12 overall, 5 numeric training values)."""
    from histospark.operators.readings import lookback_days
    end = h.as_of() if as_of is None else as_of
    days = lookback_days(lookback)
    at = lambda t: F.lit(t.isoformat(sep=" ") if t is not None else None).cast("timestamp_ntz")
    if isinstance(end, dict):  # one end per feed
        start = F.element_at(F.create_map(*[x for f, t in end.items() for x in (F.lit(f), at(t))]), F.col("feed"))
    else:
        start = at(end)
    m = h.streams.where(F.col("data_type").isin(NUMERIC_TYPES))
    rr = unified_readings(h, meta=m, numeric_only=True).select(*KEYS, "ts", "numeric_value", "feed")
    in_win = F.col("ts") >= start - F.make_dt_interval(days=F.lit(days))
    g = rr.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.count("numeric_value").alias("numeric_readings"),
        F.count_if(in_win).alias("window_readings"),
        F.stddev_samp(F.when(in_win, F.col("numeric_value"))).alias("_wstd"))
    train = F.least(F.col("numeric_readings"), F.lit(TRAIN_ROWS))
    status = (F.when((F.col("window_readings") >= 50) & (F.coalesce("_wstd", F.lit(0.0)) > 0), "CANDIDATE")
              .when(F.col("window_readings") >= MIN_READINGS, "DETECTABLE")
              .when((F.col("total_readings") >= MIN_READINGS) & (train >= MIN_TRAIN), "FORECAST_ONLY")
              .otherwise("INSUFFICIENT"))
    return g.select(*KEYS, "total_readings", "numeric_readings", "window_readings",
                    (F.col("window_readings") >= MIN_READINGS).alias("can_detect"),
                    ((F.col("total_readings") >= MIN_READINGS) & (train >= MIN_TRAIN)).alias("can_forecast"),
                    status.alias("status"))
