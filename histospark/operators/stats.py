"""Volumes, KPIs, trends, top-k and the advertised sample questions
(E3–E14, E16–E19, H1–H4, Q1–Q6).

Everything is a grouped aggregation (partial + final), a per-key
``row_number`` limit (partial WindowGroupLimit) or a global top-k
(TakeOrderedAndProject). Windows without ``partitionBy`` appear only over
tables whose size is bounded by the number of feeds.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histospark.functions.timecalc import boundary_diff, trunc_ntz, ts_lit
from histospark.operators.anomaly import NUMERIC_TYPES
from histospark.operators.metadata import AGGREGATES
from histospark.operators.readings import feed_readings, resolve_signal, streams_of, unified_readings

STALE_HOURS = 48
TREND_HOURS = 48
TREND_ROWS = 500
TOP_ASSETS = 4
BUNDLE_PAGE = 1000  # names in one list
RECENT_ANOMALIES = 5000  # rows of the newest-first list, where the list is the result
RECENT_EVENTS = 20


def numeric_only(h) -> DataFrame:
    return h.streams.where(F.col("data_type").isin(NUMERIC_TYPES))


def feed_timestamps(h) -> DataFrame:
    """(feed, ts) of every row of every reachable feed; only ``Timestamp``
    is read from each source."""
    parts = [f.df.select(F.lit(f.name).alias("feed"), f.time.alias("ts")) for f in h.live_feeds]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else h.spark.createDataFrame([], "feed string, ts timestamp_ntz")


def feed_volume(h) -> DataFrame:
    """Rows, earliest, latest and number of signals per feed; a feed
    that cannot be read reports 0 rows."""
    v = feed_timestamps(h).groupBy("feed").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    names = h.spark.createDataFrame([(f.name,) for f in h.feeds], "feed string")
    sig = h.metadata.groupBy("feed").agg(F.count(F.lit(1)).alias("signals"))
    return (names.join(v, "feed", "left").join(sig, "feed", "left")
            .select("feed", F.coalesce("rows", F.lit(0)).alias("rows"), "earliest", "latest",
                    F.coalesce("signals", F.lit(0)).alias("signals")))


def domain_stats(meta: DataFrame) -> DataFrame:
    """Streams and distinct assets per domain."""
    return meta.groupBy("domain").agg(F.count(F.lit(1)).alias("streams"),
                                      F.count_distinct("asset").alias("assets"))


def asset_stats(meta: DataFrame, top: int | None = None) -> DataFrame:
    """E5: signals per (asset, domain), largest first; ``top`` = only the first."""
    g = meta.groupBy("asset", "domain").agg(F.count(F.lit(1)).alias("signals"))
    g = g.orderBy(F.col("signals").desc(), "asset", "domain")
    return g if top is None else g.limit(top)


def kpi_summary(meta: DataFrame) -> DataFrame:
    """Total streams, distinct assets, domains and signal names."""
    return meta.agg(F.count(F.lit(1)).alias("total_streams"), F.count_distinct("asset").alias("assets"),
                    F.count_distinct("domain").alias("domains"), F.count_distinct("signal").alias("signal_types"))


def domain_top_assets(meta: DataFrame, top: int = TOP_ASSETS) -> DataFrame:
    """Per domain the first ``top`` assets (by name) with their signal
    counts, and the domain's stream count; largest domains first."""
    g = meta.groupBy("domain", "asset").agg(F.count(F.lit(1)).alias("signals"))
    # rank filter alone -> partial (map-side) WindowGroupLimit per domain
    ranked = g.withColumn("k", F.row_number().over(W.partitionBy("domain").orderBy("asset")))
    top_assets = ranked.where(F.col("k") <= top)
    # one row per domain; domains come from a fixed keyword list (bounded)
    totals = meta.groupBy("domain").agg(F.count(F.lit(1)).alias("domain_streams"))
    return top_assets.join(F.broadcast(totals), "domain").select(
        "domain", "domain_streams", "asset", "signals", F.col("k").cast("bigint").alias("asset_rank")).orderBy(
        F.desc("domain_streams"), "domain", "asset_rank")


def hourly_trend(h, hours: int = TREND_HOURS) -> DataFrame:
    """Hourly mean per numeric signal, its first ``hours`` hours with
    readings. The readings are read once and combined to hours before anything
    is shuffled; only hours are ranked."""
    r = unified_readings(h, meta=numeric_only(h), numeric_only=True)
    g = r.groupBy("asset", "signal", trunc_ntz("hour", F.col("ts")).alias("hour")).agg(F.avg("numeric_value").alias("avg_value"))
    return first_hours(g, hours)


def first_hours(g: DataFrame, hours: int = TREND_HOURS) -> DataFrame:
    """The first ``hours`` rows of each (asset, signal) of an hourly table."""
    w = W.partitionBy("asset", "signal").orderBy("hour")
    return g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= hours).drop("k")


def trend_summary(h, rows: int = TREND_ROWS) -> DataFrame:
    """Min / max / mean / sample std of the latest ``rows`` readings."""
    from histospark.operators.forecast import last_n
    return tail_summary(last_n(unified_readings(h, meta=numeric_only(h), numeric_only=True), rows))


def tail_summary(t: DataFrame) -> DataFrame:
    return t.groupBy("asset", "signal").agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("numeric_value").alias("min_value"), F.max("numeric_value").alias("max_value"),
        F.avg("numeric_value").alias("mean_value"), F.stddev_samp("numeric_value").alias("std_value"))


def recent(df: DataFrame, n: int, *order) -> DataFrame:
    """Global top-k: every partition keeps its best n, one task merges."""
    return df.orderBy(*order).limit(n)


def recent_anomalies(anoms: DataFrame, n: int = RECENT_ANOMALIES) -> DataFrame:
    """H1: the newest ``n`` anomaly rows."""
    return recent(anoms, n, F.col("ts").desc(), "asset", "signal")


def anomaly_kpis(anoms: DataFrame, n: int | None = None) -> DataFrame:
    """Rows analysed, anomalies and distinct signals, of all rows or of
    the newest ``n``."""
    top = anoms if n is None else recent_anomalies(anoms, n)
    return top.agg(F.count(F.lit(1)).alias("rows_analyzed"), F.count_if("is_anomaly").alias("anomalies"),
                   F.count_distinct("asset", "signal").alias("signals_analyzed"))


def anomaly_counts(anoms: DataFrame) -> DataFrame:
    """Scored rows and anomalies per (asset, signal)."""
    return anoms.groupBy("asset", "signal").agg(F.count(F.lit(1)).alias("scored_rows"),
                                               F.count_if("is_anomaly").alias("anomalies"))


def forecast_summary(fc: DataFrame) -> DataFrame:
    """Forecast points and covered range per signal."""
    return fc.groupBy("asset", "signal").agg(F.count(F.lit(1)).alias("forecast_points"),
                                            F.min("ts").alias("forecast_from"), F.max("ts").alias("forecast_to"))


def event_usage(events: DataFrame) -> DataFrame:
    """Per event type: count, first and last event."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"),
                                            F.min("ts").alias("first_event"), F.max("ts").alias("last_event")).orderBy(
        F.desc("event_count"), "event_type")


def schema_inventory(meta: DataFrame) -> DataFrame:
    """Domain counts, distinct (asset, domain) and distinct signals as
    one tagged list."""
    d = meta.groupBy("domain").agg(F.count(F.lit(1)).alias("streams")).select(
        F.lit("domain").alias("section"), F.col("domain").alias("name"), F.col("domain"), "streams")
    a = meta.select("asset", "domain").distinct().select(
        F.lit("asset").alias("section"), F.col("asset").alias("name"), "domain", F.lit(None).cast("bigint").alias("streams"))
    s = meta.select("signal").distinct().select(
        F.lit("signal").alias("section"), F.col("signal").alias("name"), F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("bigint").alias("streams"))
    return d.unionByName(a).unionByName(s).orderBy(
        F.array_position(F.array(F.lit("domain"), F.lit("asset"), F.lit("signal")), F.col("section")), F.desc_nulls_last("streams"), "name", "domain")


def feed_freshness(h, as_of: _dt.datetime, stale_hours: int = STALE_HOURS) -> DataFrame:
    """Per feed with metadata: latest ts, hours stale (hour boundaries
    crossed up to ``as_of``), stale flag; no data -> -1, never stale; data
    after ``as_of`` -> 0. Fleet maxima are a window over this per-feed table
    (one row per feed)."""
    latest = feed_timestamps(h).groupBy("feed").agg(F.max("ts").alias("latest"))
    feeds = h.metadata.select("feed").distinct()
    j = feeds.join(latest, "feed", "left")
    hours = F.coalesce(F.greatest(boundary_diff("hour", F.col("latest"), ts_lit(as_of)), F.lit(0).cast("bigint")), F.lit(-1).cast("bigint"))
    j = j.select("feed", "latest", hours.alias("hours_stale"))
    w = W.partitionBy(F.lit(1))  # one row per feed
    return j.select("feed", "latest", "hours_stale", (F.col("hours_stale") > stale_hours).alias("is_stale"),
                    F.max("hours_stale").over(w).alias("fleet_max_hours"),
                    F.floor(F.max("hours_stale").over(w) / 24).alias("fleet_max_days"))


def bundle_lists(h) -> DataFrame:
    """Every stream of every feed and whether it carries numeric
    readings (bundled): one row per stream, whatever their number. One boolean
    per stream is aggregated; the readings are not joined, and not read at all
    where a readings store keeps the counts."""
    if h.store is not None:
        return h.store.streams().select("feed", "stream", (F.col("n_numeric") > 0).alias("bundled"))
    parts = [p for p in (feed_readings(f) for f in h.live_feeds) if p is not None]
    streams = h.streams.select("feed", "stream")
    if not parts:
        return streams.withColumn("bundled", F.lit(False))
    r = reduce(lambda a, b: a.unionByName(b), parts)
    per = r.groupBy("feed", "stream").agg(F.max(F.col("numeric_value").isNotNull()).alias("bundled"))
    return streams.join(per, ["feed", "stream"], "left").select("feed", "stream", F.coalesce("bundled", F.lit(False)).alias("bundled"))


def bundle_summary(h, page: int = BUNDLE_PAGE) -> DataFrame:
    """Per feed and kind (bundled or not) the number of streams and their
    names as comma lists, in name order, ``page`` names a list: one row per
    list, so that no list grows with the feed."""
    rows = bundle_lists(h)
    w = W.partitionBy("feed", "bundled")
    rows = rows.withColumn("page", F.floor((F.row_number().over(w.orderBy("stream")) - 1) / page)).withColumn("streams", F.count(F.lit(1)).over(w))
    return rows.groupBy("feed", "bundled", "streams", "page").agg(F.array_join(F.array_sort(F.collect_list("stream")), ",").alias("names"))


def signal_query(h, asset: str, signal: str, agg: str = "AVG", days: int | None = None) -> DataFrame:
    """One aggregate (AVG, SUM, MIN, MAX, COUNT, STDDEV) of one signal, over
    all history or the last ``days``; only that signal's streams are read."""
    meta = resolve_signal(h, asset, signal)
    r = unified_readings(h, days=days, meta=meta, streams_by_feed=streams_of(meta))
    return r.agg(AGGREGATES[agg.upper()]("numeric_value").cast("double").alias("value"), F.count(F.lit(1)).alias("readings")).select(
        F.lit(asset).alias("asset"), F.lit(signal).alias("signal"), F.lit(agg.upper()).alias("agg"), "value", "readings")


# --- step logs over the event table ------------------------------------------
STEP_TYPES = ["click", "view", "purchase", "signup", "error"]
FAILED_STEP = "error"


def step_status(events: DataFrame, steps: list[str] = STEP_TYPES) -> DataFrame:
    """Every expected step of every entity, left-joined to what happened;
    missing -> PENDING, failed -> ERROR; first and last time per step. The
    expected list is a literal array exploded per entity (bounded fan-out)."""
    done = events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    ents = events.select("user_id").distinct()
    grid = ents.select("user_id", F.explode(F.array(*[F.lit(s) for s in steps])).alias("event_type"))
    j = grid.join(done, ["user_id", "event_type"], "left")
    status = (F.when(F.col("n").isNull(), "PENDING").when(F.col("event_type") == FAILED_STEP, "ERROR")
              .otherwise("COMPLETE"))
    return j.select("user_id", F.col("event_type").alias("step"), status.alias("status"),
                    F.coalesce("n", F.lit(0)).alias("events"), "first_ts", "last_ts")


def step_rollup(events: DataFrame, steps: list[str] = STEP_TYPES) -> DataFrame:
    """Per entity, done and failed step counts and the overall status
    by priority ERROR > RUNNING > COMPLETE > PARTIAL > NOT_STARTED."""
    st = step_status(events, steps)
    expected = len([s for s in steps if s != FAILED_STEP])
    g = st.groupBy("user_id").agg(F.count_if(F.col("status") == "COMPLETE").alias("done_steps"),
                                  F.count_if(F.col("status") == "ERROR").alias("failed_steps"),
                                  F.count_if(F.col("status") == "RUNNING").alias("running_steps"))
    status = (F.when(F.col("failed_steps") > 0, "ERROR").when(F.col("running_steps") > 0, "RUNNING")
              .when(F.col("done_steps") == expected, "COMPLETE").when(F.col("done_steps") > 0, "PARTIAL")
              .otherwise("NOT_STARTED"))
    return g.select("user_id", "done_steps", "failed_steps", status.alias("status"))


def latest_step_log(events: DataFrame) -> DataFrame:
    """The latest row per (entity, step), ties broken by event id."""
    keys = ["user_id", "event_type"]
    rows = events.select(*keys, "event_id", "ts", "value").where("ts IS NOT NULL AND event_id IS NOT NULL")
    return best_row(rows, keys, F.desc("ts"), F.desc("event_id"))


def best_row(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in ``order``: ``row_number() = 1`` is limited
    before the shuffle, so that a task sends one row a key, the source is read
    once, and nothing is joined back."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """H2: the newest ``n`` events."""
    return recent(events, n, F.col("ts").desc(), F.col("event_id").desc()).select(
        "event_id", "ts", "event_type", "user_id", "props")


# --- sample questions -----------------------------------------------------------
def avg_signal_by_asset(h) -> DataFrame:
    """Q1: average of each signal by asset."""
    r = unified_readings(h, meta=numeric_only(h), numeric_only=True)
    return r.groupBy("signal", "asset").agg(F.avg("numeric_value").alias("avg_value"))


def top_asset_for_signal(h) -> DataFrame:
    """Q2: per signal name, the asset holding the highest reading."""
    r = unified_readings(h, meta=numeric_only(h), numeric_only=True).where(F.col("numeric_value").isNotNull())
    # ties: the last asset, then the latest time
    top = best_row(r.select("signal", "asset", "numeric_value", "ts"), ["signal"], F.desc("numeric_value"), F.desc("asset"), F.desc("ts"))
    return top.select("signal", "asset", F.col("numeric_value").alias("max_value"), "ts")


def total_over_time(h, unit: str = "day") -> DataFrame:
    """Q3: total of each signal per day (or hour)."""
    r = unified_readings(h, meta=numeric_only(h), numeric_only=True)
    return r.groupBy("asset", "signal", trunc_ntz(unit, F.col("ts")).alias("period")).agg(
        F.sum("numeric_value").alias("total_value"), F.count(F.lit(1)).alias("readings"))


def quality_issue_count(h) -> DataFrame:
    """Q4: questionable readings per feed and signal."""
    r = unified_readings(h)
    return r.groupBy("feed", "asset", "signal").agg(
        F.count_if(F.col("is_questionable")).alias("questionable"), F.count(F.lit(1)).alias("readings"))


def compare_assets(h, domain: str, unit: str = "hour") -> DataFrame:
    """Q5, long form for any number of assets: mean per (signal, period, asset)."""
    meta = numeric_only(h).where(F.col("domain") == domain)
    r = unified_readings(h, meta=meta, numeric_only=True)
    return r.groupBy("signal", trunc_ntz(unit, F.col("ts")).alias("period"), "asset").agg(F.avg("numeric_value").alias("avg_value"))


def compare_across_assets(h, domain: str, assets: list[str], unit: str = "hour") -> DataFrame:
    """Q5: each signal of ``domain`` side by side for the given assets (one
    column per asset; explicit pivot values, so no extra job)."""
    meta = numeric_only(h).where(F.col("domain") == domain)
    r = unified_readings(h, meta=meta, numeric_only=True)
    p = r.groupBy("signal", trunc_ntz(unit, F.col("ts")).alias("period")).pivot("asset", assets).agg(
        F.avg("numeric_value"))
    return p.select("signal", "period", *[F.col(f"`{a}`").alias(a) for a in assets])


def latest_reading(h) -> DataFrame:
    """Q6: latest reading of every signal (ties by row id)."""
    r = unified_readings(h).select("asset", "signal", "ts", "row_id", "numeric_value", "string_value")
    keys = ["asset", "signal"]
    last = best_row(r.where("ts IS NOT NULL"), keys, F.desc("ts"), F.desc("row_id"))
    return last.select(*keys, "ts", "numeric_value", "string_value")
