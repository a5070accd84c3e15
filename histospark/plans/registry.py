"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs one operator of the library over the fixture feeds built from
the whole driver tables (no subsets); the SQL twin of every entry lives in
:mod:`histospark.plans.oracle`. Column names are aliased identically.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from histospark.context import Historian
from histospark.functions.names import round6
from histospark.operators import anomaly as A
from histospark.operators import metadata as M
from histospark.operators import readings as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, as the SQL twins do; the operators return full doubles."""
    return df.select(*[round6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str):
    def deco(fn: Callable[[Historian], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: rounded(_fn(Historian.for_fixtures(spark, sf_dir)))
        return fn
    return deco


# --- B: metadata -------------------------------------------------------------
@query("stream_metadata")
def q_stream_metadata(h: Historian) -> DataFrame:
    return h.metadata.select(*M.PUBLIC_COLUMNS)


# --- B17/B18: readings ------------------------------------------------------
_READ_OUT = ["feed", "stream", "asset", "signal", "domain", "unit", "ts", "numeric_value", "string_value",
             "is_questionable", "row_id"]


@query("unified_readings")
def q_unified_readings(h: Historian) -> DataFrame:
    return R.unified_readings(h).select(*_READ_OUT)


@query("readings_table")
def q_readings_table(h: Historian) -> DataFrame:
    """The unified readings, read from the table by feed and day."""
    own = Historian(h.spark, h._sources, sf_dir=h.sf_dir)
    own.materialise(unit="year")
    return R.unified_readings(own).select(*_READ_OUT)


@query("string_readings")
def q_string_readings(h: Historian) -> DataFrame:
    return (R.unified_readings(h).where(F.col("string_value").isNotNull())
            .select("feed", "asset", "signal", "ts", "string_value", "row_id"))


# --- F: windows / anomalies ---------------------------------------------------
@query("detect_anomalies")
def q_detect_anomalies(h: Historian) -> DataFrame:
    return _anomalies(h)


@query("rolling_stats")
def q_rolling_stats(h: Historian) -> DataFrame:
    r = R.unified_readings(h, numeric_only=True).where(F.col("data_type").isin(A.NUMERIC_TYPES))
    rolled = A.rolling_stats(r.select("asset", "signal", "ts", "row_id", "numeric_value", "n_readings"),
                             ["asset", "signal"], h=h)
    return rolled.select("asset", "signal", "ts", "row_id",
                         F.col("rolling_avg").alias("rolling_avg"),
                         F.col("rolling_std").alias("rolling_std"))


@query("signal_stats")
def q_signal_stats(h: Historian) -> DataFrame:
    return A.signal_window_stats(h, lookback=7, as_of=h.feed_max_ts())


@query("anomaly_candidates")
def q_anomaly_candidates(h: Historian) -> DataFrame:
    return A.anomaly_candidates(h, lookback=7, as_of=h.feed_max_ts())


# --- E2, E15, F3, F4, G: series, gaps, forecasts ----------------------------
from histospark.operators import forecast as G  # noqa: E402


@query("series_profile")
def q_series_profile(h: Historian) -> DataFrame:
    return G.series_profile(G.numeric_readings(h))


@query("reading_gaps")
def q_reading_gaps(h: Historian) -> DataFrame:
    return G.reading_gaps(G.numeric_readings(h), h).select("asset", "signal", "ts", "row_id", "gap_minutes")


@query("last_n_readings")
def q_last_n_readings(h: Historian) -> DataFrame:
    t = G.last_n(G.numeric_readings(h), G.TRAIN_ROWS)
    return t.select("asset", "signal", "ts", "row_id", "numeric_value", F.col("k").cast("bigint").alias("recency_rank"))


@query("sampling_interval")
def q_sampling_interval(h: Historian) -> DataFrame:
    return G.sampling_interval(G.numeric_readings(h))


@query("holt_fit")
def q_holt_fit(h: Historian) -> DataFrame:
    f = G.holt_fit(G.numeric_readings(h))
    return f.select("asset", "signal", "train_rows", "last_ts", F.col("level").alias("level"),
                    F.col("trend").alias("trend"), F.col("residual_std").alias("residual_std"))


@query("forecast_steps")
def q_forecast_steps(h: Historian) -> DataFrame:
    iv = G.sampling_interval(G.numeric_readings(h))
    return iv.select("asset", "signal", "interval_minutes",
                     G.forecast_steps(F.col("interval_minutes"), G.DEFAULT_HORIZON_DAYS).alias("steps"))


@query("forecast_signal")
def q_forecast_signal(h: Historian) -> DataFrame:
    return G.forecast(h, horizon=7)


@query("auto_forecast_signal")
def q_auto_forecast_signal(h: Historian) -> DataFrame:
    return G.auto_forecast(h, horizon=7)


@query("data_sufficiency")
def q_data_sufficiency(h: Historian) -> DataFrame:
    return G.data_sufficiency(h, lookback=7, as_of=h.feed_max_ts())


# --- E, H, Q: aggregates, top-k, sample questions -----------------------------
from histospark.operators import catalog as C  # noqa: E402
from histospark.operators import stats as S  # noqa: E402
from histospark.sources.fixtures import table  # noqa: E402


def _events(h: Historian) -> DataFrame:
    return table(h.spark, h.sf_dir, "events")


def _anomalies(h: Historian) -> DataFrame:
    """Last week of each feed: the fixture feeds end years apart."""
    return A.detect_anomalies(h, lookback=7, as_of=h.feed_max_ts())


@query("feed_volume")
def q_feed_volume(h): return S.feed_volume(h)


@query("domain_stats")
def q_domain_stats(h): return S.domain_stats(h.metadata)


@query("asset_stats")
def q_asset_stats(h): return S.asset_stats(h.metadata)


@query("kpi_summary")
def q_kpi_summary(h): return S.kpi_summary(h.metadata)


@query("domain_top_assets")
def q_domain_top_assets(h): return S.domain_top_assets(h.metadata)


@query("hourly_trend")
def q_hourly_trend(h): return S.hourly_trend(h)


@query("trend_summary")
def q_trend_summary(h): return S.trend_summary(h)


@query("anomaly_kpis")
def q_anomaly_kpis(h): return S.anomaly_kpis(_anomalies(h))


@query("anomaly_counts")
def q_anomaly_counts(h): return S.anomaly_counts(_anomalies(h))


@query("forecast_summary")
def q_forecast_summary(h): return S.forecast_summary(G.forecast(h, horizon=7))


@query("event_usage")
def q_event_usage(h): return S.event_usage(_events(h))


@query("schema_inventory")
def q_schema_inventory(h): return S.schema_inventory(h.metadata)


FRESHNESS_AS_OF = _dt.datetime(2024, 1, 31)


@query("feed_freshness")
def q_feed_freshness(h): return S.feed_freshness(h, FRESHNESS_AS_OF)


@query("bundle_lists")
def q_bundle_lists(h): return S.bundle_lists(h)


@query("step_status")
def q_step_status(h): return S.step_status(_events(h))


@query("step_rollup")
def q_step_rollup(h): return S.step_rollup(_events(h))


@query("latest_step_log")
def q_latest_step_log(h): return S.latest_step_log(_events(h))


@query("recent_anomalies")
def q_recent_anomalies(h): return S.recent_anomalies(_anomalies(h))


@query("recent_events")
def q_recent_events(h): return S.recent_events(_events(h))


@query("ordered_metadata")
def q_ordered_metadata(h):
    return h.metadata.select(*M.PUBLIC_COLUMNS).orderBy("domain", "asset", "signal")


@query("distinct_streams")
def q_distinct_streams(h):
    """Streams of every feed (read from the data), (asset, domain) pairs and signal names."""
    none = F.lit(None).cast("string")
    streams = _cands(h).select(F.lit("stream").alias("kind"), "feed", F.col("stream").alias("name"), none.alias("domain"))
    assets = h.metadata.select(F.lit("asset").alias("kind"), none.alias("feed"), F.col("asset").alias("name"), "domain").distinct()
    signals = h.metadata.select(F.lit("signal").alias("kind"), none.alias("feed"), F.col("signal").alias("name"), none.alias("domain")).distinct()
    return streams.unionByName(assets).unionByName(signals)


@query("avg_signal_by_asset")
def q_avg_signal_by_asset(h): return S.avg_signal_by_asset(h)


@query("top_asset_for_signal")
def q_top_asset_for_signal(h): return S.top_asset_for_signal(h)


@query("total_over_time")
def q_total_over_time(h): return S.total_over_time(h, "day")


@query("quality_issue_count")
def q_quality_issue_count(h): return S.quality_issue_count(h)


COMPARE_DOMAIN = "rotating_machinery"


@query("compare_across_assets")
def q_compare_across_assets(h):
    assets = sorted(r["asset"] for r in h.metadata.where(F.col("domain") == COMPARE_DOMAIN)
                    .select("asset").distinct().collect())
    return S.compare_across_assets(h, COMPARE_DOMAIN, assets)


@query("latest_reading")
def q_latest_reading(h): return S.latest_reading(h)


# --- C, J: catalog filters and joins ----------------------------------------------
@query("metadata_filter")
def q_metadata_filter(h):
    return C.metadata_filter(h.metadata, ["rotating_machinery", "general"]).select(*M.PUBLIC_COLUMNS)


@query("numeric_signals")
def q_numeric_signals(h): return C.numeric_signals(h.metadata).select(*M.PUBLIC_COLUMNS)


# Access pattern per market segment (fixed demo mapping for the entitlement join).
SEGMENT_PATTERNS = [("AUTOMOBILE", "wind%"), ("MACHINERY", "rotating%"), ("BUILDING", "%"),
                    ("FURNITURE", "process%"), ("HOUSEHOLD", "%_single")]


@query("entitled_feeds")
def q_entitled_feeds(h):
    cust = table(h.spark, h.sf_dir, "customer")
    pats = h.spark.createDataFrame(SEGMENT_PATTERNS, "c_mktsegment string, view_pattern string")
    acc = cust.join(F.broadcast(pats), "c_mktsegment").select(F.col("c_name").alias("account"), "view_pattern")
    return C.entitled_feeds(h, acc).select("account", "view_pattern", "feed")


@query("resolve_signal_join")
def q_resolve_signal_join(h): return C.resolve_signal_join(h)


@query("domain_lookup")
def q_domain_lookup(h): return C.domain_lookup(h)


@query("hierarchy_signals")
def q_hierarchy_signals(h): return C.hierarchy_signals(M.asset_hierarchy(h.metadata), h.metadata)


@query("queryable_feeds")
def q_queryable_feeds(h): return C.queryable_feeds(h)


@query("missing_keys")
def q_missing_keys(h):
    """Required state keys that are missing, and signals that fell silent."""
    state = HL.missing_state_keys(_stored_state(h)).select(F.lit("state").alias("kind"), "key", F.lit(None).cast("string").alias("asset"))
    silent = C.silent_signals(h, 7).select(F.lit("signal").alias("kind"), F.col("signal").alias("key"), "asset")
    return state.unionByName(silent)


@query("history_forecast_align")
def q_history_forecast_align(h):
    return C.history_forecast_align(G.numeric_readings(h), G.forecast(h, horizon=7))


@query("asset_hierarchy")
def q_asset_hierarchy(h): return M.asset_hierarchy(h.metadata)


# --- B: parsing views over data-derived names -----------------------------------
from histospark.functions import names as N  # noqa: E402
from histospark.operators import events as EV  # noqa: E402
from histospark.operators import health as HL  # noqa: E402
from histospark.operators import tables as TB  # noqa: E402
from histospark.sources.fixtures import LONG_FEED, fixture_feeds  # noqa: E402


def _cands(h):
    return M.stream_candidates(h.spark, h.feeds)


@query("clean_signal_name")
def q_clean_signal_name(h):
    return _cands(h).select("feed", "stream", N.clean_signal_name(F.col("stream")).alias("clean_name"))


@query("parse_long_field")
def q_parse_long_field(h):
    c = _cands(h).where(F.col("format") == "LONG")
    a, s = N.parse_long_field(F.col("stream"), F.col("feed"))
    return c.select("feed", "stream", a.alias("asset"), s.alias("signal"))


@query("parse_wide_column")
def q_parse_wide_column(h):
    c = M.stream_candidates(h.spark, h.feeds, volumes=True).where(F.col("format") == "WIDE")
    a, s = N.parse_wide_column(F.col("stream"), F.col("feed"))
    return c.select("feed", "stream", a.alias("asset"), s.alias("signal"), F.col("n_readings").alias("feed_rows"))


@query("extract_unit")
def q_extract_unit(h):
    return _cands(h).select("feed", "stream", N.extract_unit(F.col("stream")).alias("unit"))


@query("clean_alias")
def q_clean_alias(h):
    return _cands(h).select("feed", "stream", N.clean_alias(F.col("stream")).alias("alias"))


@query("domain_classify")
def q_domain_classify(h):
    return _cands(h).select("feed", "stream", "asset", "signal",
                            N.domain_of(F.col("asset"), F.col("signal")).alias("domain"))


@query("dedupe_signals")
def q_dedupe_signals(h):
    return h.metadata.select("feed", "stream", "asset", "signal", "data_type")


@query("domain_distribution")
def q_domain_distribution(h): return M.domain_distribution(h.metadata)


@query("numeric_coercion")
def q_numeric_coercion(h):
    r = R.unified_readings(h)  # every feed shape
    return r.select("feed", "stream", "row_id", "numeric_value", F.col("numeric_value").isNotNull().alias("is_numeric"))


@query("semantic_model")
def q_semantic_model(h):
    return M.semantic_model(h.spark, h.feeds, h.metadata).select(
        "feed", "table_alias", "column_name", "alias", "role", "unit", "comment")


WIDE_FACTS = ["ACTIVE_POWER_10_MIN_ROLLING_AVG", "EXPECTED_POWER", "REVENUE_MONTHLY", "BL1_ACT"]


@query("semantic_select")
def q_semantic_select(h):
    model = M.semantic_model(h.spark, h.feeds, h.metadata)
    return M.semantic_select(h, model, "WINDTURBINE_FIXED_2603", WIDE_FACTS, ["STATE"])


@query("event_payload")
def q_event_payload(h): return EV.event_payload(_events(h))


# Code normalisation: group hint and the list of valid codes (demo reference list).
PRIORITY_HINT = "PRIO"
VALID_PRIORITY_CODES = ["PRIO_1-URGENT", "PRIO_2-HIGH", "PRIO_3-MEDIUM", "PRIO_4-NOT_SPECIFIED"]


@query("normalise_code")
def q_normalise_code(h):
    o = table(h.spark, h.sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    code = N.normalise_code(F.col("o_orderpriority"), F.lit(PRIORITY_HINT))
    valid = h.spark.createDataFrame([(c,) for c in VALID_PRIORITY_CODES], "code string")
    x = o.select("o_orderkey", F.col("o_orderpriority").alias("raw_code"), code.alias("code"))
    j = x.join(F.broadcast(valid.withColumn("is_valid", F.lit(True))), "code", "left")
    return j.select("o_orderkey", "raw_code", "code", F.concat(F.lit("PUBLIC."), F.col("code")).alias("full_code"),
                    F.split_part(F.col("code"), F.lit("_"), F.lit(1)).alias("code_group"),
                    F.coalesce("is_valid", F.lit(False)).alias("is_valid"))


@query("validate_key")
def q_validate_key(h):
    c = table(h.spark, h.sf_dir, "customer").select("c_custkey", "c_name")
    reason = N.validate_key_reason(F.col("c_name"))
    return c.select("c_custkey", "c_name", reason.isNull().alias("is_valid"), reason.alias("reason"))


# --- A: sources, sinks, table maintenance -----------------------------------------
@query("feed_registry")
def q_feed_registry(h): return HL.feed_registry(h)


@query("feed_column_profile")
def q_feed_column_profile(h): return HL.feed_column_profile(h)


@query("feed_bundle_status")
def q_feed_bundle_status(h):
    srcs = dict(fixture_feeds(h.spark, h.sf_dir))
    srcs["missing_feed"] = f"{h.sf_dir}/missing_feed.parquet"
    return HL.feed_bundle_status(h.spark, srcs).select("feed", "feed_ord", "status",
                                                       F.col("error").isNotNull().alias("has_error"))


@query("feed_preview")
def q_feed_preview(h):
    return HL.feed_preview(h.feed(LONG_FEED), 100).select(
        "Timestamp", "Field", F.col("Value").try_cast("double").alias("Value"), "Name", "Uom", "row_id")


def _results(h):
    return TB.as_results(_anomalies(h)).unionByName(TB.as_results(G.forecast(h, horizon=7)))


REPLACED_ASSET = "GE01"


@query("result_store_replace")
def q_result_store_replace(h):
    meta = h.streams.where(F.col("asset") == REPLACED_ASSET).where(F.col("data_type").isin(A.NUMERIC_TYPES))
    return TB.result_store_replace(h.spark, _results(h), G.forecast(h, horizon=14, meta=meta))


@query("export_csv")
def q_export_csv(h):
    return TB.export_csv(h.spark, G.forecast(h, horizon=7))


def _state(h):
    return HL.app_state(h, M.semantic_model(h.spark, h.feeds, h.metadata))


def _stored_state(h):
    """State as it was stored before the last feed came and before the
    semantic model was made: the checks see a drift and a missing key."""
    feeds = fixture_feeds(h.spark, h.sf_dir)
    return HL.app_state(Historian(h.spark, {k: feeds[k] for k in list(feeds)[:-1]}, sf_dir=h.sf_dir))


@query("state_upsert")
def q_state_upsert(h):
    previous = h.spark.createDataFrame([("STREAM_COUNT", "0"), ("METADATA_DISCOVERED", "FALSE"),
                                        ("LAST_ERROR", "none")], "key string, value string")
    return TB.state_upsert(previous, _state(h).withColumn("seq", F.lit(1))).select("key", "value")


CONFIG_DEFAULTS = [("VIEW_PATTERN", "%"), ("ACCESS_REGION", "PUBLIC.AWS_US_WEST_2"), ("STREAM_COUNT", "0")]


@query("seed_if_absent")
def q_seed_if_absent(h):
    defaults = h.spark.createDataFrame(CONFIG_DEFAULTS, "key string, value string")
    return TB.seed_if_absent(_state(h), defaults).select("key", "value")


@query("append_log")
def q_append_log(h):
    rows = _events(h).select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("COMPLETE").alias("status"),
        F.col("ts").alias("step_ts"), "event_id")
    return TB.append_log(h.spark, rows, times=2).select("entity", "step", "status", "step_ts", "event_id")


@query("reset_keys")
def q_reset_keys(h):
    store = TB.result_store(h.spark)
    TB.store_results(h.spark, _results(h), store.path)
    return TB.reset_keys(store, F.col("asset") == REPLACED_ASSET)


CONSUMER = "CONSUMER_ACCOUNT_1"


@query("share_back")
def q_share_back(h):
    """A second run leaves the same rows."""
    stored = TB.store_results(h.spark, _results(h))
    return TB.share_back(h.spark, stored, CONSUMER, runs=2)


@query("share_back_counts")
def q_share_back_counts(h):
    """Counted in the consumer's copy, the one place where the results are written."""
    return TB.share_back_counts(TB.share_back(h.spark, _results(h), CONSUMER))


# --- C1, C2, C4, L ------------------------------------------------------------------
SIGNAL_ROWS = 500


@query("signal_readings")
def q_signal_readings(h):
    r = R.unified_readings(h)
    t = G.last_n(r, SIGNAL_ROWS)
    return t.select("asset", "signal", "ts", F.col("numeric_value").alias("numeric_value"), "row_id")


ONE_SIGNAL = ("GE01", "Expected Power")


@query("one_signal_readings")
def q_one_signal_readings(h):
    """C1 itself: one resolved signal, all of its readings, newest first."""
    return R.signal_readings(h, *ONE_SIGNAL, limit=None)


@query("signal_query")
def q_signal_query(h):
    return S.signal_query(h, *ONE_SIGNAL, agg="MAX")


@query("semantic_select_long")
def q_semantic_select_long(h):
    """B16 on the long table: largest value per field."""
    model = M.semantic_model(h.spark, h.feeds, h.metadata)
    return M.semantic_select(h, model, "ROTATINGMACHINE_FIXED_26Q1", ["SENSOR_VALUE"], ["FIELD"], agg="MAX")


@query("compare_assets")
def q_compare_assets(h): return S.compare_assets(h, COMPARE_DOMAIN)


@query("lookback_filter")
def q_lookback_filter(h):
    r = R.unified_readings(h, days=R.lookback_days(None), as_of=h.feed_max_ts())
    return r.select("feed", "asset", "signal", "ts", "numeric_value", "row_id")


@query("dictionary_search")
def q_dictionary_search(h): return EV.data_dictionary(h, search="pressure")


@query("data_dictionary")
def q_data_dictionary(h): return EV.data_dictionary(h)


@query("log_events")
def q_log_events(h): return EV.log_events(table(h.spark, h.sf_dir, "conversations"))


@query("redact_text")
def q_redact_text(h): return EV.redact_text(table(h.spark, h.sf_dir, "documents"))


@query("redaction_counts")
def q_redaction_counts(h): return EV.redaction_counts(table(h.spark, h.sf_dir, "documents"))


@query("health_check")
def q_health_check(h):
    sem = M.semantic_model(h.spark, h.feeds, h.metadata)
    return HL.health_check(h, _stored_state(h), sem, S.feed_freshness(h, FRESHNESS_AS_OF))


# --- A7: streaming ingest, the readings store and its summaries -------------------------
from histospark.operators import summaries as SM  # noqa: E402
from histospark.session import workspace_dir  # noqa: E402
from histospark.sources.fixtures import CLASSIC_FEED, WIDE_FEED, classic_feed_of, long_feed_of, wide_feed_of  # noqa: E402
from histospark.sources.readings_store import ReadingsStore  # noqa: E402
from histospark.streaming.ingest import incremental_ingest, read_ingested  # noqa: E402


@query("incremental_ingest")
def q_incremental_ingest(h):
    path, ckpt = incremental_ingest(h, h.sf_dir, long_feed_of, LONG_FEED, file_glob="events.parquet")
    incremental_ingest(h, h.sf_dir, long_feed_of, LONG_FEED, table_path=path, checkpoint=ckpt,
                       file_glob="events.parquet")  # a rerun adds nothing
    return read_ingested(h.spark, path).select("feed", "asset", "signal", "ts", "numeric_value", "string_value",
                                               "row_id")


_STORES: dict[tuple, Historian] = {}


def _from_store(h: Historian) -> Historian:
    """A Historian over a readings store alone, filled by the ingest with all
    three feed shapes; one per application and folder."""
    key = (h.spark.sparkContext.applicationId, h.sf_dir)
    if key not in _STORES:
        path = workspace_dir(h.spark, "readings")
        for feed, adapter, file in ((LONG_FEED, long_feed_of, "events"), (WIDE_FEED, wide_feed_of, "orders"), (CLASSIC_FEED, classic_feed_of, "events")):
            incremental_ingest(h, h.sf_dir, adapter, feed, table_path=path, file_glob=f"{file}.parquet", unit="year")
        _STORES[key] = Historian.from_store(h.spark, path, sf_dir=h.sf_dir)
    return _STORES[key]


@query("store_readings")
def q_store_readings(h): return R.unified_readings(_from_store(h)).select(*_READ_OUT)


@query("store_metadata")
def q_store_metadata(h): return _from_store(h).metadata.select(*M.PUBLIC_COLUMNS)


@query("store_one_signal")
def q_store_one_signal(h): return R.signal_readings(_from_store(h), *ONE_SIGNAL, limit=None)


@query("summary_series_profile")
def q_summary_series_profile(h): return SM.series_profile(_from_store(h))


@query("summary_feed_volume")
def q_summary_feed_volume(h): return SM.feed_volume(_from_store(h))


@query("summary_hourly_trend")
def q_summary_hourly_trend(h): return SM.hourly_trend(_from_store(h))


@query("summary_avg_by_asset")
def q_summary_avg_by_asset(h): return SM.avg_signal_by_asset(_from_store(h))


@query("summary_total_over_time")
def q_summary_total_over_time(h): return SM.total_over_time(_from_store(h), "day")


@query("summary_dictionary")
def q_summary_dictionary(h): return SM.data_dictionary(_from_store(h))


@query("summary_latest_reading")
def q_summary_latest_reading(h): return SM.latest_reading(_from_store(h))


@query("summary_trend")
def q_summary_trend(h): return SM.trend_summary(_from_store(h))


@query("summary_forecast")
def q_summary_forecast(h): return SM.forecast(_from_store(h), horizon=7)


@query("readings_table_names")
def q_readings_table_names(h):
    """Feeds whose names differ as text only: readings per feed, from the table."""
    feeds = {"01": classic_feed_of(_events(h)), "1": classic_feed_of(_events(h).where("event_id % 2 = 0"))}
    own = Historian(h.spark, feeds, sf_dir=h.sf_dir)
    own.materialise(unit="year")
    return R.unified_readings(own).groupBy("feed").agg(F.count(F.lit(1)).alias("readings"), F.sum("numeric_value").alias("total_value"))


@query("lookback_default")
def q_lookback_default(h):
    """The default window: seven days to the latest reading of any feed."""
    return R.unified_readings(h, days=R.lookback_days(None)).select("feed", "asset", "signal", "ts", "numeric_value", "row_id")


NOT_AFTER = _dt.datetime(1998, 1, 1)


@query("lookback_not_after")
def q_lookback_not_after(h):
    """The same with later times left out of the as-of and of the readings."""
    own = Historian(h.spark, h._sources, sf_dir=h.sf_dir, not_after=NOT_AFTER)
    return R.unified_readings(own, days=30).select("feed", "asset", "signal", "ts", "numeric_value", "row_id")


@query("late_feeds")
def q_late_feeds(h): return Historian(h.spark, h._sources, sf_dir=h.sf_dir, not_after=NOT_AFTER).late_feeds()


@query("bundle_summary")
def q_bundle_summary(h): return S.bundle_summary(h, page=10)


@query("stream_hourly_trend")
def q_stream_hourly_trend(h):
    from histospark.streaming.trend import read_hourly, stream_hourly_trend
    path, _, _ = stream_hourly_trend(h.spark, h.sf_dir, long_feed_of, LONG_FEED, file_glob="events.parquet")
    return read_hourly(h.spark, path)


@query("stream_anomalies")
def q_stream_anomalies(h):
    from histospark.streaming.anomalies import read_scored, stream_anomalies
    path, _ = stream_anomalies(h.spark, h.sf_dir, long_feed_of, LONG_FEED, file_glob="events.parquet")
    return read_scored(h.spark, path)


NEEDLE = "pressure value"


@query("name_search")
def q_name_search(h):
    """C4 through the trigram index: the signals whose asset.signal name contains the needle."""
    from histospark.operators.name_search import NameIndex
    names = h.metadata.select(F.concat_ws(".", "asset", "signal").alias("name"))
    return NameIndex.build(names, "name").search(NEEDLE)


@query("customer_search")
def q_customer_search(h):
    """The index over the customers' names."""
    from histospark.operators.name_search import NameIndex
    return NameIndex.build(table(h.spark, h.sf_dir, "customer"), "c_name").search("00012")
