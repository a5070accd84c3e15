"""Cases that the fixtures don't hold: huge and non-finite values, re-tagged
streams, odd schemas, silent feeds, replaced and cleared keys, private data."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histospark.context import Historian
from histospark.functions import names as N
from histospark.functions.redact import redact
from histospark.operators import anomaly as A
from histospark.operators import catalog as C
from histospark.operators import events as EV
from histospark.operators import forecast as G
from histospark.operators import health as HL
from histospark.operators import metadata as M
from histospark.operators import stats as S
from histospark.operators import tables as TB
from histospark.operators.readings import signal_readings, unified_readings

T0 = dt.datetime(2024, 1, 1)
NBSP = chr(0xA0)


def long_df(spark, rows):
    return spark.createDataFrame(rows, "Timestamp timestamp_ntz, Field string, Value string")


def minutes(n, value=lambda i: str(i % 7), field="P1.Flow"):
    return [(T0 + dt.timedelta(minutes=i), field, value(i)) for i in range(n)]


def test_large_values_are_not_clipped(spark):
    h = Historian(spark, {"f": long_df(spark, minutes(20, lambda i: "1e12") + [(T0, "P1.Big", "1e13")])})
    total = {r.signal: r.total_value for r in S.total_over_time(h).collect()}
    assert total == {"Flow": 2e13, "Big": 1e13}
    assert {r.signal: r.avg_value for r in S.avg_signal_by_asset(h).collect()}["Big"] == 1e13
    got = spark.createDataFrame([(1e13,), (-5e14,), (float("nan"),), (float("inf"),), (0.1234565,)], "v double").select(N.round6("v")).collect()
    assert got[0][0] == 1e13 and got[1][0] == -5e14 and got[2][0] != got[2][0] and got[3][0] == float("inf")


@pytest.mark.parametrize("bad", ["NaN", "Infinity", "-Infinity"])
def test_non_finite_readings_are_missing(spark, bad):
    h = Historian(spark, {"f": long_df(spark, minutes(60, lambda i: bad if i == 30 else str(i % 7)))})
    assert unified_readings(h).where("numeric_value IS NULL AND string_value IS NOT NULL").count() == 1
    assert A.detect_anomalies(h, lookback=30).where("is_anomaly").count() == 0
    wide = spark.createDataFrame([(T0 + dt.timedelta(minutes=i), float(bad) if i == 9 else float(i % 5)) for i in range(60)], "Timestamp timestamp_ntz, `GE1.P` double")
    w = Historian(spark, {"w": wide})
    assert unified_readings(w).where("numeric_value IS NOT NULL").count() == 59
    assert A.detect_anomalies(w, lookback=30).where("is_anomaly").count() == 0


def test_streams_of_one_signal_keep_their_readings(spark):
    tag = "P1.Flow.00000000-0000-0000-0000-00000000000{}"
    one = long_df(spark, minutes(3, field=tag.format(1)) + minutes(2, field=tag.format(2)))
    h = Historian(spark, {"a": one, "b": long_df(spark, minutes(4, field="P1.Flow"))})
    assert h.metadata.count() == 1 and h.streams.count() == 3
    assert unified_readings(h).count() == 9
    assert signal_readings(h, "P1", "Flow", limit=None).count() == 9


def test_columns_that_hold_no_readings(spark):
    rows = [(T0, dt.date(2024, 1, 1), 1.5, True, "on", b"x", [1], T0)]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, `A.Day` date, `A.P` double, `A.Run` boolean, `A.State` string, `A.Raw` binary, `A.List` array<int>, `A.At` timestamp_ntz")
    h = Historian(spark, {"w": df})
    assert {r.signal for r in unified_readings(h).collect()} == {"P", "Run", "State"}
    assert {r.column_name for r in HL.unsupported_columns(h).collect()} == {"A.Day", "A.Raw", "A.List", "A.At"}


def test_one_signal_reads_its_columns_only(spark, tmp_path):
    cols = ", ".join(f"CAST(id + {i} AS double) AS `A.S{i}`" for i in range(8))
    path = str(tmp_path / "wide")
    spark.sql(f"SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(id AS int)) AS Timestamp, {cols} FROM range(20)").write.parquet(path)
    h = Historian(spark, {"w": path})
    df = signal_readings(h, "A", "S3", limit=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "A.S3" in schema and "A.S4" not in schema
    assert df.count() == 20 and df.select("row_id").distinct().count() == 20


def test_unicode_blanks(spark):
    df = spark.createDataFrame([(f"Flow{NBSP}(kW){NBSP}",)], "s string")
    r = df.select(N.clean_signal_name(F.col("s")).alias("n"), N.extract_unit(F.col("s")).alias("u")).first()
    assert (r.n, r.u) == ("Flow", "kW")


def test_malformed_payloads(spark):
    df = spark.createDataFrame([(1, "a", '{"k": 3}'), (2, "a", "{bad"), (3, "b", None)], "event_id long, event_type string, props string")
    assert {r.event_id: r.k for r in EV.event_payload(df).collect()} == {1: 3, 2: None, 3: None}
    assert {r.event_type: (r.payloads, r.rejected) for r in EV.rejected_payloads(df).collect()} == {"a": (2, 1), "b": (1, 0)}


@pytest.mark.parametrize(("text", "want"), [
    ("call 555-123-4567 now", "call [PHONE] now"), ("(555) 123-4567", "[PHONE]"), ("5551234567", "[PHONE]"),
    ("+1 (017) 555-7713", "[PHONE]"), ("+44 20 7946 0958.", "[PHONE]."), ("555-123-4567 555-123-4568", "[PHONE] [PHONE]"),
    ("1 555 123 4567", "[PHONE]"), ("123-45-6789", "[SSN]"), ("1234567-89-01234", "1234567-89-01234"), ("a@b.co,c@d.org", "[EMAIL],[EMAIL]"),
    ("card 9807915762804490 ok", "card 9807915762804490 ok"), ("id 12345", "id 12345"), ("5551234567x5551234568", "[PHONE]x[PHONE]"), ("", "")])
def test_redaction(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(redact(F.col("t"))).first()[0] == want


def test_log_redacts_before_it_cuts(spark):
    text = "x" * 990 + " bob@example.com and more"
    df = spark.createDataFrame([(1, 1, "user", text), (1, 2, "user", ""), (1, 3, "user", None)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r.redacted_query for r in EV.log_events(df).collect()}
    assert "bob" not in got[1] and got[1].endswith("[EMAIL] a"[: len(got[1]) - 991]) and len(got[1]) <= 1000
    assert got[2] is None and got[3] is None


def test_aliases_take_the_first_free_suffix(spark):
    df = spark.createDataFrame([(T0, 1.0, 2.0, 3.0, 4.0)], "Timestamp timestamp_ntz, `A.x` double, `A.x_2` double, `B.x` double, `C.x_2` double")
    h = Historian(spark, {"w": df})
    model = M.semantic_model(spark, h.feeds, h.metadata)
    assert [r.alias for r in model.orderBy("column_name").where("role = 'FACT'").collect()] == ["X", "X_2", "X_3", "X_2_2"]


def test_upsert_takes_the_last_write(spark):
    cur = spark.createDataFrame([("k", "0")], "key string, value string")
    upd = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, seq int")
    for df in (upd, upd.orderBy(F.desc("seq"))):
        assert [(r.key, r.value) for r in TB.state_upsert(cur, df).collect()] == [("k", "2")]
    with pytest.raises(ValueError):
        TB.state_upsert(cur, cur)


def _result(spark, *rows):
    return TB.as_results(spark.createDataFrame([(a, s, T0, v, m) for a, s, v, m in rows], "asset string, signal string, ts timestamp_ntz, numeric_value double, model_type string"))


def test_replacing_clears_keys_without_new_rows(spark):
    start = _result(spark, ("a", "x", 1.0, "M"), ("a", "y", 2.0, "M"), (None, "z", 3.0, "M"))
    store = TB.result_store(spark)
    store.replace(start)
    keys = start.select(*store.keys)
    left = lambda: sorted((r.asset or "", r.signal, r.numeric_value) for r in store.read().collect())
    store.replace(_result(spark, ("a", "x", 9.0, "M")), keys.where("signal IN ('x', 'z')"))
    assert left() == [("a", "x", 9.0), ("a", "y", 2.0)]
    store.replace(start.limit(0), keys.where("signal = 'x'"))
    assert left() == [("a", "y", 2.0)]
    assert TB.reset_keys(store, F.col("signal") == "y").count() == 0 and store.read().count() == 0
    store.replace(start)
    assert len(left()) == 3


def test_share_back_of_an_empty_result(spark):
    from histospark.session import workspace_dir
    path = workspace_dir(spark, "share-test")
    one = _result(spark, ("a", "x", 1.0, "M"))
    assert TB.share_back(spark, one, "c1", path).count() == 1
    assert TB.share_back(spark, one, "c2", path).count() == 2
    assert {r.consumer_account for r in TB.share_back(spark, one.limit(0), "c1", path).collect()} == {"c2"}


def test_ingest_takes_streams_that_no_catalog_knows(spark, tmp_path):
    from histospark.streaming.ingest import incremental_ingest, read_ingested
    src, add = str(tmp_path / "src"), lambda rows: long_df(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    add(minutes(1))
    h = Historian(spark, {"f": spark.read.parquet(src)})
    path, ckpt = incremental_ingest(h, src, lambda d: d, "f")
    add(minutes(2, field="P2.New (bar)"))
    for _ in range(2):
        incremental_ingest(h, src, lambda d: d, "f", table_path=path, checkpoint=ckpt)
        got = read_ingested(spark, path).groupBy("asset", "signal", "unit").count().collect()
        assert {(r.asset, r.signal, r.unit): r["count"] for r in got} == {("P1", "Flow", None): 1, ("P2", "New", "bar"): 2}


def test_silent_feed_and_freshness(spark):
    old = [(t - dt.timedelta(days=5000), "P9.Old", v) for t, _, v in minutes(30)]
    h = Historian(spark, {"new": long_df(spark, minutes(30)), "old": long_df(spark, old)})
    assert {r.signal for r in unified_readings(h, days=7).collect()} == {"Flow"}
    assert [r.signal for r in C.silent_signals(h).collect()] == ["Old"]
    late = dt.datetime(2026, 6, 1)
    got = {r.feed: (r.hours_stale, r.is_stale) for r in S.feed_freshness(h, late).collect()}
    assert got["new"][0] > 20000 and all(s for _, s in got.values())
    early = {r.feed: (r.hours_stale, r.is_stale) for r in S.feed_freshness(h, dt.datetime(2020, 1, 1)).collect()}
    assert early["new"] == (0, False)


def test_health_statuses(spark):
    h = Historian(spark, {"new": long_df(spark, minutes(30)), "gone": "/nowhere/at/all"})
    state = spark.createDataFrame([("VIEW_COUNT", "1"), ("SEMANTIC_VIEW_CREATED", "TRUE")], "key string, value string")
    model = M.semantic_model(spark, h.feeds, h.metadata)
    fresh = S.feed_freshness(h, dt.datetime(2024, 1, 2))
    got = {r.check_name: r.status for r in HL.health_check(h, state, model.limit(0), fresh).collect()}
    assert got == {"shared_content_sync": "DRIFT", "app_state_keys": "MISSING", "stream_metadata": "OK", "proxy_views": "DEGRADED",
                   "semantic_view": "ERROR", "data_freshness": "OK", "overall": "DEGRADED"}
    assert {r.key for r in HL.missing_state_keys(state).collect()} == set(HL.STATE_KEYS) - {"VIEW_COUNT", "SEMANTIC_VIEW_CREATED"}
    none = state.where("key = 'VIEW_COUNT'")
    assert {r.check_name: r.status for r in HL.health_check(h, none, model.limit(0), fresh).collect()}["semantic_view"] == "SKIPPED"


def test_minute_series_is_forecast_to_its_horizon(spark):
    h = Historian(spark, {"f": long_df(spark, minutes(300))})
    r = G.forecast(h, horizon=7).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).first()
    assert r.n == 7 * 1440 and r.last == T0 + dt.timedelta(minutes=299) + dt.timedelta(days=7)


def test_refresh_sees_new_streams(spark, tmp_path):
    path = str(tmp_path / "feed")
    long_df(spark, minutes(5)).write.parquet(path)
    h = Historian(spark, {"f": path})
    assert h.metadata.count() == 1
    long_df(spark, [(t + dt.timedelta(days=9), "P2.Later", v) for t, _, v in minutes(5)]).write.mode("append").parquet(path)
    h.refresh()
    assert h.metadata.count() == 2 and h.as_of() > T0 + dt.timedelta(days=8)


def test_readings_table(spark, tmp_path):
    rows = minutes(30) + [(t - dt.timedelta(days=40), "P1.Flow", v) for t, _, v in minutes(5)]
    h = Historian(spark, {"f": long_df(spark, rows)})
    every = lambda **k: sorted(map(str, unified_readings(h, **k).collect()))
    raw, week = every(), every(days=7)
    h.materialise(str(tmp_path / "readings"))
    assert every() == raw and every(days=7) == week and len(week) == 30
    plan = unified_readings(h, days=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert h.refresh().readings_path is None


def test_orders(spark, hist):
    from histospark.plans.registry import QUERIES
    from tests.conftest import SF_SMALL
    rows = lambda q: QUERIES[q](spark, SF_SMALL).collect()
    std = [r.stddev for r in A.anomaly_candidates(hist, lookback=3650, as_of=hist.feed_max_ts()).collect()]
    assert std == sorted(std, reverse=True) and len(std) >= 5
    usage = [r.event_count for r in rows("event_usage")]
    assert usage == sorted(usage, reverse=True)
    sizes = [r.domain_streams for r in rows("domain_top_assets")]
    assert sizes == sorted(sizes, reverse=True)
    at = [(r.asset, r.signal, r.ts) for r in rows("history_forecast_align")]
    assert at == sorted(at)
    dom = [r.streams for r in rows("schema_inventory") if r.section == "domain"]
    assert dom == sorted(dom, reverse=True)


def test_no_sort_aggregate_over_readings(spark, hist):
    for df in (S.latest_reading(hist), S.top_asset_for_signal(hist), EV.data_dictionary(hist)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from histospark.session import checkpoint_root
    spark = MagicMock()
    spark.sparkContext.getCheckpointDir.return_value = None
    spark.conf.get.return_value = None
    spark.sparkContext.getConf.return_value.get.return_value = None
    spark.sparkContext.master = "yarn"
    with pytest.raises(ValueError):
        checkpoint_root(spark)
