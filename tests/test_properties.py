
from __future__ import annotations

import math
from collections import defaultdict

import pytest


@pytest.fixture(scope="module")
def anomalies(hist):
    from histospark.operators.anomaly import detect_anomalies
    return detect_anomalies(hist, lookback=30).collect()


@pytest.fixture(scope="module")
def forecasts(hist):
    from histospark.operators.forecast import forecast
    return forecast(hist, horizon=7).collect()


def test_z_nonnegative_and_bounds_symmetric(anomalies):
    assert anomalies
    for r in anomalies:
        assert r["anomaly_score"] is None or r["anomaly_score"] >= 0
        if r["lower_bound"] is not None:
            mid = (r["lower_bound"] + r["upper_bound"]) / 2
            assert mid == pytest.approx(r["forecast_value"], abs=2e-6)
        if r["is_anomaly"]:
            assert r["anomaly_score"] > 3


def test_band_grows_with_sqrt_h(forecasts):
    by_sig = defaultdict(list)
    for r in forecasts:
        by_sig[(r["asset"], r["signal"])].append(r)
    assert by_sig
    for rows in by_sig.values():
        rows.sort(key=lambda r: r["step"])
        assert [r["step"] for r in rows] == list(range(1, len(rows) + 1))
        unit = (rows[0]["upper_bound"] - rows[0]["lower_bound"]) / 2
        for r in rows:
            half = (r["upper_bound"] - r["lower_bound"]) / 2
            assert half == pytest.approx(unit * math.sqrt(r["step"]), rel=1e-5, abs=1e-5)
        ts = [r["ts"] for r in rows]
        assert ts == sorted(ts) and len(set(ts)) == len(ts)


def test_replace_twice_is_idempotent(spark, hist):
    from histospark.operators import tables as TB
    from histospark.operators.forecast import forecast
    from histospark.session import workspace_dir
    path = workspace_dir(spark, "idem")
    initial = forecast(hist, horizon=7)
    repl = forecast(hist, horizon=14, meta=hist.metadata.where("asset = 'GE01' AND data_type = 'NUMERIC'"))
    once = TB.result_store_replace(spark, initial, repl, path)
    n1 = once.count()
    twice = TB.result_store_replace(spark, initial, repl, path)
    assert twice.count() == n1


def test_incremental_ingest_picks_up_only_new_files(spark, hist):
    from pyspark.sql import functions as F

    from histospark.operators.readings import unified_readings
    from histospark.session import workspace_dir
    from histospark.sources.fixtures import LONG_FEED, long_feed_of, table
    from histospark.streaming.ingest import incremental_ingest, read_ingested
    from tests.conftest import SF_SMALL
    events = table(spark, SF_SMALL, "events")
    src = workspace_dir(spark, "ingest-src")
    cut = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    events.where(F.col("event_id") <= cut).write.parquet(src)
    path, ckpt = incremental_ingest(hist, src, long_feed_of, LONG_FEED)
    first = read_ingested(spark, path).count()
    # new files arrive in the same folder; the same checkpoint adds only them
    events.where(F.col("event_id") > cut).write.mode("append").parquet(src)
    incremental_ingest(hist, src, long_feed_of, LONG_FEED, table_path=path, checkpoint=ckpt)
    incremental_ingest(hist, src, long_feed_of, LONG_FEED, table_path=path, checkpoint=ckpt)  # nothing new
    total = read_ingested(spark, path).count()
    expected = unified_readings(hist).where(F.col("feed") == LONG_FEED).count()
    assert 0 < first < total == expected
