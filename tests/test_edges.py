"""Edge rows on small hand-made feeds (FIXTURES.md §5)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from histospark.context import Historian
from histospark.operators import anomaly as A
from histospark.operators import metadata as M
from histospark.operators.readings import unified_readings

T0 = dt.datetime(2024, 1, 1)


def long_rows(field: str, n: int, start_id: int, value=lambda i: str(10.0 + (i % 7))):
    return [(T0 + dt.timedelta(minutes=10 * i), field, value(i), start_id + i) for i in range(n)]


@pytest.fixture(scope="module")
def edge_hist(spark):
    long_schema = "Timestamp timestamp_ntz, Field string, Value string, row_id bigint"
    rows = (long_rows("Pump A.Flow", 11, 0) + long_rows("Pump B.Flow", 12, 100)
            + long_rows("Pump C.Flow", 49, 200) + long_rows("Pump D.Flow", 50, 300)
            + long_rows("Pump E.Flow", 60, 400, value=lambda i: "5.0")           # constant series
            + long_rows("Pump F.Flow", 11, 500))
    feed1 = spark.createDataFrame(rows, long_schema)
    # second feed repeats Pump A.Flow: the catalog lists the first feed, readings come from both
    feed2 = spark.createDataFrame(long_rows("Pump A.Flow", 5, 1000), long_schema)
    wide = spark.createDataFrame(
        [(T0, 1.0, 2.0, 3.0, 4.0, 5), (T0 + dt.timedelta(hours=1), 1.5, None, 3.5, 4.5, 6)],
        "Timestamp timestamp_ntz, `X (kW)` double, `GE01.X_2` double, `GE02.X` double, `odd``name` double, row_id bigint")
    empty = spark.createDataFrame([], long_schema)
    return Historian(spark, {"feed_one": feed1, "feed_two": feed2, "wide_feed": wide, "empty_feed": empty})


def test_first_feed_wins_dedupe(edge_hist):
    m = {(r["asset"], r["signal"]): r for r in edge_hist.metadata.collect()}
    assert m[("Pump A", "Flow")]["feed"] == "feed_one"
    assert m[("Pump A", "Flow")]["n_readings"] == 16  # of both feeds
    assert ("wide_feed", "odd`name") in {(r["feed"], r["stream"]) for r in edge_hist.metadata.collect()}


def test_readings_of_repeated_streams_and_empty_feeds(edge_hist):
    per = {r["feed"]: r["count"] for r in unified_readings(edge_hist).groupBy("feed").count().collect()}
    assert per["feed_two"] == 5 and "empty_feed" not in per        # no reading is lost / no rows
    assert per["feed_one"] == 11 + 12 + 49 + 50 + 60 + 11
    assert per["wide_feed"] == 7                                   # one NULL skipped, back-tick column read


def test_detection_guard_eleven_vs_twelve(edge_hist):
    got = {r["asset"] for r in A.detect_anomalies(edge_hist, lookback=30).collect()}
    assert "Pump F" not in got and "Pump B" in got and "Pump A" in got  # 11, 12, 11 + 5 readings


def test_constant_series_scores_zero(edge_hist):
    rows = A.detect_anomalies(edge_hist, lookback=30, asset="Pump E", signal="Flow").collect()
    assert rows and all(r["anomaly_score"] == 0.0 and not r["is_anomaly"] for r in rows)


def test_candidate_guard_49_vs_50(edge_hist):
    got = {r["asset"] for r in A.anomaly_candidates(edge_hist, lookback=30, scan_first=None, keep_first=None).collect()}
    assert "Pump C" not in got and "Pump D" in got
    assert "Pump E" not in got                                     # std 0


def test_duplicate_aliases_are_numbered(spark, edge_hist):
    model = M.semantic_model(spark, edge_hist.feeds, edge_hist.metadata)
    al = {r["column_name"]: r["alias"] for r in model.where(F.col("feed") == "wide_feed").collect()}
    assert al["X (kW)"] == "X"
    assert len(set(al.values())) == len(al)                        # all unique within the table
    assert al["GE02.X"] != "X"


def test_semantic_select_long_table_filters_field(spark, hist):
    from histospark.operators.readings import unified_readings
    model = M.semantic_model(spark, hist.feeds, hist.metadata)
    field = "Rotating Machinery - PS0.Flow Rate Value"
    got = M.semantic_select(hist, model, "ROTATINGMACHINE_FIXED_26Q1", ["SENSOR_VALUE"], ["NAME"], field=field).collect()
    assert [r["NAME"] for r in got] == ["PS0"]
    exp = (unified_readings(hist).where(F.col("stream") == field)
           .agg(F.avg("numeric_value").alias("a")).first()["a"])
    assert got[0]["SENSOR_VALUE"] == pytest.approx(exp, abs=1e-6)


def test_metadata_filter_by_asset(hist):
    from histospark.operators.catalog import metadata_filter
    rows = metadata_filter(hist.metadata, "All", "GE01").collect()
    assert {r["asset"] for r in rows} == {"GE01"} and len(rows) == 3
