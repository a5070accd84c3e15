"""Every registered query against its DuckDB twin on the smallest fixture,
plus pipeline-level properties (counts of FIXTURES.md §3, idempotence)."""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
KNOWN_FLOAT_TIES: set[str] = set()  # queries allowed to differ in float ties (none)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _names():
    from histospark.plans.registry import QUERIES
    return sorted(QUERIES)


def test_every_query_has_oracle():
    import __spark_entry__ as E
    assert set(_names()) <= set(E.oracle_sql()) <= set(E.queries())
    assert len(_names()) >= 88


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from tools.check_oracle import table_hash, type_diff
    sdf = E.queries()[name](spark, SF_SMALL)
    assert type_diff(sdf, duck, E.oracle_sql()[name]) == {}
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    if name not in KNOWN_FLOAT_TIES:
        assert table_hash(sdf.columns, srows)[0] == table_hash(dcols, drows)[0]


def test_fixture_counts(hist):
    from histospark.operators.readings import unified_readings
    assert hist.metadata_rows == 41
    per = {r["feed"]: r["count"] for r in unified_readings(hist).groupBy("feed").count().collect()}
    assert per == {"rotatingmachine_fixed_26q1": 986, "windturbine_fixed_2603": 7350, "process_flow_single": 201}


def test_entry_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    long_rows = [r for r in rows if r["asset"].startswith("Rotating")]
    assert len(long_rows) == 950  # FIXTURES.md §3: 30 days, guard 12
    assert sum(1 for r in long_rows if r["is_anomaly"]) == 47


def test_share_back_idempotent(spark, hist):
    from histospark.operators import tables as TB
    from histospark.operators.anomaly import detect_anomalies
    res = detect_anomalies(hist, lookback=30)
    once = TB.share_back(spark, res, "X", runs=1).count()
    twice = TB.share_back(spark, res, "X", runs=2).count()
    assert once == twice == res.count()


def test_upsert_last_write_wins(spark):
    from histospark.operators import tables as TB
    cur = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    upd = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    got = {r["key"]: r["value"] for r in TB.state_upsert(cur, upd.withColumn("seq", upd["value"].cast("int"))).collect()}
    assert got == {"a": "1", "b": "3", "c": "4"}
    seeded = {r["key"]: r["value"] for r in TB.seed_if_absent(cur, upd).collect()}
    assert seeded == {"a": "1", "b": "2", "c": "4"}


def test_single_signal_reads_one_column(spark, hist):
    from histospark.operators.readings import signal_readings
    df = signal_readings(hist, "GE01", "Expected Power", limit=500)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GE01.Active Power" not in plan  # only the resolved column is projected
    assert df.count() == 500


def test_metadata_join_without_broadcast_is_identical(spark):
    from histospark.context import Historian
    from histospark.operators.anomaly import detect_anomalies
    from histospark.sources.fixtures import fixture_feeds
    from tools.check_oracle import table_hash
    small = Historian.for_fixtures(spark, SF_SMALL)
    big = Historian(spark, fixture_feeds(spark, SF_SMALL), broadcast_rows=0, sf_dir=SF_SMALL)
    a, b = (detect_anomalies(x, lookback=30, as_of=x.feed_max_ts()) for x in (small, big))
    hints = [df._jdf.queryExecution().analyzed().toString().count("ResolvedHint") for df in (a, b)]
    assert hints[0] > 0 and hints[1] == 0
    assert table_hash(a.columns, [tuple(r) for r in a.collect()])[0] == table_hash(b.columns, [tuple(r) for r in b.collect()])[0]


def test_hot_signal_route_is_identical(spark, hist):
    """With a tiny chunk the 1,500-reading wide signals count as hot and take
    the chunk + halo route; the result must not change."""
    from histospark.operators.anomaly import detect_anomalies
    from tools.check_oracle import table_hash
    assert hist.has_hot_streams(100) and not hist.has_hot_streams(1 << 20)
    plain = detect_anomalies(hist, lookback=3650)
    routed = detect_anomalies(hist, lookback=3650, chunk_rows=100)
    a = [tuple(r) for r in plain.collect()]
    b = [tuple(r) for r in routed.collect()]
    assert len(a) == len(b) > 1000
    assert table_hash(plain.columns, a)[0] == table_hash(routed.columns, b)[0]


@pytest.mark.parametrize("asset,signal", [("GE01", "Expected Power"),
                                          ("Rotating Machinery - PS3", "Flow Rate Value"),
                                          ("process_flow_single", "VALUE")])
def test_single_signal_detection_is_targeted(spark, hist, asset, signal):
    from pyspark.sql import functions as F

    from histospark.operators.anomaly import detect_anomalies
    from tools.check_oracle import table_hash
    one = detect_anomalies(hist, lookback=30, asset=asset, signal=signal, as_of=hist.feed_max_ts())
    ref = detect_anomalies(hist, lookback=30, as_of=hist.feed_max_ts()).where((F.col("asset") == asset) & (F.col("signal") == signal))
    a, b = [tuple(r) for r in one.collect()], [tuple(r) for r in ref.collect()]
    assert len(a) == len(b) > 0
    assert table_hash(one.columns, a)[0] == table_hash(ref.columns, b)[0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    if asset == "GE01":
        assert "Revenue - Monthly" not in plan and "GE02_STATE" not in plan


def test_auto_forecast_reads_one_signal(spark, hist):
    from histospark.operators.forecast import auto_forecast, forecast
    a = auto_forecast(hist, horizon=7)
    picked = {(r["asset"], r["signal"]) for r in a.select("asset", "signal").distinct().collect()}
    assert len(picked) == 1
    allf = forecast(hist, horizon=7)
    (asset, signal), = picked
    assert a.count() == allf.where((allf.asset == asset) & (allf.signal == signal)).count()
