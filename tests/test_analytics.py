"""Window, anomaly and forecast semantics on small hand-made frames."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histospark.functions.timecalc import boundary_diff
from histospark.operators import anomaly as A
from histospark.operators import forecast as G


def series(spark, n_per_key: dict, seed=1, ties=False, nulls=False):
    rnd = random.Random(seed)
    rows = []
    rid = 0
    base = dt.datetime(2024, 1, 1)
    for key, n in n_per_key.items():
        t = base
        for i in range(n):
            if not (ties and i % 5 == 0):
                t = t + dt.timedelta(minutes=rnd.choice([0, 1, 7, 60, 600]))
            v = None if (nulls and i % 11 == 3) else rnd.gauss(50, 10) + (40 if i % 97 == 0 else 0)
            rows.append(("A", key, t, rid, v))
            rid += 1
    return spark.createDataFrame(rows, "asset string, signal string, ts timestamp_ntz, row_id bigint, numeric_value double")


def plain_rolling(df):
    w = W.partitionBy("asset", "signal").orderBy("ts", "row_id").rowsBetween(-24, -1)
    return df.select("row_id", F.avg("numeric_value").over(w).alias("a"), F.stddev_samp("numeric_value").over(w).alias("s"))


@pytest.mark.parametrize("chunk", [24, 25, 50, 1000])
def test_chunked_rolling_equals_plain_window(spark, chunk):
    df = series(spark, {"s1": 300, "s2": 7, "s3": 1, "s4": 130}, ties=True, nulls=True)
    got = {r["row_id"]: (r["rolling_avg"], r["rolling_std"]) for r in
           A.rolling_stats(df, ["asset", "signal"], chunk_rows=chunk).collect()}
    exp = {r["row_id"]: (r["a"], r["s"]) for r in plain_rolling(df).collect()}
    assert got.keys() == exp.keys()
    for k, (a, s) in exp.items():
        ga, gs = got[k]
        assert (a is None and ga is None) or ga == pytest.approx(a, rel=1e-9, abs=1e-9)
        assert (s is None and gs is None) or gs == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_numbered_is_dense_and_ordered(spark):
    df = series(spark, {"s1": 500}, ties=True)
    rows = A.numbered(df, ["asset", "signal"]).orderBy("ts", "row_id").collect()
    assert [r["rn"] for r in rows] == list(range(1, 501))
    assert {r["n_rows"] for r in rows} == {500}


def test_score_rules(spark):
    rows = [(1.0, None, None), (5.0, 1.0, None), (10.0, 1.0, 1.0), (2.0, 1.0, 0.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "numeric_value double, rolling_avg double, rolling_std double")
    out = A.score(df).orderBy(F.col("numeric_value").asc_nulls_last()).collect()
    assert len(out) == 4  # no previous mean -> dropped
    z = {r["numeric_value"]: (r["anomaly_score"], r["is_anomaly"]) for r in out}
    assert z[5.0] == (0.0, False)      # std NULL -> z 0
    assert z[10.0] == (9.0, True)
    assert z[2.0] == (0.0, False)      # std 0 -> z 0
    assert z[None] == (None, False)    # non-numeric reading: kept, unscored


def python_holt(values):
    level, trend = values[0], (values[-1] - values[0]) / (len(values) - 1)
    res = []
    for x in values[1:]:
        f = level + 0.98 * trend
        res.append(x - f)
        nl = 0.3 * x + (1 - 0.3) * (level + 0.98 * trend)
        trend = 0.1 * (nl - level) + (1 - 0.1) * 0.98 * trend
        level = nl
    m = sum(res) / len(res)
    sd = (sum((r - m) ** 2 for r in res) / (len(res) - 1)) ** 0.5
    return level, trend, sd


def test_holt_matches_python_recursion(spark):
    df = series(spark, {"s1": 260, "s2": 9}, nulls=True)
    fit = {r["signal"]: r for r in G.holt_fit(df).collect()}
    pdf = sorted(df.collect(), key=lambda r: (r["ts"], r["row_id"]))
    for sig in ["s1", "s2"]:
        vals = [r["numeric_value"] for r in pdf if r["signal"] == sig and r["numeric_value"] is not None][-200:]
        lv, tr, sd = python_holt(vals)
        assert fit[sig]["train_rows"] == len(vals)
        assert fit[sig]["level"] == pytest.approx(lv, rel=1e-12)
        assert fit[sig]["trend"] == pytest.approx(tr, rel=1e-9, abs=1e-12)
        assert fit[sig]["residual_std"] == pytest.approx(sd, rel=1e-9)


@pytest.mark.parametrize("gap,horizon,steps", [(60.0, 7, 168), (1.0, 30, 43200), (3000.0, 2, 2), (82.5, 7, 119)])
def test_forecast_steps(spark, gap, horizon, steps):
    df = spark.createDataFrame([(gap,)], "g double")
    assert df.select(G.forecast_steps(F.col("g"), horizon)).first()[0] == steps
    assert df.select(G.forecast_steps(F.col("g"), horizon, max_steps=100)).first()[0] == min(steps, 100)


def test_boundary_diff_counts_crossings(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 59), dt.datetime(2024, 1, 1, 0, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(boundary_diff("minute", F.col("a"), F.col("b"))).first()[0] == 1
    assert df.select(boundary_diff("hour", F.col("a"), F.col("b"))).first()[0] == 0


def test_sampling_interval_default_60(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", "s", t + dt.timedelta(seconds=5 * i), i, float(i)) for i in range(10)]  # all gaps < 1 minute
    df = spark.createDataFrame(rows, "asset string, signal string, ts timestamp_ntz, row_id bigint, numeric_value double")
    assert G.sampling_interval(df).first()["interval_minutes"] == 60.0


def test_closed_form_damped_sum():
    phi, run = 0.98, 0.0
    for h in range(1, 501):
        run += phi ** h
        assert math.isclose(run, phi * (1 - phi ** h) / (1 - phi), rel_tol=1e-12)


def test_time_helpers_ignore_session_zone(spark):
    from histospark.functions.timecalc import trunc_ntz
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 59, 30), dt.datetime(2024, 3, 10, 3, 0, 10),
                                     dt.datetime(2024, 3, 10, 2, 30, 15, 123456))],
                                   "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
        r = df.select(boundary_diff("minute", F.col("a"), F.col("b")).alias("m"),
                      boundary_diff("hour", F.col("a"), F.col("b")).alias("h"),
                      trunc_ntz("hour", F.col("c")).alias("t")).first()
        assert (r["m"], r["h"]) == (61, 2)           # wall-clock crossings, DST gap ignored
        assert r["t"] == dt.datetime(2024, 3, 10, 2, 0, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


class _Hist:
    """Stand-in for the size decision of a Historian."""

    def __init__(self, hot: bool):
        self.hot = hot

    def has_hot_streams(self, rows: int) -> bool:
        return self.hot


@pytest.mark.parametrize("hot", [True, False])
def test_routed_rolling_equals_plain_window(spark, hot):
    df = series(spark, {"s1": 300, "s2": 40, "s3": 1}, ties=True, nulls=True)
    df = df.withColumn("n_readings", F.when(F.col("signal") == "s1", F.lit(300)).otherwise(F.lit(40)).cast("bigint"))
    got = {r["row_id"]: (r["rolling_avg"], r["rolling_std"], r["rn"], r["n_rows"]) for r in
           A.rolling_stats(df, ["asset", "signal"], chunk_rows=64, h=_Hist(hot)).collect()}
    exp = {r["row_id"]: (r["a"], r["s"]) for r in plain_rolling(df).collect()}
    assert got.keys() == exp.keys()
    for k, (a, s) in exp.items():
        ga, gs, _, _ = got[k]
        assert (a is None and ga is None) or ga == pytest.approx(a, rel=1e-9, abs=1e-9)
        assert (s is None and gs is None) or gs == pytest.approx(s, rel=1e-9, abs=1e-9)
    assert {v[3] for k, v in got.items()} == {300, 40, 1}
