"""Versioned stores, the readings store with its summaries, ingest, streams,
discovery, name search, feed types."""

from __future__ import annotations

import datetime as dt
import glob
import math
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histospark.context import Historian
from histospark.functions.redact import redact, redaction_stages
from histospark.operators import anomaly as A
from histospark.operators import forecast as G
from histospark.operators import health as HL
from histospark.operators import stats as S
from histospark.operators import summaries as SM
from histospark.operators import tables as TB
from histospark.operators.name_search import NameIndex
from histospark.operators.readings import rejected_values, signal_readings, unified_readings
from histospark.sources.discovery import CatalogHistorian
from histospark.sources import readings_store as RS
from histospark.sources.manifest import Conflict, Manifests
from histospark.sources.readings_store import ReadingsStore
from histospark.streaming.ingest import incremental_ingest, read_ingested

T0 = dt.datetime(2024, 1, 1)
KV = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), KV)


def content(store, version=None):
    return sorted((r.k, r.v) for r in store.read(version).collect())


# --- manifests and keyed stores --------------------------------------------------


def test_manifest_has_one_winner(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    assert m.latest() == 0 and m.load() == {"version": 0}
    m.publish({"version": 1, "x": "a"})
    with pytest.raises(Conflict):
        m.publish({"version": 1, "x": "b"})
    assert m.load() == {"version": 1, "x": "a"} and m.versions() == [1]


def test_crash_before_publishing_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = TB.KeyedStore(spark, str(tmp_path / "s"), KV, ["k"])
    store.replace(kv(spark, ("a", 1), ("b", 2)))
    snapshot = store.read()

    def killed(self, manifest):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "publish", killed)
        with pytest.raises(RuntimeError):
            store.replace(kv(spark, ("a", 9)))
        with pytest.raises(RuntimeError):
            store.delete(kv(spark, ("b", 0)).select("k"))
    again = TB.KeyedStore(spark, str(tmp_path / "s"), KV, ["k"])
    assert content(again) == [("a", 1), ("b", 2)]
    again.replace(kv(spark, ("a", 3)))
    assert content(again) == [("a", 3), ("b", 2)] and content(again, 1) == [("a", 1), ("b", 2)]
    assert sorted((r.k, r.v) for r in snapshot.collect()) == [("a", 1), ("b", 2)]  # a frame keeps its version


def test_bucket_number_is_the_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    TB.KeyedStore(spark, path, KV, ["k"], buckets=64).replace(kv(spark, *[(f"s{i % 2}", i) for i in range(400)]))
    other = TB.KeyedStore(spark, path, KV, ["k"], buckets=16)
    assert other.buckets == 64
    other.replace(kv(spark, ("s1", -1)))
    assert len(content(other)) == 201 and [r for r in content(other) if r[0] == "s1"] == [("s1", -1)]
    other.rebucket(5)
    assert TB.KeyedStore(spark, path, KV, ["k"]).buckets == 5 and len(content(other)) == 201
    with pytest.raises(ValueError):
        TB.KeyedStore(spark, path, T.StructType(KV.fields[:1]), ["k"])


def test_second_writer_builds_on_the_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    one, two = (TB.KeyedStore(spark, path, KV, ["k"]) for _ in range(2))
    one.replace(kv(spark, ("a", 1), ("b", 1)))
    publish, raced = Manifests.publish, []

    def late(self, manifest):
        if not raced:
            raced.append(True)
            one.replace(kv(spark, ("b", 5), ("c", 5)))  # comes first
        publish(self, manifest)

    monkeypatch.setattr(Manifests, "publish", late)
    two.replace(kv(spark, ("a", 7)))
    assert content(one) == [("a", 7), ("b", 5), ("c", 5)]
    assert one.manifests.versions() == [1, 2, 3]


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    store = TB.KeyedStore(spark, str(tmp_path / "s"), KV, ["k"])
    for i in range(4):
        store.replace(kv(spark, ("a", i)))
    assert store.manifests.vacuum(keep=2) == []  # all folders are young
    assert len(store.manifests.versions()) == 2
    assert len(store.manifests.vacuum(keep=2, older_than_hours=-1)) == 2
    assert content(store) == [("a", 3)] and content(store, 3) == [("a", 2)]


# --- readings store ---------------------------------------------------------------


def put(spark, df, folder, name):
    """``df`` as one file of ``folder``."""
    tmp = f"{folder}-{name}"
    df.coalesce(1).write.parquet(tmp)
    shutil.copy(glob.glob(f"{tmp}/*.parquet")[0], f"{folder}/{name}.parquet")


def wide(spark, n, columns, first=0, value=lambda i, j: float(i + j)):
    rows = [(T0 + dt.timedelta(minutes=7 * (i + first)), *[value(i, j) for j in range(len(columns))]) for i in range(n)]
    return spark.createDataFrame(rows, "Timestamp timestamp_ntz, " + ", ".join(f"`{c}` {t}" for c, t in columns))


def test_new_columns_and_types_are_ingested(spark, tmp_path):
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    put(spark, wide(spark, 5, [("A.x", "double")]), src, "1")
    h = Historian(spark, {"w": src})
    path, ckpt = incremental_ingest(h, src, lambda d: d, "w")
    put(spark, wide(spark, 5, [("A.x", "double"), ("A.y", "double")], 5), src, "2")
    put(spark, wide(spark, 2, [("A.x", "string")], 10, lambda i, j: "7"), src, "3")  # no common type
    for _ in range(2):  # the second run adds nothing
        incremental_ingest(h, src, lambda d: d, "w", table_path=path, checkpoint=ckpt)
    got = {r.signal: r["count"] for r in read_ingested(spark, path).groupBy("signal").count().collect()}
    assert got == {"x": 12, "y": 5}
    alone = Historian.from_store(spark, path)  # needs no raw feed
    assert unified_readings(alone).count() == 17 and {r.signal for r in alone.metadata.collect()} == {"x", "y"}


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    h = Historian(spark, {"f": wide(spark, 30, [("A.x", "double")])})
    store = ReadingsStore(spark, str(tmp_path / "s"))

    def killed(self, manifest):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "publish", killed)
        with pytest.raises(RuntimeError):
            store.append(h.feeds[0], "src", 0)
    assert store.readings().count() == 0 and store.feeds() == {}
    assert store.append(h.feeds[0], "src", 0) and not store.append(h.feeds[0], "src", 0)
    assert store.append(h.feeds[0], "src", 1) and store.readings().count() == 60 and store.feeds()["f"]["rows"] == 60


def test_summaries_equal_the_scan(spark, tmp_path, monkeypatch):
    """Many batches, late readings, two streams of one signal, text, NULLs, merged folders."""
    monkeypatch.setattr("histospark.sources.readings_store.FOLDERS", 3)
    rng = random.Random(4)
    tag = "P1.Flow.00000000-0000-0000-0000-00000000000{}"
    rows = []
    for i in range(900):
        t = T0 + dt.timedelta(minutes=rng.randrange(40_000))
        v = rng.choice([f"{1e6 + rng.gauss(0, 1e-2):.6f}", str(rng.randrange(50)), "bad", None])
        rows.append((t, rng.choice([tag.format(1), tag.format(2), "P2.Level", "P3.Once"]) if i else "P4.Single", v, "u", i))
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, Field string, Value string, Uom string, row_id long")
    raw = Historian(spark, {"f": df})
    store = ReadingsStore(spark, str(tmp_path / "s"), "month")
    for b in range(8):
        store.append(Historian(spark, {"f": df.where(f"row_id % 8 = {b}")}).feeds[0], "src", b)
    assert len(store.manifests.load()["hours"]) <= 4
    h = Historian.from_store(spark, store)

    def same(a, b):
        key = lambda r: tuple(str(x) for x in r.asDict().values() if not isinstance(x, float))
        x, y = (sorted((r.asDict() for r in d.select(*sorted(d.columns)).collect()), key=lambda r: str([v for v in r.values() if not isinstance(v, float)])) for d in (a, b))
        assert len(x) == len(y) and key
        for p, q in zip(x, y, strict=True):
            assert p.keys() == q.keys()
            for c in p:
                ok = p[c] == q[c] or (isinstance(p[c], float) and isinstance(q[c], float) and math.isclose(p[c], q[c], rel_tol=1e-9, abs_tol=1e-6))
                assert ok, (c, p, q)

    same(SM.series_profile(h), G.series_profile(G.numeric_readings(raw)))
    same(SM.hourly_trend(h), S.hourly_trend(raw))
    same(SM.avg_signal_by_asset(h), S.avg_signal_by_asset(raw))
    same(SM.total_over_time(h), S.total_over_time(raw))
    same(SM.latest_reading(h), S.latest_reading(raw))
    same(SM.trend_summary(h), S.trend_summary(raw))
    same(SM.forecast(h), G.forecast(raw))
    same(SM.feed_volume(h), S.feed_volume(raw))
    from histospark.operators.events import data_dictionary
    same(SM.data_dictionary(h), data_dictionary(raw))
    same(unified_readings(h).drop("n_readings"), unified_readings(raw).drop("n_readings"))
    store.compact()
    assert len(store.manifests.load()["readings"]) == 1 and store.readings().count() == unified_readings(raw).count()
    for df in (SM.series_profile(h), SM.forecast(h), SM.hourly_trend(h)):  # no scan of readings
        assert "/readings/" not in df._jdf.queryExecution().toString()


def test_names_come_from_the_table(spark, tmp_path):
    """A stream that the old catalog lacks, and feeds that differ as text only."""
    one = spark.createDataFrame([(T0 + dt.timedelta(hours=i), "A.x", str(i)) for i in range(5)], "Timestamp timestamp_ntz, Field string, Value string")
    two = one.unionByName(one.withColumn("Field", F.lit("A.new")).limit(3))
    Historian(spark, {"01": two, "1": one, "a/b =%é": one}).materialise(str(tmp_path / "r"))
    h = Historian(spark, {"01": one, "1": one})
    assert h.streams.count() == 2
    h.use_readings(str(tmp_path / "r"))
    got = {(r.feed, r.signal): r["count"] for r in unified_readings(h).groupBy("feed", "signal").count().collect()}
    assert got == {("01", "x"): 5, ("01", "new"): 3, ("1", "x"): 5, ("a/b =%é", "x"): 5}


def test_one_signal_reads_few_rows(spark, tmp_path):
    """Sorted files and day folders: a signal's week is a small part of what is stored."""
    df = spark.range(200_000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id div 200 AS int) * 604.8) AS Timestamp",
                                         "concat('P', id % 200, '.Flow') AS Field", "cast(id AS string) AS Value", "id AS row_id")
    store = ReadingsStore(spark, str(tmp_path / "s"))
    store.append(Historian(spark, {"f": df}).feeds[0])
    h = Historian.from_store(spark, store)
    r = unified_readings(h, days=2, meta=h.streams.where("asset = 'P7'"), streams_by_feed={"f": ["P7.Flow"]})
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "In(stream" in plan or "EqualTo(stream,P7.Flow)" in plan or "IN (P7.Flow)" in plan or "(stream" in plan.split("PushedFilters")[1]
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert 200 < r.count() < 500
    import pyarrow.parquet as pq
    files = glob.glob(str(tmp_path / "s" / "readings" / "*" / "*" / "*" / "*.parquet"))
    assert all(pq.read_table(f, columns=["stream"])["stream"].to_pylist() == sorted(pq.read_table(f, columns=["stream"])["stream"].to_pylist()) for f in files)


# --- feed types, as-of, no feed ------------------------------------------------------


def test_feed_types(spark):
    text = [(f"2024-01-01 {i:02d}:00:00" if i != 3 else "soon", "A.x", str(i), "maybe" if i == 1 else "true", f"id-{i}" if i % 2 else str(i)) for i in range(12)]
    a = spark.createDataFrame(text, "Timestamp string, Field string, Value string, IsQuestionable string, row_id string")
    zoned = spark.createDataFrame([(T0 + dt.timedelta(hours=i), float(i)) for i in range(12)], "Timestamp timestamp_ntz, `B.y` double").withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    h = Historian(spark, {"text": a, "zoned": zoned})
    r = unified_readings(h)
    assert dict(r.dtypes)["ts"] == "timestamp_ntz"
    rows = r.collect()
    assert len(rows) == 24 and len({x.row_id for x in rows}) == 24
    assert [x.is_questionable for x in rows if x.raw_value == "1" and x.feed == "text"] == [None]
    assert unified_readings(h, days=1, as_of=T0 + dt.timedelta(hours=30)).where("feed = 'zoned'").count() == 6
    assert unified_readings(h, days=1, as_of=T0 + dt.timedelta(hours=30)).where("feed = 'text'").count() == 6
    assert {(x.feed, x.column_name): x.rejected for x in rejected_values(h).collect()} == {
        ("text", "Timestamp"): 1, ("text", "IsQuestionable"): 1, ("text", "row_id"): 6}
    assert unified_readings(h).where("feed = 'zoned'").agg(F.min("ts")).first()[0] == T0


def test_one_reading_of_a_broken_clock(spark):
    rows = [(T0 + dt.timedelta(minutes=i), "A.x", str(i % 7)) for i in range(60)] + [(dt.datetime(2099, 1, 1), "A.x", "1")]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, Field string, Value string")
    assert A.detect_anomalies(Historian(spark, {"f": df}), lookback=7).count() == 0
    h = Historian(spark, {"f": df}, not_after=dt.datetime(2030, 1, 1))
    assert h.as_of() == T0 + dt.timedelta(minutes=59)
    assert A.detect_anomalies(h, lookback=7).count() == 59 and unified_readings(h, days=7).count() == 60
    assert [tuple(r) for r in h.late_feeds().collect()] == [("f", 1, dt.datetime(2099, 1, 1))]


def test_no_live_feed(spark, tmp_path):
    for sources in ({}, {"gone": str(tmp_path / "nothing")}):
        h = Historian(spark, sources)
        assert h.metadata.count() == 0 and h.as_of() is None and unified_readings(h).count() == 0
        assert S.feed_volume(h).count() == len(sources) and HL.feed_registry(h).count() == len(sources)
        for empty in (HL.feed_column_profile(h), A.detect_anomalies(h), G.forecast(h), S.bundle_summary(h), S.bundle_lists(h), h.late_feeds(), rejected_values(h)):
            assert empty.collect() == []


# --- windows ------------------------------------------------------------------------


def test_a_burst_at_one_instant_is_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "workspace_dir", lambda _, name: f"{tmp_path}/{name}")
    rows = [(T0, "P1.Burst", str((i * 7919) % 101), i) for i in range(6000)] + [(T0 + dt.timedelta(minutes=i), "P1.Slow", str(i % 9), 10_000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "Timestamp timestamp_ntz, Field string, Value string, row_id long").repartition(6)
    r = unified_readings(Historian(spark, {"f": df})).select("asset", "signal", "ts", "row_id", "numeric_value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 6,300 rows would go into one file
    try:
        n = A.numbered(r, ["asset", "signal"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {i: i + 1 for i in range(6000)} | {10_000 + i: i + 1 for i in range(300)}
    assert {x.row_id: x.rn for x in n.collect()} == want
    assert {x.n_rows for x in n.where("signal = 'Burst'").collect()} == {6000}
    spread = spark.read.parquet(f"{tmp_path}/hot-rows").where("signal = 'Burst'").groupBy("_part").count().collect()
    monkeypatch.undo()
    assert len(spread) > 4 and max(x["count"] for x in spread) < 3000
    plain = {x.row_id: (x.rolling_avg, x.rolling_std) for x in A.plain_window(r, ["asset", "signal"], A._rolling_columns("numeric_value", 24)).collect()}
    assert {x.row_id: (x.rolling_avg, x.rolling_std) for x in A.rolling_stats(r, ["asset", "signal"], chunk_rows=100).collect()} == plain


# --- streams ------------------------------------------------------------------------


def long_rows(spark, lo, hi, step=7):
    rows = [(T0 + dt.timedelta(minutes=step * i), f"P{i % 3}.Flow", str((i * 37) % 11) if i % 13 else "bad", i) for i in range(lo, hi)]
    return spark.createDataFrame(rows, "Timestamp timestamp_ntz, Field string, Value string, row_id long")


def test_trend_stream_closes_hours(spark, tmp_path):
    from histospark.streaming.trend import read_hourly, stream_hourly_trend
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    put(spark, long_rows(spark, 0, 300), src, "1")
    path, ckpt, late = stream_hourly_trend(spark, src, lambda d: d, "f", delay="2 hours")
    assert late == 0
    put(spark, long_rows(spark, 300, 500), src, "2")
    put(spark, long_rows(spark, 0, 2), src, "3")  # long past
    _, _, late = stream_hourly_trend(spark, src, lambda d: d, "f", delay="2 hours", table_path=path, checkpoint=ckpt, max_files_per_trigger=1)
    assert late > 0
    got = {(r.asset, r.hour): (r.avg_value, r.readings) for r in read_hourly(spark, path).collect()}
    batch = S.hourly_trend(Historian(spark, {"f": long_rows(spark, 0, 500)}), hours=10_000).collect()
    end = T0 + dt.timedelta(minutes=7 * 499) - dt.timedelta(hours=3)
    assert {(r.asset, r.hour): r.avg_value for r in batch if r.hour <= end} == {k: v[0] for k, v in got.items()}


def test_anomaly_stream_equals_the_batch(spark, tmp_path):
    from histospark.streaming.anomalies import read_scored, stream_anomalies
    src = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    path = ckpt = None
    for k, (lo, hi) in enumerate(((0, 50), (50, 51), (51, 260))):  # every pass is a restart from the checkpoint
        put(spark, long_rows(spark, lo, hi), src, str(k))
        path, ckpt = stream_anomalies(spark, src, lambda d: d, "f", table_path=path, checkpoint=ckpt)
    h = Historian(spark, {"f": long_rows(spark, 0, 260)})
    r = unified_readings(h).select("asset", "signal", "domain", "ts", "row_id", "numeric_value")
    want = A.score(A.plain_window(r, ["asset", "signal"], A._rolling_columns("numeric_value", 24)))
    columns = ["asset", "signal", "row_id", "numeric_value", "rolling_avg", "rolling_std", "anomaly_score", "is_anomaly"]
    got, want = (sorted((tuple(x) for x in d.select(*columns).collect()), key=lambda x: x[2]) for d in (read_scored(spark, path), want))
    assert len(got) == len(want) > 200
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


# --- discovery and search -----------------------------------------------------------


def test_feeds_of_a_database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE hs_found LOCATION '{tmp_path}/db'")
    try:
        h = CatalogHistorian(spark, "hs_found")
        assert h.feeds == [] and h.metadata.count() == 0 and h.report().count() == 0 and S.feed_volume(h).count() == 0
        long_rows(spark, 0, 30).write.saveAsTable("hs_found.b_feed")
        spark.range(3).write.saveAsTable("hs_found.other")
        spark.sql("CREATE VIEW hs_found.a_view AS SELECT * FROM hs_found.b_feed WHERE row_id < 10")
        h.refresh()
        assert h.added == ["a_view", "b_feed"] and {r.feed: r.status for r in h.report().collect()} == {"a_view": "BUNDLED", "b_feed": "BUNDLED", "other": "NOT_A_FEED"}
        assert {r.feed: r.rows for r in S.feed_volume(h).collect()} == {"a_view": 10, "b_feed": 30}
        spark.sql("DROP VIEW hs_found.a_view")
        h.refresh()
        assert h.dropped == ["a_view"] and [f.name for f in h.feeds] == ["b_feed"]
        assert {r.feed: r.status for r in h.report().collect()}["a_view"] == "DROPPED"
    finally:
        spark.sql("DROP DATABASE hs_found CASCADE")


def test_name_index_equals_the_scan(spark, tmp_path):
    names = spark.range(20_000).selectExpr("CASE WHEN id % 997 = 0 THEN 'Größe Ölpumpe ' || id WHEN id % 500 = 1 THEN NULL ELSE concat('Unit', id % 40, '.Signal ', id) END AS n").unionByName(
        spark.createDataFrame([("",), ("ab",), ("Unit1.Signal 41",)], "n string"))
    index = NameIndex.build(names, "n", str(tmp_path / "i"))
    for needle in ("ölpumpe", "7", "t3", "signal 199", "GNAL 1999", "zzz", "ab", ""):
        want = {r.n for r in names.where(F.lower("n").contains(F.lower(F.lit(needle)))).collect()}
        got = [r.name for r in index.search(needle).collect()]
        assert set(got) == want and len(got) == len(want), needle
    assert index.candidates("signal 1999").count() < 0.05 * 20_000


# --- redaction -------------------------------------------------------------------------


def test_redaction_is_linear(spark):
    text = "x" * 1_000_000 + " bob@example.com " + "7-" * 200_000 + "a@" * 50_000
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.select(redact(F.lit("warm up a@b.cd"))).collect()
    t = time.time()
    out = df.select(redact(F.col("t"))).first()[0]
    assert time.time() - t < 8 and "[EMAIL]" in out and "bob" not in out


@pytest.mark.parametrize("text", ["a@b.com_c@d.org", "..a@b.co..c@d.co", "a@b@c.de", "x.y+z@a-b.c.dd,%q@r.st", "a@b.c d@e.fg@h.ij", "@a.bc", "a@.bc", "a@b..cd"])
def test_addresses_as_with_the_plain_pattern(spark, text):
    import re
    plain = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(redact(F.col("t"))).first()[0] == re.sub(plain, "[EMAIL]", text)
    assert df.select(dict(redaction_stages(F.col("t")))["email"]).first()[0] == len(re.findall(plain, text))


# --- writing: bounded tasks -----------------------------------------------------------


def odd_rows(spark, ids=True):
    """Streams with many rows an hour, few numbers, rows without time or name."""
    rnd, rows = random.Random(3), []
    for i in range(3000):
        s = ["hot", "text", "few", "timeless", None][min(4, int(rnd.expovariate(0.9)))]
        ts = None if s == "timeless" or rnd.random() < 0.01 else T0 + dt.timedelta(minutes=rnd.randrange(60 if s == "hot" and i % 2 else 20_000))
        rows.append(("f", s, ts, i if ids else None, "x" if s == "text" or i % 3 == 0 else str(i), None if s == "text" or i % 3 == 0 else float(i), None, None))
    return spark.createDataFrame(rows, "feed string, stream string, ts timestamp_ntz, row_id bigint, raw_value string, numeric_value double, uom string, is_questionable boolean")


@pytest.mark.parametrize("n_streams", [5, RS.BROADCAST_STREAMS + 1])
def test_tails_from_their_hours_alone(spark, n_streams):
    rows = odd_rows(spark)
    got = ReadingsStore._tails_of(rows, ReadingsStore._hours_of(rows), n_streams).collect()
    key = lambda r: (r.ts is not None, r.ts or T0, r.row_id)
    by, want = {}, set()
    for r in rows.collect():
        by.setdefault(r.stream, []).append(r)
    for s, all_rows in by.items():
        ordered = sorted(all_rows, key=key, reverse=True)
        numbers = [r for r in ordered if r.numeric_value is not None]
        want |= {(s, "all", r.row_id) for r in ordered[: RS.TAIL]} | {(s, "numeric", r.row_id) for r in numbers[: RS.NUMERIC_TAIL]} | {(s, "first", ordered[-1].row_id)}
    assert len(got) == len(want) and {(r.stream, r.kind, r.row_id) for r in got} == want


def test_tails_leave_early_hours_unsorted(spark):
    rows = spark.range(20_000).select(F.lit("f").alias("feed"), F.lit("s").alias("stream"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    bounds = ReadingsStore._bounds_of(ReadingsStore._hours_of(rows.withColumns({"numeric_value": F.lit(1.0), "is_questionable": F.lit(False)}))).first()
    assert bounds.since >= T0 + dt.timedelta(minutes=20_000 - RS.TAIL - 60) and bounds.since_numeric >= T0 + dt.timedelta(minutes=20_000 - RS.NUMERIC_TAIL - 60)
    assert bounds.until <= T0 + dt.timedelta(hours=1)


def test_writing_tasks_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RS, "TASK_ROWS", 500)
    df = spark.range(6000).select((F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("Timestamp"),
                                  F.lit("a.b").alias("Field"), F.col("id").cast("string").alias("Value"), F.col("id").alias("row_id"))
    h = Historian(spark, {"f": df})
    h.materialise(str(tmp_path / "r"), unit="year")
    per = [r["count"] for r in h.store.readings().groupBy(F.input_file_name()).count().collect()]
    assert sum(per) == 6000 and max(per) <= 1000
