"""Readings table with its own catalog and summaries, filled in batches.

A store is a folder under numbered manifests (:mod:`histospark.sources.manifest`).
A batch of one feed adds immutable folders and is published as a whole:

* ``readings``: the normalised readings by feed and day (or month, year), in
  every file sorted by stream and time, with Bloom filters on the stream, so
  that reading one stream for a few days opens few row groups;
* ``streams``: the streams of the batch with their numbers of readings;
* ``hours``: per stream and hour the number, sum, second moment, smallest and
  largest of the readings, which add up across batches, late ones included;
* ``tails``: per stream the latest TAIL readings, the latest NUMERIC_TAIL
  numeric ones, and the first reading of the batch.

Rows, first and last time of each feed stand in the manifest. A batch is known
by its source and number: one that is published already is not added again,
whatever was left of an earlier attempt. When a summary has more than FOLDERS
folders, they are merged into one by the batch that comes next; so what a query
merges stays small. Queries answered from summaries alone are in
:mod:`histospark.operators.summaries`.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histospark.functions.timecalc import trunc_ntz, ts_lit
from histospark.sources.feeds import Feed
from histospark.sources.manifest import Conflict, Manifests

READINGS = ("feed string, day date, stream string, ts timestamp_ntz, raw_value string, numeric_value double, uom string, "
            "is_questionable boolean, row_id bigint")
STREAMS = "feed string, stream string, feed_ord int, col_ord int, data_type string, format string, n_readings bigint, n_numeric bigint"
HOURS = ("feed string, stream string, hour timestamp_ntz, n bigint, n_numeric bigint, total double, m2 double, min_value double, "
         "max_value double, n_questionable bigint")
TAILS = ("feed string, stream string, kind string, ts timestamp_ntz, row_id bigint, raw_value string, numeric_value double, uom string, "
         "is_questionable boolean")
TAIL, NUMERIC_TAIL = 500, 200
FOLDERS = 16
#: Bytes of a row group: the unit that one-stream reads skip.
ROW_GROUP = 16 << 20
#: Readings that a task sorts and writes (about), and how few of them a task gets where cores are idle.
TASK_ROWS, LEAST_ROWS = 1 << 20, 1 << 16
#: Streams whose bounds are broadcast when tails are taken.
BROADCAST_STREAMS = 250_000
UNITS = ("day", "month", "year")
DELTAS = {"streams": STREAMS, "hours": HOURS, "tails": TAILS}


def names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def escaped(name: str) -> str:
    """A feed's name as a folder value: Spark reads %XX back as the character."""
    return "".join(c if c.isalnum() or c in "._-" else "".join(f"%{b:02X}" for b in c.encode()) if c.isascii() else c for c in name)


def latest(rows: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    """The ``n`` latest (or first) rows of each stream; every task sends n of them at most."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("ts", "row_id")]
    k = F.row_number().over(W.partitionBy("feed", "stream").orderBy(*order))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


class ReadingsStore:
    def __init__(self, spark: SparkSession, path: str, unit: str = "day"):
        if unit not in UNITS:
            raise ValueError(f"unit is one of {UNITS}")
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)
        self._unit = unit

    # -- writing ------------------------------------------------------------------
    def append(self, feed: Feed, source: str | None = None, batch: int = 0) -> bool:
        """Add the rows of ``feed`` (what ``feed.df`` holds now) as ``batch`` of
        ``source`` (default: the feed itself); False if it was added before."""
        from histospark.operators.metadata import stream_candidates
        from histospark.operators.readings import feed_readings
        source = source or feed.name
        base = self.manifests.load()
        if base.get("batches", {}).get(source, -1) >= batch:
            return False
        unit = base.get("unit", self._unit)
        folder = self.manifests.folder()
        below = folder.removeprefix(f"{self.path}/")
        added: dict[str, str] = {}
        rows = feed_readings(feed)
        if rows is not None:
            day = F.to_date("ts") if unit == "day" else F.trunc(F.to_date("ts"), unit)
            added["readings"] = self._write_readings({feed.name: rows.withColumn("day", day)})
            own = self._read_readings([f"{self.path}/{added['readings']}"])
            catalog = stream_candidates(self.spark, [feed], volumes=True).drop("asset", "signal")
            for name, make in (("streams", lambda: self._streams_of(own, catalog)), ("hours", lambda: self._hours_of(own)),
                               ("tails", lambda: self._tails_of(own, self._written(f"{folder}/hours", "hours"), self._written(f"{folder}/streams", "streams").count()))):
                make().select(*names_of(DELTAS[name])).write.parquet(f"{folder}/{name}")
                added[name] = f"{below}/{name}"
        facts = feed.df.agg(F.count(F.lit(1)).alias("rows"), F.min(feed.time).cast("string").alias("first"), F.max(feed.time).cast("string").alias("last")).first().asDict()
        while True:
            merged = self._merge_folders(base, folder, below)
            feeds = dict(base.get("feeds", {}))
            old = feeds.get(feed.name, {"ordinal": feed.ordinal if feed.ordinal else len(feeds) + 1, "rows": 0, "first": None, "last": None})
            ends = {k: f(v for v in (old[k], facts[k]) if v is not None) if old[k] or facts[k] else None for k, f in (("first", min), ("last", max))}
            feeds[feed.name] = old | ends | {"format": feed.format, "rows": old["rows"] + facts["rows"]}
            manifest = {"version": base["version"] + 1, "unit": unit, "feeds": feeds, "batches": base.get("batches", {}) | {source: batch}}
            for name in ("readings", *DELTAS):
                kept = merged.get(name, base.get(name, []))
                manifest[name] = kept + [added[name]] if name in added else kept
            try:
                self.manifests.publish(manifest)
                return True
            except Conflict:  # what was written stays good, whoever came first
                base = self.manifests.load()
                if base.get("batches", {}).get(source, -1) >= batch:
                    return False

    def _write_readings(self, by_feed: dict[str, DataFrame]) -> str:
        """Write each feed's rows into a new folder; its place below the store.
        The rows go to tasks by ranges of day, stream and time, about TASK_ROWS
        each, so that a task's sort stays in memory however many there are."""
        folder = f"readings/batch={uuid.uuid4().hex}"
        for feed, rows in by_feed.items():
            n = rows.count()
            tasks = max(1, -(-n // TASK_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
            out = rows.select(*[c for c in names_of(READINGS) if c != "feed"])
            out = out.repartitionByRange(tasks, "day", "stream", "ts", "row_id").sortWithinPartitions("day", "stream", "ts")
            (out.write.partitionBy("day").option("parquet.bloom.filter.enabled#stream", "true")
             .option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{folder}/feed={escaped(feed)}"))
        return folder

    def _merge_folders(self, base: dict, folder: str, below: str) -> dict[str, list[str]]:
        """Summaries of more than FOLDERS folders, merged into one: {name: [folder]}."""
        out = {}
        for name in DELTAS:
            if len(base.get(name, [])) >= FOLDERS:
                to = f"{name}-{base['version']}"
                self._merged(name, base).select(*names_of(DELTAS[name])).write.mode("overwrite").parquet(f"{folder}/{to}")
                out[name] = [f"{below}/{to}"]
        return out

    def compact(self) -> None:
        """Write the readings of all batches into one folder, sorted anew."""
        base = self.manifests.load()
        if len(base.get("readings", [])) < 2:
            return
        rows = self._read_readings(self._folders("readings", base))
        to, done = self._write_readings({f: rows.where(F.col("feed") == f) for f in base["feeds"]}), set(base["readings"])
        while True:
            now = self.manifests.load()
            try:
                return self.manifests.publish(now | {"version": now["version"] + 1, "readings": [to] + [f for f in now["readings"] if f not in done]})
            except Conflict:
                continue

    # -- what a batch adds -------------------------------------------------------------
    @staticmethod
    def _streams_of(rows: DataFrame, catalog: DataFrame) -> DataFrame:
        n = rows.groupBy("feed", "stream").agg(F.count(F.lit(1)).alias("n"), F.count("numeric_value").alias("n_numeric"))
        j = catalog.drop("n_readings").join(n, ["feed", "stream"], "left")
        return j.withColumns({"n_readings": F.coalesce("n", F.lit(0)), "n_numeric": F.coalesce("n_numeric", F.lit(0))})

    @staticmethod
    def _hours_of(rows: DataFrame) -> DataFrame:
        v = "numeric_value"
        return rows.groupBy("feed", "stream", trunc_ntz("hour", F.col("ts")).alias("hour")).agg(
            F.count(F.lit(1)).alias("n"), F.count(v).alias("n_numeric"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
            F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
            F.count_if("is_questionable").alias("n_questionable"))

    @staticmethod
    def _bounds_of(hours: DataFrame) -> DataFrame:
        """Per stream the hours that its tails lie in: ``since`` and
        ``since_numeric`` (NULL: all rows, also those without time), ``until``
        for the first reading, or ``timeless``: the first has no time."""
        hour, later = F.col("hour"), W.partitionBy("feed", "stream").orderBy(F.col("hour").desc()).rowsBetween(W.unboundedPreceding, -1)
        after = hours.select("feed", "stream", "hour", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("n", "n_numeric")])
        since = lambda needed: F.when(~F.bool_or(needed & hour.isNull()), F.min(F.when(needed, hour)))
        return after.groupBy(F.col("feed").alias("f"), F.col("stream").alias("s")).agg(
            since(F.col("n") < TAIL).alias("since"), since(F.col("n_numeric") < NUMERIC_TAIL).alias("since_numeric"),
            (F.min("hour") + F.expr("INTERVAL 1 HOUR")).alias("until"), F.bool_or(hour.isNull()).alias("timeless"))

    @classmethod
    def _tails_of(cls, rows: DataFrame, hours: DataFrame, n_streams: int) -> DataFrame:
        """The tails of ``rows``, whose hours are ``hours``: only the rows of
        the hours that hold them are sorted."""
        slim = rows.select("feed", "stream", "ts", "row_id", "raw_value", "numeric_value", "uom", "is_questionable")
        bounds = cls._bounds_of(hours)
        bounds = F.broadcast(bounds) if n_streams <= BROADCAST_STREAMS else bounds
        near = slim.join(bounds, F.col("feed").eqNullSafe(F.col("f")) & F.col("stream").eqNullSafe(F.col("s")))
        ts, reach = F.col("ts"), lambda c: F.col(c).isNull() | (F.col("ts") >= F.col(c))
        kinds = F.array_compact(F.array(F.when(reach("since"), F.lit("all")), F.when(F.col("numeric_value").isNotNull() & reach("since_numeric"), F.lit("numeric"))))
        ends = near.select(*slim.columns, F.explode(kinds).alias("kind"))
        k = F.row_number().over(W.partitionBy("feed", "stream", "kind").orderBy(F.desc("ts"), F.desc("row_id")))
        ends = ends.withColumn("k", k).where(F.col("k") <= TAIL).where((F.col("kind") == "all") | (F.col("k") <= NUMERIC_TAIL)).drop("k")
        first = near.where(F.when(F.col("timeless"), ts.isNull()).otherwise(ts < F.col("until"))).select(*slim.columns)
        return ends.unionByName(latest(first, 1, ascending=True).withColumn("kind", F.lit("first")))

    # -- reading -----------------------------------------------------------------------
    def _folders(self, name: str, manifest: dict | None = None) -> list[str]:
        manifest = self.manifests.load() if manifest is None else manifest
        return [f"{self.path}/{f}" for f in manifest.get(name, [])]

    def _written(self, folders: list[str] | str, name: str) -> DataFrame:
        return self.spark.read.schema(DELTAS[name]).parquet(*([folders] if isinstance(folders, str) else folders))

    def _read(self, name: str, manifest: dict | None = None) -> DataFrame:
        folders = self._folders(name, manifest)
        return self._written(folders, name) if folders else self.spark.createDataFrame([], DELTAS[name])

    def _read_readings(self, folders: list[str]) -> DataFrame:
        """Feed and day are folder names, of the declared types whatever they look like."""
        if not folders:
            return self.spark.createDataFrame([], READINGS)
        found = self.spark.read.schema(f"{READINGS}, batch string").option("basePath", f"{self.path}/readings").parquet(*folders)
        return found.select(*names_of(READINGS))

    @property
    def unit(self) -> str:
        return self.manifests.load().get("unit", self._unit)

    def feeds(self) -> dict[str, dict]:
        """{feed: ordinal, format, rows, first, last} in the order of their ordinals."""
        return dict(sorted(self.manifests.load().get("feeds", {}).items(), key=lambda f: f[1]["ordinal"]))

    def readings(self, feed: str | None = None, since: _dt.datetime | None = None, streams: list[str] | None = None) -> DataFrame:
        """The normalised readings, of one feed, from ``since`` on, of some
        streams: folders outside are not listed, row groups outside not read."""
        manifest = self.manifests.load()
        out = self._read_readings(self._folders("readings", manifest))
        if feed is not None:
            out = out.where(F.col("feed") == feed)
        if since is not None:
            first = since.date()
            if manifest.get("unit", self._unit) != "day":
                first = first.replace(day=1) if manifest["unit"] == "month" else first.replace(month=1, day=1)
            out = out.where((F.col("day") >= F.lit(first)) & (F.col("ts") >= ts_lit(since)))
        if streams is not None:
            out = out.where(F.col("stream").isin(streams))
        return out.drop("day")

    def _merged(self, name: str, manifest: dict | None = None) -> DataFrame:
        return {"streams": self._merged_streams, "hours": self._merged_hours, "tails": self._merged_tails}[name](self._read(name, manifest))

    @staticmethod
    def _merged_streams(rows: DataFrame) -> DataFrame:
        """A stream that was text in any batch is text."""
        return rows.groupBy("feed", "stream").agg(
            F.min("feed_ord").alias("feed_ord"), F.min("col_ord").alias("col_ord"), F.max("data_type").alias("data_type"),
            F.min("format").alias("format"), F.sum("n_readings").alias("n_readings"), F.sum("n_numeric").alias("n_numeric"))

    @staticmethod
    def _merged_hours(rows: DataFrame) -> DataFrame:
        """One row per stream and hour. Second moments are moved to the common
        mean (a list of one element a batch, FOLDERS at most)."""
        parts = F.collect_list(F.struct(F.col("n_numeric").alias("n"), "total", "m2"))
        g = rows.groupBy("feed", "stream", "hour").agg(
            F.sum("n").alias("n"), F.sum("n_numeric").alias("n_numeric"), F.sum("total").alias("total"), parts.alias("parts"),
            F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("n_questionable").alias("n_questionable"))
        return g.withColumn("m2", moved(F.col("parts"), F.col("n_numeric"), F.col("total"))).drop("parts")

    @staticmethod
    def _merged_tails(rows: DataFrame) -> DataFrame:
        parts = [latest(rows.where(F.col("kind") == kind), n, ascending) for kind, n, ascending in (("all", TAIL, False), ("numeric", NUMERIC_TAIL, False), ("first", 1, True))]
        return reduce(DataFrame.unionByName, parts)

    def streams(self) -> DataFrame:
        """The catalog: feed, stream, feed_ord, col_ord, data_type, format, n_readings, n_numeric."""
        return self._merged("streams")

    def hours(self) -> DataFrame:
        return self._merged("hours")

    def tails(self, kind: str = "all", n: int | None = None) -> DataFrame:
        """The latest ``n`` readings of each stream ("all": 500 at most,
        "numeric": 200) or its first one ("first")."""
        most = {"all": TAIL, "numeric": NUMERIC_TAIL, "first": 1}[kind]
        if n is not None and n > most:
            raise ValueError(f"the store keeps {most} readings")
        return latest(self._read("tails").where(F.col("kind") == kind), n or most, kind == "first").drop("kind")


def moved(parts, n, total):
    """Second moment about the common mean of ``parts`` (array of n, total, m2)."""
    mean = total / n
    step = lambda a, x: a + x["m2"] + F.when(x["n"] > 0, x["n"] * F.pow(x["total"] / x["n"] - mean, F.lit(2.0))).otherwise(F.lit(0.0))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), step)).otherwise(F.lit(0.0))
