"""Historian context: registered feeds + materialised stream metadata.

The metadata table plays the role of the stream-metadata config table: it is
computed once (one distinct-Field job over the long feeds), written to the
shared checkpoint folder (lineage cut, survives executor loss) and counted.
The count is the proven size bound that decides whether joins against it may
broadcast; above the bound the join shuffles instead.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.functions.timecalc import ts_lit
from histospark.operators import metadata as M
from histospark.session import workspace_dir
from histospark.sources.feeds import Feed, register_feeds
from histospark.sources.readings_store import ReadingsStore

# Joins against the metadata broadcast it only up to this many streams.
DEFAULT_BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20

_MEMO: dict[tuple, "Historian"] = {}


class Historian:
    """Registered feeds and what is known of them. ``not_after`` bounds the
    times that are believed: later readings (a broken clock) are left out of
    every query and of the default as-of, and :meth:`late_feeds` reports them."""

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame | str],
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS, sf_dir: str | None = None, not_after: _dt.datetime | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.not_after = not_after
        self.feeds: list[Feed] = register_feeds(spark, sources)
        self.broadcast_rows = broadcast_rows
        self._sources = dict(sources)
        self._meta: DataFrame | None = None
        self._meta_rows: int | None = None
        self._max_ts: dict[str, _dt.datetime | None] | None = None
        self._hot: dict[int, bool] = {}
        self.store: ReadingsStore | None = None

    # -- construction -----------------------------------------------------
    @classmethod
    def for_fixtures(cls, spark: SparkSession, sf_dir: str) -> "Historian":
        """Historian over the three fixture feeds of ``sf_dir``; one per
        (application, folder), so the metadata job runs once per session."""
        from histospark.sources.fixtures import fixture_feeds
        key = (spark.sparkContext.applicationId, sf_dir)
        h = _MEMO.get(key)
        if h is None:
            h = cls(spark, fixture_feeds(spark, sf_dir), sf_dir=sf_dir)
            _MEMO[key] = h
        return h

    @classmethod
    def from_store(cls, spark: SparkSession, store: ReadingsStore | str, **options) -> "Historian":
        """Historian over a readings store alone: feeds, streams and readings
        all come from it; the sources it was filled from may be gone."""
        h = cls(spark, {}, **options)
        h.use_readings(store)
        return h

    def feed(self, name: str) -> Feed:
        return next(f for f in self.feeds if f.name == name)

    @property
    def live_feeds(self) -> list[Feed]:
        return [f for f in self.feeds if f.reachable]

    def refresh(self) -> "Historian":
        """Open the sources again and forget what was derived from them:
        new feeds, streams, columns and times are seen from the next call on."""
        self.feeds = register_feeds(self.spark, self._sources)
        self._meta = self._meta_rows = self._max_ts = self.store = None
        self._hot = {}
        return self

    # -- readings table -----------------------------------------------------
    @property
    def readings_path(self) -> str | None:
        return self.store.path if self.store is not None else None

    def materialise(self, path: str | None = None, unit: str = "day") -> str:
        """Write the normalised readings of all feeds into a readings store, by
        feed and day (``unit``: "month" or "year" folders for sparse feeds);
        from then on (until ``refresh``) every query reads that store instead
        of the raw feeds. Feeds that the store holds already are not added
        again: later rows come in by the incremental ingest."""
        store = ReadingsStore(self.spark, path or workspace_dir(self.spark, "readings"), unit)
        for f in self.live_feeds:
            store.append(f)
        return self.use_readings(store)

    def use_readings(self, store: ReadingsStore | str) -> str:
        """Let queries read a readings store: its feeds, its catalog of streams
        and its readings, as of now (``use_readings`` again to see later batches)."""
        self.store = ReadingsStore(self.spark, store) if isinstance(store, str) else store
        known = {f.name: f for f in self.feeds}
        self.feeds = []
        for name, facts in self.store.feeds().items():
            if name in known and known[name].reachable:
                self.feeds.append(known[name])
            else:
                rows = self.store.readings(name).select(
                    F.col("ts").alias("Timestamp"), F.col("stream").alias("Field"), F.col("raw_value").alias("Value"),
                    F.col("uom").alias("Uom"), F.col("is_questionable").alias("IsQuestionable"), "row_id")
                self.feeds.append(Feed(name, facts["ordinal"], rows))
        self._meta = self._meta_rows = self._max_ts = None
        self._hot = {}
        return self.store.path

    # -- metadata ---------------------------------------------------------
    @property
    def streams(self) -> DataFrame:
        """Every stream (see ``stream_map``), written once to the shared folder."""
        if self._meta is None:
            # One job writes the table; reading it back cuts the lineage (a
            # lost executor never recomputes discovery) and the count comes
            # from the small written table.
            path = workspace_dir(self.spark, "stream-metadata")
            found = M.stream_map(self.spark, self.feeds) if self.store is None else M.named_streams(M.with_names(self.store.streams()))
            found.write.parquet(path)
            meta = self.spark.read.parquet(path)
            size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("feed", "stream", "asset", "signal", "domain", "unit")), F.lit(64))
            self._meta_rows, self._meta_bytes = meta.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
            self._meta = meta
        return self._meta

    @property
    def metadata(self) -> DataFrame:
        """The catalog: the first stream of every (asset, signal)."""
        return self.streams.where("is_primary").drop("is_primary")

    @property
    def metadata_rows(self) -> int:
        _ = self.streams
        return int(self._meta_rows or 0)

    def has_hot_streams(self, rows: int) -> bool:
        """Whether any stream holds more than ``rows`` readings (decided on
        the small metadata table; one boolean reaches the driver)."""
        key = int(rows)
        if key not in self._hot:
            self._hot[key] = self.streams.where(F.col("n_readings") > key).limit(1).count() > 0
        return self._hot[key]

    def small(self, df: DataFrame, rows: int) -> DataFrame:
        """Broadcast hint only when the measured rows and bytes of the stream
        table are within the bounds; otherwise the planner shuffles."""
        _ = self.streams
        fits = rows <= self.broadcast_rows and self._meta_bytes <= BROADCAST_BYTES
        return F.broadcast(df) if fits else df

    def meta_side(self, *cols: str) -> DataFrame:
        m = self.streams.select(*cols) if cols else self.streams
        return self.small(m, self.metadata_rows)

    # -- as-of ------------------------------------------------------------
    def as_of(self) -> _dt.datetime | None:
        """One instant for the fleet, the latest Timestamp of any feed (not
        after ``not_after``): the default end of lookback windows, so that a
        silent feed ages out."""
        return max((t for t in self.feed_max_ts().values() if t is not None), default=None)

    def feed_max_ts(self) -> dict[str, _dt.datetime | None]:
        """Latest Timestamp per feed, not after ``not_after`` (one small job;
        rows = number of feeds), a literal, so that lookback filters reach the
        parquet scan. A store knows it without a job."""
        if self._max_ts is None:
            known = self.store.feeds() if self.store is not None else {}
            done, parts = {}, []
            for f in self.live_feeds:
                last = _dt.datetime.fromisoformat(known[f.name]["last"]) if known.get(f.name, {}).get("last") else None
                if f.name in known and (self.not_after is None or last is None or last <= self.not_after):
                    done[f.name] = last
                else:
                    bounds = f.between(until=self.not_after)
                    df = f.df if bounds is None else f.df.where(bounds)
                    parts.append(df.select(F.lit(f.name).alias("feed"), f.time.alias("ts")).agg(F.first("feed").alias("feed"), F.max("ts").alias("max_ts")))
            rows = reduce(lambda a, b: a.unionByName(b), parts).where("feed IS NOT NULL").collect() if parts else []
            found = done | {r["feed"]: r["max_ts"] for r in rows}
            self._max_ts = {f.name: found.get(f.name) for f in self.live_feeds}
        return self._max_ts

    def late_feeds(self) -> DataFrame:
        """Feeds with readings after ``not_after``: how many, and the latest."""
        schema = "feed string, late_rows bigint, latest timestamp_ntz"
        if self.not_after is None or not self.live_feeds:
            return self.spark.createDataFrame([], schema)
        late = lambda f: f.time > ts_lit(self.not_after)
        parts = [f.df.where(late(f)).agg(F.count(F.lit(1)).alias("late_rows"), F.max(f.time).alias("latest")).select(F.lit(f.name).alias("feed"), "late_rows", "latest")
                 for f in self.live_feeds]
        return reduce(lambda a, b: a.unionByName(b), parts).where("late_rows > 0")
