"""Unified readings.

Every feed is normalised to ``(feed, stream, ts, raw_value, numeric_value,
uom, is_questionable, row_id)`` and the union is joined once to the stream
metadata on (feed, stream). Lookback filters are literal ``Timestamp``
predicates on each feed *before* normalising, so they reach the parquet scan.
WIDE feeds are unpivoted numeric and text columns separately (unpivot needs one
value type); for a few streams only the needed columns are unpivoted.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histospark.functions import names as N
from histospark.functions.timecalc import ts_lit
from histospark.sources.feeds import CLASSIC, LONG, ROW_ID, TS_COL, Feed, is_signal_type, type_class

DEFAULT_LOOKBACK_DAYS = 7

READING_COLUMNS = ["feed", "stream", "asset", "signal", "domain", "unit", "ts", "raw_value",
                   "numeric_value", "string_value", "is_questionable", "row_id"]


def lookback_days(n) -> int:
    """NULL or <= 0 -> 7 days."""
    return int(n) if n is not None and n > 0 else DEFAULT_LOOKBACK_DAYS


def since_of(as_of: _dt.datetime | None, days: int | None) -> _dt.datetime | None:
    if as_of is None or days is None:
        return None
    return as_of - _dt.timedelta(days=days)


def _own_row_id(feed: Feed) -> Column:
    """The feed's ``row_id``; one that is no whole number is hashed."""
    if isinstance(dict(feed.columns)[ROW_ID], T.IntegralType):
        return F.col(ROW_ID).cast("bigint")
    text = F.col(ROW_ID).cast("string")
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("bigint"), F.xxhash64(text)))


def _row_id(feed: Feed, *parts: Column) -> Column:
    """The feed's ``row_id``, or a hash of what makes up the reading (time,
    stream, value): other columns are not read for it."""
    return _own_row_id(feed) if ROW_ID in feed.column_names else F.xxhash64(*parts)


def _questionable(columns: dict) -> Column:
    """A reading is questionable when a flag says so: IsQuestionable set, or
    IsGood not set; NULL in feeds without such flags, and where a flag is a
    text that is neither true nor false."""
    parts = []
    for name, negative in (("IsQuestionable", False), ("IsGood", True)):
        if name in columns:
            flag = F.col(name).try_cast("boolean") if isinstance(columns[name], (T.StringType, T.BooleanType, T.NumericType)) else F.lit(None).cast("boolean")
            parts.append(~flag if negative else flag)
    if not parts:
        return F.lit(None).cast("boolean")
    return parts[0] if len(parts) == 1 else F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False))


def _q(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def feed_readings(feed: Feed, since: _dt.datetime | None = None, streams: list[str] | None = None,
                  numeric_only: bool = False, until: _dt.datetime | None = None) -> DataFrame:
    """Normalise one feed; non-null readings only. ``numeric_only`` skips
    the text columns of a WIDE feed (their streams are typed STRING). Times
    are TIMESTAMP_NTZ whatever the feed's type."""
    df, ts = feed.df, feed.time
    bounds = feed.between(since, until)
    if bounds is not None:
        df = df.where(bounds)
    name = F.lit(feed.name)
    fmt = feed.format
    cols = dict(feed.columns)
    if fmt == LONG:
        if streams is not None:
            df = df.where(F.col("Field").isin(streams))
        raw = F.col("Value").cast("string")
        return df.where(F.col("Value").isNotNull()).select(
            name.alias("feed"), F.col("Field").alias("stream"), ts.alias("ts"),
            raw.alias("raw_value"),
            (N.finite(F.col("Value").cast("double")) if type_class(cols["Value"]) == "NUMERIC" else N.numeric_of(raw)).alias("numeric_value"),
            (F.col("Uom").cast("string") if "Uom" in cols else F.lit(None).cast("string")).alias("uom"),
            _questionable(cols).alias("is_questionable"),
            _row_id(feed, ts, F.col("Field"), raw).alias("row_id"))
    if fmt == CLASSIC:
        numeric = type_class(cols["Value"]) == "NUMERIC"
        raw = F.col("Value").cast("string")
        return df.where(F.col("Value").isNotNull()).select(
            name.alias("feed"), name.alias("stream"), ts.alias("ts"), raw.alias("raw_value"),
            (N.finite(F.col("Value").cast("double")) if numeric else N.numeric_of(raw)).alias("numeric_value"),
            (F.col("Uom").cast("string") if "Uom" in cols else F.lit(None).cast("string")).alias("uom"),
            _questionable(cols).alias("is_questionable"),
            _row_id(feed, ts, name, raw).alias("row_id"))
    # WIDE: unpivot only the wanted signal columns, numeric and text ones in
    # one pass: every column becomes struct<n double, t string> (one of the
    # two set), so one scan and one Expand serve both kinds.
    sig = [(c, t) for _, c, t in feed.signal_columns() if (streams is None or c in streams) and is_signal_type(t)]
    num = [c for c, t in sig if type_class(t) == "NUMERIC"]
    txt = [] if numeric_only else [c for c, t in sig if type_class(t) == "STRING"]
    if not num and not txt:
        return None
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    vals = ([F.struct(_q(c).cast("double").alias("n"), none_s.alias("t")).alias(c) for c in num]
            + [F.struct(none_d.alias("n"), _q(c).cast("string").alias("t")).alias(c) for c in txt])
    own = ROW_ID in feed.column_names
    base = df.select(ts.alias("ts"), _questionable(cols).alias("is_questionable"),
                     (_own_row_id(feed) if own else F.lit(None).cast("bigint")).alias("row_id"), *vals)
    u = base.unpivot(["ts", "is_questionable", "row_id"], [_q(c) for c in num + txt], "stream", "v")
    n, t = F.col("v.n"), F.col("v.t")
    u = u.where(n.isNotNull() | t.isNotNull())
    if not own:
        u = u.withColumn("row_id", F.xxhash64("ts", "stream", "v"))
    return u.select(name.alias("feed"), "stream", "ts",
                    F.coalesce(t, n.cast("string")).alias("raw_value"),
                    F.when(t.isNull(), N.finite(n)).otherwise(N.numeric_of(t)).alias("numeric_value"),
                    F.lit(None).cast("string").alias("uom"), "is_questionable", "row_id")


EMPTY = ("feed string, stream string, asset string, signal string, domain string, unit string, ts timestamp_ntz, raw_value string, "
         "numeric_value double, string_value string, is_questionable boolean, row_id bigint, data_type string, n_readings bigint")


def rejected_values(h) -> DataFrame:
    """Per feed and control column the values that can't be read: times, flags
    and row ids of another type, with their number (none is left out)."""
    parts = []
    for f in h.live_feeds:
        kinds = dict(f.columns)
        checks = [(c, F.col(c).isNotNull() & good.isNull()) for c, good in (
            [(TS_COL, f.time)] + [(c, F.col(c).try_cast("boolean")) for c in ("IsQuestionable", "IsGood") if c in kinds]
            + ([(ROW_ID, F.col(ROW_ID).cast("string").try_cast("bigint"))] if ROW_ID in kinds else [])) if isinstance(kinds[c], T.StringType)]
        if checks:
            one = f.df.agg(*[F.count_if(bad).alias(f"n{i}") for i, (_, bad) in enumerate(checks)])
            entries = F.array(*[F.struct(F.lit(f.name).alias("feed"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("rejected")) for i, (c, _) in enumerate(checks)])
            parts.append(one.select(F.explode(entries).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts) if parts else h.spark.createDataFrame([], "feed string, column_name string, rejected bigint")


def unified_readings(h, days: int | None = None, as_of: dict | _dt.datetime | None = None,
                     meta: DataFrame | None = None, streams_by_feed: dict[str, list[str]] | None = None,
                     numeric_only: bool = False) -> DataFrame:
    """All feeds in the canonical readings schema.

    ``days`` = lookback window (None: whole history); ``as_of`` = one instant
    or {feed: instant}, default the latest Timestamp of all feeds.
    ``meta`` = an already filtered stream map (e.g. one signal; of ``h.streams``,
    so that every stream of a signal is read) and ``streams_by_feed`` the
    matching stream names, so that only those
    streams/columns are read (C1). ``numeric_only`` = only numeric signals
    are wanted, so text columns are not even read."""
    if days is not None and as_of is None:
        as_of = h.as_of()
    parts = []
    for f in h.live_feeds:
        if streams_by_feed is not None and f.name not in streams_by_feed:
            continue
        a = as_of.get(f.name) if isinstance(as_of, dict) else as_of
        if days is not None and a is None:
            continue  # empty feed: nothing inside any window
        wanted = streams_by_feed.get(f.name) if streams_by_feed else None
        if h.store is not None:
            r = h.store.readings(f.name, since_of(a, days), wanted)
            r = r if h.not_after is None else r.where(F.col("ts") <= ts_lit(h.not_after))
        else:
            r = feed_readings(f, since_of(a, days), wanted, numeric_only, h.not_after)
        if r is not None:
            parts.append(r)
    if not parts:
        return h.spark.createDataFrame([], EMPTY)
    allr = reduce(lambda a, b: a.unionByName(b), parts)
    mcols = ["feed", "stream", "asset", "signal", "domain", "unit", "data_type", "n_readings"]
    m = h.meta_side(*mcols) if meta is None else h.small(meta.select(*mcols), h.metadata_rows)
    j = allr.join(m, ["feed", "stream"], "inner")
    return j.select(
        "feed", "stream", "asset", "signal", "domain",
        F.coalesce(F.col("uom"), F.col("unit")).alias("unit"),
        "ts", "raw_value", "numeric_value",
        F.when(F.col("numeric_value").isNull(), F.col("raw_value")).alias("string_value"),
        "is_questionable", "row_id", "data_type", "n_readings")


RESOLVE_LIMIT = 10_000  # streams resolved on the driver for targeted reads


def streams_of(meta: DataFrame, limit: int = RESOLVE_LIMIT) -> dict[str, list[str]] | None:
    """{feed: [stream, ...]} of a filtered metadata frame, so that only those
    Field values / wide columns are read; None when more than ``limit``
    streams match (then the feeds are read whole and joined: the same rows)."""
    rows = meta.select("feed", "stream").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["feed"], []).append(r["stream"])
    return out


def resolve_signal(h, asset: str, signal: str) -> DataFrame:
    """The streams of one (asset, signal)."""
    return h.streams.where((F.col("asset") == asset) & (F.col("signal") == signal))


def signal_readings(h, asset: str, signal: str, limit: int | None = 500) -> DataFrame:
    """One signal, newest first, ``limit`` rows (None = all). The signal
    is resolved in the metadata first (one tiny collect of feed and stream
    names) so only that feed, that Field value or that one column is read."""
    meta = resolve_signal(h, asset, signal)
    r = unified_readings(h, streams_by_feed=streams_of(meta), meta=meta)
    out = r.select("asset", "signal", "ts", "numeric_value", "row_id")
    if limit is not None:
        out = out.orderBy(F.col("ts").desc(), F.col("row_id").desc()).limit(limit)
    return out
