"""Filters over the signal catalog and joins around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.operators.anomaly import NUMERIC_TYPES
from histospark.operators.metadata import PUBLIC_COLUMNS, stream_candidates
from histospark.operators.readings import unified_readings

ALL = "All"


def metadata_filter(meta: DataFrame, domains: list[str] | str | None = ALL, asset: str | None = ALL) -> DataFrame:
    """Domain IN (…) or = x, asset = x; "All" (or None) = no filter."""
    out = meta
    if domains not in (None, ALL):
        out = out.where(F.col("domain").isin([domains] if isinstance(domains, str) else list(domains)))
    if asset not in (None, ALL):
        out = out.where(F.col("asset") == asset)
    return out


def dictionary_search(dictionary: DataFrame, text: str, fields=("field", "description")) -> DataFrame:
    """C4: case-insensitive substring match in any of ``fields``."""
    needle = F.lower(F.lit(text))
    cond = None
    for c in fields:
        term = F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        cond = term if cond is None else (cond | term)
    return dictionary.where(cond)


def numeric_signals(meta: DataFrame) -> DataFrame:
    """Streams whose data type is numeric."""
    return meta.where(F.col("data_type").isin(NUMERIC_TYPES))


def entitled_feeds(h, accounts: DataFrame, pattern_col: str = "view_pattern") -> DataFrame:
    """Which feeds each account may see (feed name LIKE its pattern).

    Patterns are matched once per distinct pattern against the array of
    registered feed names (one literal, known on the driver); accounts join
    their pattern's feeds by equality."""
    names = F.array(*[F.lit(f.name) for f in h.feeds]).cast("array<string>")
    patterns = accounts.select(pattern_col).distinct().withColumn("feed", F.explode(names)).where(F.expr(f"feed LIKE {pattern_col}"))
    return accounts.join(patterns, pattern_col)


def resolve_signal_join(h) -> DataFrame:
    """Readings joined to (asset, signal, domain) on (feed, stream);
    reading count per resolved stream."""
    r = unified_readings(h)
    return r.groupBy("feed", "stream", "asset", "signal", "domain").agg(F.count(F.lit(1)).alias("readings"))


def domain_lookup(h) -> DataFrame:
    """Every discovered stream (before dedupe) with the domain of its
    (feed, stream) in the deduped metadata: NULL when missing, and the
    forecast-style fallback 'general'."""
    cand = stream_candidates(h.spark, h.feeds).select("feed", "stream", "asset", "signal")
    m = h.small(h.metadata.select("feed", "stream", "domain"), h.metadata_rows)
    j = cand.join(m, ["feed", "stream"], "left")
    return j.select("feed", "stream", "asset", "signal", "domain",
                    F.coalesce("domain", F.lit("general")).alias("domain_or_general"))


def hierarchy_signals(hier: DataFrame, meta: DataFrame) -> DataFrame:
    """Hierarchy rows with their signals (asset_path = metadata asset)."""
    m = meta.select(F.col("asset").alias("asset_path"), "signal", "data_type", F.col("domain").alias("signal_domain"))
    return hier.join(m, "asset_path", "left").select("asset_path", "asset_name", "level_depth", "signal", "data_type",
                                                     "signal_domain")


def queryable_feeds(h) -> DataFrame:
    """Registered feeds that have metadata (semi join)."""
    feeds = h.spark.createDataFrame([(f.name, f.ordinal, f.format if f.reachable else None) for f in h.feeds],
                                    "feed string, feed_ord int, format string")
    return feeds.join(h.metadata.select("feed"), "feed", "left_semi")


def silent_signals(h, lookback_days: int = 7) -> DataFrame:
    """Signals in the catalog without any reading in the lookback window
    that ends at the fleet's latest reading (anti join)."""
    recent = unified_readings(h, days=lookback_days).select("asset", "signal")
    return h.metadata.select(*PUBLIC_COLUMNS).join(recent, ["asset", "signal"], "left_anti")


def history_forecast_align(history: DataFrame, fc: DataFrame) -> DataFrame:
    """History and forecast side by side on (asset, signal, ts)."""
    hst = history.select("asset", "signal", "ts", F.col("numeric_value").alias("historical"))
    f = fc.select("asset", "signal", "ts", F.col("forecast_value").alias("forecast"), "lower_bound", "upper_bound")
    j = hst.join(f, ["asset", "signal", "ts"], "full_outer")
    return j.select("asset", "signal", "ts", "historical", "forecast", "lower_bound", "upper_bound").orderBy("asset", "signal", "ts")
