"""Feed registry views, app state and the health check.

Only schema facts (column lists, which sources opened) come from the driver;
row counts, stream counts and freshness are Spark aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.operators.metadata import domain_distribution_json
from histospark.sources.feeds import WIDE, Feed, model_class, register_feeds, type_class

# State keys and check statuses that must equal the reference's.
STATE_KEYS = ["VIEWS_INITIALIZED", "VIEW_COUNT", "METADATA_DISCOVERED", "STREAM_COUNT",
              "DOMAIN_DISTRIBUTION", "SEMANTIC_VIEW_CREATED"]
OK_STATUSES = ["OK", "SKIPPED", "STALE"]


def feed_registry(h) -> DataFrame:
    """A1 (+A4): one row per registered feed: shape, columns, rows, streams."""
    from histospark.operators.stats import feed_timestamps
    info = h.spark.createDataFrame(
        [(f.name, f.ordinal, f.format if f.reachable else None, len(f.columns) if f.reachable else 0) for f in h.feeds],
        "feed string, feed_ord int, format string, n_columns int")
    rows = feed_timestamps(h).groupBy("feed").agg(F.count(F.lit(1)).alias("rows"))
    streams = h.metadata.groupBy("feed").agg(F.count(F.lit(1)).alias("streams"))
    return (info.join(rows, "feed", "left").join(streams, "feed", "left")
            .select("feed", "feed_ord", "format", "n_columns", F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.coalesce("streams", F.lit(0)).alias("streams")))


def _profile_one(f: Feed) -> DataFrame:
    aggs, entries = [], []
    for i, (c, t) in enumerate(f.columns, start=1):
        col = F.col("`" + c.replace("`", "``") + "`")
        cls = type_class(t)
        aggs.append(F.count(col).alias(f"n{i}"))
        if cls == "STRING":
            aggs.append(F.count(col.try_cast("double")).alias(f"x{i}"))
        elif model_class(t) == "FACT":
            aggs.append(F.count(col).alias(f"x{i}"))
        else:
            aggs.append(F.lit(None).cast("bigint").alias(f"x{i}"))
        entries.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                                F.lit(cls).alias("metadata_class"), F.lit(model_class(t)).alias("model_class"),
                                F.col(f"n{i}").alias("non_null"), F.col(f"x{i}").alias("numeric_castable")))
    one = f.df.agg(*aggs)
    return one.select(F.lit(f.name).alias("feed"), F.explode(F.array(*entries)).alias("e")).select("feed", "e.*")


def feed_column_profile(h) -> DataFrame:
    """A2 (+B8): per (feed, ordinal, column): metadata class, model class,
    non-null count and numeric-castable count — one aggregation per feed."""
    parts = [_profile_one(f) for f in h.live_feeds]
    if not parts:
        return h.spark.createDataFrame([], "feed string, ordinal int, column_name string, metadata_class string, model_class string, non_null bigint, numeric_castable bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)


def feed_bundle_status(spark: SparkSession, sources: dict) -> DataFrame:
    """A3: open and probe every source with a one-row read; BUNDLED or
    NOT_BUNDLED with the error text. Broken sources are reported, not fatal."""
    feeds = register_feeds(spark, sources, create_views=False)
    errors = probe(feeds)
    rows = [(f.name, f.ordinal, "NOT_BUNDLED" if f.name in errors else "BUNDLED", errors.get(f.name)) for f in feeds]
    return spark.createDataFrame(rows, "feed string, feed_ord int, status string, error string")


def probe(feeds: list[Feed]) -> dict[str, str]:
    """{feed: error} of the feeds that can't be read. All feeds are probed in
    one job; only when that fails, each on its own to find the broken ones."""
    errors = {f.name: f.error for f in feeds if f.error is not None}
    live = [f for f in feeds if f.error is None]

    def one(f: Feed) -> DataFrame:
        return f.df.limit(1).select(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))

    try:
        if live:
            reduce(lambda a, b: a.unionAll(b), [one(f) for f in live]).collect()
    except Exception:  # some feed has unreadable data behind a valid schema
        for f in live:
            try:
                one(f).collect()
            except Exception as exc:
                errors[f.name] = str(exc).splitlines()[0][:300]
    return errors


def missing_state_keys(state: DataFrame) -> DataFrame:
    """Required state keys that the stored state lacks, by name."""
    spark = state.sparkSession
    needed = spark.createDataFrame([(k,) for k in STATE_KEYS], "key string")
    return needed.join(state.select("key"), "key", "left_anti")


def unsupported_columns(h) -> DataFrame:
    """Columns of wide feeds that no reading can come from, with their type."""
    rows = [(f.name, c, t) for f in h.live_feeds if f.format == WIDE for c, t in f.unsupported_columns()]
    return h.spark.createDataFrame(rows, "feed string, column_name string, type string")


def feed_preview(f: Feed, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a feed in (Timestamp, row_id) order."""
    order = ["Timestamp"] + (["row_id"] if "row_id" in f.column_names else [])
    return f.df.orderBy(*order).limit(n)


def app_state(h, semantic: DataFrame | None = None) -> DataFrame:
    """Key/value state derived from the current metadata: feed count, stream
    count, domain distribution (JSON) and readiness flags."""
    meta = h.metadata
    n = meta.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        h.spark.createDataFrame([("VIEWS_INITIALIZED", "TRUE"), ("VIEW_COUNT", str(len(h.feeds)))],
                                "key string, value string"),
        n.select(F.lit("STREAM_COUNT").alias("key"), F.col("n").cast("string").alias("value")),
        n.select(F.lit("METADATA_DISCOVERED").alias("key"),
                 F.when(F.col("n") > 0, "TRUE").otherwise("FALSE").alias("value")),
        domain_distribution_json(meta).select(F.lit("DOMAIN_DISTRIBUTION").alias("key"),
                                              F.col("distribution_json").alias("value")),
    ]
    if semantic is not None:
        parts.append(semantic.agg(F.count(F.lit(1)).alias("c")).select(
            F.lit("SEMANTIC_VIEW_CREATED").alias("key"),
            F.when(F.col("c") > 0, "TRUE").otherwise("FALSE").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _row(name: str, status: F.Column, value: F.Column, total: F.Column) -> list:
    return [F.lit(name).alias("check_name"), status.alias("status"),
            value.cast("bigint").alias("value"), total.cast("bigint").alias("total")]


def health_check(h, state: DataFrame, semantic: DataFrame, freshness: DataFrame) -> DataFrame:
    """Six checks, one row each, plus the overall verdict (HEALTHY iff
    every check is OK, SKIPPED or STALE). ``state`` is the stored key/value
    state, written when the feeds were last set up; it is compared with what
    is there now. Feeds are judged by a one-row read."""
    spark = h.spark
    n_feeds = len(h.feeds)
    n_live = n_feeds - len(probe(h.feeds))
    stored = state.where(F.col("key") == "VIEW_COUNT").agg(F.max(F.col("value").try_cast("bigint")).alias("s"))
    c1 = stored.select(*_row("shared_content_sync",
                             F.when(F.lit(n_feeds) == F.coalesce("s", F.lit(0)), "OK").otherwise("DRIFT"),
                             F.lit(n_feeds), F.coalesce("s", F.lit(0))))
    present = state.where(F.col("key").isin(STATE_KEYS)).agg(F.count_distinct("key").alias("p"))
    c2 = present.select(*_row("app_state_keys",
                              F.when(F.col("p") == len(STATE_KEYS), "OK").otherwise("MISSING"),
                              F.col("p"), F.lit(len(STATE_KEYS))))
    mc = h.metadata.agg(F.count(F.lit(1)).alias("m"))
    c3 = mc.select(*_row("stream_metadata", F.when(F.col("m") > 0, "OK").otherwise("EMPTY"), F.col("m"), F.col("m")))
    pv = "OK" if n_feeds and n_live == n_feeds else ("DEGRADED" if n_live else ("ERROR" if n_feeds else "EMPTY"))
    c4 = spark.range(1).select(*_row("proxy_views", F.lit(pv), F.lit(n_live), F.lit(n_feeds)))
    facts = semantic.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("role") == "FACT").alias("f"))
    made = state.where("key = 'SEMANTIC_VIEW_CREATED'").agg(F.coalesce(F.max(F.col("value") == "TRUE"), F.lit(False)).alias("made"))
    c5 = facts.join(made, F.lit(True)).select(*_row(
        "semantic_view", F.when(F.col("c") > 0, "OK").when(F.col("made"), "ERROR").otherwise("SKIPPED"), F.col("f"), F.col("c")))
    fr = freshness.agg(F.count_if("is_stale").alias("st"), F.count(F.lit(1)).alias("t"))
    c6 = fr.select(*_row("data_freshness", F.when(F.col("st") == 0, "OK").otherwise("STALE"), F.col("st"), F.col("t")))
    checks = reduce(lambda a, b: a.unionByName(b), [c1, c2, c3, c4, c5, c6])
    overall = checks.agg(
        F.count_if(~F.col("status").isin(OK_STATUSES)).alias("bad"), F.count(F.lit(1)).alias("n")).select(
        *_row("overall", F.when(F.col("bad") == 0, "HEALTHY").otherwise("DEGRADED"),
              F.col("n") - F.col("bad"), F.col("n")))
    return checks.unionByName(overall)
