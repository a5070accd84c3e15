"""Event log, redaction, JSON payloads and the data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.functions.redact import MAX_QUERY_CHARS, redact, redaction_stages
from histospark.operators.readings import streams_of, unified_readings
from histospark.operators.stats import best_row


def event_payload(events: DataFrame, key: str = "k", json_col: str = "props") -> DataFrame:
    """Parse the semi-structured payload (VARIANT) and read one field;
    malformed payloads give NULL (:func:`rejected_payloads` counts them)."""
    return events.select("event_id", "event_type",
                         F.expr(f"try_variant_get(try_parse_json({json_col}), '$.{key}', 'int')").alias(key))


def rejected_payloads(events: DataFrame, json_col: str = "props") -> DataFrame:
    """Payloads per event type that are no JSON."""
    bad = F.col(json_col).isNotNull() & F.expr(f"try_parse_json({json_col}) IS NULL")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("payloads"), F.count_if(bad).alias("rejected"))


def log_events(conversations: DataFrame) -> DataFrame:
    """L1: every conversation turn becomes a logged query event: type, JSON
    data and the redacted question (empty or missing -> NULL). The whole text
    is redacted before it is cut to the log column's 1000 characters, so that
    a match across the cut is never stored in part."""
    redacted = F.when(F.length(F.coalesce(F.col("text"), F.lit(""))) > 0, F.substring(redact(F.col("text")), 1, MAX_QUERY_CHARS))
    data = F.to_json(F.struct("conv_id", "turn", F.length("text").alias("chars")))
    return conversations.select(
        "conv_id", "turn", F.concat(F.lit("QUERY_"), F.upper("role")).alias("event_type"),
        data.alias("event_data"), redacted.alias("redacted_query"))


def redact_text(docs: DataFrame) -> DataFrame:
    """L2: the whole text of every document with e-mails, SSNs and phones
    replaced by tags."""
    return docs.select("doc_id", "source", redact(F.col("text")).alias("redacted_text"))


def redaction_counts(docs: DataFrame) -> DataFrame:
    """L3: matches of each kind per source (audit of L2)."""
    stages = redaction_stages(F.col("text"))
    per_doc = docs.select("source", *[c.alias(k) for k, c in stages])
    return per_doc.groupBy("source").agg(*[F.sum(k).cast("bigint").alias(f"{k}_count") for k, _ in stages],
                                         F.count(F.lit(1)).alias("documents"))


def described(h) -> DataFrame:
    """The catalog with a description of each signal."""
    return h.metadata.select("feed", "asset", "signal", "domain", "data_type", "unit").withColumn(
        "description", F.concat_ws(" ", F.col("signal"), F.lit("of"), F.col("asset"), F.lit("("), F.col("domain"), F.lit(")")))


STANDARD_FIELDS = [("Timestamp", "When the value was recorded"), ("Value", "The recorded value"),
                   ("Field", "Historian tag the value belongs to"), ("Name", "Short name of the asset"),
                   ("Uom", "Physical unit of the value")]


def data_dictionary(h, search: str | None = None) -> DataFrame:
    """L4: one entry per signal (category Signal) with type, unit, feed, the
    first reading as example and min/max, plus the standard columns
    (category Metadata). Deterministic stand-in for generated prose. With
    ``search`` (C4) only entries whose name or description contains it, in any
    case: names are searched in the catalog, and only the streams of the
    signals found are read."""
    m = described(h)
    needle = F.lower(F.lit(search or ""))
    if search:
        m = m.where(F.lower("signal").contains(needle) | F.lower("description").contains(needle))
        found = h.streams.join(m.select("asset", "signal"), ["asset", "signal"], "left_semi")
        r = unified_readings(h, meta=found, streams_by_feed=streams_of(found))
    else:
        r = unified_readings(h)
    st = r.groupBy("asset", "signal").agg(
        F.min("numeric_value").alias("min_value"), F.max("numeric_value").alias("max_value"), F.count(F.lit(1)).alias("readings"))
    # the example is the first reading; a scan task sends one a signal
    first = best_row(r.select("asset", "signal", "ts", "row_id", "numeric_value"), ["asset", "signal"], F.asc("ts"), F.asc("row_id"))
    st = st.join(first.select("asset", "signal", F.col("numeric_value").alias("example_value")), ["asset", "signal"])
    return dictionary_of(h, m, st, needle if search else None)


def dictionary_of(h, m: DataFrame, st: DataFrame, needle=None) -> DataFrame:
    """The dictionary from the catalog ``m`` (with descriptions) and a row of
    facts per signal: min_value, max_value, readings, example_value."""
    sig = m.join(st, ["asset", "signal"], "left").select(
        F.col("signal").alias("field"), F.lit("Signal").alias("category"), "description",
        "unit", "data_type", "feed", "asset",
        F.col("example_value").alias("example_value"), F.col("min_value").alias("min_value"),
        F.col("max_value").alias("max_value"), F.coalesce("readings", F.lit(0)).alias("readings"))
    std = h.spark.createDataFrame(STANDARD_FIELDS, "field string, description string").select(
        "field", F.lit("Metadata").alias("category"), "description",
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("data_type"),
        F.lit(None).cast("string").alias("feed"), F.lit(None).cast("string").alias("asset"),
        F.lit(None).cast("double").alias("example_value"), F.lit(None).cast("double").alias("min_value"),
        F.lit(None).cast("double").alias("max_value"), F.lit(0).cast("bigint").alias("readings"))
    if needle is not None:
        std = std.where(F.lower("field").contains(needle) | F.lower("description").contains(needle))
    return sig.unionByName(std)
