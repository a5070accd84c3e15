"""Feed fixtures derived from the driver's parquet tables.

The three historian feed shapes (long, wide, single-signal) are rebuilt from
``events`` and ``orders`` with column expressions only, so each fixture is a
lazy projection of a parquet scan (pruning and pushdown stay intact). The
same adapters exist as SQL text in :mod:`histospark.plans.oracle`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed feed names and order (first-wins dedupe depends on the order).
LONG_FEED = "rotatingmachine_fixed_26q1"
WIDE_FEED = "windturbine_fixed_2603"
CLASSIC_FEED = "process_flow_single"

# Wide feed column names (historian style: asset.signal.uuid (unit)).
W_ACTIVE = "GE01.Active Power - 10 min rolling avg.4cda6eb5-885a-5fd4-323f-add6141de672 (kW)"
W_EXPECTED = "GE01.Expected Power.f3a878d6-3edc-5585-14ea-008cd1cec068 (kW)"
W_REVENUE = "GE01.Revenue - Monthly.1d8f39d7-4532-5b81-0652-bb84f250bd9a ()"
W_BLADE = "GE02_BL1_ACT (°)"
W_STATE = "GE02_STATE"
WIDE_COLUMNS = [W_ACTIVE, W_EXPECTED, W_REVENUE, W_BLADE, W_STATE]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def long_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_feed_of(table(spark, sf_dir, "events"))


def long_feed_of(e: DataFrame) -> DataFrame:
    """LONG adapter over an events frame (batch or streaming)."""
    asset = F.concat(F.lit("Rotating Machinery - PS"), (F.col("user_id") % 7).cast("string"))
    signal = (F.when(F.col("event_type") == "click", "Bearing Temperature Value")
              .when(F.col("event_type") == "view", "Discharge Pressure Value")
              .when(F.col("event_type") == "purchase", "Suction Pressure Value")
              .when(F.col("event_type") == "signup", "Flow Rate Value")
              .otherwise("Vibration Value"))
    value = (F.when(F.col("event_id") % 50 == 0, F.lit("Bad Input"))
             .when(F.col("event_id") % 75 == 1, F.lit(None).cast("string"))
             .otherwise(F.col("value").cast("string")))
    return e.select(
        F.col("ts").alias("Timestamp"),
        F.concat(asset, F.lit("."), signal).alias("Field"),
        value.alias("Value"),
        F.concat(F.lit("PS"), (F.col("user_id") % 7).cast("string")).alias("Name"),
        F.col("event_type").alias("Uom"),
        F.col("event_id").alias("row_id"),
    )


def wide_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_feed_of(table(spark, sf_dir, "orders"))


def wide_feed_of(o: DataFrame) -> DataFrame:
    """WIDE adapter over an orders frame."""
    ts = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return o.select(
        ts.alias("Timestamp"),
        (F.col("o_totalprice") / 1000).alias(W_ACTIVE),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 950).alias(W_EXPECTED),
        (F.col("o_totalprice") / 12).alias(W_REVENUE),
        (F.col("o_custkey") % 90).cast("double").alias(W_BLADE),
        F.col("o_orderstatus").alias(W_STATE),
        F.col("o_orderkey").alias("row_id"),
    )


def classic_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classic_feed_of(table(spark, sf_dir, "events"))


def classic_feed_of(e: DataFrame) -> DataFrame:
    """Single-signal adapter over an events frame."""
    return e.filter(F.col("event_type") == "error").select(
        F.col("ts").alias("Timestamp"),
        F.col("value").alias("Value"),
        (F.col("value") > 100).alias("IsQuestionable"),
        F.col("event_id").alias("row_id"),
    )


def fixture_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Ordered {feed name: DataFrame} of the three fixture feeds."""
    return {
        LONG_FEED: long_feed(spark, sf_dir),
        WIDE_FEED: wide_feed(spark, sf_dir),
        CLASSIC_FEED: classic_feed(spark, sf_dir),
    }
