"""Connected components of an edge table, by alternating large-star and
small-star steps: joins and map-side combined minima only, every round written
to the shared folder. Nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id that occurs in ``edges``; component is the
    smallest id reachable. The smallest id of a component has no row."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "edges-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges-small")
        new = _mark(e)
        if new == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = new
