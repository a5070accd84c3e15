"""Exact de-duplication with a heavy-hitter split.

Misra-Gries summaries, one per task, find the digests that may be frequent;
their exact counts and winners are verified in a second, map-side combined
pass and broadcast (at most ``k`` rows). Rows of frequent digests are settled
by that map-side join; all other digests take an ordinary shuffle in which no
key is large.

Null text counts as empty. Of equal texts the row with the largest doc_id
stays (null doc_ids last); of rows that repeat both text and doc_id exactly
one stays. An empty table gives an empty result; other columns are ignored by
the report and carried along by :func:`keep_one`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histospark.llm.common import ROW, stored, table

#: Counters of a Misra-Gries summary, and the most digests that are broadcast.
COUNTERS = 4096
_LEAST = -(1 << 63)


def frequent(digests: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` values of ``key`` that may be frequent: the Misra-Gries
    summaries (``k`` counters) of all tasks added up. A summary is short by at
    most rows/(k+1) per value; counters of one are left out, so that a value
    with more than rows/(k+1) + tasks occurrences is always among the sums."""

    def summarise(batches):
        counters: dict = {}
        for pdf in batches:
            for x, c in pdf[key].value_counts(sort=False).items():
                counters[x] = counters.get(x, 0) + int(c)
            if len(counters) > k:  # merge step: subtract the (k+1)-th largest counter
                least = sorted(counters.values(), reverse=True)[k]
                counters = {y: c - least for y, c in counters.items() if c > least}
        found = [(y, c) for y, c in counters.items() if c > 1]
        yield pd.DataFrame({key: pd.Series([y for y, _ in found], dtype=object),
                            "n": pd.Series([c for _, c in found], dtype="int64")})

    parts = digests.select(key).mapInPandas(summarise, f"{key} string, n long")
    return parts.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(k)


def _winners(rows: DataFrame, digest: str, id_col: str) -> list:
    best = F.coalesce(F.col(id_col), F.lit(_LEAST).cast("long"))
    return [F.max(id_col).alias("keep_id"), F.max_by(ROW, best).alias("__hs_keep"), F.count(F.lit(1)).alias("group_size")]


def duplicate_groups(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
                  .withColumn(ROW, F.monotonically_increasing_id()), "digests")
    candidates = frequent(rows, "text_sha256", k).select("text_sha256")
    # Verified: exact size and winner of each candidate; k rows at most.
    heavy = stored(rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256")
                   .agg(*_winners(rows, "text_sha256", "doc_id")), "heavy-digests")
    settled = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(*_winners(rest, "text_sha256", "doc_id"))
    out = settled.unionByName(rest.join(groups, "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", (F.col(ROW) == F.col("__hs_keep")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Losers of frequent digests
    go map-side, before the only shuffle of the texts; in that shuffle each
    task sends at most one row per digest."""
    d, w = "__hs_digest", "__hs_win"
    names = docs.columns
    rows = docs.withColumn(d, F.sha2(F.coalesce("text", F.lit("")), 256))
    digests = stored(rows.select(d, F.col("doc_id").cast("long").alias(w)), "digests")
    heavy = stored(digests.join(F.broadcast(frequent(digests, d, k).select(d)), d).groupBy(d).agg(F.max(w).alias(w)),
                   "heavy-digests")
    left = rows.join(F.broadcast(heavy), d, "left").where(F.col(w).isNull() | (F.col(w) == F.col("doc_id").cast("long")))
    order = Window.partitionBy(d).orderBy(F.col("doc_id").desc_nulls_last())
    return left.withColumn("__hs_rank", F.row_number().over(order)).where("__hs_rank = 1").select(*[f"`{c}`" for c in names])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, row_number() OVER () AS r FROM documents),
     w AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r) AS pos FROM d)
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, text_sha256 FROM w
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE = {"op7_exact_dedup": SQL}
