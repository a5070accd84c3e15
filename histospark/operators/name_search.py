"""Trigram index for name search (C4).

``build`` writes posting lists of the lower-cased names: for every run of three
characters the ids of the names that have it, in rows of at most BLOCK ids,
sorted by trigram so that a search reads the row groups of its own trigrams
only. A search intersects the lists of its trigrams (a name must occur in each)
and verifies the survivors with the real substring test, so it returns exactly
the rows of a scan. A needle of one or two characters has no trigram; its
posting lists are those of the shorter runs, which the index keeps as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.session import workspace_dir

GRAM = 3
#: Ids in one posting row.
BLOCK = 4096
ROW_GROUP = 1 << 20
POSTINGS = "gram string, ids array<bigint>"


def grams(text, n: int = GRAM):
    """The distinct runs of ``n`` characters of a lower-cased text."""
    last = F.length(text) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


class NameIndex:
    """Index over the distinct values of a name column."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, names: DataFrame, column: str, path: str | None = None) -> "NameIndex":
        """Write the index of ``names``; each distinct name is indexed once."""
        spark = names.sparkSession
        index = cls(spark, path or workspace_dir(spark, "name-index"))
        distinct = names.select(F.col(column).cast("string").alias("name")).where("name IS NOT NULL").distinct()
        distinct.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{index.path}/names")
        low = index._names().select("id", F.lower("name").alias("low"))
        runs = low.select("id", F.explode(F.concat(*[grams(F.col("low"), n) for n in range(1, GRAM + 1)])).alias("gram"))
        # a gram's ids are dealt to rows of BLOCK ids at most, so that a very common gram is many rows, not one
        spread = F.floor(F.count(F.lit(1)) / F.lit(BLOCK // 2)) + 1
        blocks = runs.groupBy("gram").agg(spread.alias("blocks"))
        dealt = runs.join(blocks, "gram").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        lists = dealt.groupBy("gram", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        lists = lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
        lists.select("gram", "ids").write.option("parquet.block.size", ROW_GROUP).parquet(f"{index.path}/postings")
        return index

    def _names(self) -> DataFrame:
        return self.spark.read.schema("name string, id bigint").parquet(f"{self.path}/names")

    def candidates(self, needle: str) -> DataFrame:
        """Ids of the names that have every gram of ``needle``."""
        low = self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]  # as the index lower-cases
        n = min(GRAM, len(low))
        wanted = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where(F.col("gram").isin(wanted))
        ids = rows.select("gram", F.explode("ids").alias("id"))
        return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")

    def search(self, needle: str) -> DataFrame:
        """The distinct names that contain ``needle`` in any case; all of an empty one."""
        names = self._names()
        if needle:
            names = names.join(self.candidates(needle), "id", "left_semi").where(F.lower("name").contains(F.lower(F.lit(needle))))
        return names.select("name")
