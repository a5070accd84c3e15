"""Feeds found in a catalog database (A1, A3).

``discover`` walks the tables and views of a database: each is opened, those
with a ``Timestamp`` column are feeds (name = table name, in name order), the
others and the ones that can't be opened are reported. ``CatalogHistorian``
takes up new tables and drops vanished ones on ``refresh``.
"""

from __future__ import annotations

import fnmatch

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from histospark.context import Historian
from histospark.sources.feeds import TS_COL

REPORT = "feed string, status string, n_columns int, error string"


def discover(spark: SparkSession, database: str, pattern: str = "*") -> tuple[dict[str, DataFrame], list[tuple]]:
    """({name: frame} of the feeds, report rows of all tables): BUNDLED, NOT_A_FEED
    (no Timestamp column) or NOT_BUNDLED (with the error). Schemas only are read."""
    feeds, report = {}, []
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and fnmatch.fnmatchcase(t.name, pattern))
    for name in names:
        try:
            df = spark.table(f"`{database}`.`{name}`")
            columns = df.columns
        except PySparkException as e:
            report.append((name, "NOT_BUNDLED", None, str(e).splitlines()[0][:300]))
            continue
        if TS_COL in columns:
            feeds[name] = df
        report.append((name, "BUNDLED" if TS_COL in columns else "NOT_A_FEED", len(columns), None))
    return feeds, report


class CatalogHistorian(Historian):
    """A Historian over the feeds of a catalog database."""

    def __init__(self, spark: SparkSession, database: str, pattern: str = "*", **options):
        self.database, self.pattern = database, pattern
        feeds, self._report = discover(spark, database, pattern)
        self.added, self.dropped = sorted(feeds), []
        super().__init__(spark, feeds, **options)

    def refresh(self) -> "CatalogHistorian":
        """Walk the database again; ``added`` and ``dropped`` name what changed."""
        feeds, self._report = discover(self.spark, self.database, self.pattern)
        self.added, self.dropped = sorted(set(feeds) - set(self._sources)), sorted(set(self._sources) - set(feeds))
        for name in self.dropped:
            self.spark.catalog.dropTempView(name)
        self._sources = feeds
        super().refresh()
        return self

    def report(self) -> DataFrame:
        """A row per table found, and per feed that has gone since the last walk (DROPPED)."""
        gone = [(name, "DROPPED", None, None) for name in self.dropped]
        return self.spark.createDataFrame(self._report + gone, REPORT)
