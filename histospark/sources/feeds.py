"""Feed registry (A1, A3, A4, A5): register sources, detect their shape.

A feed is any DataFrame (or parquet path) with a ``Timestamp`` column. Only the
schema is inspected on the driver; data never is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histospark.functions.timecalc import ts_lit

LONG, WIDE, CLASSIC = "LONG", "WIDE", "CLASSIC"
TS_COL = "Timestamp"
ROW_ID = "row_id"
# Long-format descriptive columns and single-signal quality flags.
LONG_DIMENSIONS = ("Field", "Name", "Uom")
QUALITY_FLAGS = ("IsQuestionable", "IsSubstituted", "IsAnnotated", "IsGood")


def type_class(dt: T.DataType) -> str:
    """Metadata class: string types -> STRING, everything else -> NUMERIC."""
    return "STRING" if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)) else "NUMERIC"


def is_signal_type(dt: T.DataType) -> bool:
    """Numbers, booleans and text can be readings; dates, times, binary and
    nested types can't."""
    return isinstance(dt, (T.NumericType, T.BooleanType, T.StringType, T.VarcharType, T.CharType))


def model_class(dt: T.DataType) -> str | None:
    """Semantic-model class: numbers are facts, text is a dimension, the rest
    (booleans, timestamps) is left out."""
    if isinstance(dt, T.NumericType):
        return "FACT"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "DIMENSION"
    return None


@dataclass
class Feed:
    name: str
    ordinal: int
    df: DataFrame | None
    error: str | None = None
    control_columns: tuple[str, ...] = (TS_COL, ROW_ID)
    _columns: list[tuple[str, T.DataType]] = field(default_factory=list)

    @property
    def reachable(self) -> bool:
        return self.df is not None and self.error is None

    @property
    def columns(self) -> list[tuple[str, T.DataType]]:
        if not self._columns and self.df is not None:
            self._columns = [(f.name, f.dataType) for f in self.df.schema.fields]
        return self._columns

    @property
    def column_names(self) -> list[str]:
        return [c for c, _ in self.columns]

    @property
    def time(self):
        """The Timestamp column as TIMESTAMP_NTZ, whatever its type: a zoned one
        in the session's zone; a text that is no time counts as missing."""
        kind = dict(self.columns)[TS_COL]
        if isinstance(kind, T.TimestampNTZType):
            return F.col(TS_COL)
        return F.col(TS_COL).try_cast("timestamp_ntz") if isinstance(kind, T.StringType) else F.col(TS_COL).cast("timestamp_ntz")

    def between(self, since=None, until=None):
        """Condition on the Timestamp column, of its own type so that it
        reaches the scan; None without bounds."""
        zoned = isinstance(dict(self.columns)[TS_COL], T.TimestampType)
        ts, lit = (F.col(TS_COL), lambda t: ts_lit(t).cast("timestamp")) if zoned else (self.time, ts_lit)
        parts = ([ts >= lit(since)] if since is not None else []) + ([ts <= lit(until)] if until is not None else [])
        return parts[0] & parts[-1] if parts else None

    @property
    def format(self) -> str:
        """A4: LONG when ``Field`` exists, CLASSIC when ``Value`` exists
        without ``Field``, otherwise WIDE (names are case-sensitive)."""
        names = set(self.column_names)
        if "Field" in names:
            return LONG
        if "Value" in names:
            return CLASSIC
        return WIDE

    def ordinal_of(self, col: str) -> int:
        return self.column_names.index(col) + 1

    def signal_columns(self) -> list[tuple[int, str, T.DataType]]:
        """WIDE: every column that can hold a signal, with 1-based ordinal; the
        control columns and quality flags are none."""
        skip = self.control_columns + QUALITY_FLAGS
        return [(i + 1, c, t) for i, (c, t) in enumerate(self.columns) if c not in skip and is_signal_type(t)]

    def unsupported_columns(self) -> list[tuple[str, str]]:
        """WIDE: (column, type) of columns whose type can't be a reading."""
        return [(c, t.simpleString()) for c, t in self.columns if c not in self.control_columns and not is_signal_type(t)]


def _is_view_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) is not None


def register_feeds(spark: SparkSession, sources: dict[str, DataFrame | str],
                   control_columns: tuple[str, ...] = (TS_COL, ROW_ID),
                   create_views: bool = True) -> list[Feed]:
    """A1/A5: one Feed per source, in the given order; parquet paths are
    opened lazily and an unreadable path becomes an unreachable feed (A3).
    Each reachable feed is also exposed as a temp view of the same name."""
    feeds = []
    for i, (name, src) in enumerate(sources.items(), start=1):
        df, err = None, None
        try:
            df = spark.read.parquet(src) if isinstance(src, str) else src
            _ = df.schema
        except Exception as exc:  # unreadable source: kept, flagged
            df, err = None, str(exc).splitlines()[0][:300]
        feed = Feed(name, i, df, err, control_columns)
        if create_views and feed.reachable and _is_view_name(name):
            df.createOrReplaceTempView(name)
        feeds.append(feed)
    return feeds
