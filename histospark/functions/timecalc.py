"""Time helpers as column expressions.

Date differences count *boundary crossings* (the warehouse semantics the
reference relies on): the difference of ``date_trunc``-ed values, never
Spark's ``timestampdiff`` (which counts complete units).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def ts_lit(t: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (no session-zone shift)."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ wall clock (no zone)."""
    return F.unix_timestamp(ts)


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``
    (difference of the truncated wall clocks, independent of the session
    time zone)."""
    s = _UNIT_SECONDS[unit]
    return (F.floor(epoch_seconds(end) / F.lit(s)) - F.floor(epoch_seconds(start) / F.lit(s))).cast("bigint")


def trunc_ntz(unit: str, ts: Column) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ (Spark's ``date_trunc``
    returns a zoned TIMESTAMP): the wall clock minus its finer fields."""
    secs = F.date_part(F.lit("SECOND"), ts)
    if unit == "minute":
        iv = F.make_dt_interval(secs=secs)
    elif unit == "hour":
        iv = F.make_dt_interval(mins=F.minute(ts), secs=secs)
    elif unit == "day":
        iv = F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts), secs=secs)
    else:
        raise ValueError(unit)
    return (ts - iv).cast("timestamp_ntz")


def add_minutes(ts: Column, minutes: Column) -> Column:
    """``ts`` + a possibly fractional number of minutes, rounded to microseconds."""
    micros = F.round(minutes * F.lit(60_000_000)).cast("bigint")
    return (ts + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))).cast("timestamp_ntz")
