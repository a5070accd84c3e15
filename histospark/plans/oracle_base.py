"""Shared SQL text for the DuckDB oracle: fixture feeds, stream metadata and
unified readings written independently of the Spark code (same rules, other
engine). Every oracle query starts with ``WITH`` + :data:`BASE`.
"""

from __future__ import annotations

from histospark.sources.fixtures import (CLASSIC_FEED, LONG_FEED, W_ACTIVE, W_BLADE, W_EXPECTED,
                                         W_REVENUE, W_STATE, WIDE_FEED)

# The domain keywords in their order (the first matching domain
# wins), written out here so that the check does not share the operator's table.
DOMAINS = [
    ("wind_energy", ["wind", "turbine", "hornsea", "ge0", "ge1", "yorkshire",
                     "wind_speed", "wind_direction", "pitch_angle", "vane_position",
                     "gearbox", "hub_temp", "eaf", "active power", "apparent power",
                     "expected power", "revenue", "total power", "total turbines"]),
    ("rotating_machinery", ["rotating", "ps0", "ps1", "ps2", "ps3", "ps4", "ps5", "ps6",
                            "bearing", "suction", "discharge", "pump"]),
    ("production_quality", ["plant", "pq.", "concentration", "granule", "dissolv", "ingredient", "agitator"]),
    ("packaging", ["pack", "line", "carb", "chill", "warmer", "running", "refrigerant"]),
]
UUID_RE = r"\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
UNIT_RE = r"\s*\([^)]*\)\s*$"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    return strip_ws(f"regexp_replace(regexp_replace({x}, '{UUID_RE}', '', 'g'), '{UNIT_RE}', '')")


def unit_of(x: str) -> str:
    u = f"regexp_extract({x}, '\\(([^)]+)\\)\\s*$', 1)"
    return f"CASE WHEN {strip_ws(u)} <> '' THEN {u} END"


def domain_case(a: str, sig: str) -> str:
    parts = []
    for dom, keys in DOMAINS:
        cond = " OR ".join(f"contains(lower({a}), {s(k)}) OR contains(lower({sig}), {s(k)})" for k in keys)
        parts.append(f"WHEN {cond} THEN {s(dom)}")
    return "CASE " + " ".join(parts) + f" ELSE 'general' END"


def numeric(x: str) -> str:
    return f"CASE WHEN isfinite(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END"


_WIDE_COLS = [(2, W_ACTIVE, "NUMERIC"), (3, W_EXPECTED, "NUMERIC"), (4, W_REVENUE, "NUMERIC"),
              (5, W_BLADE, "NUMERIC"), (6, W_STATE, "STRING")]

_long_base = clean("stream")
_wide_values = ", ".join(f"({o}, {s(c)}, {s(t)})" for o, c, t in _WIDE_COLS)

FEEDS = f"""
f_long AS (
  SELECT ts AS "Timestamp",
         'Rotating Machinery - PS' || CAST(user_id % 7 AS VARCHAR) || '.' ||
         CASE event_type WHEN 'click' THEN 'Bearing Temperature Value'
                         WHEN 'view' THEN 'Discharge Pressure Value'
                         WHEN 'purchase' THEN 'Suction Pressure Value'
                         WHEN 'signup' THEN 'Flow Rate Value'
                         ELSE 'Vibration Value' END AS "Field",
         CASE WHEN event_id % 50 = 0 THEN 'Bad Input'
              WHEN event_id % 75 = 1 THEN NULL
              ELSE CAST(value AS VARCHAR) END AS "Value",
         'PS' || CAST(user_id % 7 AS VARCHAR) AS "Name",
         event_type AS "Uom",
         event_id AS row_id
  FROM events),
f_wide AS (
  SELECT o_orderdate + to_seconds(o_orderkey % 86400) AS "Timestamp",
         o_totalprice / 1000 AS {q(W_ACTIVE)},
         CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 950 END AS {q(W_EXPECTED)},
         o_totalprice / 12 AS {q(W_REVENUE)},
         CAST(o_custkey % 90 AS DOUBLE) AS {q(W_BLADE)},
         o_orderstatus AS {q(W_STATE)},
         o_orderkey AS row_id
  FROM orders),
f_classic AS (
  SELECT ts AS "Timestamp", value AS "Value", value > 100 AS "IsQuestionable", event_id AS row_id
  FROM events WHERE event_type = 'error')"""

META = f"""
cand_long AS (
  SELECT '{LONG_FEED}' AS feed, 1 AS feed_ord, 2 AS col_ord, stream, 'NUMERIC' AS data_type, 'LONG' AS format,
         {_long_base} AS base
  FROM (SELECT DISTINCT "Field" AS stream FROM f_long WHERE "Field" IS NOT NULL)),
cand_wide AS (
  SELECT '{WIDE_FEED}' AS feed, 2 AS feed_ord, o AS col_ord, c AS stream, t AS data_type, 'WIDE' AS format
  FROM (VALUES {_wide_values}) v(o, c, t)),
cand AS (
  SELECT feed, feed_ord, col_ord, stream, data_type, format,
         CASE WHEN strpos(base, '.') > 0
              THEN substr(base, 1, length(base) - length(string_split(base, '.')[-1]) - 1)
              ELSE feed END AS asset,
         CASE WHEN strpos(base, '.') > 0 THEN {strip_ws("string_split(base, '.')[-1]")} ELSE base END AS signal
  FROM cand_long
  UNION ALL
  SELECT feed, feed_ord, col_ord, stream, data_type, format,
         CASE WHEN strpos(stream, '.') > 0 THEN {strip_ws("substr(stream, 1, strpos(stream, '.') - 1)")}
              WHEN strpos(stream, '_') > 0 THEN {strip_ws("substr(stream, 1, strpos(stream, '_') - 1)")}
              ELSE feed END AS asset,
         CASE WHEN strpos(stream, '.') > 0 THEN {clean(strip_ws("substr(stream, strpos(stream, '.') + 1)"))}
              WHEN strpos(stream, '_') > 0 THEN {clean(strip_ws("substr(stream, strpos(stream, '_') + 1)"))}
              ELSE stream END AS signal
  FROM cand_wide
  UNION ALL
  SELECT '{CLASSIC_FEED}', 3, 2, '{CLASSIC_FEED}', 'NUMERIC', 'CLASSIC', '{CLASSIC_FEED}', 'VALUE'),
smap AS (
  SELECT feed, stream, asset AS asset_path, asset, signal, {domain_case("asset", "signal")} AS domain,
         data_type, CASE WHEN format <> 'CLASSIC' THEN {unit_of("stream")} END AS unit,
         feed_ord, col_ord, format, k
  FROM (SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY feed_ord, col_ord, stream) AS k FROM cand)),
meta AS (SELECT * EXCLUDE (k) FROM smap WHERE k = 1)"""

_wide_num = "\n  UNION ALL\n  ".join(
    f"SELECT '{WIDE_FEED}' AS feed, {s(c)} AS stream, \"Timestamp\" AS ts, CAST({q(c)} AS VARCHAR) AS raw_value, "
    f"CASE WHEN isfinite({q(c)}) THEN {q(c)} END AS numeric_value, CAST(NULL AS VARCHAR) AS uom, "
    f"CAST(NULL AS BOOLEAN) AS is_questionable, row_id FROM f_wide WHERE {q(c)} IS NOT NULL"
    for _, c, t in _WIDE_COLS if t == "NUMERIC")
_wide_txt = "\n  UNION ALL\n  ".join(
    f"SELECT '{WIDE_FEED}' AS feed, {s(c)} AS stream, \"Timestamp\" AS ts, {q(c)} AS raw_value, "
    f"{numeric(q(c))} AS numeric_value, CAST(NULL AS VARCHAR) AS uom, "
    f"CAST(NULL AS BOOLEAN) AS is_questionable, row_id FROM f_wide WHERE {q(c)} IS NOT NULL"
    for _, c, t in _WIDE_COLS if t == "STRING")

READINGS = f"""
r_all AS (
  SELECT '{LONG_FEED}' AS feed, "Field" AS stream, "Timestamp" AS ts, "Value" AS raw_value,
         {numeric('"Value"')} AS numeric_value, "Uom" AS uom, CAST(NULL AS BOOLEAN) AS is_questionable, row_id
  FROM f_long WHERE "Value" IS NOT NULL
  UNION ALL
  {_wide_num}
  UNION ALL
  {_wide_txt}
  UNION ALL
  SELECT '{CLASSIC_FEED}', '{CLASSIC_FEED}', "Timestamp", CAST("Value" AS VARCHAR),
         CASE WHEN isfinite("Value") THEN "Value" END, CAST(NULL AS VARCHAR), "IsQuestionable", row_id
  FROM f_classic WHERE "Value" IS NOT NULL),
readings AS (
  SELECT r.feed, r.stream, m.asset, m.signal, m.domain, coalesce(r.uom, m.unit) AS unit, r.ts, r.raw_value,
         r.numeric_value, CASE WHEN r.numeric_value IS NULL THEN r.raw_value END AS string_value,
         r.is_questionable, r.row_id, m.data_type
  FROM r_all r JOIN smap m ON r.feed = m.feed AND r.stream = m.stream),
feed_max AS (
  SELECT '{LONG_FEED}' AS feed, max("Timestamp") AS max_ts FROM f_long
  UNION ALL SELECT '{WIDE_FEED}', max("Timestamp") FROM f_wide
  UNION ALL SELECT '{CLASSIC_FEED}', max("Timestamp") FROM f_classic),
num_meta AS (SELECT * FROM meta WHERE data_type IN ('FLOAT', 'NUMBER', 'DOUBLE', 'NUMERIC'))"""

BASE = FEEDS + "," + META + "," + READINGS


def windowed(days: int) -> str:
    """Readings of numeric signals inside the last ``days`` of their feed."""
    return f"""(SELECT r.* FROM readings r JOIN feed_max fm ON r.feed = fm.feed
     WHERE r.data_type IN ('FLOAT', 'NUMBER', 'DOUBLE', 'NUMERIC')
       AND r.ts >= fm.max_ts - INTERVAL {int(days)} DAY)"""


def r6(x: str) -> str:
    """Same rounding steps as ``names.round6``."""
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def sql(*ctes: str, select: str) -> str:
    """WITH BASE, extra CTEs..., then the final SELECT."""
    extra = "".join("," + c for c in ctes)
    head = "WITH RECURSIVE " if "rec AS (" in extra else "WITH "
    return head + BASE + extra + "\n" + select
