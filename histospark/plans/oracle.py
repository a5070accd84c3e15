"""DuckDB SQL twin of every registered query (same names, same columns)."""

from __future__ import annotations

from histospark.plans.oracle_base import sql, windowed

ORACLE: dict[str, str] = {}


def oracle(name: str, text: str) -> None:
    ORACLE[name] = text


oracle("stream_metadata", sql(select="SELECT feed, stream, asset_path, asset, signal, domain, data_type FROM meta"))

oracle("unified_readings", sql(select="""
SELECT feed, stream, asset, signal, domain, unit, ts, numeric_value, string_value, is_questionable, row_id
FROM readings"""))

oracle("readings_table", ORACLE["unified_readings"])

oracle("string_readings", sql(select="""
SELECT feed, asset, signal, ts, string_value, row_id FROM readings WHERE string_value IS NOT NULL"""))

_ROLL = """
  CASE WHEN count(numeric_value) OVER w > 0
       THEN list_sum(list(numeric_value) OVER w) / count(numeric_value) OVER w END AS rolling_avg,
  stddev_samp(numeric_value) OVER w AS rolling_std,
  count(*) OVER (PARTITION BY asset, signal) AS n_rows"""
_WIN = "WINDOW w AS (PARTITION BY asset, signal ORDER BY ts, row_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"

ANOM = f"""
scored_base AS (SELECT asset, signal, domain, ts, row_id, numeric_value, {_ROLL}
  FROM {windowed(7)} {_WIN}),
scored AS (SELECT *, CASE WHEN rolling_std > 0 THEN abs((numeric_value - rolling_avg) / rolling_std) ELSE 0 END AS z
  FROM scored_base WHERE n_rows >= 12 AND rolling_avg IS NOT NULL),
anom AS (
SELECT asset, signal, domain, ts, (floor((numeric_value) * 1e6 + 0.5) / 1e6) AS numeric_value,
       coalesce(z > 3, false) AS is_anomaly, (floor((z) * 1e6 + 0.5) / 1e6) AS anomaly_score,
       (floor((rolling_avg) * 1e6 + 0.5) / 1e6) AS forecast_value,
       (floor((rolling_avg - 3 * rolling_std) * 1e6 + 0.5) / 1e6) AS lower_bound,
       (floor((rolling_avg + 3 * rolling_std) * 1e6 + 0.5) / 1e6) AS upper_bound, 'ANOMALY' AS model_type
FROM scored)"""

oracle("detect_anomalies", sql(ANOM, select="SELECT * FROM anom"))

oracle("rolling_stats", sql(select=f"""
SELECT asset, signal, ts, row_id,
       (floor((CASE WHEN count(numeric_value) OVER w > 0
                    THEN list_sum(list(numeric_value) OVER w) / count(numeric_value) OVER w END) * 1e6 + 0.5) / 1e6)
         AS rolling_avg,
       (floor((stddev_samp(numeric_value) OVER w) * 1e6 + 0.5) / 1e6) AS rolling_std
FROM readings WHERE data_type IN ('FLOAT', 'NUMBER', 'DOUBLE', 'NUMERIC') {_WIN}"""))

oracle("signal_stats", sql(select=f"""
SELECT asset, signal, count(*) AS readings,
       (floor((coalesce(stddev_samp(numeric_value), 0)) * 1e6 + 0.5) / 1e6) AS stddev,
       (floor((coalesce(avg(numeric_value), 0)) * 1e6 + 0.5) / 1e6) AS avg_value
FROM {windowed(7)} GROUP BY asset, signal"""))

oracle("anomaly_candidates", sql(f"""
st AS (SELECT r.asset, r.signal, count(*) AS readings, stddev_samp(numeric_value) AS sd, avg(numeric_value) AS av
  FROM {windowed(7)} r GROUP BY r.asset, r.signal)""", select="""
SELECT asset, signal, readings, (floor((sd) * 1e6 + 0.5) / 1e6) AS stddev, (floor((coalesce(av, 0)) * 1e6 + 0.5) / 1e6) AS avg_value
FROM st WHERE readings >= 50 AND coalesce(sd, 0) > 0 ORDER BY sd DESC, asset, signal"""))

# --- E2, E15, F3, F4, G -----------------------------------------------------
from histospark.plans.oracle_base import r6  # noqa: E402

_NUM = "(SELECT * FROM readings WHERE data_type IN ('FLOAT', 'NUMBER', 'DOUBLE', 'NUMERIC'))"

oracle("series_profile", sql(select=f"""
SELECT asset, signal, count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts,
       {r6('avg(numeric_value)')} AS avg_value, {r6('stddev_samp(numeric_value)')} AS stddev
FROM {_NUM} GROUP BY asset, signal"""))

oracle("reading_gaps", sql(select=f"""
SELECT asset, signal, ts, row_id,
       date_diff('minute', lag(ts) OVER (PARTITION BY asset, signal ORDER BY ts, row_id), ts) AS gap_minutes
FROM {_NUM}"""))

oracle("last_n_readings", sql(select=f"""
SELECT asset, signal, ts, row_id, numeric_value, recency_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS recency_rank FROM {_NUM})
WHERE recency_rank <= 200"""))

_INTERVAL = f"""
t201 AS (SELECT asset, signal, ts, row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS k
         FROM {_NUM}),
g201 AS (SELECT asset, signal, k, date_diff('minute', lag(ts) OVER (PARTITION BY asset, signal ORDER BY k DESC), ts) AS gap
         FROM t201 WHERE k <= 201),
med AS (SELECT asset, signal, median(gap) AS med FROM g201 WHERE k <= 200 AND gap > 0 GROUP BY asset, signal),
ivl AS (SELECT s.asset, s.signal, coalesce(CAST(med.med AS DOUBLE), 60.0) AS interval_minutes
        FROM (SELECT DISTINCT asset, signal FROM {_NUM}) s LEFT JOIN med USING (asset, signal))"""

oracle("sampling_interval", sql(_INTERVAL, select="SELECT asset, signal, interval_minutes FROM ivl"))

_STEPS = "CAST(greatest(floor(1440.0 / interval_minutes), 1) * {h} AS INTEGER)"

oracle("forecast_steps", sql(_INTERVAL, select=f"""
SELECT asset, signal, interval_minutes, {_STEPS.format(h=7)} AS steps FROM ivl"""))

_A, _B, _P = "0.3::DOUBLE", "0.1::DOUBLE", "0.98::DOUBLE"
_LP = f"(rec.l + {_P} * rec.t)"
_HOLT = f"""
tr AS (SELECT asset, signal, ts, row_id, numeric_value AS v,
              row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS k
       FROM {_NUM} WHERE numeric_value IS NOT NULL),
tr2 AS (SELECT asset, signal, ts, v, row_number() OVER (PARTITION BY asset, signal ORDER BY ts, row_id) AS i,
               count(*) OVER (PARTITION BY asset, signal) AS n
        FROM tr WHERE k <= 200),
rec AS (
  SELECT a.asset, a.signal, 1 AS i, a.v AS l,
         CASE WHEN a.n > 1 THEN (b.v - a.v) / (a.n - 1) ELSE 0.0 END AS t, CAST(NULL AS DOUBLE) AS r
  FROM tr2 a JOIN tr2 b ON a.asset = b.asset AND a.signal = b.signal AND a.i = 1 AND b.i = b.n
  UNION ALL
  SELECT rec.asset, rec.signal, rec.i + 1,
         {_A} * x.v + (1.0::DOUBLE - {_A}) * {_LP},
         {_B} * (({_A} * x.v + (1.0::DOUBLE - {_A}) * {_LP}) - rec.l) + (1.0::DOUBLE - {_B}) * {_P} * rec.t,
         x.v - {_LP}
  FROM rec JOIN tr2 x ON x.asset = rec.asset AND x.signal = rec.signal AND x.i = rec.i + 1),
fit AS (SELECT rec.asset, rec.signal, max(rec.i) AS train_rows, arg_max(rec.l, rec.i) AS level,
               arg_max(rec.t, rec.i) AS trend, stddev_samp(rec.r) AS residual_std
        FROM rec GROUP BY rec.asset, rec.signal),
lastts AS (SELECT asset, signal, max(ts) AS last_ts FROM tr2 GROUP BY asset, signal)"""

oracle("holt_fit", sql(_HOLT, select=f"""
SELECT f.asset, f.signal, CAST(f.train_rows AS INTEGER) AS train_rows, l.last_ts, {r6('f.level')} AS level,
       {r6('f.trend')} AS trend, {r6('f.residual_std')} AS residual_std
FROM fit f JOIN lastts l USING (asset, signal)"""))


_FC_NAMES = ["t201", "g201", "med", "ivl", "tr", "tr2", "rec", "fit", "lastts", "cnt", "base", "st", "fc", "fcout", "pick"]


def forecast_ctes(pick: str = "", horizon: int = 7, suffix: str = "") -> list[str]:
    """CTEs ending in ``fcout<suffix>``: forecasts of every numeric signal
    (or of the signals in the ``pick`` CTE)."""
    num = _NUM if not pick else "(SELECT * FROM readings WHERE (asset, signal) IN (SELECT asset, signal FROM pick))"
    body = (_INTERVAL + "," + _HOLT).replace(_NUM, num)
    ctes = ([pick] if pick else []) + [body, f"""
cnt AS (SELECT asset, signal, count(*) AS n, stddev_samp(numeric_value) AS all_std, max(domain) AS domain
        FROM {num} GROUP BY asset, signal),
base AS (SELECT c.asset, c.signal, coalesce(c.domain, 'general') AS domain, f.level, f.trend,
                coalesce(f.residual_std, CASE WHEN c.all_std <> 0 THEN c.all_std ELSE 1.0 END) AS sigma,
                l.last_ts, i.interval_minutes, {_STEPS.format(h=int(horizon))} AS steps
         FROM cnt c JOIN fit f USING (asset, signal) JOIN lastts l USING (asset, signal) JOIN ivl i USING (asset, signal)
         WHERE c.n >= 12 AND f.train_rows >= 5),
st AS (SELECT *, unnest(generate_series(1, steps)) AS step FROM base),
fc AS (SELECT *, level + (({_P} * (1.0::DOUBLE - pow({_P}, step))) / (1.0::DOUBLE - {_P})) * trend AS fv,
              1.96::DOUBLE * sigma * sqrt(CAST(step AS DOUBLE)) AS band FROM st),
fcout AS (
SELECT asset, signal, domain, CAST(step AS INTEGER) AS step,
       last_ts + to_microseconds(CAST(round(interval_minutes * step * 60000000) AS BIGINT)) AS ts,
       {r6('fv')} AS forecast_value, {r6('fv - band')} AS lower_bound, {r6('fv + band')} AS upper_bound,
       'FORECAST' AS model_type
FROM fc)"""]
    if suffix:
        import re
        ctes = [re.sub(r"\b(" + "|".join(_FC_NAMES) + r")\b", lambda m: m.group(1) + suffix, c) for c in ctes]
    return ctes


oracle("forecast_signal", sql(*forecast_ctes(), select="SELECT * FROM fcout"))
oracle("auto_forecast_signal", sql(*forecast_ctes(
    "pick AS (SELECT asset, signal FROM num_meta ORDER BY signal, asset LIMIT 1)"), select="SELECT * FROM fcout"))

oracle("data_sufficiency", sql(f"""
ds AS (SELECT r.asset, r.signal, count(*) AS total_readings, count(r.numeric_value) AS numeric_readings,
              count(*) FILTER (WHERE r.ts >= fm.max_ts - INTERVAL 7 DAY) AS window_readings,
              stddev_samp(r.numeric_value) FILTER (WHERE r.ts >= fm.max_ts - INTERVAL 7 DAY) AS wstd
       FROM {_NUM} r JOIN feed_max fm ON r.feed = fm.feed GROUP BY r.asset, r.signal)""", select="""
SELECT asset, signal, total_readings, numeric_readings, window_readings,
       window_readings >= 12 AS can_detect,
       total_readings >= 12 AND least(numeric_readings, 200) >= 5 AS can_forecast,
       CASE WHEN window_readings >= 50 AND coalesce(wstd, 0) > 0 THEN 'CANDIDATE'
            WHEN window_readings >= 12 THEN 'DETECTABLE'
            WHEN total_readings >= 12 AND least(numeric_readings, 200) >= 5 THEN 'FORECAST_ONLY'
            ELSE 'INSUFFICIENT' END AS status
FROM ds"""))

# --- E, H, Q ----------------------------------------------------------------------
from histospark.plans.oracle_base import s as _s  # noqa: E402
from histospark.sources.fixtures import CLASSIC_FEED, LONG_FEED, WIDE_FEED  # noqa: E402

FEED_NAMES = f"(VALUES ('{LONG_FEED}', 1), ('{WIDE_FEED}', 2), ('{CLASSIC_FEED}', 3)) fl(feed, feed_ord)"
FT = f"""ft AS (SELECT '{LONG_FEED}' AS feed, "Timestamp" AS ts FROM f_long
  UNION ALL SELECT '{WIDE_FEED}', "Timestamp" FROM f_wide
  UNION ALL SELECT '{CLASSIC_FEED}', "Timestamp" FROM f_classic)"""

oracle("feed_volume", sql(FT, """
v AS (SELECT feed, count(*) AS n, min(ts) AS earliest, max(ts) AS latest FROM ft GROUP BY feed),
sg AS (SELECT feed, count(*) AS signals FROM meta GROUP BY feed)""", select=f"""
SELECT fl.feed, coalesce(v.n, 0) AS "rows", v.earliest, v.latest, coalesce(sg.signals, 0) AS signals
FROM {FEED_NAMES} LEFT JOIN v ON v.feed = fl.feed LEFT JOIN sg ON sg.feed = fl.feed"""))

oracle("domain_stats", sql(select="SELECT domain, count(*) AS streams, count(DISTINCT asset) AS assets FROM meta GROUP BY domain"))

oracle("asset_stats", sql(select="""
SELECT asset, domain, count(*) AS signals FROM meta GROUP BY asset, domain
ORDER BY signals DESC, asset, domain"""))

oracle("kpi_summary", sql(select="""
SELECT count(*) AS total_streams, count(DISTINCT asset) AS assets, count(DISTINCT domain) AS domains,
       count(DISTINCT signal) AS signal_types FROM meta"""))

oracle("domain_top_assets", sql("""
g AS (SELECT domain, asset, count(*) AS signals FROM meta GROUP BY domain, asset),
rk AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY asset) AS asset_rank,
              CAST(sum(signals) OVER (PARTITION BY domain) AS BIGINT) AS domain_streams FROM g)""", select="""
SELECT domain, domain_streams, asset, signals, asset_rank FROM rk WHERE asset_rank <= 4"""))

oracle("hourly_trend", sql(f"""
g AS (SELECT asset, signal, date_trunc('hour', ts) AS hour, avg(numeric_value) AS avg_value
      FROM {_NUM} GROUP BY asset, signal, date_trunc('hour', ts))""", select=f"""
SELECT asset, signal, hour, {r6('avg_value')} AS avg_value FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY hour) AS k FROM g) WHERE k <= 48"""))

oracle("trend_summary", sql(f"""
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS k
      FROM {_NUM}) WHERE k <= 500)""", select=f"""
SELECT asset, signal, count(*) AS readings, {r6('min(numeric_value)')} AS min_value, {r6('max(numeric_value)')} AS max_value,
       {r6('avg(numeric_value)')} AS mean_value, {r6('stddev_samp(numeric_value)')} AS std_value
FROM t GROUP BY asset, signal"""))

_TOPA = "topa AS (SELECT * FROM anom ORDER BY ts DESC, asset, signal LIMIT 5000)"
oracle("anomaly_kpis", sql(ANOM, select="""
SELECT count(*) AS rows_analyzed, count(*) FILTER (WHERE is_anomaly) AS anomalies,
       count(DISTINCT (asset, signal)) AS signals_analyzed FROM anom"""))

oracle("anomaly_counts", sql(ANOM, select="""
SELECT asset, signal, count(*) AS scored_rows, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM anom GROUP BY asset, signal"""))

oracle("recent_anomalies", sql(ANOM, _TOPA, select="SELECT * FROM topa"))

oracle("forecast_summary", sql(*forecast_ctes(), select="""
SELECT asset, signal, count(*) AS forecast_points, min(ts) AS forecast_from, max(ts) AS forecast_to
FROM fcout GROUP BY asset, signal"""))

oracle("event_usage", """
SELECT event_type, count(*) AS event_count, min(ts) AS first_event, max(ts) AS last_event
FROM events GROUP BY event_type""")

oracle("schema_inventory", sql(select="""
SELECT 'domain' AS section, domain AS name, domain, count(*) AS streams FROM meta GROUP BY domain
UNION ALL SELECT DISTINCT 'asset', asset, domain, CAST(NULL AS BIGINT) FROM meta
UNION ALL SELECT DISTINCT 'signal', signal, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM meta"""))

oracle("feed_freshness", sql(FT, """
lt AS (SELECT feed, max(ts) AS latest FROM ft GROUP BY feed),
fj AS (SELECT m.feed, lt.latest,
              coalesce(greatest(date_diff('hour', lt.latest, TIMESTAMP '2024-01-31 00:00:00'), 0), -1) AS hours_stale
       FROM (SELECT DISTINCT feed FROM meta) m LEFT JOIN lt ON lt.feed = m.feed)""", select="""
SELECT feed, latest, hours_stale, hours_stale > 48 AS is_stale, max(hours_stale) OVER () AS fleet_max_hours,
       CAST(floor(max(hours_stale) OVER () / 24) AS BIGINT) AS fleet_max_days FROM fj"""))

oracle("bundle_lists", sql(select="""
SELECT m.feed, m.stream, coalesce(b.bundled, false) AS bundled FROM smap m
LEFT JOIN (SELECT feed, stream, bool_or(numeric_value IS NOT NULL) AS bundled FROM r_all GROUP BY feed, stream) b
  ON b.feed = m.feed AND b.stream = m.stream"""))

_STEPS_SQL = """
done AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
         FROM events GROUP BY user_id, event_type),
grid AS (SELECT u.user_id, st.step FROM (SELECT DISTINCT user_id FROM events) u
         CROSS JOIN (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error')) st(step)),
stepst AS (SELECT g.user_id, g.step,
                  CASE WHEN d.n IS NULL THEN 'PENDING' WHEN g.step = 'error' THEN 'ERROR' ELSE 'COMPLETE' END AS status,
                  coalesce(d.n, 0) AS events, d.first_ts, d.last_ts
           FROM grid g LEFT JOIN done d ON d.user_id = g.user_id AND d.event_type = g.step)"""

oracle("step_status", "WITH " + _STEPS_SQL + "\nSELECT * FROM stepst")

oracle("step_rollup", "WITH " + _STEPS_SQL + """,
ro AS (SELECT user_id, count(*) FILTER (WHERE status = 'COMPLETE') AS done_steps, count(*) FILTER (WHERE status = 'ERROR') AS failed_steps,
              count(*) FILTER (WHERE status = 'RUNNING') AS running_steps FROM stepst GROUP BY user_id)
SELECT user_id, done_steps, failed_steps,
       CASE WHEN failed_steps > 0 THEN 'ERROR' WHEN running_steps > 0 THEN 'RUNNING'
            WHEN done_steps = 4 THEN 'COMPLETE' WHEN done_steps > 0 THEN 'PARTIAL' ELSE 'NOT_STARTED' END AS status
FROM ro""")

oracle("latest_step_log", """
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
WHERE k = 1""")

oracle("recent_events", """
SELECT event_id, ts, event_type, user_id, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")

oracle("ordered_metadata", sql(select="""
SELECT feed, stream, asset_path, asset, signal, domain, data_type FROM meta ORDER BY domain, asset, signal"""))

oracle("distinct_streams", sql(select="""
SELECT 'stream' AS kind, feed, stream AS name, CAST(NULL AS VARCHAR) AS domain FROM smap
UNION ALL SELECT DISTINCT 'asset', NULL, asset, domain FROM meta
UNION ALL SELECT DISTINCT 'signal', NULL, signal, NULL FROM meta"""))

oracle("avg_signal_by_asset", sql(select=f"""
SELECT signal, asset, {r6('avg(numeric_value)')} AS avg_value FROM {_NUM} GROUP BY signal, asset"""))

oracle("top_asset_for_signal", sql(select=f"""
SELECT signal, asset, {r6('numeric_value')} AS max_value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY signal ORDER BY numeric_value DESC, asset DESC, ts DESC, row_id DESC) AS k
  FROM {_NUM} WHERE numeric_value IS NOT NULL) WHERE k = 1"""))

oracle("total_over_time", sql(select=f"""
SELECT asset, signal, date_trunc('day', ts) AS period, {r6('sum(numeric_value)')} AS total_value, count(*) AS readings
FROM {_NUM} GROUP BY asset, signal, date_trunc('day', ts)"""))

oracle("quality_issue_count", sql(select="""
SELECT feed, asset, signal, count(*) FILTER (WHERE is_questionable) AS questionable, count(*) AS readings
FROM readings GROUP BY feed, asset, signal"""))

_PS = [f"Rotating Machinery - PS{i}" for i in range(7)]
oracle("compare_across_assets", sql(select="SELECT signal, date_trunc('hour', ts) AS period, " + ", ".join(
    f"{r6(f'avg(numeric_value) FILTER (WHERE asset = {_s(a)})')} AS \"{a}\"" for a in _PS) + f"""
FROM {_NUM} WHERE domain = 'rotating_machinery' GROUP BY signal, date_trunc('hour', ts)"""))

oracle("latest_reading", sql(select=f"""
SELECT asset, signal, ts, {r6('numeric_value')} AS numeric_value, string_value FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS k FROM readings)
WHERE k = 1"""))

# --- C, J --------------------------------------------------------------------------
oracle("metadata_filter", sql(select="""
SELECT feed, stream, asset_path, asset, signal, domain, data_type FROM meta
WHERE domain IN ('rotating_machinery', 'general')"""))

oracle("numeric_signals", sql(select="SELECT feed, stream, asset_path, asset, signal, domain, data_type FROM num_meta"))

oracle("entitled_feeds", f"""
WITH acc AS (SELECT c.c_name AS account, p.view_pattern FROM customer c JOIN (VALUES
  ('AUTOMOBILE', 'wind%'), ('MACHINERY', 'rotating%'), ('BUILDING', '%'), ('FURNITURE', 'process%'),
  ('HOUSEHOLD', '%_single')) p(seg, view_pattern) ON c.c_mktsegment = p.seg)
SELECT account, view_pattern, fl.feed FROM acc JOIN {FEED_NAMES} ON fl.feed LIKE acc.view_pattern""")

oracle("resolve_signal_join", sql(select="""
SELECT feed, stream, asset, signal, domain, count(*) AS readings FROM readings
GROUP BY feed, stream, asset, signal, domain"""))

oracle("domain_lookup", sql(select="""
SELECT c.feed, c.stream, c.asset, c.signal, m.domain, coalesce(m.domain, 'general') AS domain_or_general
FROM cand c LEFT JOIN meta m ON m.feed = c.feed AND m.stream = c.stream"""))

HIER = """
hier AS (
  SELECT asset_path, string_split(asset_path, '.')[-1] AS asset_name,
         CASE WHEN strpos(asset_path, '.') > 0
              THEN substr(asset_path, 1, length(asset_path) - length(string_split(asset_path, '.')[-1]) - 1)
              ELSE '' END AS parent_path,
         CAST(len(string_split(asset_path, '.')) AS BIGINT) AS level_depth,
         domain, stream_count
  FROM (SELECT asset_path, domain, count(*) OVER (PARTITION BY asset_path) AS stream_count,
               row_number() OVER (PARTITION BY asset_path ORDER BY feed_ord, col_ord, stream) AS k FROM meta)
  WHERE k = 1)"""

oracle("asset_hierarchy", sql(HIER, select="SELECT * FROM hier"))

oracle("hierarchy_signals", sql(HIER, select="""
SELECT h.asset_path, h.asset_name, h.level_depth, m.signal, m.data_type, m.domain AS signal_domain
FROM hier h LEFT JOIN meta m ON m.asset = h.asset_path"""))

oracle("queryable_feeds", sql(select=f"""
SELECT fl.feed, fl.feed_ord, CASE fl.feed_ord WHEN 1 THEN 'LONG' WHEN 2 THEN 'WIDE' ELSE 'CLASSIC' END AS format
FROM {FEED_NAMES} WHERE fl.feed IN (SELECT feed FROM meta)"""))

oracle("missing_keys", sql(select="""
SELECT 'signal' AS kind, signal AS key, asset FROM meta m
WHERE NOT EXISTS (SELECT 1 FROM readings r WHERE r.ts >= (SELECT max(max_ts) FROM feed_max) - INTERVAL 7 DAY
                                             AND r.asset = m.asset AND r.signal = m.signal)
UNION ALL SELECT 'state', 'SEMANTIC_VIEW_CREATED', NULL"""))

oracle("history_forecast_align", sql(*forecast_ctes(), f"""
hist AS (SELECT * FROM {_NUM})""", select=f"""
SELECT coalesce(h.asset, f.asset) AS asset, coalesce(h.signal, f.signal) AS signal, coalesce(h.ts, f.ts) AS ts,
       {r6('h.numeric_value')} AS historical, f.forecast_value AS forecast, f.lower_bound, f.upper_bound
FROM hist h FULL OUTER JOIN fcout f ON h.asset = f.asset AND h.signal = f.signal AND h.ts = f.ts"""))

# --- B: parsing views ------------------------------------------------------------------

KEY_PATTERN = "^[A-Za-z0-9_]+$"  # fixed value: characters of a valid key
from histospark.plans.oracle_base import UNIT_RE, UUID_RE, clean, domain_case, numeric, unit_of  # noqa: E402


def clean_alias_sql(x: str) -> str:
    base = f"regexp_replace(regexp_replace({x}, '{UUID_RE}', '', 'g'), '{UNIT_RE}', '')"
    last = f"string_split({base}, '.')[-1]"
    no_prefix = f"regexp_replace({last}, '^[A-Z0-9]+_', '')"
    collapsed = f"regexp_replace({no_prefix}, '[^A-Za-z0-9]+', '_', 'g')"
    trimmed = f"upper(regexp_replace({collapsed}, '^_+|_+$', '', 'g'))"
    return f"CASE WHEN {trimmed} = '' THEN 'VALUE' ELSE {trimmed} END"


oracle("clean_signal_name", sql(select=f"SELECT feed, stream, {clean('stream')} AS clean_name FROM cand"))
oracle("parse_long_field", sql(select="SELECT feed, stream, asset, signal FROM cand WHERE format = 'LONG'"))
oracle("parse_wide_column", sql(select="""
SELECT feed, stream, asset, signal, (SELECT count(*) FROM f_wide) AS feed_rows FROM cand WHERE format = 'WIDE'"""))
oracle("extract_unit", sql(select=f"SELECT feed, stream, {unit_of('stream')} AS unit FROM cand"))
oracle("clean_alias", sql(select=f"SELECT feed, stream, {clean_alias_sql('stream')} AS alias FROM cand"))
oracle("domain_classify", sql(select=f"SELECT feed, stream, asset, signal, {domain_case('asset', 'signal')} AS domain FROM cand"))
oracle("dedupe_signals", sql(select="SELECT feed, stream, asset, signal, data_type FROM meta"))
oracle("domain_distribution", sql(select="SELECT domain, count(*) AS streams FROM meta GROUP BY domain"))
oracle("numeric_coercion", sql(select="""
SELECT feed, stream, row_id, numeric_value, numeric_value IS NOT NULL AS is_numeric FROM readings"""))

_COLS = [  # feed, feed_ord, col_ord, column, model class (NULL = not modelled)
    (LONG_FEED, 1, 1, "Timestamp", None), (LONG_FEED, 1, 2, "Field", "DIMENSION"),
    (LONG_FEED, 1, 3, "Value", "DIMENSION"), (LONG_FEED, 1, 4, "Name", "DIMENSION"),
    (LONG_FEED, 1, 5, "Uom", "DIMENSION"),
    (WIDE_FEED, 2, 1, "Timestamp", None)] + [
    (WIDE_FEED, 2, o, c, "FACT" if t == "NUMERIC" else "DIMENSION") for o, c, t in
    __import__("histospark.plans.oracle_base", fromlist=["_WIDE_COLS"])._WIDE_COLS] + [
    (CLASSIC_FEED, 3, 1, "Timestamp", None), (CLASSIC_FEED, 3, 2, "Value", "FACT"),
    (CLASSIC_FEED, 3, 3, "IsQuestionable", None)]


def _v(x):
    return "NULL" if x is None else (str(x) if isinstance(x, int) else _s(x))


_COLS_VALUES = ", ".join("(" + ", ".join(_v(x) for x in row) + ")" for row in _COLS)
_SPECIAL = "column_name IN ('Timestamp', 'Field', 'Name', 'Uom', 'Value')"
SEM = f"""
mcols AS (SELECT * FROM (VALUES {_COLS_VALUES}) v(feed, feed_ord, col_ord, column_name, model_class)
          WHERE feed IN (SELECT feed FROM meta)),
sem0 AS (SELECT feed, feed_ord, col_ord, column_name,
                upper(regexp_replace(feed, '[^A-Za-z0-9_]', '_', 'g')) AS table_alias,
                CASE WHEN column_name = 'Timestamp' THEN 'MEASUREMENT_TIME'
                     WHEN column_name IN ('Field', 'Name', 'Uom') THEN upper(column_name)
                     WHEN column_name = 'Value' THEN 'SENSOR_VALUE'
                     ELSE {clean_alias_sql('column_name')} END AS base_alias,
                CASE WHEN column_name IN ('Timestamp', 'Field', 'Name', 'Uom') THEN 'DIMENSION'
                     WHEN column_name = 'Value' THEN CASE WHEN model_class = 'FACT' THEN 'FACT' ELSE 'DIMENSION' END
                     ELSE model_class END AS role,
                CASE WHEN NOT ({_SPECIAL}) THEN {unit_of('column_name')} END AS unit,
                model_class
         FROM mcols),
sem AS (SELECT feed, table_alias, column_name,
               CASE WHEN k = 1 THEN base_alias ELSE base_alias || '_' || CAST(k AS VARCHAR) END AS alias, role, unit,
               CASE WHEN column_name = 'Timestamp' THEN 'When the value was recorded'
                    WHEN column_name = 'Field' THEN 'Historian tag the value belongs to'
                    WHEN column_name = 'Name' THEN 'Short name of the asset'
                    WHEN column_name = 'Uom' THEN 'Physical unit of the value'
                    WHEN column_name = 'Value' THEN CASE WHEN model_class = 'FACT' THEN 'The recorded number'
                                                         ELSE 'The recorded text' END
                    WHEN model_class = 'FACT' THEN replace(regexp_replace(column_name, '{UUID_RE}', '', 'g'), '''', '')
                         || CASE WHEN unit IS NOT NULL THEN ' (' || unit || ')' ELSE '' END
                    ELSE replace(regexp_replace(column_name, '{UUID_RE}', '', 'g'), '''', '') END AS comment
        FROM (SELECT *, row_number() OVER (PARTITION BY feed, base_alias ORDER BY col_ord) AS k FROM sem0)
        WHERE role IS NOT NULL)"""

oracle("semantic_model", sql(SEM, select="SELECT feed, table_alias, column_name, alias, role, unit, comment FROM sem"))

from histospark.sources.fixtures import W_ACTIVE, W_BLADE, W_EXPECTED, W_REVENUE, W_STATE  # noqa: E402
from histospark.plans.oracle_base import q as _q  # noqa: E402

oracle("semantic_select", sql(select=f"""
SELECT {_q(W_STATE)} AS "STATE",
       {r6(f'avg(CAST({_q(W_ACTIVE)} AS DOUBLE))')} AS ACTIVE_POWER_10_MIN_ROLLING_AVG,
       {r6(f'avg(CAST({_q(W_EXPECTED)} AS DOUBLE))')} AS EXPECTED_POWER,
       {r6(f'avg(CAST({_q(W_REVENUE)} AS DOUBLE))')} AS REVENUE_MONTHLY,
       {r6(f'avg(CAST({_q(W_BLADE)} AS DOUBLE))')} AS BL1_ACT
FROM f_wide GROUP BY {_q(W_STATE)}"""))

oracle("event_payload", """
SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")

_CODE0 = "upper(replace(trim(o_orderpriority), ' ', '_'))"
_CODE1 = f"CASE WHEN starts_with({_CODE0}, 'PUBLIC.') THEN substr({_CODE0}, 8) ELSE {_CODE0} END"
_CODE = f"CASE WHEN NOT starts_with({_CODE1}, 'PRIO') THEN 'PRIO_' || {_CODE1} ELSE {_CODE1} END"
oracle("normalise_code", f"""
WITH x AS (SELECT o_orderkey, o_orderpriority AS raw_code, {_CODE} AS code FROM orders)
SELECT o_orderkey, raw_code, code, 'PUBLIC.' || code AS full_code, split_part(code, '_', 1) AS code_group,
       code IN ('PRIO_1-URGENT', 'PRIO_2-HIGH', 'PRIO_3-MEDIUM', 'PRIO_4-NOT_SPECIFIED') AS is_valid
FROM x""")

oracle("validate_key", f"""
WITH x AS (SELECT c_custkey, c_name,
  CASE WHEN c_name IS NULL THEN 'missing'
       WHEN NOT regexp_matches(c_name, '{KEY_PATTERN}') THEN 'bad characters'
       WHEN length(c_name) > 100 OR length(c_name) < 1 THEN 'too long' END AS reason FROM customer)
SELECT c_custkey, c_name, reason IS NULL AS is_valid, reason FROM x""")

# --- A ----------------------------------------------------------------------------------
oracle("feed_registry", sql(FT, select=f"""
SELECT fl.feed, fl.feed_ord, fl.format, fl.n_columns, coalesce(v.n, 0) AS "rows", coalesce(sg.s, 0) AS streams
FROM (VALUES ('{LONG_FEED}', 1, 'LONG', 6), ('{WIDE_FEED}', 2, 'WIDE', 7), ('{CLASSIC_FEED}', 3, 'CLASSIC', 4))
     fl(feed, feed_ord, format, n_columns)
LEFT JOIN (SELECT feed, count(*) AS n FROM ft GROUP BY feed) v ON v.feed = fl.feed
LEFT JOIN (SELECT feed, count(*) AS s FROM meta GROUP BY feed) sg ON sg.feed = fl.feed"""))

_PROFILE = [  # cte, feed, ordinal, column, metadata class, model class, kind
    ("f_long", LONG_FEED, 1, "Timestamp", "NUMERIC", None, "other"),
    ("f_long", LONG_FEED, 2, "Field", "STRING", "DIMENSION", "str"),
    ("f_long", LONG_FEED, 3, "Value", "STRING", "DIMENSION", "str"),
    ("f_long", LONG_FEED, 4, "Name", "STRING", "DIMENSION", "str"),
    ("f_long", LONG_FEED, 5, "Uom", "STRING", "DIMENSION", "str"),
    ("f_long", LONG_FEED, 6, "row_id", "NUMERIC", "FACT", "num"),
    ("f_wide", WIDE_FEED, 1, "Timestamp", "NUMERIC", None, "other"),
    ("f_wide", WIDE_FEED, 2, W_ACTIVE, "NUMERIC", "FACT", "num"),
    ("f_wide", WIDE_FEED, 3, W_EXPECTED, "NUMERIC", "FACT", "num"),
    ("f_wide", WIDE_FEED, 4, W_REVENUE, "NUMERIC", "FACT", "num"),
    ("f_wide", WIDE_FEED, 5, W_BLADE, "NUMERIC", "FACT", "num"),
    ("f_wide", WIDE_FEED, 6, W_STATE, "STRING", "DIMENSION", "str"),
    ("f_wide", WIDE_FEED, 7, "row_id", "NUMERIC", "FACT", "num"),
    ("f_classic", CLASSIC_FEED, 1, "Timestamp", "NUMERIC", None, "other"),
    ("f_classic", CLASSIC_FEED, 2, "Value", "NUMERIC", "FACT", "num"),
    ("f_classic", CLASSIC_FEED, 3, "IsQuestionable", "NUMERIC", None, "other"),
    ("f_classic", CLASSIC_FEED, 4, "row_id", "NUMERIC", "FACT", "num"),
]


def _prof(cte, feed, o, c, mc, mo, kind):
    x = {"str": f"count(TRY_CAST({_q(c)} AS DOUBLE))", "num": f"count({_q(c)})", "other": "CAST(NULL AS BIGINT)"}[kind]
    return (f"SELECT {_s(feed)} AS feed, {o} AS ordinal, {_s(c)} AS column_name, {_s(mc)} AS metadata_class, "
            f"{_v(mo)} AS model_class, count({_q(c)}) AS non_null, {x} AS numeric_castable FROM {cte}")


oracle("feed_column_profile", sql(select="\nUNION ALL ".join(_prof(*p) for p in _PROFILE)))

oracle("feed_bundle_status", f"""
SELECT * FROM (VALUES ('{LONG_FEED}', 1, 'BUNDLED', false), ('{WIDE_FEED}', 2, 'BUNDLED', false),
  ('{CLASSIC_FEED}', 3, 'BUNDLED', false), ('missing_feed', 4, 'NOT_BUNDLED', true)) v(feed, feed_ord, status, has_error)""")

oracle("feed_preview", sql(select="""
SELECT "Timestamp", "Field", TRY_CAST("Value" AS DOUBLE) AS "Value", "Name", "Uom", row_id
FROM f_long ORDER BY "Timestamp", row_id LIMIT 100"""))

_RES_COLS = ("asset, signal, domain, ts, numeric_value, is_anomaly, anomaly_score, forecast_value, "
             "lower_bound, upper_bound, model_type")
RESULTS = f"""
results AS (
  SELECT {_RES_COLS} FROM anom
  UNION ALL
  SELECT asset, signal, domain, ts, CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS DOUBLE),
         forecast_value, lower_bound, upper_bound, model_type FROM fcout)"""

oracle("result_store_replace", sql(ANOM, *forecast_ctes(), *forecast_ctes(
    "pick AS (SELECT asset, signal FROM num_meta WHERE asset = 'GE01')", horizon=14, suffix="_r"), RESULTS,
    select=f"""
SELECT {_RES_COLS} FROM results
WHERE NOT (model_type = 'FORECAST' AND (asset, signal) IN (SELECT asset, signal FROM fcout_r))
UNION ALL
SELECT asset, signal, domain, ts, CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN), CAST(NULL AS DOUBLE),
       forecast_value, lower_bound, upper_bound, model_type FROM fcout_r"""))

oracle("export_csv", sql(*forecast_ctes(), select="SELECT * FROM fcout"))

STATE = f"""
dd AS (SELECT domain, count(*) AS n FROM meta GROUP BY domain),
state AS (
  SELECT 'VIEWS_INITIALIZED' AS key, 'TRUE' AS value
  UNION ALL SELECT 'VIEW_COUNT', '3'
  UNION ALL SELECT 'STREAM_COUNT', CAST(count(*) AS VARCHAR) FROM meta
  UNION ALL SELECT 'METADATA_DISCOVERED', CASE WHEN count(*) > 0 THEN 'TRUE' ELSE 'FALSE' END FROM meta
  UNION ALL SELECT 'DOMAIN_DISTRIBUTION', '{{' || string_agg('"' || domain || '":' || CAST(n AS VARCHAR), ',' ORDER BY domain) || '}}' FROM dd
  UNION ALL SELECT 'SEMANTIC_VIEW_CREATED', CASE WHEN count(*) > 0 THEN 'TRUE' ELSE 'FALSE' END FROM sem)"""

oracle("state_upsert", sql(SEM, STATE, select="""
SELECT key, value FROM state
UNION ALL SELECT 'LAST_ERROR', 'none'"""))

oracle("seed_if_absent", sql(SEM, STATE, select="""
SELECT key, value FROM state
UNION ALL SELECT * FROM (VALUES ('VIEW_PATTERN', '%'), ('ACCESS_REGION', 'PUBLIC.AWS_US_WEST_2'), ('STREAM_COUNT', '0')) d(key, value)
WHERE d.key NOT IN (SELECT key FROM state)"""))

oracle("append_log", """
SELECT user_id AS entity, event_type AS step, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'COMPLETE' END AS status,
       ts AS step_ts, event_id
FROM events, (VALUES (1), (2)) t(n)""")

oracle("reset_keys", sql(ANOM, *forecast_ctes(), RESULTS, select=f"SELECT {_RES_COLS} FROM results WHERE asset <> 'GE01'"))

oracle("share_back", sql(ANOM, *forecast_ctes(), RESULTS, select=f"""
SELECT {_RES_COLS}, 'CONSUMER_ACCOUNT_1' AS consumer_account FROM results"""))

oracle("share_back_counts", sql(ANOM, *forecast_ctes(), RESULTS, select="""
SELECT 'CONSUMER_ACCOUNT_1' AS consumer_account, count(*) AS shared_count,
       count(*) FILTER (WHERE coalesce(is_anomaly, false)) AS anomaly_count FROM results"""))

# --- C1, C2, C4, L -----------------------------------------------------------------------
oracle("signal_readings", sql(select=f"""
SELECT asset, signal, ts, {r6('numeric_value')} AS numeric_value, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY ts DESC, row_id DESC) AS k FROM readings)
WHERE k <= 500"""))

oracle("one_signal_readings", sql(select=f"""
SELECT asset, signal, ts, {r6('numeric_value')} AS numeric_value, row_id FROM readings
WHERE asset = 'GE01' AND signal = 'Expected Power'"""))

oracle("signal_query", sql(select=f"""
SELECT 'GE01' AS asset, 'Expected Power' AS signal, 'MAX' AS agg, {r6('max(numeric_value)')} AS value, count(*) AS readings
FROM readings WHERE asset = 'GE01' AND signal = 'Expected Power'"""))

oracle("semantic_select_long", sql(select=f"""
SELECT "Field" AS "FIELD", {r6('max(' + numeric('"Value"') + ')')} AS "SENSOR_VALUE" FROM f_long GROUP BY 1"""))

oracle("compare_assets", sql(select=f"""
SELECT signal, date_trunc('hour', ts) AS period, asset, {r6('avg(numeric_value)')} AS avg_value FROM {_NUM}
WHERE domain = 'rotating_machinery' GROUP BY ALL"""))

oracle("lookback_filter", sql(select="""
SELECT r.feed, r.asset, r.signal, r.ts, r.numeric_value, r.row_id
FROM readings r JOIN feed_max fm ON r.feed = fm.feed WHERE r.ts >= fm.max_ts - INTERVAL 7 DAY"""))

DICT = f"""
first_r AS (SELECT asset, signal, numeric_value FROM (
  SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY ts, row_id) AS k FROM readings) WHERE k = 1),
agg_r AS (SELECT asset, signal, min(numeric_value) AS mn, max(numeric_value) AS mx, count(*) AS n
          FROM readings GROUP BY asset, signal),
dict AS (
  SELECT m.signal AS field, 'Signal' AS category,
         concat_ws(' ', m.signal, 'of', m.asset, '(', m.domain, ')') AS description,
         m.unit, m.data_type, m.feed, m.asset, {r6('f.numeric_value')} AS example_value,
         {r6('a.mn')} AS min_value, {r6('a.mx')} AS max_value, coalesce(a.n, 0) AS readings
  FROM meta m LEFT JOIN first_r f ON f.asset = m.asset AND f.signal = m.signal
              LEFT JOIN agg_r a ON a.asset = m.asset AND a.signal = m.signal
  UNION ALL
  SELECT field, 'Metadata', description, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS BIGINT)
  FROM (VALUES ('Timestamp', 'When the value was recorded'), ('Value', 'The recorded value'), ('Field', 'Historian tag the value belongs to'),
               ('Name', 'Short name of the asset'), ('Uom', 'Physical unit of the value')) s(field, description))"""

oracle("data_dictionary", sql(DICT, select="SELECT * FROM dict"))
oracle("dictionary_search", sql(DICT, select="""
SELECT * FROM dict WHERE coalesce(contains(lower(field), 'pressure'), false)
                      OR coalesce(contains(lower(description), 'pressure'), false)"""))


# Written out for this engine, which has no look-around: the neighbours of a
# number are captured and put back, and a second pass finds numbers that share
# one. (kind, pattern, replacement, tag)
_N, _E = "(^|[^0-9])", "($|[^0-9])"
REDACTIONS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[EMAIL]", "[EMAIL]"),
    ("ssn", _N + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E, r"\1[SSN]\2", "[SSN]"),
    ("phone", _N + r"(?:\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,4}\)?[ .-]?){2,4}[0-9]{2,4}"
     r"|(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})" + _E, r"\1[PHONE]\2", "[PHONE]"),
]


def _redact_one(x: str, pattern: str, to: str) -> str:
    for _ in range(1 if to.startswith("[") else 2):
        x = f"regexp_replace({x}, {_s(pattern)}, {_s(to)}, 'g')"
    return x


def redact_sql(x: str) -> str:
    for _, pattern, to, _ in REDACTIONS:
        x = _redact_one(x, pattern, to)
    return x


oracle("log_events", f"""
SELECT conv_id, turn, 'QUERY_' || upper(role) AS event_type,
       CAST(json_object('conv_id', conv_id, 'turn', turn, 'chars', length(text)) AS VARCHAR) AS event_data,
       CASE WHEN length(coalesce(text, '')) > 0 THEN {"substr(" + redact_sql('text') + ", 1, 1000)"} END AS redacted_query
FROM conversations""")

oracle("redact_text", f"SELECT doc_id, source, {redact_sql('text')} AS redacted_text FROM documents")


def _stages_sql() -> str:
    cols, x = [], "text"
    found = lambda t, tag: f"len(regexp_extract_all({t}, {_s(chr(92) + tag[:-1] + chr(92) + ']')}))"
    for kind, pattern, to, tag in REDACTIONS:
        after = _redact_one(x, pattern, to)
        cols.append(f"{found(after, tag)} - {found(x, tag)} AS {kind}")
        x = after
    return ", ".join(cols)


oracle("redaction_counts", f"""
WITH per AS (SELECT source, {_stages_sql()} FROM documents)
SELECT source, {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}_count" for k, _, _, _ in REDACTIONS)},
       count(*) AS documents FROM per GROUP BY source""")

# The state as stored before the third feed and the semantic model existed.
_STORED = """state AS (SELECT * FROM (VALUES ('VIEWS_INITIALIZED', 'TRUE'), ('VIEW_COUNT', '2'), ('STREAM_COUNT', '40'),
  ('METADATA_DISCOVERED', 'TRUE'), ('DOMAIN_DISTRIBUTION', '{}')) v(key, value))"""
oracle("health_check", sql(SEM, _STORED, FT, """
lt AS (SELECT feed, max(ts) AS latest FROM ft GROUP BY feed),
fr AS (SELECT m.feed, coalesce(date_diff('hour', lt.latest, TIMESTAMP '2024-01-31 00:00:00'), -1) > 48 AS is_stale
       FROM (SELECT DISTINCT feed FROM meta) m LEFT JOIN lt ON lt.feed = m.feed),
checks AS (
  SELECT 'shared_content_sync' AS check_name,
         CASE WHEN 3 = coalesce(max(TRY_CAST(value AS BIGINT)), 0) THEN 'OK' ELSE 'DRIFT' END AS status,
         CAST(3 AS BIGINT) AS value, CAST(coalesce(max(TRY_CAST(value AS BIGINT)), 0) AS BIGINT) AS total
  FROM state WHERE key = 'VIEW_COUNT'
  UNION ALL
  SELECT 'app_state_keys', CASE WHEN count(DISTINCT key) = 6 THEN 'OK' ELSE 'MISSING' END, count(DISTINCT key), 6
  FROM state WHERE key IN ('VIEWS_INITIALIZED', 'VIEW_COUNT', 'METADATA_DISCOVERED', 'STREAM_COUNT',
                           'DOMAIN_DISTRIBUTION', 'SEMANTIC_VIEW_CREATED')
  UNION ALL
  SELECT 'stream_metadata', CASE WHEN count(*) > 0 THEN 'OK' ELSE 'EMPTY' END, count(*), count(*) FROM meta
  UNION ALL
  SELECT 'proxy_views', 'OK', 3, 3
  UNION ALL
  SELECT 'semantic_view', CASE WHEN count(*) > 0 THEN 'OK' ELSE 'SKIPPED' END, count(*) FILTER (WHERE role = 'FACT'), count(*)
  FROM sem
  UNION ALL
  SELECT 'data_freshness', CASE WHEN count(*) FILTER (WHERE is_stale) = 0 THEN 'OK' ELSE 'STALE' END,
         count(*) FILTER (WHERE is_stale), count(*) FROM fr)""", select="""
SELECT check_name, status, CAST(value AS BIGINT) AS value, CAST(total AS BIGINT) AS total FROM checks
UNION ALL
SELECT 'overall', CASE WHEN count(*) FILTER (WHERE status NOT IN ('OK', 'SKIPPED', 'STALE')) = 0 THEN 'HEALTHY'
                       ELSE 'DEGRADED' END,
       count(*) - count(*) FILTER (WHERE status NOT IN ('OK', 'SKIPPED', 'STALE')), count(*) FROM checks"""))

oracle("incremental_ingest", sql(select=f"""
SELECT feed, asset, signal, ts, numeric_value, string_value, row_id FROM readings WHERE feed = '{LONG_FEED}'"""))

# --- readings store, summaries, streams, name search -------------------------------
for _name, _same in (("store_readings", "unified_readings"), ("store_metadata", "stream_metadata"), ("store_one_signal", "one_signal_readings"),
                     ("summary_series_profile", "series_profile"), ("summary_feed_volume", "feed_volume"), ("summary_hourly_trend", "hourly_trend"),
                     ("summary_avg_by_asset", "avg_signal_by_asset"), ("summary_total_over_time", "total_over_time"), ("summary_dictionary", "data_dictionary"),
                     ("summary_latest_reading", "latest_reading"), ("summary_trend", "trend_summary"), ("summary_forecast", "forecast_signal")):
    oracle(_name, ORACLE[_same])

oracle("readings_table_names", sql(select=f"""
SELECT '01' AS feed, count(*) AS readings, {r6('sum("Value")')} AS total_value FROM f_classic WHERE "Value" IS NOT NULL
UNION ALL
SELECT '1', count(*), {r6('sum("Value")')} FROM f_classic WHERE "Value" IS NOT NULL AND row_id % 2 = 0"""))

oracle("lookback_default", sql(select=f"""
SELECT feed, asset, signal, ts, {r6('numeric_value')} AS numeric_value, row_id FROM readings
WHERE ts >= (SELECT max(max_ts) FROM feed_max) - INTERVAL 7 DAY"""))

_LATE = "TIMESTAMP '1998-01-01'"
_STAMPS = f"""
stamps AS (SELECT '{LONG_FEED}' AS feed, "Timestamp" AS ts FROM f_long UNION ALL SELECT '{WIDE_FEED}', "Timestamp" FROM f_wide
           UNION ALL SELECT '{CLASSIC_FEED}', "Timestamp" FROM f_classic)"""
oracle("lookback_not_after", sql(_STAMPS, select=f"""
SELECT feed, asset, signal, ts, {r6('numeric_value')} AS numeric_value, row_id FROM readings
WHERE ts <= {_LATE} AND ts >= (SELECT max(ts) FROM stamps WHERE ts <= {_LATE}) - INTERVAL 30 DAY"""))

oracle("late_feeds", sql(_STAMPS, select=f"""
SELECT feed, count(*) AS late_rows, max(ts) AS latest FROM stamps WHERE ts > {_LATE} GROUP BY feed"""))

oracle("bundle_summary", sql("""
b AS (SELECT m.feed, m.stream, coalesce(x.bundled, false) AS bundled FROM smap m
      LEFT JOIN (SELECT feed, stream, bool_or(numeric_value IS NOT NULL) AS bundled FROM r_all GROUP BY feed, stream) x
        ON x.feed = m.feed AND x.stream = m.stream),
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY feed, bundled ORDER BY stream) - 1) // 10 AS BIGINT) AS page,
             count(*) OVER (PARTITION BY feed, bundled) AS streams FROM b)""", select="""
SELECT feed, bundled, streams, page, string_agg(stream, ',' ORDER BY stream) AS names FROM p GROUP BY feed, bundled, streams, page"""))

_LONG_ROWS = f"(SELECT * FROM readings WHERE feed = '{LONG_FEED}')"
oracle("stream_hourly_trend", sql(select=f"""
SELECT asset, signal, date_trunc('hour', ts) AS hour, {r6('avg(numeric_value)')} AS avg_value, count(*) AS readings
FROM {_LONG_ROWS} GROUP BY asset, signal, date_trunc('hour', ts)
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {_LONG_ROWS}) - INTERVAL 1 HOUR"""))

oracle("stream_anomalies", sql(f"""
sb AS (SELECT asset, signal, ts, row_id, numeric_value, {_ROLL} FROM {_LONG_ROWS} {_WIN}),
sc AS (SELECT *, CASE WHEN rolling_std > 0 THEN abs((numeric_value - rolling_avg) / rolling_std) ELSE 0 END AS z
       FROM sb WHERE n_rows >= 12 AND rolling_avg IS NOT NULL)""", select=f"""
SELECT asset, signal, ts, row_id, {r6('numeric_value')} AS numeric_value, {r6('rolling_avg')} AS rolling_avg, {r6('rolling_std')} AS rolling_std,
       {r6('z')} AS anomaly_score, coalesce(z > 3, false) AS is_anomaly FROM sc"""))

oracle("name_search", sql(select="""
SELECT DISTINCT asset || '.' || signal AS name FROM meta WHERE contains(lower(asset || '.' || signal), 'pressure value')"""))

oracle("customer_search", "SELECT DISTINCT c_name AS name FROM customer WHERE contains(lower(c_name), '00012')")
