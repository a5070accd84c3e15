"""Stream-name parsing and classification as Spark column expressions.

Every function takes and returns a ``Column``; they run inside whole-stage
codegen over a DataFrame of *distinct* stream names (never per reading).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Historian tag suffix: ".<uuid>" in lower-case hex 8-4-4-4-12.
UUID_SUFFIX = r"\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Trailing unit annotation "( ... )", empty parentheses included.
UNIT_SUFFIX = r"(?U)\s*\([^)]*\)\s*$"
# Unit text inside the trailing parentheses.
UNIT_CAPTURE = r"(?U)\(([^)]+)\)\s*$"
# Domain keyword groups, checked in this order; first group with a keyword
# contained in the lower-cased asset or signal wins; otherwise "general".
DOMAIN_KEYWORDS: list[tuple[str, list[str]]] = [
    ("wind_energy", ["wind", "turbine", "hornsea", "ge0", "ge1", "yorkshire",
                     "wind_speed", "wind_direction", "pitch_angle", "vane_position",
                     "gearbox", "hub_temp", "eaf", "active power", "apparent power",
                     "expected power", "revenue", "total power", "total turbines"]),
    ("rotating_machinery", ["rotating", "ps0", "ps1", "ps2", "ps3", "ps4", "ps5", "ps6",
                            "bearing", "suction", "discharge", "pump"]),
    ("production_quality", ["plant", "pq.", "concentration", "granule", "dissolv",
                            "ingredient", "agitator"]),
    ("packaging", ["pack", "line", "carb", "chill", "warmer", "running", "refrigerant"]),
]
DEFAULT_DOMAIN = "general"
# Key validation: allowed characters and length range.
KEY_PATTERN = r"^[A-Za-z0-9_]+$"
KEY_MAX_LEN = 100
# ---------------------------------------------------------------------------


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind, Unicode blanks such as
    the no-break space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_uuid(c: Column) -> Column:
    return F.regexp_replace(c, UUID_SUFFIX, "")


def clean_signal_name(c: Column) -> Column:
    """B1: drop every ``.uuid``, then a trailing ``( … )``, then trim."""
    return py_strip(F.regexp_replace(strip_uuid(c), UNIT_SUFFIX, ""))


def extract_unit(c: Column) -> Column:
    """Text in the trailing parentheses; blank or absent -> NULL."""
    raw = F.regexp_extract(c, UNIT_CAPTURE, 1)
    return F.when(py_strip(raw) != "", raw)


def _last_dot_split(c: Column):
    parts = F.split(c, r"\.")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), n - 1), ".")
    return parts, n, head, F.element_at(parts, -1)


def parse_long_field(field: Column, feed: Column) -> tuple[Column, Column]:
    """B2: uuid and unit are removed first; asset = all before the last dot,
    signal = the last part; without a dot asset = feed name."""
    base = clean_signal_name(field)
    parts, n, head, last = _last_dot_split(base)
    asset = F.when(n > 1, head).otherwise(feed)
    signal = F.when(n > 1, py_strip(last)).otherwise(base)
    return asset, signal


def parse_wide_column(col_name: Column, feed: Column) -> tuple[Column, Column]:
    """Split at the first dot, else at the first underscore; otherwise the
    feed is the asset and the raw column name the signal."""
    dot = F.instr(col_name, ".")
    us = F.instr(col_name, "_")
    asset = (F.when(dot > 0, py_strip(F.substring_index(col_name, ".", 1)))
             .when(us > 0, py_strip(F.substring_index(col_name, "_", 1)))
             .otherwise(feed))
    signal = (F.when(dot > 0, clean_signal_name(py_strip(F.substr(col_name, dot + 1))))
              .when(us > 0, clean_signal_name(py_strip(F.substr(col_name, us + 1))))
              .otherwise(col_name))
    return asset, signal


def clean_alias(c: Column) -> Column:
    """Uuid and unit stripped, part after the last dot, one leading
    ``[A-Z0-9]+_`` removed, non-alphanumeric runs -> ``_``, edges stripped,
    upper-cased; empty -> ``VALUE``."""
    base = F.regexp_replace(strip_uuid(c), UNIT_SUFFIX, "")
    last = F.element_at(F.split(base, r"\."), -1)
    no_prefix = F.regexp_replace(last, r"^[A-Z0-9]+_", "")
    collapsed = F.regexp_replace(no_prefix, r"[^A-Za-z0-9]+", "_")
    trimmed = F.upper(F.regexp_replace(collapsed, r"^_+|_+$", ""))
    return F.when(trimmed == "", F.lit("VALUE")).otherwise(trimmed)


def table_alias(c: Column) -> Column:
    """Feed name -> ``[^A-Za-z0-9_]`` replaced by ``_``, upper-cased."""
    return F.upper(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"))


def domain_of(asset: Column, signal: Column, groups=None) -> Column:
    """Keyword domain classification (first matching group wins)."""
    groups = groups if groups is not None else DOMAIN_KEYWORDS
    a, s = F.lower(asset), F.lower(signal)
    expr = None
    for domain, keys in groups:
        cond = None
        for k in keys:
            term = a.contains(k) | s.contains(k)
            cond = term if cond is None else (cond | term)
        expr = F.when(cond, F.lit(domain)) if expr is None else expr.when(cond, F.lit(domain))
    return expr.otherwise(F.lit(DEFAULT_DOMAIN)) if expr is not None else F.lit(DEFAULT_DOMAIN)


def finite(v: Column) -> Column:
    """NaN and infinities are no readings: NULL."""
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def numeric_of(raw: Column) -> Column:
    """Text -> double; failure, NaN and infinities -> NULL."""
    return finite(raw.try_cast("double"))


def validate_key_reason(c: Column) -> Column:
    """NULL when the key is valid, otherwise the reason."""
    return (F.when(c.isNull(), F.lit("missing"))
            .when(~c.rlike(KEY_PATTERN), F.lit("bad characters"))
            .when((F.length(c) > KEY_MAX_LEN) | (F.length(c) < 1), F.lit("too long"))
            .otherwise(F.lit(None).cast("string")))


def normalise_code(raw: Column, hint: Column | None = None) -> Column:
    """Trim, upper, spaces -> ``_``, drop a ``PUBLIC.`` prefix, prepend the
    group hint when the code does not already start with it."""
    v = F.upper(F.replace(F.trim(raw), F.lit(" "), F.lit("_")))
    v = F.when(v.startswith("PUBLIC."), F.substring(v, 8, 1 << 30)).otherwise(v)
    if hint is not None:
        h = F.upper(hint)
        v = F.when(h.isNotNull() & ~v.startswith(h), F.concat(h, F.lit("_"), v)).otherwise(v)
    return v


def round6(c: Column | str) -> Column:
    """Round half up to 6 decimals with plain IEEE steps (x*1e6+0.5, floor,
    /1e6) so that any engine doing the same steps gets the same double. Values
    beyond 9e12, whose scaled floor has no BIGINT, and non-finite ones stay as
    they are. Only for comparing results; the operators return full doubles."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(9e12), F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).otherwise(c)
