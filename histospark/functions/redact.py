"""Pattern-based redaction (L2) as a chain of ``regexp_replace`` calls.

Only what a pattern can find is redacted: e-mail addresses, US social
security numbers and phone numbers. Names and postal addresses need a
language model and are not handled (see README).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and tags, applied in this order (each on the output of the
# previous one). Numbers are matched whole: never a part of a longer number.
# Phones: international with +, or ten digits with or without a country
# prefix, brackets and separators. An address begins where a run of its
# characters does or where the match before ended (\G), and the run is taken
# whole: the same matches as without, in a time that is linear in the text.
REDACTION_RULES: list[tuple[str, str, str]] = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "[SSN]"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,4}\)?[ .-]?){2,4}[0-9]{2,4}"
              r"|(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?![0-9])", "[PHONE]"),
]
# What every match of the rule contains: texts without it skip the regex.
REQUIRED = {"email": lambda t: t.contains("@"), "ssn": lambda t: t.rlike("[0-9]-[0-9]"), "phone": lambda t: t.rlike("[0-9][0-9]")}
MAX_QUERY_CHARS = 1000


def redact(c: Column) -> Column:
    """Replace every match of every rule by its tag."""
    for kind, pattern, tag in REDACTION_RULES:
        c = _guard(kind, c, F.regexp_replace(c, pattern, tag), c)
    return c


def _guard(kind: str, text: Column, hit: Column, miss: Column) -> Column:
    return F.when(REQUIRED[kind](text), hit).otherwise(miss)


def redaction_stages(c: Column) -> list[tuple[str, Column]]:
    """(kind, matches of that kind) counted on the text as it is when the
    rule runs, i.e. after the earlier rules have replaced their matches."""
    out = []
    for kind, pattern, tag in REDACTION_RULES:
        out.append((kind, _guard(kind, c, F.regexp_count(c, F.lit(pattern)), F.lit(0))))
        c = _guard(kind, c, F.regexp_replace(c, pattern, tag), c)
    return out
