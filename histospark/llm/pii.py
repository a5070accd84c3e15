"""Personal data: proposed by regular expressions, confirmed by checksums,
scored with the words nearby. DataFrame expressions only.

Base kinds (always reported when valid): email, ip, card (Luhn), phone.
Kinds that the method adds, where they overlap no base span: iban (mod-97),
ssn and tel (national phone numbers), the last two only with a telling word
within CONTEXT characters. A span is reported from THRESHOLD up.

Offsets count code points; ends are exclusive. The patterns use possessive
forms of the documented ones (same matches, no deep backtracking on long
runs). Null text counts as empty: no spans. Repeated rows are reported each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histospark.llm.common import table

CONTEXT = 40
THRESHOLD = 0.6
#: Array elements summed at a time, so that running sums stay linear.
CHUNK = 256
#: Characters in a piece of a long text.
PIECE = 4096

_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: Length of an IBAN, without blanks: countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Groups of four after the country and check digits, as many as the country has; any number for countries not listed."""
    groups = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    fixed = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{groups(n)}" for n, names in IBAN_LENGTHS.items())
    listed = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?:{fixed}|{other})(?![A-Za-z0-9])"


#: kind: (text that must occur, pattern)
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", _iban()),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    "tel": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
}
BASE = ("email", "ip", "card", "phone")
#: kind: (score of a match that passes its checks, score with a telling word, words)
SCORES = {
    "email": (0.9, 0.95, r"mail|contact|write"),
    "ip": (0.6, 0.8, r"\bip\b|address|host|server"),
    "card": (0.9, 0.95, r"card|visa|master|credit|pay"),
    "phone": (0.8, 0.9, r"\btel|phone|call|mobile|fax"),
    "iban": (0.9, 0.95, r"iban|account|konto|cuenta|compte|bank"),
    "ssn": (0.4, 0.8, r"\bssn\b|social security"),
    "tel": (0.3, 0.7, r"\btel|phone|call|mobile|fax"),
}


def running(steps: Column, add=lambda a, b: a + b, start: int = 0) -> Column:
    """Inclusive running sums of an array of longs (or another associative
    ``add`` with its neutral ``start``), in chunks."""
    zero = F.lit(start).cast("long")
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    sums = lambda xs: F.aggregate(xs, F.array(zero), grow)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")),
                         lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, add))
    parts = F.zip_with(chunks, sums(totals),
                       lambda c, base: F.when(c.isNotNull(), F.transform(F.slice(sums(c), F.lit(2), F.lit(CHUNK)), lambda x: add(x, base))))
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def free_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with ``free``: the ``added`` spans that overlap no ``base``
    span, in one pass over all spans by start: the furthest end of a base span
    up to each place, and the nearest start of one after it."""
    mark = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_base).alias("base"), s["end"].alias("end"), s.alias("span")))
    far = F.lit(1 << 62).cast("long")
    # Each array is a column of its own, so that it is made once and not in every step that looks into it.
    out = rows.withColumn("every", F.when(F.size("added") > 0, F.array_sort(F.concat(mark(F.col("base"), True), mark(F.col("added"), False)))).otherwise(F.array().cast(MARKED)))
    out = out.withColumns({"ends": F.transform("every", lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(0).cast("long"))),
                           "starts": F.reverse(F.transform("every", lambda s: F.when(s["base"], s["start"]).otherwise(far)))})
    out = out.withColumns({"ends": running(F.col("ends"), lambda a, b: F.greatest(a, b)), "starts": F.reverse(running(F.col("starts"), lambda a, b: F.least(a, b), 1 << 62))})
    kept = F.filter(F.arrays_zip(F.col("every").alias("s"), F.col("ends").alias("before"), F.col("starts").alias("after")),
                    lambda r: ~r["s"]["base"] & (r["before"] <= r["s"]["start"]) & (r["after"] >= r["s"]["end"]))
    return out.withColumn("free", F.transform(kept, lambda r: r["s"]["span"])).drop("every", "ends", "starts")


def pieces_of(text: Column) -> Column:
    """A long text in pieces of PIECE characters, so that a place is found
    without counting the characters before it; a short text is one piece."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.length(text) > PIECE, cut).otherwise(F.array(text))


def context(cut: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (from 0) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    n = F.floor((start + length) / PIECE).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(cut, first + 1, n), ""), (start - first * PIECE + 1).cast("int"), length.cast("int"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    d = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, d(i)).otherwise(
        d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, "[^A-Z0-9]", "")
    chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


SPAN = "array<struct<start:bigint,no:int,end:bigint,score:double,match:string>>"


MARKED = "array<struct<start:bigint,base:boolean,end:bigint,span:struct<start:bigint,no:int,end:bigint,score:double,match:string>>>"


def steps_of(matches: Column, pieces: Column) -> Column:
    """From each match's start to the next one's. The pieces between the matches
    and the matches themselves make up the text, so their lengths tell."""
    lengths = F.transform(matches, lambda m: F.length(m).cast("long"))
    return F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)),
                      F.concat(F.array(F.lit(0).cast("long")), F.slice(lengths, F.lit(1), F.size(matches) - 1)),
                      lambda p, m: F.length(p).cast("long") + m)


def spans_of(kind: str, cut: Column, matches: Column, starts: Column) -> Column:
    """Valid spans of one kind, ``cut`` the text in pieces."""
    plain, told, words = SCORES[kind]
    no = list(PATTERNS).index(kind)

    def span(m: Column, start: Column) -> Column:
        near = F.lower(context(cut, F.greatest(start - CONTEXT, F.lit(0)), F.length(m) + 2 * CONTEXT))
        score = F.when(near.rlike(words), told).otherwise(plain)
        return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.length(m)).alias("end"), score.alias("score"), m.alias("match"))

    all_spans = F.zip_with(matches, starts, span)
    kept = F.filter(all_spans, lambda s: _valid(kind, s["match"]) & (s["score"] >= THRESHOLD))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (sorted by start, then kind) and base (the base spans) of
    each row of ``docs`` (doc_id, text)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    hints = {k: F.instr("text", h) > 0 if h == "@" else F.col("text").rlike(h) for k, (h, _) in PATTERNS.items()}
    out = out.withColumns({f"m_{k}": F.when(hints[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none)
                           for k, (_, p) in PATTERNS.items()})
    out = out.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none)
                           for k, (_, p) in PATTERNS.items()})
    found = F.lit(False)
    for k in PATTERNS:
        found = found | (F.size(f"m_{k}") > 0)
    out = out.withColumn("cut", F.when(found, pieces_of(F.col("text"))).otherwise(none))
    longs = F.array().cast("array<bigint>")
    out = out.withColumns({f"t_{k}": F.when(F.size(f"m_{k}") > 0, steps_of(F.col(f"m_{k}"), F.col(f"p_{k}"))).otherwise(longs) for k in PATTERNS})
    out = out.withColumns({f"t_{k}": F.when(F.size(f"t_{k}") > 0, running(F.col(f"t_{k}"))).otherwise(longs) for k in PATTERNS})
    out = out.withColumns({f"s_{k}": spans_of(k, F.col("cut"), F.col(f"m_{k}"), F.col(f"t_{k}")) for k in PATTERNS})
    out = out.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in BASE])).alias("base"),
                     F.concat(*[F.col(f"s_{k}") for k in PATTERNS if k not in BASE]).alias("added"))
    return free_spans(out).select("doc_id", "base", F.array_sort(F.concat("base", "free")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["no"] + 1), s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    number = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    counts = [number(no).alias(f"n_{k}") for no, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
