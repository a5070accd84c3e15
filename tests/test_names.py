"""Goldens for the name-parsing expressions (worked examples of the source
documentation, FIXTURES.md §4) and edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from histospark.functions import names as N


def one(spark, expr, *vals):
    df = spark.createDataFrame([tuple(vals)], ",".join(f"c{i} string" for i in range(len(vals))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(vals))]).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("Active Power - 10 min rolling avg.4cda6eb5-885a-5fd4-323f-add6141de672 (kW)", "Active Power - 10 min rolling avg"),
    ("Expected Power.f3a878d6-3edc-5585-14ea-008cd1cec068 (kW)", "Expected Power"),
    ("Revenue - Monthly.1d8f39d7-4532-5b81-0652-bb84f250bd9a ()", "Revenue - Monthly"),
    ("BL1_ACT (°)", "BL1_ACT"),
    ("  spaced\t", "spaced"),
])
def test_clean_signal_name(spark, raw, expected):
    assert one(spark, N.clean_signal_name, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("GE01.Wind Speed - 10 min rolling avg.4cda6eb5-885a-5fd4-323f-add6141de672 (kW)", "WIND_SPEED_10_MIN_ROLLING_AVG"),
    ("GE01_P_ACT (kW)", "P_ACT"),
    ("P_ACT", "ACT"),
    ("GE01.P_ACT", "ACT"),
    ("( )", "VALUE"),
    ("GE01.", "VALUE"),
])
def test_clean_alias(spark, raw, expected):
    assert one(spark, N.clean_alias, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("GE01_P_ACT (kW)", "kW"), ("X ()", None), ("X ( )", None), ("X", None),
])
def test_extract_unit(spark, raw, expected):
    assert one(spark, N.extract_unit, raw) == expected


def test_parse_wide(spark):
    df = spark.createDataFrame([("GE02_BL1_ACT (°)", "feed"), ("plain", "feed"),
                                ("GE01.Expected Power.f3a878d6-3edc-5585-14ea-008cd1cec068 (kW)", "feed")], "c string, f string")
    a, s = N.parse_wide_column(F.col("c"), F.col("f"))
    got = [(r["a"], r["s"]) for r in df.select(a.alias("a"), s.alias("s")).collect()]
    assert got == [("GE02", "BL1_ACT"), ("feed", "plain"), ("GE01", "Expected Power")]


def test_parse_long(spark):
    df = spark.createDataFrame([("Rotating Machinery - PS0.Bearing Temperature Value", "v"), ("A.B.Flow", "v"),
                                ("NoDot", "v"), ("PS0.Flow (m3.h)", "v")], "c string, f string")
    a, s = N.parse_long_field(F.col("c"), F.col("f"))
    got = [(r["a"], r["s"]) for r in df.select(a.alias("a"), s.alias("s")).collect()]
    assert got == [("Rotating Machinery - PS0", "Bearing Temperature Value"), ("A.B", "Flow"),
                   ("v", "NoDot"), ("PS0", "Flow")]


@pytest.mark.parametrize("asset,signal,expected", [
    ("GE01", "Active Power", "wind_energy"),
    ("Rotating Machinery - PS0", "Bearing Temperature Value", "rotating_machinery"),
    ("Tank 4", "Agitator Speed", "production_quality"),
    ("Filler", "Line Speed", "packaging"),
    ("storage01", "Level", "wind_energy"),
    ("Unit X", "Level", "general"),
])
def test_domain(spark, asset, signal, expected):
    assert one(spark, N.domain_of, asset, signal) == expected


def test_normalise_code(spark):
    got = [one(spark, lambda c: N.normalise_code(c), v) for v in ["AZURE_WESTUS2", "azure westus2", "PUBLIC.AZURE_WESTUS2"]]
    assert got == ["AZURE_WESTUS2"] * 3
    assert one(spark, lambda c, h: N.normalise_code(c, h), "westus2", "AZURE") == "AZURE_WESTUS2"


def test_validate_key(spark):
    assert one(spark, N.validate_key_reason, "ACME_MANUFACTURING") is None
    assert one(spark, N.validate_key_reason, "Customer#1") == "bad characters"
    assert one(spark, N.validate_key_reason, "A" * 101) == "too long"


def test_numeric_coercion(spark):
    df = spark.createDataFrame([(" 12 ",), ("Bad Input",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(N.numeric_of(F.col("v"))).collect()] == [12.0, None, None, None]


def test_round6_half_up(spark):
    df = spark.createDataFrame([(1.0000005,), (-2.5e-7,), (None,)], "v double")
    got = [r[0] for r in df.select(N.round6(F.col("v"))).collect()]
    assert got[0] == pytest.approx(1.000001) and got[2] is None
