from __future__ import annotations

import math
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.shop import rows
from tillroll.functions import measures as m
from tillroll.functions.stats import erfc, two_proportion_z


def test_delay_bucket_edges(spark):
    df = spark.createDataFrame([(d,) for d in (-1, 0, 1, 3, 4, 7, 8, None)], "d int")
    assert [r[0] for r in rows(df.select(m.delay_bucket(F.col("d"))))] == [
        "1. Early", "2. On time", "3. 1-3 days late", "3. 1-3 days late",
        "4. 4-7 days late", "4. 4-7 days late", "5. 8+ days late", None,
    ]


@pytest.mark.parametrize(
    "part,whole,digits,expected",
    [(1, 8, 2, "12.50"), (1, 3, 2, "33.33"), (1, 800, 2, "0.13"), (-1, 800, 2, "-0.13"),
     (1, 200, 0, "1"), (5, 0, 2, None)],
)
def test_pct_rounds_half_away_from_zero(spark, part, whole, digits, expected):
    df = spark.createDataFrame([(part, whole)], "a bigint, b bigint")
    got = df.select(m.pct(F.col("a"), F.col("b"), digits)).first()[0]
    assert got == (None if expected is None else Decimal(expected))


def test_pct_equals_integer_half_up(spark):
    pairs = spark.range(1, 200).select(F.col("id").alias("b")).join(
        spark.range(0, 120).select(F.col("id").alias("a"))
    )
    wrong = pairs.filter(
        m.pct(F.col("a"), F.col("b"), 2) * 100 != F.expr("(20000 * a + b) div (2 * b)")
    )
    assert wrong.count() == 0


def test_months(spark):
    df = spark.createDataFrame([(date(2018, 2, 1), date(2017, 11, 1))], "a date, b date")
    assert rows(df.select(m.months_between(F.col("a"), F.col("b")))) == [(3,)]


def test_erfc_matches_the_library_function(spark):
    xs = [i / 50 for i in range(0, 500)] + [0.46875, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in rows(df.select("x", erfc(F.col("x")))):
        assert got == pytest.approx(math.erfc(x), rel=1e-13)


def test_z_test(spark):
    df = spark.createDataFrame([(30, 1000, 10, 500), (1, 10, 0, 0)], "a int, na int, b int, nb int")
    z = two_proportion_z(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))
    (z0,), (z1,) = rows(df.select(z))
    pooled = 40 / 1500
    assert z0 == pytest.approx(
        (0.03 - 0.02) / math.sqrt(pooled * (1 - pooled) * (1 / 1000 + 1 / 500))
    )
    assert z1 is None
