"""Scalar expression traps."""
import math

import pytest
from pyspark.sql import functions as F

from cadre.functions import bins, numeric, text


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_utrim_strips_nbsp_where_trim_does_not(spark):
    assert one(spark, text.utrim, "  abc  ") == "abc"
    assert one(spark, F.trim, " abc") == " abc"


@pytest.mark.parametrize("raw,expected", [
    (" 1.5 ", 1.5), ("1d", None), ("nan", None), ("NaN", None), ("inf", None), ("1,000", None),
    ("+2", 2.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("", None), ("abc", None), (None, None)])
def test_to_double_like_pandas_coerce(spark, raw, expected):
    assert one(spark, numeric.to_double, raw) == expected


def test_inf_opt_in(spark):
    assert one(spark, lambda c: numeric.to_double(c, allow_inf=True), "-inf") == -math.inf


def test_nan_never_leaks_from_numeric_columns(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    out = df.select(numeric.as_double(df, "v").alias("o")).collect()
    assert sorted([r["o"] for r in out], key=lambda x: (x is None, x)) == [1.0, None]


@pytest.mark.parametrize("raw,expected", [
    (" N/A ", "N/A"), ("N/A", None), ("-", None), (" ", None), ("  x  ", "x"), ("", None),
    (" ", None)])
def test_clean_order_tokens_before_strip(spark, raw, expected):
    assert one(spark, text.clean_string, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Y", 1), (" yes ", 1), ("1", 1), ("true", 1), ("N", 0), ("no", 0), ("0", 0), ("FALSE", 0),
    ("maybe", None), (None, None)])
def test_yes_no(spark, raw, expected):
    assert one(spark, text.yes_no, raw) == expected


@pytest.mark.parametrize("v,label", [
    (5.0, "<5km"), (5.0001, "5-15km"), (60.0, "30-60km"), (9999.0, ">60km"), (-1.0, None),
    (-0.5, "<5km"), (10000.0, None), (None, None)])
def test_distance_bins_right_closed(spark, v, label):
    assert one(spark, bins.dist_bucket, v, "double") == label


def test_bins_null_label_parity(spark):
    assert one(spark, lambda c: bins.dist_bucket(c, null_label="nan"), None, "double") == "nan"


def test_tenure_counts_time_of_day(spark):
    df = spark.createDataFrame([("2026-06-21 10:00:00",), ("2026-06-21 00:00:00",), ("2027-01-01 00:00:00",)],
                               "h string")
    out = df.select(bins.tenure_months(bins.parse_timestamp("h")).alias("t")).collect()
    assert out[0]["t"] == pytest.approx(1 / 30.44)       # 1 day 14h -> 1 floor-day
    assert out[1]["t"] == pytest.approx(2 / 30.44)
    assert out[2]["t"] == 0.0                              # hire after reference -> 0


def test_parse_timestamp_declared_formats(spark):
    df = spark.createDataFrame([("2024-01-05",), ("01/05/2024",), ("garbage",)], "h string")
    out = [r["t"] for r in df.select(bins.parse_timestamp("h").alias("t")).collect()]
    assert out[0] is not None and out[0] == out[1] and out[2] is None


def test_tier_right_closed_and_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,), (None,)], "v double")
    out = [r["t"] for r in df.select(bins.tier_of("v", 2.0, 3.0).alias("t")).collect()]
    assert out == [0, 0, 1, 1, None]


@pytest.mark.parametrize("star,y", [("1", 0), ("3", 1), ("4", 2), ("5", 3), ("2", None), ("x", None),
                                    ("5.0", 3)])
def test_star_map(spark, star, y):
    assert one(spark, bins.star_to_ordinal, star) == y


def test_safe_name_and_collision(spark):
    assert text.safe_name_py("Resolved PTG-a/b.c") == "Resolved_PTG_a_b_c"
    assert one(spark, text.safe_name, "a b-c/d.e") == "a_b_c_d_e"
