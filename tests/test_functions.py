import datetime as dt

from pyspark.sql import functions as F

from churnlens.functions import keys as K
from churnlens.functions import rules as R


def test_pad_key_keeps_last_characters(spark):
    df = spark.createDataFrame([("1234567",), ("1234567890",), ("12345678901",)], "k string")
    got = [r[0] for r in df.select(K.pad_key("k")).collect()]
    assert got == ["0001234567", "1234567890", "2345678901"]


def test_present_and_bundle_size(spark):
    rows = [("a", "b", "c"), ("a", None, "c"), ("", "", ""), (None, None, None), ("a", "", None)]
    df = spark.createDataFrame(rows, "vo string, tv string, bb string")
    got = [r[0] for r in df.select(R.bundle_size("vo", "tv", "bb")).collect()]
    # an all-empty row is 1P: 0P needs all three NULL
    assert got == ["3P", "2P", "1P", "0P", "1P"]


def test_bundle_name(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (0, 0, 0)], "v int, t int, b int")
    assert [r[0] for r in df.select(R.bundle_name("v", "t", "b")).collect()] == ["BB+VO", "BB+TV+VO", None]


def test_tenure_segment_bounds(spark):
    df = spark.createDataFrame([(6,), (7,), (12,), (13,), (None,)], "t int")
    got = [r[0] for r in df.select(R.tenure_segment("t", 6, 12)).collect()]
    assert got == ["Early Tenure", "Mid Tenure", "Mid Tenure", "Late Tenure", None]


def test_comma_decimal_and_markers(spark):
    df = spark.createDataFrame([("12,5",), ("#N/D",), ("1/2",), ("NULL",), (None,)], "r string")
    got = [r[0] for r in df.select(K.comma_decimal("r")).collect()]
    assert got == [12.5, None, None, None, 0.0]
    df2 = spark.createDataFrame([("#N/D",), ("nan",), ("123",)], "c string")
    assert [r[0] for r in df2.select(K.blank_to_null("c")).collect()] == [None, None, "123"]


def test_parse_mixed_date_swaps_day_month(spark):
    df = spark.createDataFrame([("01/02/2022",), ("25/02/2022",), ("IPHONE",)], "s string")
    got = [r[0] for r in df.select(K.parse_mixed_date("s", junk=["IPHONE"])).collect()]
    assert got == [dt.date(2022, 1, 2), dt.date(2022, 2, 25), None]


def test_month_differences_dialects(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 31), dt.date(2022, 2, 28))], "a date, b date")
    r = df.select(K.months_crossed("a", "b"), K.months_full("a", "b"), K.weeks_full("a", "b")).first()
    assert tuple(r) == (1, 0, 4)


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "n int, d int")
    assert [r[0] for r in df.select(K.safe_ratio("n", "d", 2)).collect()] == [None, 0.33]


def test_billing_system(spark):
    df = spark.createDataFrame([("12345678",), ("123456789012",)], "k string")
    assert [r[0] for r in df.select(K.billing_system("k")).collect()] == ["CERILLION", "LIBERATE"]


def test_case_when_null_falls_through(spark):
    df = spark.createDataFrame([(None,), (5,)], "x int")
    e = R.case_when([(F.col("x") > 3, "big"), (F.col("x").isNull(), "none")], "other")
    assert [r[0] for r in df.select(e).collect()] == ["none", "big"]
