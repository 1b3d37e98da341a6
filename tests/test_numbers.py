from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statemesh.functions.currency import detect_currency
from statemesh.functions.numbers import classify_ratio, parse_number, parse_range, parse_value, rounding_tolerance, significant_digits
from statemesh.functions.scale import parse_scale, scale_from_header

NUMBERS = [
    ("1,23,456.78", "123456.78"),
    ("12,34,567", "1234567"),
    ("1,00,000", "100000"),
    ("99,99,999", "9999999"),
    ("123,456.78", "123456.78"),
    ("61,451", "61451"),
    ("6145", "6145"),
    ("0.082", "0.082"),
    (".5", "0.5"),
    ("(2,345)", "-2345"),
    ("(1,23,456)", "-123456"),
    ("(0.5)", "-0.5"),
    ("-2,345", "-2345"),
    ("2,345-", "-2345"),
    ("NIL", "0"),
    ("Nil", "0"),
    ("—", "0"),
    ("–", "0"),
    ("N/A", "0"),
    ("12 34", "1234"),
    ("", None),
    ("   ", None),
    ("revenue", None),
    (None, None),
]


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_numbers(spark):
    df = rows(spark, [(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string").select("i", parse_number(F.col("t")).alias("n"))
    got = {r["i"]: r["n"] for r in df.collect()}
    for i, (text, want) in enumerate(NUMBERS):
        assert got[i] == (None if want is None else Decimal(want)), text


@pytest.mark.parametrize("words,power", [("5 crore", 7), ("crores", 7), ("10 Cr", 7), ("lakh", 5), ("lacs", 5), ("million", 6), ("mn", 6), ("billion", 9), ("thousand", 3), ("trillion", 12), ("lakh crore", 12), ("(₹ in millions)", 6), ("all amounts in lakhs", 5)])
def test_scales(spark, words, power):
    got = rows(spark, [(words,)], "t string").select(parse_scale(F.col("t")).alias("s")).first()["s"]
    assert got == 10**power


def test_scale_needs_a_word_boundary_and_captions(spark):
    df = rows(spark, [("5cr",), ("figures in ' 000",), ("(Rs. in crores)",), ("nothing",), (None,)], "t string")
    got = [tuple(r) for r in df.select(parse_scale(F.col("t")), scale_from_header(F.col("t"))).collect()]
    assert got == [(None, None), (None, 1000), (10**7, 10**7), (None, None), (None, None)]


def test_currency_symbols_go_before_words_in_their_order(spark):
    df = rows(spark, [("$5 or ₹5",), ("Rs. 5",), ("5 euros",), ("firs 5",), ("us$ 4",), (None,)], "t string")
    assert [r[0] for r in df.select(detect_currency(F.col("t"))).collect()] == ["INR", "INR", "EUR", None, "USD", None]


VALUES = [
    ("61,451", "(Rs. in millions)", "", "money", "61451000000", "INR"),
    ("6,145", "(₹ in crore)", "", "money", "61450000000", "INR"),
    ("(2,345)", "(₹ in crore)", "", "money", "-23450000000", "INR"),
    ("5 crore", "(₹ in millions)", "", "money", "50000000", "INR"),
    ("8.2%", "", "", "ratio", "0.082", None),
    ("8.2 per cent", "", "", "ratio", "0.082", None),
    ("35 basis points", "", "", "ratio", "0.0035", None),
    ("1.4x", "", "", "ratio", "1.4", None),
    ("1,234", "", "", "quantity", "1234", None),
    ("6.3 to 6.8 per cent", "", "", "ratio", "0.063", None),
    ("1,860", "₹ Cr | QoQ% | YoY%", "", "money", "18600000000", "INR"),
    ("58,400", "employed 58,400 people", "₹ in millions", "quantity", "58400", None),
    ("9.7", "real growth", "percent change", "ratio", "0.097", None),
    ("607.3", "reserves in billions of U.S. dollars", "percent change", "money", "607300000000", "USD"),
    ("abc", "", "", None, None, None),
    ("", "", "", None, None, None),
]


def test_values(spark):
    df = rows(spark, [(i, *v[:3]) for i, v in enumerate(VALUES)], "i int, r string, c string, h string")
    got = {r["i"]: r["v"] for r in df.select("i", parse_value(F.col("r"), F.col("c"), F.col("h")).alias("v")).collect()}
    for i, (raw, _, _, kind, magnitude, currency) in enumerate(VALUES):
        v = got[i]
        if kind is None:
            assert v is None
        else:
            assert (v["kind"], v["canonical_magnitude"], v["currency"]) == (kind, Decimal(magnitude), currency), raw


def test_ranges(spark):
    data = [("6.3 to 6.8",), ("between 6.8 and 6.3",), ("6.3-6.8",), ("6.3 – 6.8",), ("26-278",), ("7",)]
    got = [r["r"] and tuple(map(float, r["r"])) for r in rows(spark, data, "t string").select(parse_range(F.col("t")).alias("r")).collect()]
    assert got == [(6.3, 6.8)] * 4 + [None, None]


def test_ratio_order_and_digits(spark):
    df = rows(spark, [("5 bps, not 5%",), ("5%",), ("3 x",), ("none",)], "t string")
    assert [r[0] for r in df.select(classify_ratio(F.col("t"))).collect()] == ["bps", "percent", "multiple", None]
    df = rows(spark, [("0.0820",), ("61,451",), ("000",)], "t string")
    assert [r[0] for r in df.select(significant_digits(F.col("t"))).collect()] == [3, 5, 1]


def test_rounding_tolerance_is_a_unit_in_the_last_place(spark):
    data = [("61451000000", "61,451"), ("0.0820", "0.0820"), ("0", "0"), ("-23450000000", "2,345")]
    df = rows(spark, data, "m string, r string").select(rounding_tolerance(F.col("m").cast("decimal(38,10)"), F.col("r")).alias("t"))
    assert [float(r["t"]) for r in df.collect()] == [1e6, 1e-4, 0.0, 1e7]


def test_plain_numerals_read_like_others(spark):
    from pyspark.sql import functions as F

    from statemesh.functions.numbers import parse_number, parse_value

    # a blank in front is stripped, and sends the same numeral the long way
    raws = ["0", "0.0", "7", "1,234", "12,34,567", "1,23", "1234.50", "12,3456", "1,2", "9" * 18, "9" * 19, "12.", "1,234,567.891"]
    contexts = ["(Rs. in millions)", "in %", "bps", None, "", "tonnes", "3 1,234 customers", "USD"]
    rows = [(r, c) for r in raws for c in contexts]
    df = spark.createDataFrame(rows, "r string, c string")
    spaced = F.concat(F.lit("\n"), "r")
    differ = df.where(~parse_value(F.col("r"), F.col("c")).eqNullSafe(parse_value(spaced, F.col("c"))) | ~parse_number(F.col("r")).eqNullSafe(parse_number(spaced)))
    assert differ.collect() == []


def test_plain_numerals_inherit_like_others(spark):
    from pyspark.sql import functions as F

    from statemesh.functions.numbers import parse_value

    raws = ["0", "7", "1,234", "12,34,567", "1234.50", "12,3456", "9" * 19, "12."]
    contexts = ["(Rs. in millions)", "in %", None, "", "tonnes", "3 1,234 customers", "7 employees", "USD"]
    inherited = ["(₹ in crore)", "figures in %", "bps, in USD", None, "", "7 parcels", "Consolidated"]
    rows = [(r, c, i) for r in raws for c in contexts for i in inherited]
    df = spark.createDataFrame(rows, "r string, c string, i string")
    spaced = F.concat(F.lit("\n"), "r")
    read = lambda r: parse_value(r, F.col("c"), F.col("i"))
    assert df.where(~read(F.col("r")).eqNullSafe(read(spaced))).collect() == []


def test_rows_are_spread_over_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from statemesh import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    assert session.spread(spark.range(0, 95, 1, 2)).rdd.getNumPartitions() == 10
    assert session.spread(spark.range(0, 5, 1, 6)).rdd.getNumPartitions() == 6
