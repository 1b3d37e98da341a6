import datetime as dt

from pyspark.sql import functions as F

from statemesh.functions.periods import duration_seconds, iso_date, overlaps, parse_period, period_is_possible, same_period

D = dt.date


def last(year, month):
    return D(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)


def quarter_of_fiscal(year, q):
    month = (4, 7, 10, 1)[q - 1]
    return D(year if q == 4 else year - 1, month, 1), last(year if q == 4 else year - 1, month + 2)


def written(year):
    """Texts about one year, with what each says: made from the rules, form by form."""
    yy, fiscal, cal = f"{year % 100:02}", "IN_APR_MAR", "CALENDAR"
    whole = (D(year - 1, 4, 1), D(year, 3, 31), fiscal)
    out = {t: whole for t in (f"FY{yy} sales", f"in FY'{year}", f"Fiscal year {year}", f"{year - 1}-{year}", f"{year - 1}/{yy} plan", f"Year ended 31 MARCH {year}", f"the fiscal year ended Mar 31 {year}", f"12 M FY{yy}", f"xFY{yy}")}
    out |= {f"Q{q} - FY {yy}": (*quarter_of_fiscal(year, q), fiscal) for q in range(1, 5)}
    out |= {f"{n}MFY{yy}": (D(year - 1, 4, 1), last(year - 1, 3 + n) if n < 9 else last(year - 1, 12), fiscal) for n in (3, 6, 9)}
    out |= {f"H1 FY{yy}": (D(year - 1, 4, 1), D(year - 1, 9, 30), fiscal), f"7H2FY{yy}": (D(year - 1, 10, 1), D(year, 3, 31), fiscal)}
    out |= {f"H1-CY{yy}": (D(year, 1, 1), D(year, 6, 30), cal), f"H2 CY {year}": (D(year, 7, 1), D(year, 12, 31), cal), f"CY{yy} budget": (D(year, 1, 1), D(year, 12, 31), cal)}
    out |= {f"Q{q} {year}": (D(year, 3 * q - 2, 1), last(year, 3 * q), cal) for q in range(1, 5)}
    out |= {f"period ended 31 December {year}": (D(year, 1, 1), D(year, 12, 31), cal), f"year ended June 30, {year}": (D(year - 1, 7, 1), D(year, 6, 30), "unknown")}
    out |= {f"six months ended 30 September {year}": (D(year, 4, 1), D(year, 9, 30), "unknown"), f"3 months ended March 31, {year}": (D(year, 1, 1), D(year, 3, 31), fiscal)}
    out |= {f"as at {t}": (D(year, 3, 31), D(year, 3, 31), fiscal) for t in (f"31 March {year}", f"Mar 31, {year}", f"31.03.{year}")}
    out |= {f"as on 5/11/{year}": (D(year, 11, 5), D(year, 11, 5), "unknown"), f"as of 29 February {year}": (D(year, 2, 29), D(year, 2, 29), "unknown") if year % 4 == 0 else None}
    return out


CASES = {t: p for year in (2003, 2016, 2024, 2037) for t, p in written(year).items() if p} | {"1999-00": (D(1899, 4, 1), D(1900, 3, 31), "IN_APR_MAR")}
UNKNOWN = [None, "", " \t", "no digits at all", "line 3 of 40", "see 4.2", "Q5 FY24x", "briefy24", "halfy2019", "as at 30 February 2016", "as of 29 February 2003", "as on 5/13/2016", "year ended 31 June 2016"]


def test_every_form(spark):
    data = list(enumerate([*CASES, *UNKNOWN]))
    df = spark.createDataFrame(data, "i int, t string").select("i", parse_period(F.col("t")).alias("p"))
    got = {r["i"]: r["p"] for r in df.collect()}
    for i, text in data:
        p = got[i]
        if text in CASES:
            assert (p["start"], p["end"], p["convention"]) == CASES[text], text
            assert p["kind"] == ("instant" if text.startswith("as ") else "interval")
        else:
            assert (p["kind"], p["start"], p["end"], p["label"]) == ("unknown", None, None, None), text


def test_overlap_equality_and_plausibility(spark):
    df = spark.createDataFrame([("FY24", "Q4FY24"), ("FY24", "2023-24"), ("FY24", "CY2025"), ("FY24", "nothing")], "a string, b string")
    p = df.select(parse_period(F.col("a")).alias("a"), parse_period(F.col("b")).alias("b"))
    assert [tuple(r) for r in p.select(overlaps(F.col("a"), F.col("b")), same_period(F.col("a"), F.col("b"))).collect()] == [(True, False), (True, True), (False, False), (False, False)]
    d = spark.createDataFrame([(D(2024, 3, 31), D(2022, 4, 25)), (D(2024, 3, 31), D(2024, 3, 31)), (None, D(2024, 1, 1)), (D(2024, 3, 31), None)], "e date, v date")
    assert [r[0] for r in d.select(period_is_possible(F.col("e"), F.col("v"))).collect()] == [False, True, True, True]


def test_dates_and_durations(spark):
    df = spark.createDataFrame([("2024-02-30T00:00",), ("2024-02-29Z",), ("x",)], "t string")
    assert [r[0] for r in df.select(iso_date(F.col("t"))).collect()] == [None, D(2024, 2, 29), None]
    df = spark.createDataFrame([("7.66s",), ("1m2.5s",), ("120ms",), ("3",)], "t string")
    assert [r[0] for r in df.select(duration_seconds(F.col("t"))).collect()] == [7.66, 62.5, 0.12, 3.0]


def test_what_has_a_period_is_told_without_parsing(spark):
    from statemesh.functions.periods import has_period

    texts = ["FY24", "as at March 31, 2024", "as at 31 June 2024", "as at 30.02.2024", "0000-00", "Q1 0000", "Q1 2024", "none", "", None, "year ended 31 March 2022", "year ended 31 February 2022", "2023-24", "H1CY25 as at 99.99.2024", "12", "three months ended June 31, 2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.coalesce(has_period(F.col("t")), F.lit(False)).alias("a"), F.coalesce(parse_period(F.col("t"))["kind"] != "unknown", F.lit(False)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and 0 < sum(r["a"] for r in rows) < len(rows)


def test_forms_in_longer_texts_and_in_odd_letters(spark):
    from pyspark.sql import functions as F

    from statemesh.functions.periods import parse_period

    rows = [("see q2 - fy'24, then FY25", "q2 - fy'24"), ("x\nthe Fiſcal year 2023\ny", "Fiſcal year 2023"), ("YEAR ENDED 31 march 2024 and more", "YEAR ENDED 31 march 2024"), ("as on 5/6/2021.", "as on 5/6/2021"), ("2023–24", "2023–24"), ("calendar year 2020", "calendar year 2020"), ("as at 31 February 2024", None), ("year ended February 30, 2024", None), ("a1", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", parse_period(F.col("t"))["label"].alias("label"))
    assert [r["label"] for r in df.orderBy("i").collect()] == [want for _, want in rows]
