"""Amounts, descriptions, dates and keys on worked examples."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallystone.functions import dates, identity, text
from tallystone.operators import scenario


def values(spark, given, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


AMOUNTS = [
    ("$1,234.56", "1234.56"), ("(45.00)", "-45"), ("45.00-", "-45"), ("-45.00", "-45"), ("+45.00", "45"),
    ("£ 3", "3"), (" 12 ", "12"), (".5", "0.5"), ("5.", None), ("", None), ("  ", None), ("abc", None),
    ("1.2.3", None), ("--5", None), ("-5-", None), ("(-5)", "-5"), ("(5-)", "-5"), ("1,2,3", "123"), ("()", None),
    (" 12.50 ", "12.5"), ("12 50", "1250"), ("-", None),
]


def test_amounts(spark):
    got = values(spark, [raw for raw, _ in AMOUNTS], text.parse_amount)
    assert got == [None if amount is None else Decimal(amount) for _, amount in AMOUNTS]


def test_amounts_beyond_six_decimals_are_refused_not_rounded(spark):
    assert values(spark, ["1.23456789", "0.0049999999", "1.5000000000", "1.234567"], text.parse_amount) == [
        None, None, Decimal("1.500000"), Decimal("1.234567")]


def test_amount_with_decimal_comma(spark):
    got = values(spark, ["1.234,56", "-1.234", "1,5"], lambda c: text.parse_amount(c, decimal_comma=True))
    assert got == [Decimal("1234.56"), Decimal("-1234"), Decimal("1.5")]


DESCRIPTIONS = [
    ("SQ *BLUE BOTTLE 4412", "BLUE BOTTLE"), ("TST* BLUE BOTTLE", "BLUE BOTTLE"),
    ("BLUE BOTTLE COFFEE #221", "BLUE BOTTLE COFFEE"), ("NETFLIX 08/17", "NETFLIX"), ("#4412", "#4412"),
    ("netflix  com", "NETFLIX COM"), ("4412", "4412"), ("SQ *", "SQ *"), ("STORE 5", "STORE 5"),
    ("A 08/17/2026 #12", "A 08/17/2026"), ("A #12 08/17", "A"), ("PAYPAL * STEAM 99", "STEAM"), ("SPOTIFY", "SPOTIFY"),
]


def test_descriptions(spark):
    got = values(spark, [raw for raw, _ in DESCRIPTIONS], text.normalise_description)
    assert got == [merchant for _, merchant in DESCRIPTIONS]


DATES = [
    ("2026-08-17", "AMBIGUOUS", dt.date(2026, 8, 17)), ("17.08.2026", "DAY_FIRST", dt.date(2026, 8, 17)),
    ("08/17/26", "MONTH_FIRST", dt.date(2026, 8, 17)), ("Aug 17, 2026", "AMBIGUOUS", dt.date(2026, 8, 17)),
    ("august 17, 2026", "AMBIGUOUS", dt.date(2026, 8, 17)), ("17 Aug 2026", "AMBIGUOUS", dt.date(2026, 8, 17)),
    ("2026-08-17 14:32:00", "AMBIGUOUS", dt.date(2026, 8, 17)), ("2026-08-17T14:32:00Z", "AMBIGUOUS", dt.date(2026, 8, 17)),
    ("17-Aug-69", "AMBIGUOUS", dt.date(1969, 8, 17)), ("17-Aug-68", "AMBIGUOUS", dt.date(2068, 8, 17)),
    ("31/02/2026", "DAY_FIRST", None), ("03/04/2026", "AMBIGUOUS", None), ("03/04/2026", "DAY_FIRST", dt.date(2026, 4, 3)),
    ("2026/08/17", "MONTH_FIRST", dt.date(2026, 8, 17)), ("2026-13-01", "ISO", None), ("PENDING", "ISO", None), ("", "ISO", None),
    ("1/2/199", "MONTH_FIRST", dt.date(199, 1, 2)), ("2026.08.17", "AMBIGUOUS", dt.date(2026, 8, 17)), ("30 Feb 2026", "ISO", None),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, r, o) for i, (r, o, _) in enumerate(DATES)], "i int, v string, o string")
    got = rows.orderBy("i").select(dates.parse_date(dates.clean(F.col("v")), F.col("o"))).collect()
    assert [r[0] for r in got] == [day for _, _, day in DATES]


ORDERS = [
    (["17/08/2026", "03/04/2026"], "DAY_FIRST"), (["08/17/2026"], "MONTH_FIRST"), (["17/08/2026", "08/17/2026"], "AMBIGUOUS"),
    (["2026-08-17"], "ISO"), (["03/04/2026"], "AMBIGUOUS"), (["17 Aug 2026", "17/08/2026"], "DAY_FIRST"),
]


def test_date_orders(spark):
    rows = spark.createDataFrame(
        [(i, v) for i, (column, _) in enumerate(ORDERS) for v in column], "i int, v string"
    ).select("i", dates.clean(F.col("v")).alias("v"))
    verdict = dates.column_order(
        F.bool_or(dates.says_day_first(F.col("v"))), F.bool_or(dates.says_month_first(F.col("v"))),
        F.bool_or(dates.describes_itself(F.col("v"))))
    got = rows.groupBy("i").agg(verdict.alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [order for _, order in ORDERS]


def test_fingerprint_ignores_invisible_differences(spark):
    rows = spark.createDataFrame([("-4.50",), ("-4.5",), ("-0.001",), ("0.00",)], "a string").select(
        identity.fingerprint(F.lit("acc"), F.lit("2026-08-17").cast("date"), F.lit("M"),
                             F.col("a").cast("decimal(28,6)"), F.lit("USD")))
    got = [r[0] for r in rows.collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2] and len(got[0]) == 32


def test_account_key_folds_unicode(spark):
    names = spark.createDataFrame(
        [("Café  Checking",), ("CAFÉ checking!",), ("Caf Checking",), ("貯金",), ("--",)], "name string")
    got = {r["name"]: r["account_key"] for r in identity.with_account_key(names, "name").collect()}
    assert got["Café  Checking"] == got["CAFÉ checking!"] == "café-checking"
    assert got["Caf Checking"] == "caf-checking" and got["貯金"] == "貯金" and got["--"] is None


def test_numbers_have_guards(spark):
    raw = "Paid $4,300 (12.5%), -7 and v1.2.3 x9 1,23 8."
    rows = spark.createDataFrame([(raw,)], "t string").select(text.number_texts(F.col("t")))
    assert rows.first()[0] == ["4,300", "12.5", "-7", "23", "8"]


SHARES = [
    (100, [1, 1, 1], [34, 33, 33]), (10000, [25, 75], [2500, 7500]), (-100, [1, 1, 1], [-34, -33, -33]),
    (5, [0, 1, 1], [0, 3, 2]), (1, [1, 1, 1, 1], [1, 0, 0, 0]),
]


def test_allocation_keeps_the_total(spark):
    rows = spark.createDataFrame([(i, u, w) for i, (u, w, _) in enumerate(SHARES)], "i int, u bigint, w array<bigint>")
    got = [r[0] for r in rows.orderBy("i").select(scenario.allocate(F.col("u"), F.col("w"))).collect()]
    assert got == [shares for _, _, shares in SHARES]
    assert [sum(g) for g in got] == [units for units, _, _ in SHARES]


def test_a_cell_is_looked_at_by_few_patterns(spark):
    # every pattern costs a microsecond or more a cell, so a cell that says nothing must be done with after few
    from tallystone.functions import dates
    from tallystone.functions.text import normalise_description, parse_amount, strip

    rows = spark.createDataFrame([("a",)], "a string")

    def patterns(value):
        plan = rows.select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
        return plan.count("regexp_") + plan.count("rlike(")

    assert patterns(strip(F.col("a"))) == 0
    assert patterns(parse_amount(F.col("a"))) <= 2
    assert patterns(normalise_description(F.col("a"))) <= 20
    assert patterns(dates.parse_date(F.col("a"), F.lit("DAY_FIRST"))) <= 18


def test_odd_dates_and_amounts_read_as_ever(spark):
    from tallystone.functions import dates
    from tallystone.functions.text import parse_amount

    rows = spark.createDataFrame([(t,) for t in (
        "1/2/24", "1.2.0024", "1-2-199", "13/12/2024", "2024-01-005", "2024/1/5\n 9:15", "5 March 2024", "March 5 2024",
        "2024 Jan 5", "5-Jan-69", "5-Jan-68", "(+5)", "+-5", "(5-)", "-5-", "5,-", ",+5", "1.0000001")], "t string")
    got = rows.select("t", dates.parse_date(dates.clean(F.col("t")), F.lit("DAY_FIRST")).cast("string").alias("d"),
                      parse_amount(F.col("t")).cast("double").alias("m")).collect()
    assert {r.t: r.d for r in got if r.d} == {
        "1/2/24": "2024-02-01", "1.2.0024": "2024-02-01", "1-2-199": "0199-02-01", "13/12/2024": "2024-12-13",
        "2024-01-005": "2024-01-05", "5 March 2024": "2024-03-05", "2024 Jan 5": "2024-01-05",
        "5-Jan-69": "1969-01-05", "5-Jan-68": "2068-01-05"}
    assert {r.t: r.m for r in got if r.m is not None} == {"(+5)": -5, "+-5": -5, "(5-)": -5, "5,-": -5}
