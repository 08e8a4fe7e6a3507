import pytest

from postgrain.operators.units import pay_to_monthly_inr

UNITS = [("currency", "INR", 1, 1), ("currency", "USD", 835, 10), ("currency", "EUR", 9025, 100), ("currency", "GBP", 10575, 100), ("currency", "SGD", 625, 10),
         ("period", "hour", 160, 1), ("period", "day", 20, 1), ("period", "week", 4, 1), ("period", "fortnight", 2, 1), ("period", "month", 1, 1), ("period", "year", 1, 12)]

CASES = [
    ("stipend of 57000 INR", None, "mo", 57000, 57000),
    ("Pay: 4,500-7,000 INR p.m. (batch of 2026)", None, "p.a.", 4500, 7000),
    ("Rs.6,10,000 annually", None, None, 50833, 50833),
    ("1080-1140k", "Rupees", "p.a.", 90000, 95000),
    ("stipend of 11.8 - 12.1 lpa", "Rs", None, 98333, 100833),
    ("Rs.16.3L/yr", None, "p.m.", 135833, 135833),
    ("13.2 lakhs", "INR", "yearly", 110000, 110000),
    ("fifteen thousand rupees / Month", None, None, 15000, 15000),
    ("sixty-three thousand rupees monthly", None, None, 63000, 63000),
    ("$13/hr & 2 meals", None, "monthly", 173680, 173680),
    ("S$1,350/month", None, None, 84375, 84375),
    ("€1.000 pro Monat", None, None, 90250, 90250),
    ("2.600", "eur", "month", 234650, 234650),
    ("€12.5 ph", None, None, 180500, 180500),
    ("17,500 to 19,500 / Month", "INR", None, 17500, 19500),
    ("Pay: 28k-32k per month + certificate", "Rs.", "MONTH", 28000, 32000),
    ("INR 46 to 49k/mo, 6 month contract", None, None, 46000, 49000),
    ("£43,500, 6 month contract", None, "YEAR", 383344, 383344),
    ("1.6k – 1.8k for the first 3 months", "USD", "month", 133600, 150300),
    ("stipend of 6.9k plus 401(k)", "$", "MONTH", 576150, 576150),
    ("3,500 Rs every fortnight", None, None, 7000, 7000),
    ("INR 6", None, "annum", 1, 1),  # half a rupee rounds up
    ("19,500 - 17,500", "INR", "mo", 17500, 19500),
    ("Competitive stipend", "INR", "mo", None, None), ("26500", None, None, None, None), ("6.5 lakh", None, "year", None, None),
    (None, "INR", "mo", None, None), ("", None, None, None, None), ("Unpaid", None, None, None, None), ("x" * 100_000, "INR", "mo", None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, *c[:3], "clash") for k, c in enumerate(CASES)], "id int, compensation_text string, stipend_currency string, stipend_period string, unit string")
    units = spark.createDataFrame(UNITS, "unit_kind string, unit string, num bigint, den bigint")
    return {r["id"]: r for r in pay_to_monthly_inr(df, units, key="id").collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(got, k):
    assert (got[k]["month_inr_min"], got[k]["month_inr_max"]) == CASES[k][3:], CASES[k]


def test_source_default_is_the_last_resort(spark):
    df = spark.createDataFrame([(1, "500", None, None, "a"), (2, "500 usd", None, "week", "a"), (3, "500", None, None, None)], "id int, compensation_text string, stipend_currency string, stipend_period string, source string")
    units = spark.createDataFrame(UNITS, "unit_kind string, unit string, num bigint, den bigint")
    d = spark.createDataFrame([("a", "INR", "month")], "source string, currency string, period string")
    r = {x["id"]: x["month_inr_min"] for x in pay_to_monthly_inr(df, units, key="id", defaults=d, source="source").collect()}
    assert r == {1: 500, 2: 167000, 3: None}


def test_empty(spark):
    df = spark.createDataFrame([], "id int, compensation_text string, stipend_currency string, stipend_period string")
    units = spark.createDataFrame(UNITS, "unit_kind string, unit string, num bigint, den bigint")
    assert pay_to_monthly_inr(df, units, key="id").count() == 0
