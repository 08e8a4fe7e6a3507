"""Timestamps against a plain Python reading of each value."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from postgrain.operators.timestamps import order_posteriors, to_utc

REF = datetime(2026, 3, 1, 12, 0, 0, 123456, tzinfo=timezone.utc)
ZONES = [("in", "Asia/Kolkata", True), ("us", "America/New_York", False), ("de", "Europe/Berlin", True)]


def us(*a, zone="UTC"):
    return round(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp() * 1_000_000)


def read(spark, cases, registry=ZONES, **more):
    rows = [(k, s, v, REF) for k, (s, v) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id bigint, source string, posted string, discovered_at timestamp")
    reg = spark.createDataFrame(registry, "source string, time_zone string, day_first boolean")
    return {r["id"]: r for r in to_utc(df, reg, key="id", fields={"posted": 0}, **more).collect()}


CASES = [
    ("in", "2026-02-10", us(2026, 2, 10, zone="Asia/Kolkata")),
    ("in", "10/02/2026", us(2026, 2, 10, zone="Asia/Kolkata")),
    ("us", "02/10/2026", us(2026, 2, 10, zone="America/New_York")),
    ("us", "02-10-26 07:30", us(2026, 2, 10, 7, 30, zone="America/New_York")),
    ("de", "11.01.2026", us(2026, 1, 11, zone="Europe/Berlin")),
    ("de", "22. Juli 2026, 14:44 Uhr", us(2026, 7, 22, 14, 44, zone="Europe/Berlin")),
    ("de", "7. März 2025, 19:01 Uhr", us(2025, 3, 7, 19, 1, zone="Europe/Berlin")),
    ("in", "13th June 2026, 12:26 am", us(2026, 6, 13, 0, 26, zone="Asia/Kolkata")),
    ("in", "1st June 2026, 12:26 pm", us(2026, 6, 1, 12, 26, zone="Asia/Kolkata")),
    ("in", "30 Nov' 25", us(2025, 11, 30, zone="Asia/Kolkata")),
    ("us", "22-MAR-2025 02:50 IST", us(2025, 3, 21, 21, 20)),
    ("us", "June 23, 2026 6:25 AM CEST", us(2026, 6, 23, 4, 25)),
    ("us", "Fri, 09 Jan 2026 04:27:41 -0800", us(2026, 1, 9, 12, 27, 41)),
    ("us", "Mon, 07 Apr 2025 19:29:17 GMT", us(2025, 4, 7, 19, 29, 17)),
    ("us", "20250715T062354Z", us(2025, 7, 15, 6, 23, 54)),
    ("us", "2026-07-12 02:09:56.011111-0400", us(2026, 7, 12, 6, 9, 56, 11111)),
    ("us", "2026-04-24T04:50:25.933Z", us(2026, 4, 24, 4, 50, 25, 933000)),
    ("us", "1774097124460", 1774097124460000),
    ("us", "1775985203", 1775985203000000),
    # clocks set back: the first of two instants; clocks set forward: moved on by the gap
    ("us", "2025-11-02 01:30:00", us(2025, 11, 2, 5, 30)),
    ("us", "2025-03-09 02:30:00", us(2025, 3, 9, 7, 30)),
    ("in", "just now", round(REF.timestamp() * 1_000_000)),
    ("in", "Posted 5 days ago", round((REF - timedelta(days=5)).timestamp() * 1_000_000)),
    ("in", "Closes in 2 months", round((REF + timedelta(days=60)).timestamp() * 1_000_000)),
    ("in", "in 1 week", round((REF + timedelta(days=7)).timestamp() * 1_000_000)),
    ("nowhere", "2026-02-10T08:00", us(2026, 2, 10, 8)),
    ("in", "31/02/2026", None), ("in", "2026-13-05", None), ("in", "Rolling", None), ("in", "", None), ("in", None, None), ("in", "TBD", None),
]


def test_each_form(spark):
    got = read(spark, [(s, v) for s, v, _ in CASES])
    wrong = [(CASES[k][1], r["utc_us"], CASES[k][2]) for k, r in got.items() if r["utc_us"] != CASES[k][2]]
    assert not wrong and len(got) == len(CASES)
    assert got[26]["status"] == "invalid" and got[28]["status"] == "none"


def test_mixture_learns_an_unregistered_source(spark):
    dmy = [("new", f"{d:02d}/02/2026") for d in range(13, 29)] + [("new", "03/02/2026")]
    got = read(spark, dmy, registry=[])
    assert got[len(dmy) - 1]["utc_us"] == us(2026, 2, 3) and got[len(dmy) - 1]["status"] == "inferred"


def test_data_overrule_a_wrong_registry_and_few_values_do_not(spark):
    wrong = [("x", "Europe/Berlin", False), ("y", "Europe/Berlin", False)]
    many = [("x", f"{d:02d}/02/2026") for d in range(13, 29)] * 20 + [("x", "03/02/2026")]
    got = read(spark, [*many, ("y", "03/02/2026"), ("y", "14/02/2026")], registry=wrong)
    assert got[len(many) - 1]["utc_us"] == us(2026, 2, 3, zone="Europe/Berlin")
    assert got[len(many)]["utc_us"] == us(2026, 3, 2, zone="Europe/Berlin")


def test_time_that_occurs_twice_is_marked(spark):
    got = read(spark, [("us", "2025-11-02 01:30:00"), ("us", "2025-11-02 01:30:00 -0400"), ("us", "2025-11-02 02:30:00"), ("us", "2025-03-09 02:30:00")])
    assert (got[0]["status"], got[0]["utc_us"], got[0]["other_us"]) == ("ambiguous", us(2025, 11, 2, 5, 30), us(2025, 11, 2, 6, 30))
    assert all(got[k]["status"] == "exact" and got[k]["other_us"] is None for k in (1, 2, 3))


def test_unknown_order_is_marked(spark):
    r = read(spark, [("new", "03/02/2026")], registry=[])[0]
    assert r["status"] == "ambiguous" and {r["utc_us"], r["other_us"]} == {us(2026, 2, 3), us(2026, 3, 2)}


def test_posterior_matches_brute_force(spark):
    values = [("s", v, REF, 0, None) for v in ["01/02/2026"] * 5 + ["14/02/2026"] * 3 + ["02/14/2026"]]
    df = spark.createDataFrame(values, "source string, value string, reference timestamp, side int, day_first boolean")
    got = order_posteriors(df, rounds=25).first()["p_dmy"]
    p = 0.5
    for _ in range(25):
        p = (5 * p + 3 + 1) / (9 + 2)
    assert got == pytest.approx(p, abs=1e-9)


def test_whole_table_agrees_with_python(spark, data):
    """Every value with a written zone, read again by regular expressions in Python."""
    from postgrain.session import table

    j = table(spark, data, "jobs")
    rows = to_utc(j, table(spark, data, "source_registry"), key="id", fields={"posted_date": -1, "deadline": 1}).collect()
    seen = 0
    for r in rows:
        m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:?\d\d)", r["value"] or "")
        if m:
            seen += 1
            text = r["value"].replace("Z", "+00:00").replace(" ", "T")
            text = re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", text)
            assert r["utc_us"] == round(datetime.fromisoformat(text).timestamp() * 1_000_000)
    assert seen > 10


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "id bigint, source string, posted string, discovered_at timestamp, key string, value string, c string, zone string")
    reg = spark.createDataFrame([], "source string, time_zone string, day_first boolean")
    assert to_utc(df, reg, key="id", fields={"posted": 0}).count() == 0
    one = spark.createDataFrame([(1, "x", "2026-01-01", None, "k", "v", "c", "z")], df.schema)
    assert to_utc(one, reg, key="id", fields={"posted": 0}).first()["utc_us"] == us(2026, 1, 1)
