"""Decisions, validity, probes and typed values on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postgrain.functions import identity, values as v
from postgrain.operators import decisions as d

def review():
    return {
        "approve": d.Action({"status": F.lit("queued"), "note": F.element_at("values", F.lit("note"))}, F.col("status") == "review"),
        "reject": d.Action({"status": F.lit("closed")}, F.col("status").isin("review", "queued")),
        "fail": d.Action({"status": F.lit("failed"), "retries": F.col("retries") + 1}, F.col("retries") < 3),
        "landed": d.Action({"status": F.lit("submitted"), "note": F.coalesce(F.try_element_at("values", F.lit("evidence")), F.col("note"))}, F.col("status") == "queued"),
    }


ROWS = [("a", "review", 0, None), ("b", "review", 0, "x"), ("c", "queued", 3, None), ("d", "queued", 1, "y"), ("e", "done", 0, None)]
LOG = [("a", 1, "reject", None), ("a", 2, "approve", {"note": "ok"}), ("b", 1, "landed", {}), ("c", 1, "fail", None), ("d", 1, "landed", {"evidence": "id 7"}), ("zz", 1, "reject", None), ("e", 1, "dance", None), (None, 1, "fail", None)]


def frames(spark):
    return spark.createDataFrame(ROWS, "k string, status string, retries int, note string"), spark.createDataFrame(LOG, "k string, o int, action string, values map<string,string>")


def test_decisions_change_only_what_is_allowed(spark):
    rows, log = frames(spark)
    got = {r["k"]: tuple(r)[1:] for r in d.decide(rows, log, key="k", order="o", actions=review()).collect()}
    assert got == {"a": ("queued", 0, "ok"), "b": ("review", 0, "x"), "c": ("queued", 3, None), "d": ("submitted", 1, "id 7"), "e": ("done", 0, None)}
    told = {r["k"]: (r["outcome"], r["superseded"]) for r in d.outcomes(rows, log, key="k", order="o", actions=review()).collect()}
    assert told == {"a": ("applied", 1), "b": ("refused", 0), "c": ("refused", 0), "d": ("applied", 0), "e": ("unknown action", 0), "zz": ("no row", 0)}
    assert d.decide(rows, log.where("false"), key="k", order="o", actions=review()).count() == 5 and d.decide(rows.where("false"), log, key="k", order="o", actions=review()).count() == 0


def test_children_claims_flags_and_edits(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "p int, t string")
    new = spark.createDataFrame([(1, "z"), (2, None)], "p int, t string")
    assert sorted(tuple(r) for r in d.replace_children(c, new, parent="p").collect()) == [(1, "z"), (3, None)]
    assert sorted(r["t"] or "" for r in d.release(c, new.where("p = 1"), owner="p").collect()) == ["", "c"]
    flags = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id int, is_active int")
    assert [(r["id"], r["is_active"]) for r in d.only_active(flags, chosen=F.col("id") == 3).orderBy("id").collect()] == [(1, 0), (2, 0), (3, 1)]
    rows = spark.createDataFrame([(1, "a", None, "cv"), (2, "b", "x", "cv"), (3, "c", "x", "cv")], "id int, n string, m string, source string")
    e = spark.createDataFrame([(1, "a", "new"), (2, "b", "x"), (3, None, None)], "id int, n string, m string")
    assert [tuple(r) for r in d.edited(rows, e, key="id", columns=["n", "m"], source="source").orderBy("id").collect()] == [(1, "a", "new", "user"), (2, "b", "x", "cv"), (3, "c", "x", "cv")]
    later = rows.withColumn("n", F.upper("n"))
    assert sorted((r["id"], r["column"]) for r in d.guarded_writes(rows, later, key="id", columns=["n", "m"], allowed=F.col("id") == 2).collect()) == [(1, "n"), (3, "n")]


def test_answers_hold_in_their_time_and_condition(spark):
    day = lambda n: dt.date(2026, 1, n)
    entries = spark.createDataFrame([
        ("pay", "fact", "old", day(1), day(5), None), ("pay", "fact", "new", day(6), None, None), ("pay", "policy", "p", None, None, None), ("pay.india", "policy", "in", None, None, None),
        ("visa", "answer", "yes", None, None, "us"), ("visa", "answer", "any", None, None, None), ("gone", "fact", "x", None, day(2), None), ("odd", "rumour", "r", None, None, None),
    ], "k string, kind string, value string, valid_from date, valid_until date, condition string")
    asked = spark.createDataFrame([(1, "pay", day(3), None), (2, "pay", day(9), None), (3, "pay.india", day(9), None), (4, "visa", day(9), "us"), (5, "visa", day(9), "uk"), (6, "gone", day(9), None), (7, "odd", day(9), None), (8, None, day(9), None)], "id int, k string, at date, condition string")
    got = {r["id"]: r["value"] for r in d.resolve_valid(asked, entries, key="k", at="at", precedence=["policy", "answer", "fact"]).collect()}
    assert got == {1: "p", 2: "p", 3: "in", 4: "yes", 5: "any", 6: None, 7: None, 8: None}
    assert {r["id"]: r["value"] for r in d.resolve_valid(asked, entries, key="k", at="at", precedence=["fact"]).collect()} == {1: "old", 2: "new", 3: "new", 4: None, 5: None, 6: None, 7: None, 8: None}


def test_first_probe_that_hits(spark):
    p = spark.createDataFrame([("c1", "x", 1, None), ("c1", "y", 2, "ok2"), ("c1", "y", 1, "ok1"), ("c1", "z", 1, "late"), ("c2", "x", 1, None)], "company string, probe string, candidate int, result string")
    assert [tuple(r) for r in d.first_hit(p, key="company", rank=["x", "y", "z"], hit=F.col("result").isNotNull()).collect()] == [("c1", "y", "ok1")]


def one(spark, **cols):
    names = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(x for _, x in cols.values())], names)


@pytest.mark.parametrize("amount, cur, period, label, number, want", [
    (5.0, "inr", "month", "Expected stipend (INR)", False, "5.0 INR"), (5.0, "INR", "month", "Stipend in $", False, None), (5.0, "CAD", "month", "Stipend in $", False, "5.0 CAD"),
    (5.0, "INR", "year", "x", False, None), (5.0, "INR", "month", "x", True, "5.0"), (None, "INR", "month", "x", False, None), (5.0, None, "month", "x", False, "5.0"), (5.0, "INR", None, "x", False, None),
])
def test_money_only_where_it_fits(spark, amount, cur, period, label, number, want):
    r = one(spark, a=("double", amount), c=("string", cur), p=("string", period), l=("string", label), n=("boolean", number))
    assert r.select(v.money_text(F.col("a"), F.col("c"), F.col("p"), wanted=F.lit("month"), label=F.col("l"), number=F.col("n")).alias("x")).first()["x"] == want


def test_values(spark):
    r = one(spark, a=("string", " "), b=("string", "2026-01-01"), c=("string", "Hybrid "), d=("string", "about 12 days"), e=("string", "YES"), n=("string", None), t=("string", "acme-."), o=("array<string>", ["India"]))
    col = F.col
    got = r.select(
        v.date_of(col("a"), col("b"), col("c")).alias("date"), v.enum_or_default(col("c"), ["hybrid"], "unknown").alias("e1"), v.enum_or_default(col("n"), ["hybrid"], "unknown").alias("e2"),
        v.widget_value(col("d"), F.lit("number")).alias("w1"), v.widget_value(col("e"), F.lit("checkbox")).alias("w2"), v.widget_value(col("c"), F.lit("radio")).alias("w3"), v.widget_value(col("e"), F.lit("number")).alias("w4"),
        v.labelled_lines(A=col("a"), B=col("b")).alias("lines"), v.board_token(F.lit("x"), col("t"), {"x": ["careers"]}).alias("t1"), v.board_token(F.lit("x"), F.lit("Careers"), {"x": ["careers"]}).alias("t2"), v.board_token(F.lit("y"), F.lit("Careers"), {"x": ["careers"]}).alias("t3"),
        v.digest(col("a"), col("n")).alias("d1"), v.digest(col("n"), col("a")).alias("d2"), v.remaining(F.lit(5), F.lit(3), F.lit(9)).alias("left"), v.remaining(F.lit(5), col("n").cast("int"), F.lit(1)).alias("left2"),
        v.completeness(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean")).alias("pct"), v.names_country(col("o"), F.lit(""), "India").alias("c1"), v.names_country(col("n").cast("array<string>") if False else F.array(), F.lit("USA; india"), "India").alias("c2"), v.names_country(F.array(), F.lit("Indiana"), "India").alias("c3"),
        v.page_challenge(F.lit(429), F.lit(""), F.lit("")).alias("p1"), v.page_challenge(F.lit(200), F.lit("Just a moment..."), F.lit("")).alias("p2"), v.page_challenge(F.lit(200), F.lit("Jobs"), F.lit("Access Denied")).alias("p3"), v.page_challenge(F.lit(200), F.lit("Jobs"), F.lit("fine")).alias("p4"),
    ).first().asDict()
    assert got["d1"] != got["d2"] and len(got["d1"]) == 40
    del got["d1"], got["d2"]
    assert got == {"date": "2026-01-01", "e1": "hybrid", "e2": "unknown", "w1": "12", "w2": "true", "w3": "Hybrid ", "w4": None, "lines": "B: 2026-01-01", "t1": "acme", "t2": None, "t3": "Careers", "left": 0, "left2": 4, "pct": 33,
                   "c1": True, "c2": True, "c3": False, "p1": "HTTP 429", "p2": "challenge page: just a moment...", "p3": "HTTP 200: access denied", "p4": None}


@pytest.mark.parametrize("location, title, want", [
    ("Bombay, Berlin", "x", ("Mumbai", "India", "onsite", ["Mumbai", "Berlin"])), ("", "SDE - Berlin", ("Berlin", "Germany", "onsite", ["Berlin"])), ("Smalltown", "SDE - Berlin", (None, None, "onsite", [])),
    ("Remote, India", "Hybrid role", (None, "India", "hybrid", [])), ("Berlin (remote)", None, ("Berlin", "Germany", "remote", ["Berlin"])), ("tbd", "SDE", (None, None, "unknown", [])), (None, None, (None, None, "unknown", [])), ("tbd", "on-site SDE", (None, None, "onsite", [])),
])
def test_location_struct(spark, location, title, want):
    c = identity.Cities([("Mumbai", "India", ["Bombay"]), ("Berlin", "Germany", [])])
    r = one(spark, l=("string", location), t=("string", title)).select(identity.location_struct(F.col("l"), F.col("t"), c).alias("s")).first()["s"]
    assert (r["city"], r["country"], r["work_mode"], r["cities"]) == want
