"""Explained answers, gates, probes, idempotent inserts and CVs."""

from pyspark.sql import functions as F

from postgrain.operators import answering as a

CV = """Asha Rao
asha@mail.example | https://code.example/asha

EXPERIENCE
Data Intern, Kite  Jan 2024 - Jun 2024
Pune
- built a pipeline
  that runs nightly
Education:
B.Tech, Zen College 2021 - 2025

Skills
Languages: Python, SQL; Go
Languages: SQL, Rust
Tools: Spark
"""


def test_explain_parks_what_is_sensitive(spark):
    e = spark.createDataFrame([("gender", "cache", "x", None, None, None), ("visa", "user", "no", None, None, None), ("city", "cache", "Pune", None, None, None), ("city", "user", "Goa", None, None, None)], "k string, kind string, value string, valid_from date, valid_until date, condition string")
    q = spark.createDataFrame([(1, "gender", None, None), (2, "visa.us", None, None), (3, "city", None, None), (4, "shoe", None, None), (5, None, None, None)], "id int, k string, at date, condition string")
    got = {r["id"]: (r["value"], r["kind"], r["sensitive"], r["status"]) for r in a.explain(q, e, key="k", at="at", precedence=["user", "cache"], sensitive=["gender", "visa"]).collect()}
    assert got == {1: (None, None, True, "parked"), 2: ("no", "user", True, "answered"), 3: ("Goa", "user", False, "answered"), 4: (None, None, False, "open"), 5: (None, None, False, "open")}


def test_map_gate_probes_and_inserts(spark):
    r = spark.createDataFrame([("a", " ", None, 3)], "x string, y string, z string, n int").select(a.answers_map(x=F.col("x"), y=F.col("y"), z=F.col("z"), n=F.col("n")).alias("m")).first()
    assert r["m"] == {"x": "a", "n": "3"}
    rows = spark.createDataFrame([(True,), (None,)], "ok boolean")
    assert tuple(a.gate(rows, F.col("ok")).first()) == (False, 1) and tuple(a.gate(rows.where("ok"), F.col("ok")).first()) == (True, 0) and tuple(a.gate(rows.where("false"), F.col("ok")).first()) == (False, 0)
    c = spark.createDataFrame([("k", True), ("z", None)], "name string, home boolean")
    got = [(r["name"], r["place"], r["probe"]) for r in a.probe_list(c, probes=["p", "q", "r"], home=F.col("home"), tail=1).orderBy("name", "place").collect()]
    assert got == [("k", 0, "p"), ("k", 1, "q"), ("z", 0, "p"), ("z", 1, "q"), ("z", 2, "r")]
    old = spark.createDataFrame([(1, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "y"), (2, "x")], "id int, v string")
    first = a.insert_all({"t": old}, {"t": new}, {"t": ["id"]})["t"]
    assert [tuple(r) for r in first.collect()] == [(2, "x")]
    assert a.insert_all({"t": old.unionByName(first)}, {"t": new}, {"t": ["id"]})["t"].count() == 0


def test_cv_as_one_record(spark):
    d = spark.createDataFrame([(1, CV), (2, "Only a name"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r for r in a.cv_records(d, key="id", text="t", headings={"experience": "work", "education": "school", "skills": "skills"}).collect()}
    r = got[1]
    assert (r["name"], r["email"], r["links"]) == ("Asha Rao", "asha@mail.example", ["https://code.example/asha"])
    assert [(x["section"], x["e"]["title"], x["e"]["start"], x["e"]["end"]) for x in r["entries"]] == [("school", "B.Tech, Zen College", "2021", "2025"), ("work", "Data Intern, Kite", "Jan 2024", "Jun 2024")]
    assert r["entries"][1]["e"]["bullets"] == ["built a pipeline that runs nightly"] and r["entries"][1]["e"]["detail"] == "Pune"
    assert r["skills"]["Tools"] == ["Spark"] and sorted(r["skills"]["Languages"]) == ["Go", "Python", "Rust", "SQL"]
    assert got[2]["name"] == "Only a name" and got[2]["entries"] is None and set(got) == {1, 2, 4}
