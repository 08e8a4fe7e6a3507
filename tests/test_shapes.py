"""Payload shapes and HTML cards against records written by hand."""

import pytest
from pyspark.sql import functions as F

from postgrain.functions import cards
from postgrain.plans.feeds import PAGES
from postgrain.sources import shapes


@pytest.fixture(scope="module")
def rows(spark):
    return {(r["shape"], r["source_id"], r["title"]): r for r in shapes.records(shapes.scan(spark, PAGES)).collect()}


WANT = [  # shape, id, title, location, mode, kind, pay
    ("greenhouse", "101", "Data Intern", "Aldersea", "unknown", None, None), ("lever", "a-1", "SRE Intern", "Berlin", "onsite", "Intern", None), ("lever", "a-2", "PM", "Pune, Delhi", "unknown", None, None),
    ("ashby", "x1", "ML Intern", "Pune / Delhi", "remote", None, "$20/hour"), ("workable", "W1", "QA Intern", "Rome, Italy", "hybrid", "Internship", None), ("smartrecruiters", "77", "Analyst Intern", "Lyon, fr", "remote", "Intern", None),
    ("recruitee", "9", "Copy Intern", "Ghent", "hybrid", "internship", "EUR 500 /month"), ("keka", "5", "HR Intern", "Pune / Goa", "unknown", None, "INR 10,000 - 15,000 /month"), ("zoho_recruit", "3", "Ops Intern", "Kochi, India", "remote", "Intern", None),
    ("mynexthire", "12", "Graduate", "Park Road", "unknown", "Fresher", "INR 300,000"), ("workday", "R-9", "Chip Intern", "Pune", "unknown", None, None), ("breezy", "b1", "Sales Intern", "Oslo", "remote", "Other", None),
    ("darwinbox", "d1", "GIS Intern", "Pune / Goa", "unknown", "Intern", "INR 1,000 - 2,000 /month"), ("unstop", "1", "Web Intern", "Pune, Goa", "onsite", "Internship", "INR 8,000 /month"), ("unstop", "2", "Volunteer", "Remote", "remote", "jobs", "Unpaid"),
    ("instahyre", "8", "NLP Intern", "Work From Home", "remote", None, None), ("himalayas", "https://h.example/1", "Support", "Remote - India, Nepal", "remote", None, "USD 10 - 20 /hour"), ("himalayas", "https://h.example/2", "Anywhere", "Remote (Worldwide)", "remote", None, None),
    ("adzuna", "z1", "Clerk", "Pune", "unknown", "full_time permanent", None), ("adzuna", "z2", "Teller", None, "unknown", None, "INR 120,000 /year"), ("naukri", "n1", "Law Intern", "Delhi", "unknown", None, "INR 10,000 /month"), ("naukri", "n2", "Clerk", None, "unknown", None, None),
    ("wellfound", "w1", "Dev", "Remote - India", "remote", "Internship", None), ("wellfound", "w2", "Dev 2", "Pune, Goa", "hybrid", None, None), ("yc_waas", "31", "Founding Intern", "Remote", "unknown", "Internship", "$5k"),
    ("remoteok", "q1", "Writer", None, "unknown", None, None), ("remotive", "55", "Editor", "Europe", "unknown", None, None), ("arbeitnow", "s-1", "Werkstudent", "Bonn", "unknown", None, None),
]


@pytest.mark.parametrize("want", WANT, ids=lambda w: f"{w[0]}-{w[1]}")
def test_records(rows, want):
    r = rows[want[:3]]
    assert (r["location"], r["mode"], r["kind"], r["pay"]) == want[3:]


def test_texts_and_addresses(rows):
    assert rows["greenhouse", "101", "Data Intern"]["html"] == "<p>Build &amp; test</p>"
    assert rows["smartrecruiters", "77", "Analyst Intern"]["html"] == "What\nwork\nWho\nyou"
    assert rows["darwinbox", "d1", "GIS Intern"]["html"] is None
    assert rows["workday", "R-9", "Chip Intern"]["url"] == "https://acme.wd3.myworkdayjobs.com/Careers/job/Pune/Chip-Intern_R-9"
    assert rows["wellfound", "w1", "Dev"]["text"] == "Experience: 0+ years\nDo." and rows["lever", "a-1", "SRE Intern"]["apply_url"].endswith("/apply")
    assert not any(t in ("Hidden", "Old", "Nobody", "No id") for _, _, t in rows) and len(rows) == 30


def test_first_of_a_scan_and_odd_pages(spark):
    r = shapes.records(shapes.scan(spark, PAGES), ["unstop"])
    assert sorted(x["title"] for x in shapes.first_records(r.withColumn("o", F.length("title")), "o").collect()) == ["Volunteer", "Web Intern"]
    odd = spark.createDataFrame([("lever", "b", "c", p) for p in (None, "", "[]", "{}", "[null, 3, {}]", '[{"text": {"a": 1}}]')], "shape string, board string, company string, payload string")
    got = shapes.records(odd, ["lever"]).collect()
    assert all(x["source_id"] is None for x in got) and len(got) <= 1
    assert {x["error"] for x in shapes.page_errors(odd).collect()} == {"no JSON", "no list of postings"}
    none = spark.createDataFrame([(None, "t"), (None, "t")], "source_id string, title string").withColumn("shape", F.lit("x"))
    assert shapes.first_records(none, "title").count() == 2


def test_registry_of_sources():
    registered = {"lever": {"tier": 1}, "adzuna": {"tier": 2}, "remotive": {"on": False}}
    assert shapes.active_sources(registered) == ["lever", "adzuna"] and shapes.active_sources(registered, tier=2) == ["adzuna"] and shapes.active_sources(registered, off={"lever"}) == ["adzuna"]
    with pytest.raises(ValueError):
        shapes.active_sources({"nowhere": {}})


PAGE = """<h1> 1,204 openings</h1><div class="x individual_internship" internshipid="7" data-href="/d/7"><h3 class="job-internship-name">Web <b>Intern</b></h3><p class="company-name">Zen</p>
<span class="locations">Pune</span><img src=x><span class="stipend">10,000 /month</span><div class="text">Build &amp; test</div><span class="job_skill">sql</span><span class="job_skill">js</span></div>
<div class="individual_internship" internshipid="8"><p class="company-name">No title</p></div>"""
LIST = '<ul><li><h3 class="base-search-card__title"> SRE </h3><h4 class="base-search-card__subtitle">Kite</h4><a class="base-card__full-link" href="https://l.example/view/55/?trk=1">x</a></li><li><h3 class="base-search-card__title">No link</h3></li></ul>'


def test_listing_cards(spark):
    page = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")
    got = cards.listing_records(page, "internshala", base="https://i.example").collect()
    assert [(r["source_id"], r["title"], r["company"], r["url"], r["location"], r["pay"], r["text"], r["tags"]) for r in got] == [("7", "Web Intern", "Zen", "https://i.example/d/7", "Pune", "10,000 /month", "Build & test", ["sql", "js"])]
    assert [r["n"] for r in page.select(cards.listing_total(F.col("html")).alias("n")).collect()] == [1204, None, None]
    got = cards.listing_records(spark.createDataFrame([(LIST,)], "html string"), "linkedin").collect()
    assert [(r["source_id"], r["title"], r["company"], r["url"]) for r in got] == [("55", "SRE", "Kite", "https://l.example/view/55/")]


def test_page_facts_and_tags(spark):
    long = "This paragraph is surely longer than forty characters, is it not?"
    html = f'<title>Acme &amp; Co</title><meta name="description" content="We &quot;do&quot;"><p>short</p><p>{long}</p><p>{long}</p><name> A &lt; B </name>'
    r = spark.createDataFrame([(html,), (None,)], "h string").select(cards.page_facts(F.col("h")).alias("f"), cards.first_tag_text(F.col("h"), "name").alias("n")).collect()
    assert (r[0]["f"]["title"], r[0]["f"]["description"], r[0]["f"]["paragraphs"], r[0]["n"]) == ("Acme & Co", 'We "do"', [long], "A < B")
    assert r[1]["f"]["title"] is None and r[1]["n"] is None
