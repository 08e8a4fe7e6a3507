"""Directories, links and sitemaps on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from postgrain.sources import directories as d

PAGE = """<a href="/about">About</a><a href="https://www.kite.example/?r=1#x">Kite</a><a href="https://kite.example/jobs"><img alt="Kite logo"></a><a href="https://zen.example" title="Zen Ltd">https://zen.example</a>
<a href="https://twitter.com/x">Follow</a><a href="https://jobs.list.example/y">own sub</a><a href="//peak.example/a"></a><a href="mailto:x@y.z">Mail</a><a>no address</a><a href="/company/a">A</a><a href="/company/a"></a><a href="/company/b">B</a>"""


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([("https://list.example/top", PAGE), ("https://none.example/", None)], "url string, html string")
    return d.links(pages, excluded=["twitter.com"]).cache()


def test_links_and_entries(found):
    assert {r["domain"] for r in found.where("outbound").collect()} == {"kite.example", "zen.example", "peak.example"}
    out = {(r["name"], r["website"]) for r in d.outbound_entries(found).collect()}
    assert out == {("Kite", "https://www.kite.example/?r=1"), ("Zen Ltd", "https://zen.example"), ("", "https://peak.example/a")}
    inside = {(r["name"], r["website"]) for r in d.internal_entries(found, "/company/").collect()}
    assert inside == {("A", "https://list.example/company/a"), ("B", "https://list.example/company/b")}
    best = d.best_entries(("inside", d.internal_entries(found, "/company/")), ("out", d.outbound_entries(found))).collect()
    assert {r["way"] for r in best} == {"out"} and len(best) == 3
    assert [r["website"] for r in d.website_of_detail(found).collect()] == ["https://www.kite.example/?r=1"]


def test_first_way_that_finds_enough_holds(spark):
    few = spark.createDataFrame([("u", str(i), str(i), i) for i in range(8)], "url string, name string, website string, place int")
    many = spark.createDataFrame([("u", str(i), str(i), i) for i in range(30)], few.schema)
    assert {r["way"] for r in d.best_entries(("a", few), ("b", many)).collect()} == {"a"}
    assert {r["way"] for r in d.best_entries(("a", few.where("place < 7")), ("b", many.where("place < 5"))).collect()} == {"a"}


def test_directory_sitemap_and_resume(spark):
    entries = [{"n": "Kite", "w": "https://kite.example", "regions": ["India", "Asia"], "all": "", "s": "Active"}, {"n": "Zen", "w": "", "regions": [], "all": "Pune, India", "s": "Public"}, {"n": "Peak", "regions": ["Canada"], "s": "Active"}, {"n": "Dead", "regions": ["India"], "s": "Inactive"}, {"n": " ", "regions": ["India"], "s": "Active"}]
    p = spark.createDataFrame([(json.dumps(entries),), ("no json",), (None,)], "payload string")
    got = d.directory_seeds(p, rows="$", name="$.n", website="$.w", regions="$.regions", places="$.all", status="$.s", country="India", statuses=["Active", "Public"]).collect()
    assert sorted((r["name"], r["website"]) for r in got) == [("Kite", "https://kite.example"), ("Zen", None)]
    x = spark.createDataFrame([("<urlset><url><loc> https://a.example/company/1 </loc></url><url><loc><![CDATA[https://a.example/company/2]]></loc></url><url><loc>https://a.example/blog</loc></url></urlset>",), (None,)], "xml string")
    a = d.sitemap_addresses(x, match="/company/")
    assert sorted(r["address"] for r in a.collect()) == ["https://a.example/company/1", "https://a.example/company/2"]
    assert [r["address"] for r in d.still_to_do(a, a.where("address like '%1'"), key="address", at_once=5).collect()] == ["https://a.example/company/2"]


def test_vector_cache_and_report(spark):
    t = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    none = spark.createDataFrame([], "digest string")
    first = d.new_texts(t, none, text="t", model="m1")
    assert sorted(r["text"] for r in first.collect()) == ["a", "b"] and d.new_texts(t, first, text="t", model="m1").count() == 0 and d.new_texts(t, first, text="t", model="m2").count() == 2
    rows = spark.createDataFrame([(1, "x|y", 0.5), (2, None, 0.1)], "place int, k string, v double")
    assert [r["text"] for r in d.table_lines(rows, {"key": "k", "volume": "v"}).orderBy("line").collect()] == ["| key | volume |", "|---|---|", "| x/y | 0.5 |", "|  | 0.1 |"]
