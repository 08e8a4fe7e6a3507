from pyspark.sql import functions as F

from postgrain.functions import answers
from postgrain.sources import records


def test_entries_over_lines():
    lines = ["Data Intern, Acme  Jan 2024 - Present", "Pune", "- built a thing", "  that works", "• second", "stray 2019", "", "Dev (2020 – 2021)"]
    got = records.entries(lines)
    assert [(e["title"], e["start"], e["end"], e["detail"]) for e in got] == [("Data Intern, Acme", "Jan 2024", "Present", "Pune"), ("Dev", "2020", "2021", "")]
    assert got[0]["bullets"] == ["built a thing that works", "second stray 2019"]
    assert records.entries([]) == [] and records.entries(["no date"]) == []


def test_tree_and_script_strings(spark):
    tree = '{"rows":[{"type":"field","id":1,"parts":[{"type":"field","id":2}]},{"hidden":true,"x":{"type":"field","id":3}}]}'
    assert records.visible_nodes(tree) == ['{"id": 1, "type": "field"}', '{"id": 2, "type": "field"}']
    assert records.visible_nodes("{broken") == [] and records.visible_nodes(None) == []
    assert records.script_string("a\\x41\\u0042\\n\\'\\\\") == "aAB\n'\\" and records.script_string(None) is None
    df = spark.createDataFrame([(tree, ["A 2019 - 2020"], "\\x41"), (None, None, None)], "c string, l array<string>, s string")
    r = df.select(F.size(records.tree_fields(F.col("c"))).alias("n"), F.size(records.dated_entries(F.col("l"))).alias("e"), records.script_unescape(F.col("s")).alias("s")).collect()
    assert [tuple(x) for x in r] == [(2, 1, "A"), (0, 0, None)]


def test_answers_by_type(spark):
    rows = [
        ("yes, I do", "boolean", ["Yes", "No"], "Yes"), ("nein", "boolean", None, "No"), ("maybe", "boolean", ["Yes", "No"], None),
        ("about 3.5 years", "number", None, "3.5"), ("go, Rust, perl", "multi_select", ["Go", "Rust", "C"], "Go, Rust"), ("none", "multi_select", ["Go"], None),
        ("remote", "select", ["Remote", "Onsite"], "Remote"), ("true", "select", ["Yes", "No"], "Yes"), ("  free ", "text", None, "free"), (None, "text", None, None), ("", "select", ["a", "b"], None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v string, t string, o array<string>, want string")
    bad = df.withColumn("got", answers.adapt(F.col("v"), F.col("t"), F.col("o"))).where("not (got <=> want)").collect()
    assert not bad
