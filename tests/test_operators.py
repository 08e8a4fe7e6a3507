import random

import pytest
from pyspark.sql import functions as F

from postgrain.functions import html, text as tx
from postgrain.functions.context import duration_months, years_of_experience
from postgrain.operators import cluster, merge, rules, vectors
from postgrain.sources import payloads
from postgrain.streaming import ingest


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, key, brand", [
    ("Razorpay Software Pvt Ltd", "razorpay", "razorpay"), ("Zeta Labs", "zetalabs", "zeta"), ("Zeta Labs Pvt. Ltd.", "zeta", "zeta"),
    ("Technologies Ltd", "technologies", "technologies"), (None, "", ""), ("", "", ""),
])
def test_company_keys(spark, name, key, brand):
    assert (one(spark, tx.company_key(F.col("a")), a=name), one(spark, tx.brand_key(F.col("a")), a=name)) == (key, brand)


def test_title_key_ignores_order(spark):
    keys = {one(spark, tx.title_key(F.col("a")), a=a) for a in ["Software Engineer, Intern", "Intern - Software Engineer", "Software Engineer Internship (Remote, Paid)"]}
    assert keys == {"engineer-intern-software"}


@pytest.mark.parametrize("loc, title, mode", [("Pune", "Dev", "onsite"), ("Remote - India", "", "remote"), ("Pune (Hybrid)", "Remote Dev", "hybrid"), ("", "Dev", "unknown"), ("TBD", None, "unknown"), (None, "WFH dev", "remote")])
def test_work_mode(spark, loc, title, mode):
    assert one(spark, tx.work_mode(F.col("a"), F.col("b")), a=loc, b=title) == mode


def test_domain_and_names(spark):
    d = tx.domain_of(F.col("a"), "lever\\.co")
    assert [one(spark, d, a=x) for x in ["https://www.Acme.com/x", "acme.com", "jobs.lever.co/acme", "nothing", None]] == ["acme.com", "acme.com", None, None, None]
    assert one(spark, tx.slug_name(F.col("a")), a="https://x.y/z/acme-robotics_lab/?q=1") == "Acme Robotics Lab"
    assert one(spark, tx.clean_label(F.col("a")), a=" <b>Your  name</b> * ") == "Your name"


def test_match_option(spark):
    df = spark.createDataFrame([("yes", ["Yes", "No"]), ("No, I don't", ["Yes", "No"]), ("a", ["ab", "ac"]), ("Yes", None), (None, ["Yes"])], "v string, o array<string>")
    assert [r[0] for r in df.select(tx.match_option(F.col("v"), F.col("o"))).collect()] == ["Yes", "No", None, None, None]


def test_first_match_takes_the_first_rule(spark):
    c = rules.first_match(F.col("a"), [("x", "ab"), ("y", "b")], "z")
    assert [one(spark, c, a=a) for a in ["ab", "b", "q"]] == ["x", "y", "z"]


@pytest.mark.parametrize("text, years, months", [
    ("3-5 years of experience; 2+ years experience", 2.0, None), ("founded 12 years ago", None, None), ("Experience needed: 4 yrs", 4.0, None), ("Duration: 3-6 Months", None, 3),
    ("a 9-month internship", None, 9), ("every 14 months the period ends", None, None), ("for 24 months, or an internship of 6 months", None, 6), ("2 months ago we moved house and it was a very long tale", None, None),
    ("1 year experience" + " x" * 50_000, 1.0, None), ("", None, None), (None, None, None),
])
def test_context_numbers(spark, text, years, months):
    r = spark.createDataFrame([(text,)], "t string").select(years_of_experience(F.col("t")).alias("y"), duration_months(F.col("t")).alias("m")).first()
    assert (r["y"], r["m"]) == (years, months)


def test_html():
    assert html.text_of_html("<p>a<br>b &amp; c</p><ul><li> d") == "a\nb & c\nd"
    assert html.text_of_html(None) == "" and html.links_of_html('<a href="/x"> the <b>x</b></a>') == [("/x", "the x")]


def test_fold_fills_only_and_keeps_null_keys_out(spark):
    rows = spark.createDataFrame([("k", 2, "late", None, 5, ["b"]), ("k", 1, "unknown", "c", 7, ["a"]), ("k", 3, "later", "d", 1, None), (None, 1, "x", "x", 1, [])], "key string, seq int, a string, b string, n int, t array<string>")
    r = merge.fold(rows, key=["key"], order="seq", policies={"a": "first", "b": "last", "n": "max", "t": "union"}).collect()
    assert [tuple(x) for x in r] == [("k", "late", "d", 7, ["a", "b"])]


def test_upsert_equals_one_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.choice([None, "", "u", "v"]), rng.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq bigint, a string, n int")
    pol = {"a": "first", "n": "max"}
    whole = merge.fold(df, key=["key"], order="seq", policies=pol)
    snap = merge.fold(df.where("seq < 30"), key=["key"], order="seq", policies=pol)
    assert sorted(merge.upsert(snap, df.where("seq >= 30"), key=["key"], order="seq", policies=pol).collect()) == sorted(whole.collect())


def test_insert_absent_and_transitions(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in merge.insert_absent(old, new, key=["k"]).collect()] == [("b", 2)]
    e = spark.createDataFrame([(1, 1, "new"), (1, 2, "sent"), (1, 3, "new")], "id int, seq int, st string")
    ok = spark.createDataFrame([("new", "sent")], "`from` string, `to` string")
    assert [r["legal"] for r in merge.transitions(e, ok, key="id", order="seq", state="st").orderBy("seq").collect()] == [True, False]


def test_leaders_match_brute_force():
    rng = random.Random(3)
    words = "name full legal email phone pay expected".split()
    groups = [(x, rng.randint(1, 5), k) for k, x in enumerate(sorted({" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(120)}))]

    def brute(t):
        heads, out = [], {}
        for label, _, _ in sorted(groups, key=lambda g: (-g[1], g[2])):
            s = set(label.split())
            h = next((h for h in heads if len(s & set(h.split())) >= t * len(s | set(h.split())) - 1e-9), None)
            if h is None:
                heads.append(label)
            out[label] = h or label
        return out

    for t in (0.5, 0.8):
        assert cluster.leaders(groups, t) == brute(t)


def test_nearest_handles_nulls_and_ties(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, None), (5, [0.0, 0.0])], "k bigint, v array<double>")
    r = vectors.nearest(e, e.where("k = 3"), key="k", vector="v", k=1).collect()
    assert [(x["query"], x["key"]) for x in r] == [(3, 1)]


def test_payload_helpers(spark, tmp_path):
    xml = tmp_path / "a.xml"
    xml.write_text("<jobs><position><id>1</id><name>Dev</name></position><position><id>2</id></position></jobs>")
    assert [tuple(r) for r in payloads.read_xml(spark, str(xml), "position", "id bigint, name string").orderBy("id").collect()] == [(1, "Dev"), (2, None)]
    (tmp_path / "p.html").write_text('<html><script id="D" type="x">{"a":1}</script><div data-page="{&quot;b&quot;:2}">t</div>')
    page = spark.read.text(str(tmp_path / "p.html"), wholetext=True)
    r = page.select(payloads.embedded_json(F.col("value"), "D").alias("a"), payloads.data_attribute(F.col("value"), "data-page").alias("b")).first()
    assert tuple(r) == ('{"a":1}', '{"b":2}')
    d = spark.createDataFrame([(1, "x", "old"), (2, "y", "old")], "id int, t string, d string")
    over = payloads.overlay(d, spark.createDataFrame([(1, "new"), (2, "")], "id int, d string"), "id", ["d"])
    assert sorted(r["d"] for r in over.collect()) == ["new", "old"]
    pairs = spark.createDataFrame([([("a", "1"), ("a", "2"), (None, "3")],)], "p array<struct<type:string,label:string>>")
    assert pairs.select(payloads.labels_to_map(F.col("p")).alias("m")).first()["m"] == {"a": "2"}
    k = payloads.keep_first(spark.createDataFrame([("a", 2, "q"), ("a", 1, "p"), (None, 1, "r")], "k string, o int, v string"), "k", "o")
    assert [tuple(r) for r in k.collect()] == [("a", 1, "p")]


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 20).selectExpr("cast(id % 7 as string) as k", "1L as n", "id as last").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, n bigint, last bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.fold_stream(s, key=["k"], order="last", policies={"n": "sum", "last": "max"}, target=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("n"), F.max("last"))
    assert sorted(map(tuple, ingest.latest(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_stream_rewrites_only_touched_buckets_and_deletes_old_files(spark, tmp_path):
    import os

    out = str(tmp_path / "out")
    for i in range(4):
        spark.range(100 if i == 0 else 2).selectExpr("cast(id as string) as k", "1L as n", f"id + {i * 1000} as last").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, n bigint, last bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.fold_stream(s, key=["k"], order="last", policies={"n": "sum", "last": "max"}, target=out, checkpoint=str(tmp_path / "ck"), buckets=8)
    got = {r["k"]: r["n"] for r in ingest.latest(spark, out).collect()}
    assert len(got) == 100 and got["0"] == got["1"] == 4 and got["50"] == 1
    sizes = sorted(len([b for b in os.listdir(f"{out}/{v}") if b.startswith("__")]) for v in os.listdir(out) if v.startswith("v"))
    assert sizes[-1] <= 8 and all(n <= 2 for n in sizes[:-1]) and sorted(m for m in os.listdir(out) if m.startswith("m")) == ["m2", "m3"]


def test_stream_commits_by_count_and_writes_a_key_once(spark, tmp_path):
    for rows in ([("a", "new"), ("b", "new")], [("b", "seen"), ("c", "new")], [(None, "bad"), ("c", "seen")]):
        spark.createDataFrame(rows, "k string, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.landing(spark, str(tmp_path / "in"), files=1)
    ingest.commit_stream(s, key="k", outcome="outcome", target=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = sorted(r["k"] or "" for r in spark.read.parquet(str(tmp_path / "out" / "rows" / "*")).collect())
    counts = spark.read.parquet(str(tmp_path / "out" / "counts" / "*")).groupBy("outcome").agg(F.sum("n").alias("n")).collect()
    assert [k for k in got if k] == ["a", "b", "c"] and {r["outcome"]: r["n"] for r in counts} == {"new": 3, "seen": 2, "bad": 1}
    slow = ingest.commit_stream(s, key="k", outcome="outcome", target=str(tmp_path / "out2"), checkpoint=str(tmp_path / "ck2"), seconds=1)
    slow.processAllAvailable()
    slow.stop()
    assert spark.read.parquet(str(tmp_path / "out2" / "rows" / "*")).where("k is not null").count() == 3


def test_stream_drops_rows_later_than_the_watermark(spark, tmp_path):
    hours = [[0, 0, 1], [5], [6], [0, 5, 6]]  # the last file's row of hour 0 comes when hour 0 is closed
    for i, hs in enumerate(hours):
        rows = ", ".join(f"('t', timestamp_seconds({3600 * h + 60}))" for h in hs)
        spark.sql(f"select * from values {rows} as x(event_type, at)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_type string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.close_hours(s, target=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    got = {(r["hour_us"] // 3_600_000_000, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, 1) in got and {n for h, n in got if h == 0} <= {2} and all(h < 6 for h, _ in got)


def test_running_values_over_segments(spark):
    from postgrain.operators import running

    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    prev = {r["o"]: (r["p"], r["p_first"]) for r in running.with_previous(df, key=["k"], order="o", value="v", out="p", segment=7).collect()}
    total = {r["o"]: r["s"] for r in running.running_sum(df, key=["k"], order="o", value="v", out="s", segment=7).collect()}
    last, sums = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        assert prev[o] == (last.get(k), k not in last) and total[o] == sums[k]
        last[k] = v


def test_robots_longest_rule_and_own_group(spark):
    from postgrain.functions import robots

    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: x\nUser-agent: y\nDisallow: /*.pdf$ # no papers\nDisallow:\n"
    rows = [("h", r["agent"], r["allow"], r["path"]) for r in robots.parse(text)]
    assert len(rows) == 4 and robots.parse(None) == []
    rules_ = spark.createDataFrame(rows, "host string, agent string, allow boolean, path string")
    pages = spark.createDataFrame([(1, "h", "/a/c"), (2, "h", "/a/b/c"), (3, "h", "/z.pdf"), (4, "other", "/a")], "id int, host string, path string")

    def got(agent):
        return {r["key"]: r["allowed"] for r in robots.allowed(pages, rules_, key="id", host="host", path="path", agent=agent).collect()}

    assert got("bot") == {1: False, 2: True, 3: True, 4: True} and got("xbot") == {1: True, 2: True, 3: False, 4: True}


def test_grounding(spark):
    from postgrain.functions import grounding

    df = spark.createDataFrame([("Led 5 people at Acme in 2024", "acme had 5 people", ["secret", "ab", "LED 5"])], "d string, c string, f array<string>")
    r = df.select(grounding.unsupported_numbers(F.col("d"), F.col("c")).alias("n"), grounding.unsupported_names(F.col("d"), F.col("c")).alias("w"), grounding.leaked_values(F.col("d"), F.col("f")).alias("l")).first()
    assert (r["n"], r["w"], r["l"]) == (["2024"], ["Led"], ["LED 5"])


def test_sections_tables_and_lists(spark):
    from postgrain.sources import textfiles as tf

    doc = "Skills:\nLanguages: Go, Rust; C\n| a | b |\n|---|---|\nSTOP\n| c | d |"
    ls = tf.lines(spark.createDataFrame([(1, doc), (2, None)], "id int, t string"), "id", "t")
    s = tf.sections(ls, "id", F.regexp_extract("line", "^(Skills):$", 1)).count()
    assert s == 0  # '' is a heading too; null isn't
    s = tf.sections(ls, "id", F.when(F.col("line") == "Skills:", "skills"))
    assert {r["section"] for r in s.collect()} == {"skills"} and s.count() == 5
    rows = tf.flag_after(ls, "id", F.col("line") == "STOP").withColumn("cells", tf.table_row(F.col("line"))).where("cells is not null").orderBy("line_no").collect()
    assert [(r["cells"], r["after"]) for r in rows] == [(["a", "b"], False), (["c", "d"], True)]
    kv = ls.where("line_no = 1").select(tf.key_values(F.col("line")).alias("k")).first()["k"]
    assert (kv["name"], kv["values"]) == ("Languages", ["Go", "Rust", "C"])


def test_html_forms_and_linked_data(spark):
    from postgrain.sources import textfiles as tf

    page = '<form><label>Full <b>name</b></label><input name=a required><input type=hidden><label>Pick</label><select><option value=x>X<option value=y></select></form><script type="application/ld+json">{"a":[{"@type":"Organization","name":"Q"}]}</script><script type="application/ld+json">{broken</script>'
    assert tf.form_fields(page) == [{"label": "Full name", "type": "text", "required": True, "options": []}, {"label": "Pick", "type": "select", "required": False, "options": ["x", "y"]}]
    assert tf.linked_data(page, "Organization") == ['{"@type": "Organization", "name": "Q"}'] and tf.linked_data(None, "X") == []
    df = spark.createDataFrame([(page,), (None,)], "h string")
    r = df.select(F.size(tf.html_form_fields(F.col("h"))).alias("n"), F.size(tf.html_linked_data(F.col("h"), "Organization")).alias("m")).collect()
    assert [tuple(x) for x in r] == [(2, 1), (0, 0)]


def test_landed_files_give_errors_as_rows(spark, tmp_path):
    from postgrain.sources.textfiles import LandedFiles

    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_bytes(b"\xff\xfe\xff")
    spark.dataSource.register(LandedFiles)
    r = {x["path"][-6:]: (x["payload"], x["error"]) for x in spark.read.format("landed").load(str(tmp_path / "*.json")).collect()}
    assert r == {"a.json": ('{"x": 1}', None), "b.json": (None, "UnicodeDecodeError")}


def test_snapshots_show_only_whole_versions(spark, tmp_path):
    from postgrain.sources import snapshots

    t = str(tmp_path / "s")
    assert snapshots.publish(spark.range(2), t) == 0 and snapshots.publish(spark.range(3), t) == 1
    (tmp_path / "s" / "v2").mkdir()
    assert snapshots.current(spark, t).count() == 3 and snapshots.publish(spark.range(5), t, version=1) == 1 and snapshots.current(spark, t).count() == 5


def test_places_longest_alias_first(spark):
    from postgrain.functions import places

    al = {"navi mumbai": "Navi Mumbai", "mumbai": "Mumbai", "delhi": "Delhi", "new delhi": "Delhi"}
    assert one(spark, places.places_in(F.col("a"), al), a="New  Delhi / Navi Mumbai, mumbai; Delhiwala") == ["Delhi", "Navi Mumbai", "Mumbai"]
    assert one(spark, places.places_in(F.col("a"), al), a=None) == []
    assert one(spark, places.without_places(F.col("a"), al), a="SDE - Mumbai") == "SDE -  "
    assert one(spark, places.slug_candidates(F.col("a")), a="Acme Robotics!") == ["acmerobotics", "acme-robotics"]
    refs = places.refs_in(F.col("a"), {"lever": "lever\\.co/([a-z]+)", "gh": "greenhouse\\.io/([a-zA-Z]+)"})
    assert [(r["kind"], r["token"]) for r in one(spark, refs, a="greenhouse.io/Acme lever.co/acme greenhouse.io/acme")] == [("gh", "Acme"), ("lever", "acme")]
