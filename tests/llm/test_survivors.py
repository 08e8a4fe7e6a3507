from datetime import datetime, timedelta

import pytest

from postgrain.llm.survivors import best_of_groups, surviving_records

SCHEMA = "capture_id bigint, posting_key string, source string, fetched_at timestamp, description_text string, application_url string, apply_channel string, grp string, tier int"
REG = [("a", 1), ("b", 2), ("c", 3)]
WHOLE = " ".join(f"word{i}" for i in range(60)) + "."
CUT = " ".join(f"word{i}" for i in range(31)) + "."
DAY = datetime(2026, 1, 1)


def row(i, key="k", source="a", day=0, text=None, url=None, channel=None):
    return (i, key, source, None if day is None else DAY + timedelta(days=day), text, url, channel, "clash", 9)


def best(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    reg = spark.createDataFrame(REG, "source string, tier int")
    b = best_of_groups(df, reg)
    return df, b, {r["grp"]: r for r in b.collect()}


def test_each_field_by_its_own_rule(spark):
    rows = [
        row(1, source="c", day=9, text=WHOLE, url="https://x.example/jobs/1", channel="c"),
        row(2, source="a", day=1, text=CUT, url="https://x.example/", channel="N/A"),  # cut beside the whole; start page
        row(3, source="b", day=3, text=WHOLE + " ... Read more", url="mailto:jobs@x.example", channel="mail"),
        row(4, source="b", day=2, text="Dev at X, Pune.", url="https://x.example/login?next=1", channel="board"),
    ]
    r = best(spark, rows)[2]["k"]
    assert (r["description_rec"], r["url_rec"], r["channel_rec"], r["n_records"]) == (1, 3, 3, 4)


def test_ties_take_the_smallest_id_and_repeated_rows_count(spark):
    rows = [row(7, day=1, text=WHOLE, url="https://x.example/j/7", channel="q"), row(5, day=1, text=WHOLE, url="https://x.example/j/5", channel="q")] * 2
    r = best(spark, rows)[2]["k"]
    assert (r["description_rec"], r["url_rec"], r["channel_rec"], r["n_records"]) == (5, 5, 5, 4)


@pytest.mark.parametrize("text", [None, "", " ", "\n", "TBD", "null", "We use cookies. Accept all.", WHOLE[:-1] + " and the", "Engineer at X, Pune."])
def test_texts_that_are_not_whole(spark, text):
    assert best(spark, [row(1, text=text)])[2]["k"]["description_rec"] is None


@pytest.mark.parametrize("url, ok", [
    ("https://a.example/x/1/application", True), ("http://a.example/internship/3?ref=list", True), ("mailto:a@b.example", True),
    ("#", False), ("", False), (None, False), ("about:blank", False), ("javascript:void(0)", False), ("/jobs/1", False), ("apply", False), ("https://", False),
    ("https://a.example", False), ("https://a.example/", False), ("https://a.example/404", False), ("https://a.example/login?next=%2Fj", False), ("Link in bio", False),
])
def test_addresses(spark, url, ok):
    assert (best(spark, [row(1, url=url)])[2]["k"]["url_rec"] == 1) is ok


def test_null_keys_times_sources_and_empty_tables(spark):
    got = best(spark, [row(1, key=None, text=WHOLE), row(2, source=None, day=None, text=WHOLE, url="https://a.example/j"), row(3, source="zz", day=1, text=WHOLE)])[2]
    assert set(got) == {"k"} and got["k"]["description_rec"] == 3 and got["k"]["url_rec"] == 2
    assert best(spark, [])[2] == {}


def test_records_are_built_from_the_survivors(spark):
    df, b, _ = best(spark, [row(1, day=2, text=WHOLE, channel=" x "), row(2, day=1, url="https://a.example/j/2")])
    r = surviving_records(df, b).first()
    assert (r["description_text"], r["application_url"], r["apply_channel"], r["n_records"]) == (WHOLE, "https://a.example/j/2", "x", 2)


def test_large_group_matches_brute_force(spark):
    import random

    rng = random.Random(2)
    urls = ["https://x.example/j/%d", "#", None]
    rows = [row(i, key=rng.choice(["hot", "hot", "hot", "k%d" % (i % 5)]), source=rng.choice("abc"), day=rng.randint(0, 50), text=rng.choice([WHOLE, CUT, None, "TBD"]), url=(u := rng.choice(urls)) and u.replace("%d", str(i)), channel=rng.choice(["p", "-", None])) for i in range(2000)]
    tier = dict(REG)
    got = best(spark, rows)[2]
    for k in {r[1] for r in rows}:
        g = [r for r in rows if r[1] == k]
        d = min((r for r in g if r[4] == WHOLE), key=lambda r: (-r[3].timestamp(), r[0]))[0]
        u = min((r for r in g if r[5] and r[5] != "#"), key=lambda r: (tier[r[2]], -r[3].timestamp(), r[0]))[0]
        c = min((r for r in g if r[6] == "p"), key=lambda r: (tier[r[2]], -r[3].timestamp(), r[0]))[0]
        assert (got[k]["description_rec"], got[k]["url_rec"], got[k]["channel_rec"]) == (d, u, c)
