import random

import pytest

from postgrain.llm import canonical as c

CITIES = [("1", "Kolmegaon"), ("2", "Port Ellan"), ("2", "Ellan Harbor"), ("3", "Port Allanby"), ("4", "Grünfelde"), ("5", "Kolmagaon")]


@pytest.fixture(scope="module")
def ref():
    return c.Reference(CITIES, ignore=frozenset({"central", "near"}), decoration=r"\([^)]*\)", segments=r"[,;|/]|\s[-–—]\s", threshold=0.38)


@pytest.mark.parametrize("typed, key", [
    ("kolmegaon", "1"), ("KOLMAGAON", "5"), ("Port Elan", "2"), ("Elan Harbr", "2"), ("Prot Allanby (WFO)", "3"), ("Central Grunfelde, DE", "4"), ("near Gurnfelde - 123456", "4"),
    ("Remote", "none"), ("Umberryheath", "none"), ("India", "none"), ("12345", "none"), ("?!", "none"), ("Port Allanby " * 5000, "3"),
])
def test_values(ref, typed, key):
    assert ref.resolve(typed)[0] == key


def test_repair_finds_all_within_distance():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    ref = c.Reference([(v, v) for v in vocab])
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 9)))
        within = {v: c.distance(w, v, 9) for v in vocab if c.distance(w, v, 9) <= min(c.allowed(len(w)), c.allowed(len(v)))}
        want = {v for v, d in within.items() if d == min(within.values())}
        assert {t for t, _ in ref.repair(w)} == want


def test_distance_counts_swaps_once():
    assert c.distance("teifenau", "tiefenau", 2) == 1 and c.distance("abc", "xyz", 2) == 3 and c.distance("", "ab", 2) == 2


def test_rows(spark):
    df = spark.createDataFrame([(1, "kolmegaon", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", "x"), (5, "Nowhere", "x"), (1, "kolmegaon", "x")], "id bigint, city string, ref_key string")
    names = spark.createDataFrame(CITIES, "ref_key string, name string")
    got = sorted((r["row_id"], r["ref_key"]) for r in c.map_to_list(df, names, key="id", value="city", threshold=0.38).collect())
    assert got == [(1, "1"), (1, "1"), (4, "none"), (5, "none")]
    assert {r["ref_key"] for r in c.map_to_list(df, names.where("false"), key="id", value="city").collect()} == {"none"}
    assert c.map_to_list(df.where("false"), names, key="id", value="city").count() == 0


def test_joins_give_what_the_broadcast_gives(spark, monkeypatch):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    names = [(str(k), " ".join(rng.sample(vocab, rng.randint(1, 3)))) for k in range(80)] + [("80", ""), ("81", "?!")]
    typo = lambda w: w[:1] + w[2:] if rng.random() < 0.3 and len(w) > 3 else w
    values = [", ".join(" ".join(typo(w) for w in rng.choice(names)[1].split() + rng.choice([[], ["near"], ["12"], ["zzz"]])) for _ in range(rng.randint(1, 2))) for _ in range(150)] + [None, "", "  ", "near", "12"]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)] + [(0, values[0], "clash")], "id bigint, city string, ref_key string")
    ref = spark.createDataFrame(names, "ref_key string, name string")
    how = {"ignore": frozenset({"near"}), "segments": ",", "decoration": r"\([^)]*\)", "threshold": 0.4}
    want = sorted((r["row_id"], r["ref_key"], round(r["score"], 6)) for r in c.map_to_list(df, ref, key="id", value="city", **how).collect())
    monkeypatch.setattr(c, "MAX_REFERENCE_ROWS", 10)
    got = sorted((r["row_id"], r["ref_key"], round(r["score"], 6)) for r in c.map_to_list(df, ref, key="id", value="city", **how).collect())
    assert got == want and len({k for _, k, _ in got}) > 30
    assert c.map_by_join(df.where("false"), ref, key="id", value="city").count() == 0
    assert {r["ref_key"] for r in c.map_by_join(df, ref.where("false"), key="id", value="city").collect()} == {"none"}
