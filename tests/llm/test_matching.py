import random

import numpy as np
import pytest

from postgrain.llm import matching as m

CITIES = [("1", "Aldersea"), ("2", "Brimstead"), ("3", "Tiefenau"), ("4", "Kolmegaon")]
HOW = {"names": CITIES, "threshold": 0.38, "segments": ","}
ROLES = [["site reliability engineer", "sre"], ["copywriter", "content writer"], ["computer vision", "cv engineer"], ["data scientist", "data science"], ["people operations", "hr"], ["quality assurance", "test engineer"], ["chip design", "rtl designer"], ["game developer", "gameplay programmer"], ["quant", "quantitative research"], ["gis", "geospatial analysis"]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title string, company string, location string, brand string, wording string")


def matched(spark, jobs, listings, **how):
    jobs, listings = frame(spark, jobs), frame(spark, listings)
    learned = m.learn((jobs, "title", "company"), (listings, "title", "company"))
    sides = (m.profiles(d, learned, key="id", title="title", company="company", places=["location"], cities=HOW) for d in (jobs, listings))
    return {(r["left_key"], r["right_key"]): r["confidence"] for r in m.match(*sides, learned["counts"], **how).collect()}


@pytest.mark.parametrize("name, brand", [("Quatushahu Studios Pvt Ltd", "quatushahu"), ("QUATUSHAHU (R&D)", "quatushahu"), ("Wexe nkgimris Finnace", "wexenkgimris"), ("Studios Ltd", "studios"), (None, ""), ("", "")])
def test_brand(name, brand):
    assert m.Brand(["studios", "pvt", "ltd", "finance"])(name) == brand


def planted(seed, dated):
    """Jobs and listings of openings: an employer has each opening once, a listing uses any wording of its role; others have no job."""
    rng = random.Random(seed)
    brands = ["".join(rng.choice(["bron", "tav", "mur", "lox", "gip", "zen", "kal", "wub", "fid", "hos"]) for _ in range(4)) for _ in range(150)]
    times = ["summer 2026", "winter 2026", "spring 2027"]
    jobs, listings, want, n = [], [], set(), 0
    for b in brands:
        for k, g in enumerate(rng.sample(ROLES, 5)):
            city, time = rng.choice(CITIES)[1], rng.choice(times)
            title = lambda g=g: f"{rng.choice(g)} {rng.choice(['intern', 'trainee', 'student'])}" + (f" {rng.choice(times) if 'forklift operator' in g else time}" if dated and rng.random() < 0.8 else "")
            n += 1
            jobs.append((n, title(), f"{b} {rng.choice(['labs', 'studios', 'works'])}", city, "clash", "clash"))
            if k < 3:
                typo = b[:3] + b[4:] if n % 10 == 1 else b
                listings.append((n + 100_000, title(), f"{typo.upper()} {rng.choice(['Ltd', 'Labs'])}", f"{city}, IN", "clash", "clash"))
                want.add((n, n + 100_000))
            elif k == 3:
                listings.append((n + 100_000, title(["forklift operator", "night driver", "canteen chef"]), f"{b} Ltd", city, "clash", "clash"))
    return jobs, listings, want


@pytest.mark.parametrize("dated", [True, False])
def test_wordings_of_a_role_are_learned(spark, dated):
    jobs, listings, want = planted(3, dated)
    got = set(matched(spark, jobs, listings))
    assert len(want) == 450 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_an_unknown_role_is_no_wildcard(spark):
    jobs, listings, _ = planted(4, True)
    odd = {i for i, t, *_ in listings if any(w in t for w in ("forklift", "driver", "chef"))}
    assert len([p for p in matched(spark, jobs, listings) if p[1] in odd]) <= 0.1 * len(odd)


FILLERS = [f"{a}{b} {a}{c}" for a in ("bel", "cor", "dun", "fer", "gal", "hin", "jor", "kul", "lom", "mav") for b, c in (("ix", "ota"), ("uma", "ey"), ("ond", "ira"), ("ast", "umo"), ("erg", "ilp"), ("opt", "ach"))]


def large_blocks(seed):
    """Jobs and listings of employers that have 45 wordings each; no listing uses the wording of its job."""
    rng = random.Random(seed)
    brands = ["".join(rng.choice(["bron", "tav", "mur", "lox", "gip", "zen", "kal", "wub", "fid", "hos"]) for _ in range(4)) for _ in range(80)]
    jobs, listings, want = [], [], set()
    for b in brands:
        city = rng.choice(CITIES)[1]
        for title in rng.sample(FILLERS, 41):
            jobs.append((len(jobs), title, f"{b} labs", city, "clash", "clash"))
        for old, new in rng.sample(ROLES, 4):
            want.add((len(jobs), len(listings)))
            jobs.append((len(jobs), old, f"{b} labs", city, "clash", "clash"))
            listings.append((len(listings), new, f"{b} works", city, "clash", "clash"))
    return jobs, listings, want


def test_wordings_are_learned_from_blocks_of_many_wordings(spark):
    jobs, listings, want = large_blocks(6)
    got = set(matched(spark, jobs, listings))
    assert len(want) == 320 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_one_small_block_of_a_large_employer_is_no_evidence(spark):
    names = [old for old, _ in ROLES] + FILLERS
    left = [("large", w, None, f"c{c}") for c in range(12) for w in names] + [("large", "quant", None, "c12")]
    left += [(f"b{k}", w, None, "c0") for k in range(40) for w in names[k % 10 :: 10]]
    right = [("large", w, None, f"c{c}") for c in range(13) for w in ("forklift operator", "night driver", "canteen chef", "yoga teacher")]
    right += [(f"b{k}", names[k % 10], None, "c0") for k in range(40)]
    sides = (spark.createDataFrame(x, "brand string, wording string, intake string, city string") for x in (left, right))
    role = {(r["w1"], r["w2"]): r["role"] for r in m._related(*sides, dict.fromkeys("forklift operator night driver canteen chef yoga teacher quant".split(), 50)).collect()}
    assert max(role.get((w, "quant"), 0.0) for w in ("forklift operator", "night driver", "canteen chef", "yoga teacher")) < 1 < role["quant", "quant"]


def test_small_blocks_of_one_employer_are_one_voice(spark):
    names, odd = [old for old, _ in ROLES] + FILLERS, ("forklift operator", "night driver", "canteen chef", "yoga teacher")
    left = [("large", w, None, f"c{c}") for c in range(12) for w in names] + [("large", "quant", None, c) for c in ("c12", "c13")]
    left += [(f"b{k}", w, None, "c0") for k in range(400) for w in names[k % 10 :: 10]]
    right = [("large", w, None, f"c{c}") for c in range(14) for w in odd] + [(f"b{k}", names[k % 70], None, "c0") for k in range(400)]
    sides = (spark.createDataFrame(x, "brand string, wording string, intake string, city string") for x in (left, right))
    role = {(r["w1"], r["w2"]): r["role"] for r in m._related(*sides, dict.fromkeys("forklift operator night driver canteen chef yoga teacher quant".split(), 50)).collect()}
    assert max(role.get((w, "quant"), 0.0) for w in odd) < 1 < role["quant", "quant"]


def test_few_rows_use_the_fixed_weights(spark):
    jobs = [(1, "site reliability engineer", "Acme", "Aldersea", "", ""), (2, "copywriter", "Acme", "Aldersea", "", ""), (3, "site reliability engineer", "Zenith", "Tiefenau", "", "")]
    listings = [(7, "Site Reliability Engineer", "ACME", "Aldersea", "", ""), (8, "Site Reliability Engineer", "ACME", "Aldersea", "", "")]
    assert set(matched(spark, jobs, listings)) == {(1, 7), (1, 8)}


def test_edges(spark):
    rows = [(1, None, "Acme", "Aldersea", "", ""), (2, "SRE intern", None, "Aldersea", "", ""), (3, "SRE intern", "", None, "", ""), (4, "x " * 50_000, "Acme", "Aldersea", "", ""), (5, "?!", "Acme", "Aldersea", "", "")]
    assert set(matched(spark, rows, rows)) == {(4, 4)}
    assert matched(spark, [], rows) == {} and matched(spark, rows, []) == {}


def test_newton_fit_separates():
    x = np.array([[0.0], [1], [2], [3]])
    w = m.fit_logistic(x, np.array([0.0, 0, 1, 1]))
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert (p[:2] < 0.5).all() and (p[2:] > 0.5).all()


def test_mixture_is_not_misled_by_chance_agreement():
    rng = np.random.default_rng(1)
    true = np.arange(4000) % 2 == 0
    x = np.where(true, 2.0, -2.0)[:, None] + rng.normal(0, 1, (4000, 1))
    agree = true | (rng.random(4000) < 0.25)
    w = m.fit_mixture(x, agree, 0.25)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert ((p > 0.5) == true).mean() > 0.95
