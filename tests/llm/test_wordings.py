import random

from postgrain.llm import canonical, wordings as w


def one(spark, values):
    return spark.createDataFrame([(v, "clash") for v in values], "v string, value string")


def titles():
    rng = random.Random(5)
    names = [["data", "engineer"], ["network", "engineer"], ["copywriter"], ["game", "design"], ["chip", "design"], ["quality", "assurance"], ["speech", "scientist"]]
    return [" ".join(rng.choice(names) + [rng.choice(["intern", "trainee"])] + rng.choice([["summer"], ["winter"], []])) for _ in range(2000)]


def test_decoration_is_learned(spark):
    rows = w.distinct_tokens(one(spark, titles()), "v")
    counts = w.vocabulary(rows)
    assert w.decoration(w.spelled(rows, counts)) == {"intern", "trainee", "summer", "winter"}
    none = w.distinct_tokens(one(spark, []), "v")
    assert w.vocabulary(none) == {} and w.decoration(w.spelled(none, {})) == frozenset() and w.later_words(none) == [] and w.shares(none) == {}


def test_spelling():
    s = w.Spelling({"engineer": 500, "enginer": 6, "designer": 300, "sde": 90, "sre": 100})
    assert [s(t) for t in ("engineer", "enginer", "egnineer", "desinger", "sde", "sre", "zzz", "12345")] == ["engineer", "engineer", "engineer", "designer", "sde", "sre", "zzz", "12345"]


def test_later_words(spark):
    names = [f"brand{k} {x}" for k in range(50) for x in ("labs", "works ltd")] + ["brand1 odd"] * 20 + [None, "", "x " * 30_000]
    assert w.later_words(w.distinct_tokens(one(spark, names), "v")) == ["labs", "ltd", "works"]


def test_noise_and_remarks(spark):
    cities = ["aldersea", "brimstead", "tiefenau", "kolmegaon", "ashford", "penmarrow"]
    rng = random.Random(2)
    values = [f"{rng.choice(['central', 'near', ''])} {c}" for c in cities for _ in range(30)] + ["remote"] * 50 + [None, "", "?!"]
    assert w.noise_tokens(one(spark, values), "v", frozenset(cities)) == {"central", "near"}
    labels = [f"label number {a}" for a in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    marked = [t.format(x) for x in labels for t in ("{} (optional)", "Please tell us: {}", "{}", "{} – we read it") for _ in range(3)]
    assert w.remarks(one(spark, [*marked, None, ""]), "v") == {"optional", "please tell us", "we read it"}
    assert w.remarks(one(spark, []), "v") == frozenset() and w.noise_tokens(one(spark, []), "v", frozenset()) == frozenset()


def test_long_values_count_as_rows(spark):
    cities = [f"aldersea{c}" for c in "abcdefgh"]
    long = " ".join(["central", *cities, *[f"word{k}x" for k in range(80)]])
    values = [c for c in cities for _ in range(10)] + [f"{long} {'y' * k}z" for k in range(20)]
    got = w.noise_tokens(one(spark, values), "v", frozenset(cities), share=0.15)
    assert got == {"central", *[f"word{k}x" for k in range(80)]}
    # one long value is one row, however many names it holds
    assert w.noise_tokens(one(spark, values[:81]), "v", frozenset(cities), share=0.05) == frozenset()
    labels = [f"label number {a}" for a in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    forms = [" / ".join(["we read it", x, *[f"odd part {x} {i} {k}" for i in range(70)]]) for x in labels for k in range(3)]
    assert w.remarks(one(spark, [*labels, *forms]), "v") == {"we read it"}
    assert w.remarks(one(spark, labels * 10 + [" / ".join(y for x in labels for y in ("we read it", x))]), "v", share=0.05) == frozenset()
    ts = w.distinct_tokens(one(spark, [" ".join(f"t{k}" for k in range(70))] * 3 + ["u"] * 3), "v", strip="")
    assert w.shares(ts) == {**{f"t{k}": 0.5 for k in range(70)}, "u": 0.5}


def test_translations_against_a_plain_loop(spark):
    rng = random.Random(8)
    rows, counts = [], {f"w{k}": 5 for k in range(8)}
    for occ in range(60):
        a = rng.choice(["w0", "w1", "w2"])
        rows += [(occ, a, b) for b in rng.sample(["w3", "w4", "w5", "w6", "w7"], 3)]
    got = {(r["w1"], r["w2"]): r["role"] for r in w.translations(spark.createDataFrame(rows, "occ bigint, w1 string, w2 string"), counts).collect()}
    import math

    own = {o: a for o, a, _ in rows}
    p1 = {a: sum(x == a for x in own.values()) / len(own) for a in own.values()}
    t = {(a, b): p1[a] for _, a, b in rows}  # no likeness between these wordings: they share no token and no stem
    for _ in range(3):
        c, tot = {}, {}
        for o, a, b in rows:
            den = sum(t[x, y] for q, x, y in rows if q == o) + p1[a]
            c[a, b] = c.get((a, b), 0) + t[a, b] / den
        for (a, b), n in c.items():
            tot[b] = tot.get(b, 0) + n
        t = {(a, b): (n + 0.5 * p1[a]) / (tot[b] + 0.5) for (a, b), n in c.items()}
    assert got.keys() == t.keys() and all(abs(got[k] - math.log(t[k] / p1[k[0]])) < 1e-9 for k in got)


def test_labels_by_weights_of_the_column():
    names = [("pay", "Expected stipend"), ("zone", "Time zone"), ("move", "Willingness to relocate"), ("mail", "E-mail address")]
    ref = canonical.Reference(names, shares={"are": 0.3, "you": 0.4, "to": 0.4, "your": 0.3}, remarks=frozenset({"please tell us"}), threshold=0.28)
    for typed, key in [("Please tell us: your timezone", "zone"), ("Are you open to relocation?", "move"), ("STIPEND EXPECTATION", "pay"), ("Email", "mail"), ("Favourite board game", "none"), ("", "none")]:
        assert ref.resolve(typed)[0] == key, typed
