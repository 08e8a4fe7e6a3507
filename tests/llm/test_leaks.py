import random

from postgrain.llm import leaks

WORDS = [f"term{i:02d}" for i in range(60)] + ["the", "of", "a"]


def brute(docs, items, m):
    out = {}
    for d, t in docs:
        w = leaks.tokens(t or "")
        for i, x in items:
            q = leaks.tokens(x or "")
            runs = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)}
            if any(tuple(w[k : k + m]) in runs for k in range(len(w) - m + 1)):
                out[d, i] = True
    return set(out)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): (r["longest_run"], r["near_words"]) for r in leaks.find_leaks(d, q, **more).collect()}


def test_random_passages(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(5, 50)))) for i in range(30)]
    docs = []
    for d in range(200):
        w = rng.choices(WORDS, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            q = leaks.tokens(rng.choice(items)[1])
            a = rng.randrange(len(q))
            w[rng.randint(0, len(w)) : 0] = q[a : a + rng.randint(8, 30)]
        docs.append((d, " ".join(w)))
    want = brute(docs, items, 12)
    assert set(found(spark, docs, items)) == want and len(want) > 20
    assert set(found(spark, docs, items, chars=300)) == want


def test_disguises_and_edges(spark):
    q = "Suppose an intern in Aldersea is told to profile a archive browser within seven weeks"
    hidden = q.upper().replace("INTERN", "INT​ERN").replace(" ", "\n ,").replace("ARCHIVE", "arch­ive")
    docs = [(1, hidden), (2, q[:40]), (3, None), (4, ""), (5, q + " x " + q), (5, q), (6, "y " * 300_000 + q)]
    got = found(spark, docs, [(1, q), (2, None), (3, ""), (4, "too short")])
    assert set(got) == {(1, 1), (5, 1), (6, 1)} and got[1, 1][0] == 15
    assert found(spark, [], [(1, q)]) == {} and found(spark, docs, []) == {}


def test_proximity_spans_an_inserted_word(spark):
    w = [f"q{i}" for i in range(30)]
    doc = " ".join(w[:14] + ["extra"] + w[14:])
    assert found(spark, [(1, doc)], [(1, " ".join(w))]) == {(1, 1): (16, 30)}


def test_words_broken_and_joined(spark):
    q = "Suppose an intern in Aldersea is told to profile a archive browser within seven weeks"
    docs = [(1, q.replace("intern", "int ern")), (2, q.replace(" ", "")), (3, " ".join(q)), (4, "lead" + q.replace("in Aldersea", "inAldersea")), (5, q.replace("archive", "arch-\nive") + "tail"), (6, q.replace("told", "to other ld"))]
    got = found(spark, docs, [(1, q)])
    assert {d for d, _ in got} == {1, 2, 3, 4, 5} and all(v == (15, 15) for v in got.values())


def test_squeezed_phrases_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(8, 40)))) for i in range(25)]
    docs = []
    for d in range(150):
        w = leaks.tokens(rng.choice(items)[1])
        a = rng.randrange(len(w))
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 30)) + w[a : a + rng.randint(8, 30)] + rng.choices(WORDS, k=rng.randint(0, 30)))
        docs.append((d, "".join(c + (" " if rng.random() < 0.02 else "") for c in text if c != " " or rng.random() < 0.97)))
    squeeze = lambda t: "".join(leaks.tokens(t))
    want = set()
    for i, x in items:
        q = leaks.tokens(x)
        for k in range(len(q) - 11):
            want |= {(d, i) for d, t in docs if "".join(q[k : k + 12]) in squeeze(t)}
    assert set(found(spark, docs, items, chars=500)) == want and len(want) > 20


def test_no_match_across_documents(spark):
    w = [f"q{i}" for i in range(14)]
    assert found(spark, [(1, " ".join(w[:7])), (2, " ".join(w[7:]))], [(1, " ".join(w))]) == {}


def near_brute(w, q, m, slack, least):
    """Whether a window of q has ``least`` words in order in w, at alignments within ``slack`` of each other: full tables."""
    for k in range(len(q) - m + 1):
        for low in range(-m, len(w) + 1):
            t = [[0] * (len(w) + 1) for _ in range(m + 1)]
            for j in range(m):
                for x in range(len(w)):
                    met = w[x] == q[k + j] and low <= x - j <= low + slack
                    t[j + 1][x + 1] = max(t[j][x + 1], t[j + 1][x], t[j][x] + met)
            if t[m][len(w)] >= least:
                return True
    return False


def test_near_finds_edited_passages(spark):
    w = [f"q{i}" for i in range(36)]
    changed = [x if i % 6 != 5 else "other" for i, x in enumerate(w)]
    left_out = [x for i, x in enumerate(w) if i % 9 != 8]
    added = [y for i, x in enumerate(w) for y in ([x, "more"] if i % 7 == 6 else [x])]
    far = [y for x in w for y in [x, *["pad"] * 9]]
    docs = [(1, " ".join(changed)), (2, " ".join(left_out)), (3, " ".join(added)), (4, " ".join(reversed(w))), (5, " ".join(w)), (6, " ".join(w[:8])), (7, " ".join(far)), (8, None), (9, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, " ".join(w)), (2, None)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["kind"], r["longest_run"], r["near_words"]) for r in leaks.find_leaks(d, q, near=True).collect()}
    assert got == {1: ("near", 5, 30), 2: ("near", 8, 32), 3: ("near", 7, 36), 5: ("phrase", 36, 36)}
    assert set(found(spark, docs, [(1, " ".join(w))])) == {(5, 1)}


def test_near_equals_brute_force_in_any_sharding(spark):
    rng = random.Random(9)
    words = [f"t{i:02d}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 16)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = rng.choices(words, k=rng.randint(0, 25))
        q = leaks.tokens(rng.choice(items)[1])
        w[rng.randint(0, len(w)) : 0] = [y for x in q for y in rng.choice([[x], [x], [x], [x, "new"], ["new"], []])]
        docs.append((d, " ".join(w)))
    m, slack, least = 6, 2, 5
    want = {(d, i) for d, t in docs for i, x in items if near_brute(leaks.tokens(t), leaks.tokens(x), m, slack, least)}
    for chars in (8_000_000, 200):
        d = spark.createDataFrame(docs, "doc_id bigint, text string")
        q = spark.createDataFrame(items, "item_id bigint, text string")
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, q, near=True, near_share=0.8, min_words=m, slack=slack, chars=chars).collect()}
        assert got == want
    assert 10 < len(want) < 600
