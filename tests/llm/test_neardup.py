import random

import numpy as np
import pytest

from postgrain.llm import neardup as nd

VOCAB = [f"w{i}" for i in range(400)]


def texts(seed=0, n=120):
    """Bases with edited copies at many similarities, plus identical ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.choices(VOCAB, k=rng.randint(20, 90))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            c = list(base)
            for _ in range(rng.randint(0, len(c) // 8)):
                c[rng.randrange(len(c))] = rng.choice(VOCAB)
            out.append(" ".join(c))
    return out


def brute(ts, n, threshold):
    sets = []
    for t in ts:
        w = nd.words(t or "")
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return {(i, j) for i in range(len(ts)) for j in range(i + 1, len(ts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def found(spark, ts, **more):
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(ts)], "id bigint, txt string, cid string, t string")
    m, l = nd.near_duplicates(df, key="id", text="txt", **more)
    return {tuple(r) for r in nd.all_pairs(m, l).collect()}, m, l


@pytest.mark.parametrize("n, threshold", [(3, 0.5), (5, 0.8)])
def test_all_pairs_of_brute_force(spark, n, threshold):
    ts = texts(n)
    want = brute(ts, n, threshold)
    got, _, _ = found(spark, ts, n=n, threshold=threshold)
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 50


def test_edge_texts(spark):
    long = " ".join(random.Random(1).choices(VOCAB, k=60_000))
    ts = [None, "", "   ", "one two", "same words here now", "same words here now", "Same, words HERE now!", long, long + " tail", "émigré naïve çà là"]
    assert found(spark, ts, n=3, threshold=0.5)[0] == {(4, 5), (4, 6), (5, 6), (7, 8)}
    assert found(spark, [], n=3, threshold=0.5)[0] == set()
    assert found(spark, ["", None], n=3, threshold=0.5)[0] == set()


def test_hot_runs_go_through_blocks_and_lose_nothing(spark):
    rng = random.Random(5)
    base = rng.choices(VOCAB, k=60)
    ts = []
    for _ in range(80):
        c = list(base)
        c[rng.randrange(60)] = rng.choice(VOCAB)
        ts.append(" ".join(c))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "cid bigint, t string")
    pairs = nd.candidates(df, n=3, threshold=0.5, bands=48, rows=4, n_rows=80, block=8)
    got = {tuple(r) for r in pairs.collect()}
    assert brute(ts, 3, 0.5) <= got


def test_members_of_a_hot_key_in_other_batches_meet_it(spark):
    rng = random.Random(6)
    base = rng.choices(VOCAB, k=60)
    ts = []
    for _ in range(156):
        c = list(base)
        c[rng.randrange(60)] = rng.choice(VOCAB)
        ts.append(" ".join(c))
    ts += [" ".join(rng.choices(VOCAB, k=40)) for _ in range(30)]
    many, few = ([(i, t) for i, t in enumerate(ts) if (i < 150) == first] for first in (True, False))
    df = spark.createDataFrame(many, "cid bigint, t string").coalesce(1).unionByName(spark.createDataFrame(few + many[:3], "cid bigint, t string").coalesce(1))
    got = {tuple(r) for r in nd.candidates(df, n=3, threshold=0.5, bands=48, rows=4, n_rows=190, block=50).collect()}
    want = brute(ts, 3, 0.5)
    assert want <= got and len(want) == 156 * 155 // 2


def test_rows_of_one_text_are_paired_in_chunks(spark):
    m = spark.createDataFrame([(i, 7 if i < 25 else i) for i in range(40)], "key bigint, cid bigint")
    got = nd.all_pairs(m, spark.createDataFrame([(7, 30)], "a bigint, b bigint"), chunk=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(i, j) for i in range(25) for j in range(i + 1, 25)} | {(i, 30) for i in range(25)}


def test_copies_are_one_class(spark):
    ts = ["a b c d e f"] * 30 + ["a b c d e g"] * 2
    _, m, l = found(spark, ts, n=3, threshold=0.5)
    rows = nd.classes_with_links(m, l).collect()
    assert {(r["class_key"], r["copies"], r["links"]) for r in rows} == {(0, 30, 1), (30, 2, 1)} and len(rows) == 32


def test_signatures_estimate_similarity_and_weights():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 1 << 47, n).astype(np.uint64) for n in (600, 200, 200))
    owner = np.repeat([0, 1], 800)
    sig = nd.signatures(owner, np.concatenate([common, a, common, b]), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    w = np.concatenate([np.full(600, 3.0), np.full(200, 0.5)] * 2)
    sig = nd.signatures(owner, np.concatenate([common, a, common, b]), 2, 512, weight=w)
    assert abs((sig[0] == sig[1]).mean() - 1800 / 2000) < 0.06


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 1 << 47, n).astype(np.uint64) for n in (1, 2, 7, 50, 500)]
    owner = np.repeat(np.arange(5), [len(s) for s in sets])
    together = nd.signatures(owner, np.concatenate(sets), 5, 64)
    for k, s in enumerate(sets):
        assert (nd.signatures(np.zeros(len(s), np.int64), s, 1, 64)[0] == together[k]).all()


def test_sketch_keeps_pairs_at_the_threshold():
    from math import comb

    p, least = 0.5 + 0.5 / 2, nd.least_agreeing(0.5)
    lost = sum(comb(nd.SKETCH, k) * p**k * (1 - p) ** (nd.SKETCH - k) for k in range(least))
    assert lost < 5e-5
    assert nd.least_agreeing(0.5, 64) > nd.SKETCH - 64


def test_sketch_counts_agreeing_coordinates():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (50, 192), dtype=np.uint64).astype(np.uint32)
    other = sig.copy()
    other[:, :100] = rng.integers(0, 1 << 32, (50, 100), dtype=np.uint64).astype(np.uint32)
    bit = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(31)
    assert (nd.agreeing(nd.sketch(sig), nd.sketch(other)) == (bit(sig) == bit(other)).sum(1)).all()
    assert (nd.agreeing(nd.sketch(sig[:, :64]), nd.sketch(other[:, :64])) == 128 + (bit(sig) == bit(other))[:, :64].sum(1)).all()
