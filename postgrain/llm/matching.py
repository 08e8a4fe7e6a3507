"""The same real-world openings in two tables without a common key.

1. Profiles. A record's employer becomes a brand (name without the descriptors that ``wordings.later_words`` learns), its title a
   wording (repaired tokens without the decoration that ``wordings.decoration`` learns, any order) and the intake it states
   (a year and the word before it), its place an entry of the city list (token repair and soft TF-IDF). Equal profiles are one row
   from here on, so an employer that holds a tenth or a third of all rows is as many rows as it has wordings, places and intakes.
2. Candidate blocking by all three attributes. Brands meet by MinHash bands over letter trigrams, confirmed by edits; wordings
   meet by MinHash bands too, or because they translate into each other (below); places meet when equal or when one isn't known.
   No pair of records is made before the last step.
3. Equal roles. Wordings of one role ("SRE", "site reliability") are learned from the two tables by ``wordings.translations``: in a block
   of one brand and place a listing's wording means one of the jobs' wordings or none (intakes stay out: they judge the result). Blocks of any
   size count: those of an employer that has every role everywhere show that a wording which meets all of them means none. An employer has
   one voice for a wording, and role evidence is the log of the voices seen over those expected by chance, both with ``SHRINK`` added.
4. Classifier. Logistic regression on brand similarity, role evidence, likeness of wordings, its share of the role
   evidence above chance of all the listing's candidates and of none, and what an unknown place leaves open. Its weak labels are the stated intakes of pairs that state two: pairs of one opening
   agree, others agree by chance (the product of the marginals), so the fit is that of a mixture; the same pairs without any evidence
   for the role stand for non-matches. The fit takes at most ``max_train``
   such pairs by hash order. Confidences are calibrated by isotonic regression of the agreement on pairs left out of the fit, less
   chance; a pair's own stated intakes then raise or lower its confidence by Bayes' rule. With fewer than ``min_train`` labelled pairs
   the fixed ``FALLBACK`` weights score instead.
5. Pairs of profiles at ``confident`` or more are expanded to pairs of record ids.

Defined results: a record without an employer, or whose title has no token beside decoration, matches nothing; repeated records are
pairs of their own; an empty table gives no pairs; equal attributes on both sides give one confidence; titles and names are read whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrain.llm import wordings
from postgrain.llm.canonical import NONE, Reference, distance, tokens
from postgrain.llm.reading import isotonic

_REMARK = re.compile(wordings.REMARK)
_INTAKE = re.compile(r"([^\W\d_]+)\W+((?:19|20)\d\d)(?!\d)")


class Brand:
    """Employer name to brand: its letters without descriptors and legal forms, misspelt ones too. The first word always counts."""

    def __init__(self, generic: list[str]):
        self.generic = sorted(set(generic), key=len)
        self.exact = set(generic)
        self.seen: dict[str, bool] = {}

    def is_generic(self, token: str) -> bool:
        if (r := self.seen.get(token)) is None:
            r = token in self.exact or any(distance(token, g, m) <= m for g in self.generic if (m := 0 if len(g) < 3 else 1 if len(g) < 7 else 2))
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[token] = r
        return r

    def __call__(self, name: str | None) -> str:
        ts = tokens(_REMARK.sub(" ", name or ""))
        return "".join(t for k, t in enumerate(ts) if k == 0 or not self.is_generic(t))


def learn(*sides: tuple[DataFrame, str, str]) -> dict:
    """Spellings and decoration of titles and descriptors of company names, from (table, title column, company column) of all sides."""
    from postgrain.session import checkpointed

    def column(k: int) -> DataFrame:
        out = None
        for side in sides:
            c = side[0].select(F.col(side[k]).alias("value"))
            out = c if out is None else out.unionByName(c)
        return checkpointed(wordings.distinct_tokens(out, "value"))

    titles, companies = column(1), column(2)
    counts = wordings.vocabulary(titles)
    fixed = checkpointed(wordings.spelled(titles, counts))
    return {"counts": counts, "decoration": wordings.decoration(fixed), "generic": wordings.later_words(companies)}


def profiles(df: DataFrame, learned: dict, *, key: str, title: str, company: str, places: list[str], cities: dict) -> DataFrame:
    """key, brand, wording, intake, city of each record with a brand and a wording; ``places``: columns in order of trust."""
    shared = df.sparkSession.sparkContext.broadcast((learned, cities))

    def run(batches):
        model, city_args = shared.value
        spell, noise = wordings.Spelling(model["counts"]), model["decoration"]
        city_ref, brand = Reference(**city_args), Brand(model["generic"])

        def title_of(t: str) -> tuple[str, str | None]:
            m = _INTAKE.search(t.lower())
            fixed = (spell(x) for x in tokens(_REMARK.sub(" ", t)) if not x.isdigit())
            return " ".join(sorted({x for x in fixed if x not in noise})), f"{spell(m.group(1))} {m.group(2)}" if m else None

        memo: tuple[dict, dict, dict] = ({}, {}, {})

        def known(cache, value, f):
            if (r := cache.get(value)) is None:
                if len(cache) > 200_000:
                    cache.clear()
                r = cache[value] = f(value)
            return r

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(1, b.num_columns)]
            brands, ws, ins, cs = [], [], [], []
            for row in zip(*cols):
                t, c, *ps = row
                brands.append(known(memo[0], c, brand) if c else "")
                w, i = known(memo[1], t, title_of) if t else ("", None)
                ws.append(w)
                ins.append(i)
                city = NONE
                for p in ps:
                    if p and (city := known(memo[2], p, city_ref.resolve)[0]) != NONE:
                        break
                cs.append(city)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in (brands, ws, ins, cs)]], names=["key", "brand", "wording", "intake", "city"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(title).alias("t"), F.col(company).alias("c"), *[F.col(p).alias(f"p{k}") for k, p in enumerate(places)])
    return rows.mapInArrow(run, f"key {kind}, brand string, wording string, intake string, city string").where("brand <> '' and wording <> ''")


def met_by_minhash(left: DataFrame, right: DataFrame, *, bands: int, rows: int) -> DataFrame:
    """x, y: distinct strings (first column) of both sides that share a MinHash band over their letter trigrams."""

    def band(batches):
        a = (np.random.default_rng(5).integers(1, 1 << 31, bands * rows, dtype=np.int64) | 1)[:, None]
        c = np.random.default_rng(6).integers(0, 1 << 31, bands * rows, dtype=np.int64)[:, None]
        for b in batches:
            out_s, out_k = [], []
            for s in b.column(0).to_pylist():
                p = f"^{s}$"
                g = np.array([zlib.crc32(p[i : i + 3].encode()) for i in range(max(1, len(p) - 2))], np.int64)[None, :]
                sig = ((a * g + c) % ((1 << 31) - 1)).min(1)
                out_s += [s] * bands
                out_k += [zlib.crc32(sig[k * rows : k * rows + rows].tobytes()) * 64 + k for k in range(bands)]
            yield pa.RecordBatch.from_arrays([pa.array(out_s, pa.string()), pa.array(out_k, pa.int64())], names=["s", "band"])

    lo, ro = (d.mapInArrow(band, "s string, band bigint") for d in (left, right))
    return lo.withColumnRenamed("s", "x").join(ro.withColumnRenamed("s", "y"), "band").select("x", "y").distinct()


def brand_links(left: DataFrame, right: DataFrame, *, bands: int = 20, rows: int = 2, least: float = 0.72) -> DataFrame:
    """lb, rb, similarity: brands (one column, distinct) that MinHash bands bring together and edits confirm."""

    def confirm(batches):
        for b in batches:
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            s = []
            for p, q in zip(x, y):
                n = max(len(p), len(q))
                most = int((1 - least) * n)
                d = 0 if p == q else distance(p, q, most)
                s.append(1 - d / n if d <= most else 0.0)
            keep = pa.array([v >= least for v in s])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([v for v in s if v >= least], pa.float64())], names=["lb", "rb", "similarity"])

    return met_by_minhash(left, right, bands=bands, rows=rows).mapInArrow(confirm, "lb string, rb string, similarity double")


FEATURES = ["similarity", "exact", "brand_behind", "role", "alike", "same", "role_share", "place_unknown", "open"]
#: Weights of the features and the intercept where too few pairs state two intakes.
FALLBACK = [12.0, 0.5, -12.0, 1.5, 1.0, 1.0, 2.0, -0.5, -4.0, -15.0]

#: Employers added to those seen and to those expected by chance, so that a wording seen at one employer alone has little evidence for its role.
SHRINK = 0.25


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights, intercept last, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + l2 * len(y) / 100 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + (l2 * len(y) / 100 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def without_role(x: np.ndarray) -> np.ndarray:
    """The pairs with all evidence for the role taken away."""
    x = x.copy()
    x[:, [FEATURES.index(f) for f in ("role", "alike", "same", "role_share")]] = 0.0
    return x


def fit_mixture(x: np.ndarray, agree: np.ndarray, chance: float, other: np.ndarray | None = None, rounds: int = 15) -> np.ndarray:
    """Weights of the probability that a pair is one opening, where agreement is sure for those and ``chance`` for others. ``other``: pairs known to be none."""
    other = x[:0] if other is None else other
    r = agree.astype(float)
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        w = fit_logistic(np.vstack([x, other]), np.append(r, np.zeros(len(other))))
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        r = np.where(agree, p / (p + (1 - p) * chance), 0.0)
    return w


def _related(left: DataFrame, right: DataFrame, counts: dict[str, int], *, floor: float = 0.0) -> DataFrame:
    """w1 (of the right side), w2 (of the left), alike, role: wordings that may mean one role."""
    from postgrain.session import checkpointed

    jobs = left.where(F.col("city") != NONE).select("brand", "city", F.col("wording").alias("w2")).distinct()
    asked = right.where(F.col("city") != NONE).select("brand", "city", F.col("wording").alias("w1")).distinct()
    # an employer has one voice for a wording, shared by the places where it lists it: its blocks are no evidence apart from one another
    asked = asked.join(jobs.select("brand", "city").distinct(), ["brand", "city"], "left_semi")
    asked = asked.withColumn("voice", 1 / F.count("*").over(Window.partitionBy("brand", "w1")))
    blocks = checkpointed(asked.join(jobs, ["brand", "city"]).select(F.xxhash64("brand", "city", "w1").alias("occ"), "w1", "w2", "voice"))
    role = wordings.translations(blocks, counts).withColumn("role", F.log((F.col("c") + SHRINK) / (F.col("by_chance") + SHRINK)))
    role = checkpointed(role.drop("c", "by_chance"))
    wl, wr = left.select("wording").distinct(), right.select("wording").distinct()
    seen = role.groupBy("w2").agg(F.max("tot").alias("tot"))
    alike = met_by_minhash(wl, wr, bands=20, rows=3).select(F.col("y").alias("w1"), F.col("x").alias("w2")).join(role.select("w1", "w2"), ["w1", "w2"], "left_anti")
    alike = wordings.likeness(alike, counts).where("alike >= 0.35").join(seen, "w2", "left")
    unseen = F.when(F.col("w1") == F.col("w2"), 4.0).otherwise(4 * F.col("alike") - F.log1p(2 * F.coalesce("tot", F.lit(0.0))))
    out = role.select("w1", "w2", "alike", F.when(F.col("w1") == F.col("w2"), F.greatest("role", F.lit(4.0))).otherwise(F.col("role")).alias("role"))
    out = out.unionByName(alike.select("w1", "w2", "alike", unseen.alias("role")))
    return checkpointed(out.where(F.col("role") >= floor))


def match(left: DataFrame, right: DataFrame, counts: dict[str, int], *, max_train: int = 40_000, min_train: int = 60, confident: float = 0.5) -> DataFrame:
    """left_key, right_key, confidence of the matching records, from their ``profiles``."""
    from postgrain.session import checkpointed

    spark = left.sparkSession
    left, right = checkpointed(left), checkpointed(right)
    profile = ["brand", "wording", "intake", "city"]
    lp, rp = (d.select(*profile).distinct() for d in (left, right))
    related = _related(lp, rp, counts)
    links = brand_links(lp.select("brand").distinct(), rp.select("brand").distinct())
    lo = lp.select(F.col("brand").alias("lb"), F.col("wording").alias("w2"), F.col("intake").alias("i2"), F.col("city").alias("c2"))
    ro = rp.select(F.col("brand").alias("rb"), F.col("wording").alias("w1"), F.col("intake").alias("i1"), F.col("city").alias("c1"))
    # role and place of one linked brand: an equality join for each case of the places
    near = checkpointed(ro.join(links, "rb").join(related, "w1"))
    placed = near.where(F.col("c1") != NONE)
    cases = [
        placed.join(lo.where(F.col("c2") != NONE).withColumnRenamed("c2", "c1"), ["lb", "w2", "c1"]).withColumn("c2", F.col("c1")),
        placed.join(lo.where(F.col("c2") == NONE), ["lb", "w2"]),
        near.where(F.col("c1") == NONE).join(lo, ["lb", "w2"]),
    ]
    columns = ["rb", "w1", "i1", "c1", "lb", "w2", "i2", "c2", "similarity", "alike", "role"]
    pairs = checkpointed(cases[0].select(*columns).unionByName(cases[1].select(*columns)).unionByName(cases[2].select(*columns)))
    asked = ["rb", "w1", "c1"]
    role = F.least("role", F.lit(5.0))
    of = pairs.groupBy(*asked).agg(F.sum(F.expm1(role)).alias("all_roles"), F.max("similarity").alias("best_brand"), F.count_distinct(F.when((F.col("c2") != NONE) & (F.col("role") >= 1), F.col("c2"))).alias("cities"))
    p = pairs.join(of, asked)
    unknown = ((F.col("c1") == NONE) | (F.col("c2") == NONE)).cast("double")
    features = [
        F.col("similarity"), (F.col("similarity") == 1).cast("double"), F.col("best_brand") - F.col("similarity"), role, F.col("alike"), (F.col("w1") == F.col("w2")).cast("double"),
        F.expm1(role) / (F.col("all_roles") + 1), unknown, unknown * (1 - 1 / F.greatest("cities", F.lit(1))),
    ]
    p = p.withColumn("f", F.array(*features))
    stated = p.where(F.col("i1").isNotNull() & F.col("i2").isNotNull())
    chance = _chance(lp, rp)
    rows = stated.select(F.xxhash64("rb", "lb", "w1", "w2", "i1", "i2", "c1", "c2").alias("h"), (F.col("i1") == F.col("i2")).alias("agree"), "f").orderBy("h").limit(max_train).toArrow()
    if rows.num_rows >= min_train and chance < 0.9:
        x, agree = np.array(rows["f"].to_pylist(), float), np.array(rows["agree"].to_pylist(), bool)
        held = np.arange(len(agree)) % 2 == 1
        w = fit_mixture(x[~held], agree[~held], chance, without_role(x[~held]))
        score = np.vstack([x[held], without_role(x[held])]) @ w[:-1] + w[-1]
        sx, sy = isotonic(score, np.append(agree[held].astype(float), np.full(held.sum(), chance)))
        knots = (np.asarray(sx, float), np.clip((np.asarray(sy, float) - chance) / (1 - chance), 0.0, 1.0))
    else:
        w, s = np.array(FALLBACK), np.linspace(-12, 12, 49)
        knots = (s, 1 / (1 + np.exp(-s)))
    shared = spark.sparkContext.broadcast((w, knots))

    def confidence(batches):
        weights, (kx, ky) = shared.value
        for b in batches:
            n = b.num_columns
            f = np.array(b.column(n - 1).to_pylist(), float).reshape(-1, len(weights) - 1)
            s = np.interp(f @ weights[:-1] + weights[-1], kx, ky)
            i1, i2 = b.column(2).to_pylist(), b.column(6).to_pylist()
            other = np.array([1.0 if p is None or q is None else chance if p == q else 50 * (1 - chance) for p, q in zip(i1, i2)])
            s = s / np.maximum(s + (1 - s) * other, 1e-12)
            keep = pa.array(s >= confident)
            yield pa.RecordBatch.from_arrays([*[b.column(j).filter(keep) for j in range(n - 1)], pa.array(s[s >= confident])], names=[*columns[:8], "confidence"])

    sure = p.select(*columns[:8], "f").mapInArrow(confidence, ", ".join(f"{c} string" for c in columns[:8]) + ", confidence double")
    l = left.select(F.col("key").alias("left_key"), F.col("brand").alias("lb"), F.col("wording").alias("w2"), F.col("intake").alias("l_in"), F.col("city").alias("c2"))
    r = right.select(F.col("key").alias("right_key"), F.col("brand").alias("rb"), F.col("wording").alias("w1"), F.col("intake").alias("r_in"), F.col("city").alias("c1"))
    sure = sure.withColumn("i1", F.coalesce("i1", F.lit(""))).withColumn("i2", F.coalesce("i2", F.lit("")))
    l, r = l.withColumn("i2", F.coalesce("l_in", F.lit(""))).drop("l_in"), r.withColumn("i1", F.coalesce("r_in", F.lit(""))).drop("r_in")
    return sure.join(r, asked + ["i1"]).join(l, ["lb", "w2", "i2", "c2"]).select("left_key", "right_key", "confidence")


def _chance(left: DataFrame, right: DataFrame) -> float:
    """Probability that the stated intakes of two profiles agree by chance."""

    def shares(d: DataFrame, name: str) -> DataFrame:
        c = d.where("intake is not null").groupBy("intake").agg(F.count("*").alias("n"))
        return c.crossJoin(c.agg(F.sum("n").alias("whole"))).select("intake", (F.col("n") / F.col("whole")).alias(name))

    r = shares(left, "a").join(shares(right, "b"), "intake").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(1.0)).alias("chance")).first()
    return float(min(0.95, max(0.01, r["chance"])))
