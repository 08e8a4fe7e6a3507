"""What a column of names teaches about its own wording, without word lists: spellings, decoration, remarks, equal wordings.

Spellings. Tokens in at least ``share`` of the rows are the vocabulary (so it has at most mean tokens / share members and may be
broadcast); a token outside it, or one ten times rarer than a neighbour, is a misspelling of the nearest vocabulary token.

Decoration. A token that says nothing about the others beside it (intern, summer, hiring) stands beside about as many different
tokens as chance gives to one of its frequency; a token of a name proper stands beside few.

Later words. In names of one token and more, words after the first that follow many different first words are descriptors.

Noise and remarks. A token unknown to a reference list that stands beside many of its tokens, and a part of a value (between
brackets, dashes, colons, slashes) that stands beside many different parts, say nothing about the entry.

Equal wordings. ``translations``: an expectation-maximisation over blocks in which one wording should mean one of several others
(word alignment with whole wordings): each round splits an occurrence over the wordings of its block by their present
translation weights, or over none of them, and counts again. Lexical likeness is the prior.

Statistics cover all rows, values of any length among them. Decoration and later words alone leave out values of more than ``LONGEST``
tokens: those are prose, which has no name in it to stand beside. They are still read whole by the operators.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postgrain.llm.canonical import PARTS, allowed, deletions, distance, tokens

LONGEST = 64
PAIRS = 100_000  # pairs of a batch that leaves a worker
REMARK = r"\([^)]*\)|\[[^\]]*\]|\|.*$"


def distinct_tokens(df: DataFrame, value: str, *, strip: str = REMARK) -> DataFrame:
    """value, ts (its tokens in order without what ``strip`` matches), n (rows): one row for each value that isn't null."""
    pattern = re.compile(strip) if strip else None

    def run(batches):
        for b in batches:
            ts = [tokens(pattern.sub(" ", v) if pattern else v) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.list_(pa.string())), b.column(1)], names=["value", "ts", "n"])

    v = df.select(F.col(value).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return v.mapInArrow(run, "value string, ts array<string>, n bigint")


def vocabulary(rows: DataFrame, *, share: float = 1e-4, least: int = 5) -> dict[str, int]:
    """Rows of each token that stands in at least ``share`` of the rows and in ``least`` of them."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = rows.select(F.explode(F.array_distinct("ts")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    return {r["t"]: r["n"] for r in counts.where(F.col("n") >= max(least, share * total)).collect()}


def shares(rows: DataFrame, *, share: float = 1e-4) -> dict[str, float]:
    """Share of the rows of each token in at least ``share`` of them (so at most mean tokens / share tokens)."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {t: n / total for t, n in vocabulary(rows, share=share, least=1).items()}


class Spelling:
    """Token to the vocabulary token it misspells, or itself."""

    def __init__(self, counts: dict[str, int], ratio: float = 10.0):
        self.counts, self.ratio = counts, ratio
        self.near: dict[str, list[str]] = defaultdict(list)
        for t in counts:
            for x in deletions(t, allowed(len(t))):
                self.near[x].append(t)
        self.known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        if (r := self.known.get(token)) is None:
            most, n, best = allowed(len(token)), self.counts.get(token, 0), None
            if most and not token.isdigit():
                for c in {c for x in deletions(token, most) for c in self.near.get(x, ())}:
                    if c != token and self.counts[c] >= self.ratio * n:
                        m = min(most, allowed(len(c)))
                        d = distance(token, c, m)
                        if d <= m and (best is None or (d, -self.counts[c], c) < best):
                            best = (d, -self.counts[c], c)
            r = best[2] if best else token
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = r
        return r


def spelled(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """ts (distinct vocabulary tokens after repair, digits left out), n."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        spell = Spelling(shared.value)
        for b in batches:
            out = []
            for ts in b.column(0).to_pylist():
                fixed = {spell(t) for t in ts if not t.isdigit()}
                out.append(sorted(t for t in fixed if t in spell.counts))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column(1)], names=["ts", "n"])

    fixed = rows.where(F.size("ts") <= LONGEST).select("ts", "n").mapInArrow(run, "ts array<string>, n bigint")
    return fixed.groupBy("ts").agg(F.sum("n").alias("n"))


def decoration(rows: DataFrame, *, bound: float = 0.6, least: int = 20) -> frozenset[str]:
    """Tokens of ``spelled`` rows, in ``least`` of them, that stand beside at least ``bound`` of the different tokens that chance would give them."""
    often = rows.select(F.explode("ts").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("fa")).where(F.col("fa") >= least)
    both = rows.select(F.explode("ts").alias("a"), "ts", "n").select("a", F.explode("ts").alias("b"), "n").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = both.join(often, "a", "left_semi").join(often.select(F.col("a").alias("b")), "b", "left_semi")
    of = both.groupBy("a").agg(F.sum("n").alias("ctx"), F.count("*").alias("kinds"))
    whole = of.agg(F.sum("ctx").alias("whole"))
    # tokens of like frequency together, so chance is a sum over a few dozen classes
    p = of.crossJoin(whole).select((F.col("ctx") / F.col("whole")).alias("p"))
    classes = p.groupBy(F.floor(2 * F.log2("p")).alias("class")).agg(F.count("*").alias("many"), F.avg("p").alias("p"))
    chance = of.crossJoin(F.broadcast(classes)).groupBy("a", "kinds").agg(F.sum(F.col("many") * (1 - F.exp(-F.col("ctx") * F.col("p")))).alias("chance"))
    return frozenset(r["a"] for r in chance.where((F.col("kinds") >= 8) & (F.col("kinds") >= bound * F.col("chance"))).select("a").collect())


def later_words(rows: DataFrame, *, share: float = 3e-3, firsts: int = 5) -> list[str]:
    """Tokens after the first in at least ``share`` of the rows, beside ``firsts`` different first tokens."""
    short = rows.where(F.size("ts").between(1, LONGEST))
    total = short.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    t = short.select(F.col("ts")[0].alias("first"), F.explode(F.array_distinct(F.slice("ts", 2, LONGEST))).alias("t"), "n")
    t = t.groupBy("t").agg(F.sum("n").alias("n"), F.count_distinct("first").alias("firsts"))
    return sorted(r["t"] for r in t.where((F.col("n") >= share * total) & (F.col("firsts") >= firsts)).collect())


def noise_tokens(df: DataFrame, value: str, known: frozenset[str], *, share: float = 5e-4, beside: int = 5) -> frozenset[str]:
    """Tokens that no token of ``known`` explains, in at least ``share`` of the rows and beside ``beside`` different known ones.

    Values of any length count, a row of a long one as one row; their pairs leave in batches of ``PAIRS``."""
    rows = distinct_tokens(df, value, strip="")
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        spell = Spelling(dict.fromkeys(shared.value, 1), 0.0)
        for b in batches:
            out = _Edges()
            for ts, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fixed = [(t, spell(t) if t not in spell.counts else t) for t in dict.fromkeys(ts) if not t.isdigit()]
                names = list(dict.fromkeys(f for _, f in fixed if f in spell.counts))
                for t, f in fixed:
                    if f not in spell.counts:
                        for m, x in enumerate(names or [""]):
                            out.add(t, x, 0 if m else k)
                        if out.full():
                            yield out.batch()
            yield out.batch()

    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    t = rows.select("ts", "n").mapInArrow(run, _Edges.SCHEMA)
    t = t.groupBy("p", "x").agg(F.sum("n").alias("n")).groupBy("p").agg(F.sum("n").alias("n"), F.count_if(F.col("x") != "").alias("beside"))
    return frozenset(r["p"] for r in t.where((F.col("n") >= share * total) & (F.col("beside") >= beside)).select("p").collect())


class _Edges:
    """Rows p, x, n that leave in batches of bounded size."""

    SCHEMA = "p string, x string, n bigint"

    def __init__(self):
        self.rows: list[tuple[str, str, int]] = []

    def add(self, p: str, x: str, n: int) -> None:
        self.rows.append((p, x, n))

    def full(self) -> bool:
        return len(self.rows) >= PAIRS

    def batch(self) -> pa.RecordBatch:
        p, x, n = zip(*self.rows) if self.rows else ((), (), ())
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(x, pa.string()), pa.array(n, pa.int64())], names=["p", "x", "n"])


def parts(value: str) -> list[str]:
    """The value's parts between brackets, dashes, colons, slashes and full stops, as joined tokens."""
    return [p for p in (" ".join(tokens(x)) for x in PARTS.split(value)) if p]


def remarks(df: DataFrame, value: str, *, share: float = 5e-4, beside: int = 5) -> frozenset[str]:
    """Parts in at least ``share`` of the rows that stand beside ``beside`` different parts, and beside more than those do on
    average (by rows), and that are hardly ever (one time in twenty) a whole value."""
    v = df.select(F.col(value).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))

    def run(batches):
        for b in batches:
            left, right, n, rows = [], [], [], []
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ps = parts(x)
                edges = dict.fromkeys(e for p, q in zip(ps, ps[1:]) if p != q for e in ((p, q), (q, p))) if len(ps) != 1 else {(ps[0], ""): None}
                met = set()
                for p, q in edges:
                    left.append(p)
                    right.append(q)
                    n.append(k)
                    rows.append(0 if p in met else k)
                    met.add(p)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64()), pa.array(rows, pa.int64())], names=["p", "x", "n", "rows"])

    total = v.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edge = v.mapInArrow(run, "p string, x string, n bigint, rows bigint").groupBy("p", "x").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    beside_n, alone_n = F.sum(F.when(F.col("x") != "", F.col("rows")).otherwise(0)), F.sum(F.when(F.col("x") == "", F.col("rows")).otherwise(0))
    degree = edge.groupBy("p").agg(F.count_if(F.col("x") != "").alias("degree"), beside_n.alias("n"), alone_n.alias("alone"))
    around = edge.where("x <> ''").join(degree.select(F.col("p").alias("x"), F.col("degree").alias("theirs")), "x")
    around = around.groupBy("p").agg((F.sum(F.col("theirs") * F.col("n")) / F.sum("n")).alias("theirs"))
    t = degree.where((F.col("n") >= share * total) & (F.col("degree") >= beside) & (20 * F.col("alone") <= F.col("n"))).join(around, "p").where(F.col("degree") > F.col("theirs"))
    return frozenset(r["p"] for r in t.select("p").collect())


class Likeness:
    """Likeness of two wordings (joined tokens): weighted share of tokens that agree or have a common stem."""

    def __init__(self, counts: dict[str, int]):
        self.total = max(counts.values(), default=1)
        self.counts = counts

    def weight(self, t: str) -> float:
        return math.log(1 + 2 * self.total / self.counts.get(t, 1))

    @staticmethod
    def stem(a: str, b: str) -> float:
        if a == b:
            return 1.0
        k, n = 0, max(len(a), len(b))
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k / n if k >= 4 and 2 * k >= n else 0.0

    def __call__(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        x, y = a.split(), b.split()
        if not x or not y:
            return 0.0
        s = sum(self.weight(t) * max(self.stem(t, u) * self.weight(u) for u in y) for t in x)
        n = math.sqrt(sum(self.weight(t) ** 2 for t in x) * sum(self.weight(u) ** 2 for u in y))
        return min(1.0, s / n)


def likeness(pairs: DataFrame, counts: dict[str, int]) -> DataFrame:
    """w1, w2, alike of distinct pairs of wordings."""
    shared = pairs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        f = Likeness(shared.value)
        for b in batches:
            x, y = b.column(0), b.column(1)
            yield pa.RecordBatch.from_arrays([x, y, pa.array([f(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())], names=["w1", "w2", "alike"])

    return pairs.select("w1", "w2").mapInArrow(run, "w1 string, w2 string, alike double")


def translations(blocks: DataFrame, counts: dict[str, int], *, rounds: int = 3, prior: float = 4.0, rare: float = 0.5) -> DataFrame:
    """w1, w2, alike, role (log of the translation weight over w1's own share), tot (expected occurrences that w2 explains), c (those of w1
    among them), by_chance (what c would be if w2 explained w1 no more than any other wording).

    ``blocks``: occ BIGINT (an occurrence of w1), w1, w2 (a wording of its block), distinct rows; read once a round, so checkpoint it. With a
    column voice an occurrence counts as so much of one."""
    voice = F.col("voice") if "voice" in blocks.columns else F.lit(1.0)
    blocks = blocks.select("occ", "w1", "w2", voice.alias("voice"))
    own = blocks.groupBy("occ").agg(F.first("w1").alias("w1"), F.first("voice").alias("voice")).groupBy("w1").agg(F.sum("voice").alias("n1"))
    whole = own.agg(F.sum("n1").alias("whole"))
    own = own.crossJoin(F.broadcast(whole)).select("w1", (F.col("n1") / F.col("whole")).alias("p1"))
    base = likeness(blocks.select("w1", "w2").distinct(), counts).join(own, "w1")
    base = base.withColumn("start", F.col("p1") * F.exp(prior * F.col("alike")))
    now = base.withColumn("t", F.col("start"))
    for _ in range(rounds):
        e = blocks.join(now.select("w1", "w2", "t", "p1"), ["w1", "w2"])
        e = e.withColumn("post", F.col("voice") * F.col("t") / (F.sum("t").over(Window.partitionBy("occ")) + F.col("p1")))
        c = e.groupBy("w1", "w2").agg(F.sum("post").alias("c"))
        c = c.withColumn("tot", F.sum("c").over(Window.partitionBy("w2")))
        now = base.join(c, ["w1", "w2"]).withColumn("t", (F.col("c") + rare * F.col("start")) / (F.col("tot") + rare))
    return now.select("w1", "w2", "alike", F.log(F.col("t") / F.col("p1")).alias("role"), "tot", "c", (F.col("p1") * F.col("tot")).alias("by_chance"))
