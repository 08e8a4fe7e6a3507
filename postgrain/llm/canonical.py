"""Freely typed values to the entries of a reference list, by token repair and soft TF-IDF.

Each token of a value that the reference vocabulary doesn't know is joined to the vocabulary's tokens by edit distance (swaps of
neighbours count as one edit): both sides meet on their deletion neighbourhoods, an equality join that finds every
token within the distance allowed for its length, and the distance itself decides. Then complete entries are ranked by soft
TF-IDF: the cosine of the corrected tokens with the entry's, each common token weighted by how near the typed one
was. An entry stands for several written names; tokens of the value that no entry knows count with the highest weight, so a
value that says more than the entry isn't one. Under the threshold the value is reported as ``none``.

The reference list (with its names) is broadcast after a check of its size. Values are resolved once a worker and remembered
while ``remember`` allows; there is no shuffle, so a value that fills a third of all rows is no hot key. A longer list is
met by joins instead (``map_by_join``), with the same result: distinct tokens join the vocabulary on their deletion neighbourhoods, distinct
values join the postings of the corrected tokens.

Defined results: null and empty values give no row, blank ones are ``none``; equal best scores go to the nearer tokens, then the smaller
key; an empty reference list gives ``none`` throughout; repeated rows stay; long values are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_REFERENCE_ROWS = 200_000
NONE = "none"


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


_TOKENS = re.compile(r"[^\W_]+").findall


def tokens(text: str) -> list[str]:
    return _TOKENS(fold(text).replace("'", "").replace("’", ""))


def allowed(n: int) -> int:
    """Edits allowed for a token of that length."""
    return 0 if n <= 2 else 1 if n <= 5 else 2


def deletions(word: str, depth: int) -> set[str]:
    """The word with up to ``depth`` characters left out."""
    out, last = {word}, {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits from a to b, a swap of neighbours being one; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


PARTS = re.compile(r"\s[–—-]\s|[:/|()\[\]]|\.\s")
RAREST = 1e-4  # share of rows below which tokens weigh alike


class Reference:
    """The reference list: written names of entries, their vocabulary and weights.

    A token weighs by its rarity among the names. Where ``shares`` (token to its share of the column's rows) is given, that counts
    too, an unknown token counts by it, and a token that no edit explains may stand for one with a common stem; ``remarks``: parts of values
    to leave out."""

    def __init__(
        self, names: Iterable[tuple[str, str]], ignore: frozenset[str] = frozenset(), decoration: str = "", segments: str = "", threshold: float = 0.72,
        shares: dict[str, float] | None = None, remarks: frozenset[str] = frozenset(), stem: float = 0.4, unknown: float = 0.8,
    ):
        self.decoration = re.compile(decoration, re.I) if decoration else None
        self.segments = re.compile(segments) if segments else None
        self.ignore, self.threshold, self.shares, self.remarks, self.stem = ignore, threshold, shares, remarks, stem
        entries = sorted({(k, tuple(sorted(set(tokens(self.strip(n)))))) for k, n in names if n})
        self.entries = [e for e in entries if e[1]]
        df: dict[str, int] = defaultdict(int)
        for _, ts in self.entries:
            for t in ts:
                df[t] += 1
        n = len(self.entries)
        self.idf = {t: math.log(1 + n / c) for t, c in df.items()}
        self.unknown = math.log(1 + n)
        if shares is not None:
            self.idf = {t: (w / self.unknown) ** 0.6 * self.rarity(t) for t, w in self.idf.items()}
            self.unknown = math.sqrt(unknown)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.norm = []
        for e, (_, ts) in enumerate(self.entries):
            self.norm.append(math.sqrt(sum(self.idf[t] ** 2 for t in ts)))
            for t in ts:
                self.by_token[t].append(e)
        self.deleted: dict[str, list[str]] = defaultdict(list)
        self.begins: dict[str, list[str]] = defaultdict(list)
        for t in df:
            for x in deletions(t, allowed(len(t))):
                self.deleted[x].append(t)
            if len(t) >= 4:
                self.begins[t[:4]].append(t)
        self.repaired: dict[str, list[tuple[str, float]]] = {}

    def rarity(self, token: str) -> float:
        """Weight of a token by its share of the column's rows, at most 1."""
        return (math.log(1 + 1 / max(self.shares.get(token, 0.0), RAREST)) / math.log(1 + 1 / RAREST)) ** 0.4

    def strip(self, value: str) -> str:
        if self.decoration:
            value = self.decoration.sub(" ", value)
        if self.remarks:
            value = " . ".join(x for x in PARTS.split(value) if " ".join(tokens(x)) not in self.remarks)
        return value

    def repair(self, token: str) -> list[tuple[str, float]]:
        """Vocabulary tokens nearest to the token, with their similarity."""
        if (r := self.repaired.get(token)) is not None:
            return r
        if token in self.idf:
            r = [(token, 1.0)]
        else:
            most = allowed(len(token))
            best, r = most + 1, []
            if most and not token.isdigit():
                for t in sorted({t for x in deletions(token, most) for t in self.deleted.get(x, ())}):
                    m = min(most, allowed(len(t)))
                    d = distance(token, t, m)
                    if d <= m and d <= best:
                        if d < best:
                            best, r = d, []
                        r.append((t, 1 - d / max(len(t), len(token))))
            if not r and self.shares is not None:
                r = self.stems(token)
        if len(self.repaired) > 500_000:
            self.repaired.clear()
        self.repaired[token] = r
        return r

    def stems(self, token: str) -> list[tuple[str, float]]:
        """Vocabulary tokens with the longest common beginning, if it is at least ``stem`` of the longer word."""
        best, r = self.stem - 1e-9, []
        for t in sorted(self.begins.get(token[:4], ()) if len(token) >= 4 else ()):
            k, n = 4, max(len(t), len(token))
            while k < min(len(t), len(token)) and t[k] == token[k]:
                k += 1
            if k / n > best + 1e-9:
                best, r = k / n, []
            if abs(k / n - best) <= 1e-9:
                r.append((t, k / n))
        return r

    def split(self, ts: list[str]) -> list[str]:
        """Two tokens that the vocabulary writes as one joined, one that it writes as two taken apart."""
        out, k = [], 0
        while k < len(ts):
            t = ts[k]
            if k + 1 < len(ts) and t + ts[k + 1] in self.idf:
                out.append(t + ts[k + 1])
                k += 1
            elif t not in self.idf and (j := next((j for j in range(3, min(len(t), 40) - 2) if t[:j] in self.idf and t[j:] in self.idf), 0)):
                out += [t[:j], t[j:]]
            else:
                out.append(t)
            k += 1
        return out

    def score(self, ts: list[str]) -> tuple[float, str]:
        """The best entry for the tokens."""
        got: dict[int, dict[str, float]] = defaultdict(dict)
        square = 0.0
        for t in dict.fromkeys(ts):
            near = self.repair(t)
            if not near:
                w = self.unknown if self.shares is None else self.unknown * self.rarity(t)
                square += (0.3 * w if t in self.ignore else w) ** 2
                continue
            square += max(self.idf[c] for c, _ in near) ** 2
            for c, s in near:
                for e in self.by_token[c]:
                    got[e][c] = max(got[e].get(c, 0.0), s)
        best = (0.0, NONE)
        for e, cs in got.items():
            s = sum(self.idf[c] ** 2 * x for c, x in cs.items()) / (self.norm[e] * math.sqrt(square))
            if s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and self.entries[e][0] < best[1]):
                best = (s, self.entries[e][0])
        return best

    def options(self, value: str) -> list[list[str]]:
        """The ways to read a value, the earlier before the later: whole and in parts, with ignored words and without."""
        text = self.strip(value)
        tries = [text]
        if self.segments and len(parts := [p for p in self.segments.split(text) if p.strip()]) > 1:
            tries += parts
        out = []
        for t in tries:
            ts = tokens(t) if self.shares is None else self.split(tokens(t))
            kept = [x for x in ts if x not in self.ignore and not x.isdigit()] if self.segments else ts
            out += [o for o in ((ts, kept) if kept != ts else (ts,)) if o]
        return out

    def resolve(self, value: str) -> tuple[str, float]:
        """Key of the entry, or ``none``, and the score."""
        best = (0.0, NONE)
        for option in self.options(value):
            s, k = self.score(option)
            if s > best[0] + 1e-12:
                best = (s, k)
        return (best[1], best[0]) if best[0] >= self.threshold else (NONE, best[0])


def listed(names: DataFrame) -> list[tuple[str, str]]:
    """The reference list (ref_key, name), after a check of its size."""
    rows = [tuple(r) for r in names.select(F.col("ref_key").cast("string"), "name").limit(MAX_REFERENCE_ROWS + 1).collect()]
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError("the reference list is too large to broadcast")
    return rows


def vocabulary(rows: list[tuple[str, str]], decoration: str = "") -> frozenset[str]:
    """Tokens of the list's names."""
    pattern = re.compile(decoration, re.I) if decoration else None
    return frozenset(t for _, n in rows if n for t in tokens(pattern.sub(" ", n) if pattern else n))


def map_to_list(df: DataFrame, names: DataFrame, *, key: str, value: str, remember: int = 200_000, **how) -> DataFrame:
    """row_id, ref_key, score: one row for each value that is neither null nor empty. ``names``: ref_key STRING, name STRING; ``how``: as for ``Reference``."""
    if how.get("shares") is None and names.limit(MAX_REFERENCE_ROWS + 1).count() > MAX_REFERENCE_ROWS:
        return map_by_join(df, names, key=key, value=value, **how)
    shared = df.sparkSession.sparkContext.broadcast((listed(names), how))

    def run(batches):
        ref = Reference(shared.value[0], **shared.value[1])
        known: dict[str, tuple[str, float]] = {}
        for b in batches:
            keys, scores = [], []
            for v in b.column(1).to_pylist():
                if (r := known.get(v)) is None:
                    if len(known) >= remember:
                        known.clear()
                    r = known[v] = ref.resolve(v)
                keys.append(r[0])
                scores.append(r[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(scores, pa.float64())], names=["row_id", "ref_key", "score"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(value) != "").select(F.col(key).alias("row_id"), F.col(value).alias("v"))
    return rows.mapInArrow(run, f"row_id {kind}, ref_key string, score double")


def repaired_tokens(df: DataFrame, names: DataFrame, *, value: str) -> DataFrame:
    """token, nearest (sorted vocabulary tokens at the least distance allowed): one row for each distinct token of the column that isn't a number."""
    shared = df.sparkSession.sparkContext.broadcast(listed(names))

    def run(batches):
        ref = Reference(shared.value)
        for b in batches:
            ts = sorted({t for v in b.column(0).to_pylist() for t in tokens(v) if not t.isdigit()})
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array([sorted(t for t, _ in ref.repair(x)) for x in ts], pa.list_(pa.string()))], names=["token", "nearest"])

    return df.where(F.col(value) != "").select(F.col(value).alias("v")).distinct().mapInArrow(run, "token string, nearest array<string>").distinct()


def _deletion_keys(words: DataFrame) -> DataFrame:
    """word, key: every word with the characters left out that its length allows."""

    def run(batches):
        for b in batches:
            w, k = [], []
            for x in b.column(0).to_pylist():
                ks = deletions(x, allowed(len(x)))
                w += [x] * len(ks)
                k += ks
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.string())], names=["word", "key"])

    return words.mapInArrow(run, "word string, key string")


def map_by_join(df: DataFrame, names: DataFrame, *, key: str, value: str, **how) -> DataFrame:
    """As ``map_to_list`` for a list of any length, without ``shares``: nothing of the list is broadcast or collected."""
    from postgrain.session import checkpointed

    if how.get("shares") is not None:
        raise ValueError("weights of the column need a list that can be broadcast")
    shared = df.sparkSession.sparkContext.broadcast(how)

    def entry_tokens(batches):
        ref = Reference([], **shared.value)
        for b in batches:
            ts = [sorted(set(tokens(ref.strip(n)))) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.list_(pa.string()))], names=["ref_key", "ts"])

    def read(batches):
        ref = Reference([], **shared.value)
        for b in batches:
            v, o, ts = [], [], []
            for x in b.column(0).to_pylist():
                for k, option in enumerate(ref.options(x)):
                    v.append(x)
                    o.append(k)
                    ts.append(list(dict.fromkeys(option)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(o, pa.int32()), pa.array(ts, pa.list_(pa.string()))], names=["v", "o", "ts"])

    named = names.where("name <> ''").select(F.col("ref_key").cast("string"), "name").mapInArrow(entry_tokens, "ref_key string, ts array<string>")
    entries = checkpointed(named.where(F.size("ts") > 0).distinct().withColumn("e", F.xxhash64("ref_key", "ts")))
    n = entries.count()
    df_of = entries.select(F.explode("ts").alias("c")).groupBy("c").agg(F.count("*").alias("df"))
    idf = checkpointed(df_of.select("c", F.log(1 + F.lit(float(n)) / F.col("df")).alias("idf")))
    posting = entries.select("e", "ref_key", F.explode("ts").alias("c")).join(idf, "c")
    norm = posting.groupBy("e").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    asked = df.where(F.col(value) != "").select(F.col(value).alias("v")).distinct().mapInArrow(read, "v string, o int, ts array<string>")
    asked = checkpointed(asked)
    typed = asked.select(F.explode("ts").alias("t")).distinct()
    exact = typed.join(idf.select(F.col("c").alias("t")), "t").select("t", F.col("t").alias("c"), F.lit(1.0).alias("s"))
    odd = typed.join(idf.select(F.col("c").alias("t")), "t", "left_anti").where(~F.col("t").rlike("^\\d+$") & (F.length("t") > 2))
    met = _deletion_keys(odd).join(_deletion_keys(idf.select("c")).select(F.col("word").alias("c"), "key"), "key").select(F.col("word").alias("t"), "c").distinct()

    def near(batches):
        for b in batches:
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            most = [min(allowed(len(p)), allowed(len(q))) for p, q in zip(x, y)]
            d = [distance(p, q, m) for p, q, m in zip(x, y, most)]
            keep = pa.array([a <= m for a, m in zip(d, most)])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(d, pa.int32()).filter(keep)], names=["t", "c", "d"])

    close = met.mapInArrow(near, "t string, c string, d int")
    close = close.join(close.groupBy("t").agg(F.min("d").alias("d")), ["t", "d"]).select("t", "c", (1 - F.col("d") / F.greatest(F.length("t"), F.length("c"))).alias("s"))
    repair = checkpointed(exact.unionByName(close).join(idf, "c"))
    unknown = float(math.log(1 + n))
    weight = repair.groupBy("t").agg(F.max("idf").alias("w"))
    ignored = F.col("t").isin(*sorted(how.get("ignore") or [])) if how.get("ignore") else F.lit(False)
    parts = asked.select("v", "o", F.explode("ts").alias("t"))
    w = F.coalesce("w", F.when(ignored, 0.3 * unknown).otherwise(unknown))
    square = parts.join(weight, "t", "left").groupBy("v", "o").agg(F.sqrt(F.sum(w * w)).alias("square"))
    got = parts.join(repair.select("t", "c", "s"), "t").groupBy("v", "o", "c").agg(F.max("s").alias("s"))
    scored = got.join(posting, "c").groupBy("v", "o", "e", "ref_key").agg(F.sum(F.col("idf") * F.col("idf") * F.col("s")).alias("dot"))
    scored = scored.join(norm, "e").join(square, ["v", "o"]).withColumn("score", F.col("dot") / (F.col("norm") * F.col("square")))
    best = scored.groupBy("v").agg(F.min_by(F.struct("ref_key", "score"), F.struct(-F.round("score", 10), "o", "ref_key")).alias("b"))
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(value) != "").select(F.col(key).cast(kind).alias("row_id"), F.col(value).alias("v")).join(best, "v", "left")
    sure = F.col("b.score") >= how.get("threshold", 0.72)
    return rows.select("row_id", F.when(sure, F.col("b.ref_key")).otherwise(NONE).alias("ref_key"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
