"""Reading level of texts: a linear pairwise ranker on vocabulary and syntax features, calibrated by isotonic regression.

Every feature is a mean over the text's words, so markup, line breaks and punctuation don't move it. Vocabulary: word length, shares
of long words, and the share of each word in ``buckets`` hashed classes. Syntax: endings that mark abstract nouns, adverbs and
participles, connectives and other function words, and which kinds of words follow each other (pairs of ``CLASSES`` word classes:
a short word is its own kind, a longer one that of its ending). The ranker is fitted on
pairs of labelled texts of different levels (logistic loss on the difference of their features); scores from models
that haven't seen a text are fitted to the levels by isotonic regression, whose value, rounded, is the level.

The fit uses at most ``max_labelled`` labelled texts, chosen by a hash of their ids: bounded work for the driver. Every
text is scored. A score is the mean of its words' weights, so one look-up a word.

Defined results: texts of another language, null texts and texts under ``min_words`` words split at white space give no row;
a document with conflicting labels counts with the lowest; with no labels at all the level is null; with one labelled level every text has that level; repeated rows stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MARKUP = re.compile(r"<[^<>]{0,400}>|&[a-zA-Z]{2,8};|&#\d{1,6};|https?://\S+")
_WORDS = re.compile(r"[^\W\d_]+").findall
# Endings and function words whose shares are features.
ENDINGS = ("tion", "sion", "ity", "ment", "ness", "ance", "ence", "ism", "ly", "ed", "ing", "ive", "al", "ous", "ible", "able", "ise", "ize", "ate", "er", "est")
FUNCTION = (
    "the of and to in that which who whose whom whereas although because since while when if unless until before after "
    "thereby therefore moreover however furthermore notwithstanding by with from as than such these this those it we you i "
    "he she they is are was were be been being has have had do does can could may might must should will would not no"
).split()
LONG = (4, 6, 8, 10, 12, 14)
CLASSES = 32


def word_class(word: str) -> int:
    """The kind of a word by its form."""
    return zlib.crc32((word if len(word) <= 3 else "-" + word[-2:]).encode("utf-8", "replace")) % CLASSES


def word_features(word: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of one word."""
    at = [0] + [1 + k for k, n in enumerate(LONG) if len(word) > n]
    values = [min(len(word), 24) / 5.0] + [1.0] * (len(at) - 1)
    base = 1 + len(LONG)
    if len(word) > 5:
        at += [base + k for k, e in enumerate(ENDINGS) if word.endswith(e)]
    base += len(ENDINGS)
    if word in FUNCTION:
        at.append(base + FUNCTION.index(word))
    base += len(FUNCTION)
    at.append(base + zlib.crc32(word.encode()) % buckets)
    values += [1.0] * (len(at) - len(values))
    return np.array(at), np.array(values)


def n_features(buckets: int) -> int:
    """Features of words, then those of pairs of neighbours."""
    return n_word_features(buckets) + CLASSES * CLASSES


def n_word_features(buckets: int) -> int:
    return 1 + len(LONG) + len(ENDINGS) + len(FUNCTION) + buckets


def words(text: str) -> list[str]:
    return _WORDS(_MARKUP.sub(" ", text.lower()) if "<" in text or "&" in text or "http" in text else text.lower())


def text_features(text: str, buckets: int, cache: dict) -> tuple[list[int], list[float]]:
    """Mean features of a text, sparse."""
    total = np.zeros(n_features(buckets))
    ws = words(text)
    counts: dict[str, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    for w, c in counts.items():
        if (f := cache.get(w)) is None:
            f = cache[w] = word_features(w, buckets)
        total[f[0]] += c * f[1]
    kinds = np.array([word_class(w) for w in ws], np.int64)
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) if len(ws) > 1 else 0
    total[n_word_features(buckets) :] += pairs
    total /= max(1, len(ws))
    at = np.flatnonzero(total)
    return at.tolist(), total[at].tolist()


def fit_ranker(x: np.ndarray, level: np.ndarray, *, pairs: int, steps: int, l2: float, seed: int = 7) -> np.ndarray:
    """Weights such that texts of a higher level score higher (logistic loss on pairs, Adam steps)."""
    rng = np.random.default_rng(seed)
    n = len(level)
    i, j = rng.integers(0, n, pairs), rng.integers(0, n, pairs)
    keep = level[i] != level[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return np.zeros(x.shape[1], x.dtype)
    swap = level[i] < level[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    gap = (level[i] - level[j]).astype(np.float64)
    x = np.ascontiguousarray(x, np.float32)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = x @ w
        r = gap / (1.0 + np.exp(np.clip(s[i] - s[j] - gap, -30, 30)))
        c = ((np.bincount(j, r, n) - np.bincount(i, r, n)) / len(i)).astype(np.float32)
        g = c @ x + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, y in zip(score[order], level[order]):
        blocks.append([float(y), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[3] = b[3]
    xs = [x for b in blocks for x in (b[2], b[3])]
    return np.array(xs), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    """Word weights and the calibration."""

    def __init__(self, buckets: int, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.buckets, self.weights, self.knots = buckets, weights, knots

    def scores(self, texts: list[str], cache: dict) -> np.ndarray:
        """Scores of texts; ``cache`` holds the number of each word in the tables of weights and kinds."""
        out = np.zeros(len(texts))
        after = self.weights[n_word_features(self.buckets) :]
        for k, t in enumerate(texts):
            ws = np.array([cache[w] for w in words(t)], np.int64)
            if len(ws):
                weight, kind = cache.tables()
                kinds = kind[ws]
                out[k] = (weight[ws].sum() + after[kinds[:-1] * CLASSES + kinds[1:]].sum()) / len(ws)
            if len(cache) > 2_000_000:
                cache.clear()
        return out

    def cache(self) -> dict:
        model = self

        class Words(dict):
            def __init__(self):
                super().__init__()
                self.weight, self.kind = np.zeros(1024), np.zeros(1024, np.int64)

            def __missing__(self, word: str) -> int:
                n = len(self)
                if n == len(self.weight):
                    self.weight, self.kind = np.append(self.weight, np.zeros(n)), np.append(self.kind, np.zeros(n, np.int64))
                at, values = word_features(word, model.buckets)
                self.weight[n], self.kind[n] = model.weights[at] @ values, word_class(word)
                self[word] = n
                return n

            def tables(self) -> tuple[np.ndarray, np.ndarray]:
                return self.weight, self.kind

        return Words()

    def levels(self, scores: np.ndarray) -> np.ndarray:
        return np.floor(np.interp(scores, *self.knots) + 0.5).astype(np.int32)


def fit(features: list[tuple[list[int], list[float]]], level: np.ndarray, *, buckets: int, pairs: int = 40_000, steps: int = 80, l2: float = 1e-4, folds: int = 3) -> Model:
    """The ranker on all labelled texts, calibrated on scores of texts left out."""
    x = np.zeros((len(level), n_features(buckets)), np.float32)
    for k, (at, values) in enumerate(features):
        x[k, at] = values
    mean, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 0, 1.0 / (spread + 0.25 * np.sqrt(np.maximum(mean, 1e-8))), 0.0).astype(np.float32)
    z = (x - mean) * scale
    w = fit_ranker(z, level, pairs=pairs, steps=steps, l2=l2)
    out = np.zeros(len(level))
    fold = np.arange(len(level)) % folds
    if len(level) >= 6 * folds:
        for f in range(folds):
            wf = fit_ranker(z[fold != f], level[fold != f], pairs=pairs, steps=steps, l2=l2)
            out[fold == f] = z[fold == f] @ wf
    else:
        out = z @ w
    # a text's score is the mean of word weights: the constant shift goes into the knots
    knots = isotonic(out, level.astype(np.float64))
    return Model(buckets, (w * scale).astype(np.float64), (knots[0] + float((mean * scale) @ w), knots[1]))


def reading_levels(
    documents: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    language: str = "en",
    label: str = "reading_level",
    min_words: int = 50,
    buckets: int = 2048,
    max_labelled: int = 6_000,
) -> DataFrame:
    """key, reading_level, score: one row for each text of the language with ``min_words`` words or more."""
    spark = documents.sparkSession
    d = documents.where(F.col(text).isNotNull())
    if lang:
        d = d.where(F.col(lang) == language)
    d = d.select(F.col(key).alias("key"), F.col(text).alias("t"))
    chosen = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("l_key"), F.col(label).cast("int").alias("level")).groupBy("l_key").agg(F.min("level").alias("level"))
    chosen = chosen.orderBy(F.xxhash64("l_key"), "l_key").limit(max_labelled)
    known = d.join(F.broadcast(chosen), F.col("key") == F.col("l_key")).select("level", "t")

    def features(batches):
        cache: dict = {}
        for b in batches:
            levels, fs = [], []
            for level, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(t.split()) >= min_words:
                    levels.append(level)
                    fs.append(text_features(t, buckets, cache))
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array([a for a, _ in fs], pa.list_(pa.int32())), pa.array([v for _, v in fs], pa.list_(pa.float32()))], names=["level", "at", "v"])

    rows = known.mapInArrow(features, "level int, at array<int>, v array<float>").toArrow()
    order = sorted(range(rows.num_rows), key=lambda k: (zlib.crc32(str((rows["at"][k].as_py()[:20], rows["v"][k].as_py()[:3])).encode()), k))
    level = np.array(rows["level"].to_pylist(), np.int32)[order] if rows.num_rows else np.zeros(0, np.int32)
    ats, vs = rows["at"].to_pylist(), rows["v"].to_pylist()
    model = fit([(ats[k], vs[k]) for k in order], level, buckets=buckets) if len(level) else None
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        cache = m.cache() if m else None
        for b in batches:
            keep = [k for k, t in enumerate(b.column(1).to_pylist()) if len(t.split()) >= min_words]
            part = b.take(pa.array(keep, pa.int64()))
            texts = part.column(1).to_pylist()
            if m:
                s = m.scores(texts, cache)
                lv = pa.array(m.levels(s), pa.int32())
                sc = pa.array(s, pa.float64())
            else:
                lv, sc = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), lv, sc], names=["key", "reading_level", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return d.mapInArrow(score, f"key {kind}, reading_level int, score double").select(F.col("key").alias(key), "reading_level", "score")
