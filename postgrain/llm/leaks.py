"""Evaluation passages inside training documents, by a positional inverted index over shards of documents.

The index is partitioned by document: each task stores the postings of its shard's documents and answers every test passage on it, so
postings are never shuffled and no document meets another.

Exact phrases. Words count as letters and digits only, wherever spaces, hyphens or line ends break or join them. So the text is squeezed
to its letters and digits, and the terms of the index are its grams of ``gram`` characters with their places (a power of two, at most
16 and at most half of the shortest window of ``min_words`` words). Only grams of test passages get postings; nothing else can match.
A window of ``min_words`` consecutive test words takes the posting list of its rarest gram in the shard, adjusted by the gram's
offset, and intersects it with the offset-adjusted lists of its other grams, the rarest first. What is left is compared
character by character, and whole words within the common run are counted.

A proximity match (``near``) is a window of ``min_words`` passage words of which a share of at least ``near_share`` stands in the document
in the passage's order, with alignments that differ by at most ``slack`` places; so words changed, left out or put in don't hide a
passage. Its terms are words. With ``k`` words to be met, one of the ``min_words - k + 1`` rarest of the window is met: their
offset-adjusted postings are intersected with those of the other terms with a tolerance of ``slack``, dropped as soon as too many are
missed, and what is left is decided exactly.

Words of a passage are runs of letters and digits, lower-cased, after compatibility normalisation and removal of invisible characters and
combining marks; so case, spacing, punctuation, line breaks and invisible characters don't count.

The test passages are broadcast; their table is checked against ``MAX_ITEMS_BYTES`` first and read in blocks of passages
beyond it, each block one pass.

Defined results: null and empty texts match nothing; passages under ``min_words`` words have no window and match nothing; a
document that holds a passage twice, or a repeated row, gives one row a (document id, passage id); long texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

MAX_ITEMS_BYTES = 32_000_000
_WORDS = re.compile(r"[^\W_]+").findall
_OTHER = re.compile(r"[\W_]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")


def plain(text: str) -> str:
    """Lower case in compatibility form without invisible characters."""
    return (text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))).lower()


def tokens(text: str) -> list[str]:
    """The text's words."""
    return _WORDS(plain(text))


def squeezed(text: str) -> np.ndarray:
    """Code points of the text's letters and digits."""
    return np.frombuffer(_OTHER.sub("", plain(text)).encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) characters from each place on."""
    h, n, base = chars.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while n < size and len(h):
        h = h[:-n] * np.uint64(base) + h[n:]
        h ^= h >> np.uint64(29)
        n, base = 2 * n, base * base % (1 << 64) | 1
    return h[: max(0, len(chars) - size + 1)]


class Passages:
    """Test passages as term numbers, and all their windows of ``min_words`` words."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.m = min_words
        self.vocabulary: dict[str, int] = {}
        rows, owner, offset, self.lengths, self.words = [], [], [], {}, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(text or "")]
            self.lengths[item], self.words[item] = len(ids), ids
            for k in range(len(ids) - min_words + 1):
                rows.append(ids[k : k + min_words])
                owner.append(item)
                offset.append(k)
        self.windows = np.array(rows, np.int32).reshape(-1, min_words)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int32)


class Shard:
    """Postings of some documents: for each test term its positions in the stream of all words, ascending."""

    def __init__(self, texts: list[str | None], passages: Passages, slack: int = 0):
        get, gap = passages.vocabulary.get, passages.m + slack
        stream: list[int | None] = []
        starts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            starts[k] = len(stream)
            if t:
                stream += map(get, tokens(t))
                stream += [None] * gap  # no match crosses documents
        self.starts = starts
        self.terms = np.array([-1 if x is None else x for x in stream], np.int32)
        at = np.flatnonzero(self.terms >= 0)
        order = np.argsort(self.terms[at], kind="stable")
        self.positions = at[order]
        self.df = np.bincount(self.terms[at], minlength=len(passages.vocabulary))
        self.begin = np.cumsum(self.df) - self.df

    def near(self, p: Passages, slack: int, least: int, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place of its first word by the alignment of a word met, place of that word) where ``least`` words are met in order."""
        none = np.zeros(0, np.int64)
        if not len(p.windows) or not len(self.positions):
            return none, none, none
        rare, out = np.argsort(self.df[p.windows], axis=1, kind="stable"), []
        for a in range(p.m - least + 1):  # the rarest word met has this rank; those before it are missed
            counts = self.df[np.take_along_axis(p.windows, rare[:, a : a + 1], 1)[:, 0]]
            total = np.cumsum(counts)
            lo = 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, "right")))
                out.append(self._near(p, slack, least, rare, a, np.arange(lo, hi), counts[lo:hi]))
                lo = hi
        return tuple(np.concatenate(x) for x in zip(*out))

    def _near(self, p, slack, least, rare, a, windows, n):
        window = np.repeat(windows, n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = self.positions[self.begin[p.windows[window, rare[window, a]]] + within]
        first = at - rare[window, a]
        missed = np.full(len(window), a, np.int8)
        stream, pad = self.padded(p.m + slack)
        for j in range(a + 1, p.m):
            o = rare[window, j]
            term, place = p.windows[window, o], first + o + pad
            met = stream[place] == term
            for d in range(1, slack + 1):
                met |= (stream[place - d] == term) | (stream[place + d] == term)
            missed += ~met
            keep = missed <= p.m - least
            window, first, at, missed = window[keep], first[keep], at[keep], missed[keep]
            if not len(window):
                return window, first, at
        words, one = np.unique(np.stack([window, first, self.document(at)]), axis=1, return_index=True)
        window, first, at = window[one], first[one], at[one]
        straight = stream[first[:, None] + np.arange(p.m) + pad] == p.windows[window]
        keep = straight.sum(axis=1) >= least  # words at one alignment are in order
        left = np.flatnonzero(~keep)
        hits = self.hits(p.windows[window[left]], first[left], slack)
        for low in range(slack + 1):  # alignments from low to low + slack
            band = hits[:, :, low : low + slack + 1]
            some = np.flatnonzero(~keep[left] & (band.any(axis=2).sum(axis=1) >= least))
            keep[left[some]] = in_order(band[some]) >= least
        return window[keep], first[keep], at[keep]

    def padded(self, pad: int) -> tuple[np.ndarray, int]:
        """The stream with ``pad`` places without a term at both ends."""
        if getattr(self, "_pad", None) != pad:
            self._pad, self._stream = pad, np.pad(self.terms, pad, constant_values=-1)
        return self._stream, pad

    def hits(self, words: np.ndarray, first: np.ndarray, slack: int, low=None, high=None) -> np.ndarray:
        """Whether each word of a row (-2: none) stands at each place from -slack to slack of its alignment, between ``low`` and ``high``."""
        place = first[:, None, None] + np.arange(words.shape[1])[None, :, None] + np.arange(-slack, slack + 1)[None, None, :]
        inside = (place >= (0 if low is None else low[:, None, None])) & (place < (len(self.terms) if high is None else high[:, None, None]))
        return inside & (self.terms[np.clip(place, 0, len(self.terms) - 1)] == words[:, :, None])

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def in_order(hits: np.ndarray) -> np.ndarray:
    """Most words met in order in each row of (row, word, alignment): the longest common subsequence within a band."""
    rows, words, band = hits.shape
    best = np.zeros((rows, band + 1), np.int32)  # the last column stays under what lies right of the band
    for j in range(words):
        new = best[:, :band] + hits[:, j]
        np.maximum(new, best[:, 1:], out=new)
        best[:, :band] = np.maximum.accumulate(new, axis=1)
    return best[:, band - 1] if rows else np.zeros(0, np.int32)


def longest_runs(hits: np.ndarray) -> np.ndarray:
    """Longest run of consecutive words at one alignment in each row of (row, word, alignment)."""
    run = np.zeros((hits.shape[0], hits.shape[2]), np.int32)
    longest = np.zeros(hits.shape[0], np.int32)
    for j in range(hits.shape[1]):
        run = (run + 1) * hits[:, j]
        longest = np.maximum(longest, run.max(axis=1))
    return longest


def leaked_near(shard: Shard, p: Passages, exact: dict[tuple[int, int], tuple[int, int]], slack: int, least: int, cells: int = 20_000_000) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, passage) to (longest run, most words of the whole passage in order within ``slack`` places of an alignment), of every exact or near window."""
    window, first, at = shard.near(p, slack, least)
    out = dict(exact)
    if not len(window):
        return out
    found = np.unique(np.stack([p.owner[window], shard.document(at), first - p.offset[window]]), axis=1)
    length = np.array([p.lengths[i] for i in found[0].tolist()])
    found, length = found[:, np.argsort(length, kind="stable")], np.sort(length)
    ends = np.append(shard.starts[1:], len(shard.terms))
    lo = 0
    while lo < len(length):
        hi = lo + 1
        while hi < len(length) and length[hi] <= 2 * length[lo] and (hi - lo + 1) * length[hi] * (2 * slack + 1) <= cells:
            hi += 1
        item, doc, base = found[:, lo:hi]
        words = np.full((hi - lo, int(length[hi - 1])), -2, np.int32)
        for k, i in enumerate(item.tolist()):
            words[k, : p.lengths[i]] = p.words[i]
        hits = shard.hits(words, base, slack, shard.starts[doc], ends[doc])
        for d, i, run, near in zip(doc.tolist(), item.tolist(), longest_runs(hits).tolist(), in_order(hits).tolist()):
            r, n = out.get((d, i), (0, 0))
            out[d, i] = (max(r, run), max(n, near))
        lo = hi
    return out


class Squeezed:
    """Test passages as characters, their grams as terms, and all their windows of ``min_words`` words as places of characters."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.m = min_words
        self.chars, self.starts, windows = [], [], []
        at = 0
        for item, text in items:
            ws = tokens(text or "")
            if len(ws) < min_words:
                continue
            c = squeezed(text)
            ends = np.cumsum([len(w) for w in ws])
            begins = ends - np.array([len(w) for w in ws])
            windows += [(item, at, at + len(c), at + int(begins[k]), at + int(ends[k + min_words - 1])) for k in range(len(ws) - min_words + 1)]
            self.chars.append(c)
            self.starts.append((item, at + begins, at + ends))
            at += len(c)
        self.chars = np.concatenate(self.chars) if self.chars else np.zeros(0, np.uint32)
        self.windows = np.array(windows, np.int64).reshape(-1, 5)
        shortest = int((self.windows[:, 4] - self.windows[:, 3]).min()) if len(windows) else 2
        self.gram = 1 << min(4, max(0, int(math.log2(max(1, shortest // 2)))))
        h = gram_hashes(self.chars, self.gram)
        self.terms, self.term_at = np.unique(h, return_inverse=True)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.words = {item: (b, e) for item, b, e in self.starts}
        # grams of each window: from its first to its last place, spread evenly, four of them
        b, e = self.windows[:, 3], self.windows[:, 4] - self.gram
        self.places = (b[:, None] + (e - b)[:, None] * np.arange(4)[None, :] // 3).astype(np.int64)


def leaked(texts: list[str | None], q: Squeezed) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, passage) to (longest run of the passage's words, words within runs of at least ``min_words``)."""
    gap = np.zeros(1, np.uint32)  # no letter: no match crosses documents
    parts, starts, at = [gap], np.zeros(len(texts), np.int64), 1
    for k, t in enumerate(texts):
        starts[k] = at
        if t:
            c = squeezed(t)
            parts += [c, gap]
            at += len(c) + 1
    stream = np.concatenate(parts)
    if not len(q.windows):
        return {}
    h = gram_hashes(stream, q.gram)
    some = np.flatnonzero(q.bits[(h >> np.uint64(44)).astype(np.int64)])
    term = np.searchsorted(q.terms, h[some])
    term[term == len(q.terms)] = 0
    hit = q.terms[term] == h[some]
    position, term = some[hit], term[hit]
    order = np.argsort(term, kind="stable")
    postings, df = position[order], np.bincount(term, minlength=len(q.terms))
    begin = np.cumsum(df) - df
    # the rarest gram of each window; its postings, adjusted to the first character of all passages; windows of one gram together
    rare = np.argsort(df[q.term_at[q.places]], axis=1, kind="stable")
    places = np.take_along_axis(q.places, rare, 1)
    live = np.flatnonzero(df[q.term_at[places[:, 0]]] > 0)
    seeds = places[live]
    n = df[q.term_at[seeds[:, 0]]]
    which = np.repeat(live, n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    shift = postings[begin[q.term_at[places[which, 0]]] + within] - places[which, 0]
    key = np.sort(term.astype(np.int64) * (len(stream) + 1) + position)  # every posting as one number
    for j in range(1, places.shape[1]):  # the offset-adjusted lists of the other grams
        want = q.term_at[places[which, j]].astype(np.int64) * (len(stream) + 1) + shift + places[which, j]
        found = np.searchsorted(key, want)
        keep = (found < len(key)) & (key[np.minimum(found, len(key) - 1)] == want) if len(key) else np.zeros(len(want), bool)
        which, shift = which[keep], shift[keep]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(which):
        return out
    covered: dict[tuple[int, int], set[int]] = defaultdict(set)
    row = q.windows[which]
    for item, lo, hi, s in np.unique(np.stack([row[:, 0], row[:, 1], row[:, 2], shift]), axis=1).T.tolist():
        a, b = max(lo, -s), min(hi, len(stream) - s)
        same = stream[a + s : b + s] == q.chars[a:b]
        bad = np.concatenate([[-1], np.flatnonzero(~same), [b - a]])
        first, last = q.words[item]
        for i in np.flatnonzero(np.diff(bad) > q.gram):  # runs of common characters
            x, y = a + int(bad[i]) + 1, a + int(bad[i + 1])
            w0, w1 = int(np.searchsorted(first, x)), int(np.searchsorted(last, y, "right"))
            if w1 - w0 >= q.m:
                d = int(np.searchsorted(starts, x + s, "right")) - 1
                covered[d, item].update(range(w0, w1))
                out[d, item] = (max(out.get((d, item), (0, 0))[0], w1 - w0), 0)
    return {k: (r, len(covered[k])) for k, (r, _) in out.items()}


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    slack: int = 8,
    near: bool = False,
    near_share: float = 0.75,
    chars: int = 2_000_000,
) -> DataFrame:
    """key, item, longest_run, near_words: the documents that hold ``min_words`` consecutive words of a passage.

    ``longest_run`` is the exact phrase match; ``near_words`` are passage words within exact matches. With ``near``, documents that hold a passage by proximity only are returned too, ``near_words`` are
    the most words of the passage met in order within ``slack`` places of one alignment, and ``kind`` is 'phrase' or 'near'.
    ``chars``: characters of a shard.
    """
    least = math.ceil(near_share * min_words - 1e-9)
    if near and not 1 <= least <= min_words:
        raise ValueError("near_share must be over 0 and at most 1")
    spark = documents.sparkSession
    q = items.where(F.col(item_text).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("t"))
    total = q.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // MAX_ITEMS_BYTES))
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    out = None
    for block in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def run(batches, shared=shared):
            q, p = Squeezed(shared.value, min_words), Passages(shared.value, min_words) if near else None
            for b in batches:
                keys = b.column(0).to_pylist()
                texts = b.column(1).to_pylist()
                at = 0
                found: list[tuple] = []
                while at < len(texts):
                    stop, seen = at, 0
                    while stop < len(texts) and seen < chars:
                        seen += len(texts[stop]) if texts[stop] else 0
                        stop += 1
                    exact = leaked(texts[at:stop], q)
                    for (d, i), (run_length, met) in (leaked_near(Shard(texts[at:stop], p, slack), p, exact, slack, least) if near else exact).items():
                        found.append((keys[at + d], i, run_length, met))
                    at = stop
                if found:
                    k, i, r, n = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field(0).type), pa.array(i, pa.int64()), pa.array(r, pa.int32()), pa.array(n, pa.int32())], names=["key", "item", "longest_run", "near_words"])

        hits = docs.mapInArrow(run, f"key {kind}, item bigint, longest_run int, near_words int")
        out = hits if out is None else out.unionByName(hits)
    merged = out.groupBy("key", "item").agg(F.max("longest_run").alias("longest_run"), F.max("near_words").alias("near_words"))
    kinds = [F.when(F.col("longest_run") >= min_words, "phrase").otherwise("near").alias("kind")] if near else []
    return merged.select(F.col("key").alias(key), F.col("item").alias(item), "longest_run", "near_words", *kinds)
