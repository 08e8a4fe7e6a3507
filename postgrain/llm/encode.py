"""Encoding of texts with a public byte-level BPE vocabulary.

Each distinct word is encoded once a Python worker by the contiguous rank array method: the word's part boundaries and
the rank of each adjacent pair stand in two arrays; the minimum rank is found by a scan, its boundary deleted and
the two neighbouring ranks refreshed, until no pair has a rank. Words of over ``SCAN_BYTES`` bytes take the same merges from
a heap over linked parts, as repeated scans would be quadratic there.

Texts are cut at single spaces first: a space between two characters that aren't white space always begins a new piece of the
tokenizer's pattern, so a cut there changes nothing. Cuts beside other white space can; texts that have them are split by the
pattern as a whole. Ids of a batch come from one array lookup.

The vocabulary file is read by the driver at the path given, and its bytes (under 1 MB, checked) are broadcast.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; repeated
rows stay; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of this vocabulary's words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCAN_BYTES = 256
MAX_VOCABULARY_BYTES = 16_000_000
_NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Byte strings to ids, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by the contiguous rank array."""
    n = len(word)
    cut = list(range(n + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            rank[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, the next one taken from a heap."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; keeps the ids of at most ``keep`` words between batches (memory only, no result depends on it)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 300_000):
        self.ranks, self.find, self.keep = ranks, regex.compile(pattern).findall, keep
        self.space = regex.compile(r"\s")
        self.words: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        encoder = self

        class Pieces(dict):
            """Text between two spaces to its number; ``lead`` is what stands before it."""

            def __init__(self, lead: str):
                super().__init__()
                self.lead = lead

            def __missing__(self, piece: str) -> int:
                n = self[piece] = encoder.add(self.lead + piece, piece)
                return n

        self.words.clear()
        self.ids, self.starts_blank, self.ends_blank = [], [], []
        self.head, self.rest = Pieces(""), Pieces(" ")

    def blank(self, c: str) -> bool:
        return c.isspace() or self.space.match(c) is not None

    def add(self, text: str, piece: str) -> int:
        self.ids.append(self.plain(text))
        self.starts_blank.append(not piece or self.blank(piece[0]))
        self.ends_blank.append((not piece and text != "") or (piece != "" and self.blank(piece[-1])))
        return len(self.ids) - 1

    def word(self, w: str) -> list[int]:
        b = w.encode("utf-8", "replace")
        if (r := self.ranks.get(b)) is not None:
            return [r]
        return merge_scan(b, self.ranks) if len(b) <= SCAN_BYTES else merge_heap(b, self.ranks)

    def plain(self, text: str) -> list[int]:
        """Ids of a text by the pattern as a whole."""
        out: list[int] = []
        for w in self.find(text):
            if (ids := self.words.get(w)) is None:
                ids = self.word(w)
                if len(w) <= SCAN_BYTES:
                    self.words[w] = ids
            out += ids
        return out

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text."""
        if len(self.ids) > self.keep or len(self.words) > self.keep:
            self.reset()
        numbers: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        head, rest = self.head, self.rest
        for k, t in enumerate(texts):
            if t:
                first, *others = t.split(" ")
                numbers.append(head[first])
                numbers += map(rest.__getitem__, others)
                sizes[k] = 1 + len(others)
        num = np.array(numbers, np.int64)
        length = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        flat = np.fromiter(chain.from_iterable(self.ids), np.int32, int(length.sum()))
        start = np.cumsum(length) - length
        ends = np.cumsum(sizes)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        # a cut between white space and white space (or the end) may be wrong
        sb, eb = np.array(self.starts_blank, bool), np.array(self.ends_blank, bool)
        wrong = np.zeros(len(texts), bool)
        if len(num):
            bad = eb[num[:-1]] & sb[num[1:]] & (text_of[:-1] == text_of[1:])
            wrong[text_of[1:][bad]] = True
        n = length[num]
        total = np.bincount(text_of, n, len(texts)).astype(np.int64)
        at = np.cumsum(n) - n
        ids = flat[np.repeat(start[num] - at, n) + np.arange(int(n.sum()))] if len(num) else np.zeros(0, np.int32)
        if wrong.any():
            parts = np.split(ids, np.cumsum(total)[:-1])
            for k in np.flatnonzero(wrong):
                parts[k] = np.array(self.plain(texts[k]), np.int32)
                total[k] = len(parts[k])
            ids = np.concatenate(parts)
        del ends
        return ids, total


def encode(df: DataFrame, *, key: str, text: str, vocabulary: str = VOCABULARY, out: str = "ids", chars: int = 2_000_000) -> DataFrame:
    """key and the list of ids of ``text``, one row for each row of ``df``; about ``chars`` characters are encoded at a time."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        encoder = Encoder(read_ranks(shared.value))
        for b in batches:
            keys, column = b.column(0), b.column(1)
            try:
                texts = column.to_pylist()
            except UnicodeDecodeError:
                texts = [x if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                stop, seen = at, 0
                while stop < len(texts) and seen < chars:
                    seen += len(texts[stop] or "")
                    stop += 1
                ids, n = encoder.batch(texts[at:stop])
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([keys.slice(at, stop - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["key", "ids"])
                at = stop

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(out))
