"""Near-duplicate texts by weighted MinHash of darts (DartMinHash) and banded joining.

Signatures. Darts are thrown at the half-plane of (element, weight, rank) with unit density; each dart carries a coordinate
out of ``k``. The darts of an element depend on the element alone, so two sets share the darts of their common weight
regions. Coordinate c of a set's signature is its earliest dart (lowest rank) with that coordinate; two sets agree
there with probability equal to their weighted Jaccard similarity. Only about ``k ln k + 2k`` darts fall below
the rank bound of a set whatever its size, so a text costs a few thousand darts, not ``k`` hashes an element; a set that leaves a
coordinate empty is thrown again with the bound doubled. Weights are regions [0, w] cut at powers of two, ranks likewise.

Banding. ``bands`` groups of ``rows`` coordinates make the band keys, by default 48 of 4: pairs at similarity 0.55 meet with
probability 0.990, at 0.6 0.998, at 0.5 0.955. Identical texts are one class first, so copies cost nothing here. Band keys
travel packed, one binary row for each (batch, slice of the key space), and with them a sketch of one bit for each of 192
coordinates. Equal keys are found by sorting a slice in memory. Slices are as many as the data asks for (a target of keys each).
Within a run of equal keys the sketch drops pairs far below the threshold, without reading any text: the threshold on agreeing sketch
coordinates is four standard deviations below what a pair at the similarity threshold has (it keeps 0.99997 of such pairs, more above).

Hot keys. A key held by over a hundredth of a batch (64 texts at least) never reaches its slice: its members leave the signature stage
as rows of their own, spread over the slices, and the slice only gets a mark, so that the few members of other batches join them.
They, and runs of over ``block`` classes in a slice, are not paired in place: they go out as rows keyed by pairs of blocks, spread
over tasks, and every block pair is compared there, so a hot key is never one task's work and no pair is lost.

Verification. The candidate pairs are made distinct, the texts of their classes are fetched, and the exact similarity of
shingle sets decides. The result is pairs of class representatives plus membership; ``all_pairs`` expands them.

Defined results: null, empty and texts under ``n`` words are in no class; identical word sequences have similarity 1; repeated rows
are different rows with the same text, so pairs when their ids differ; the pair's smaller id comes first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_WORDS = re.compile(r"[^\W_]+").findall
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> _U(30))) * _M2
        x = (x ^ (x >> _U(27))) * _M3
        return x ^ (x >> _U(31))


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (by sorting: hashing is slower on millions of 64-bit keys)."""
    x = np.sort(x, axis=None)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class WordHashes(dict):
    """Word to its place in a table of 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.table: list[int] = []

    def __missing__(self, word: str) -> int:
        b = word.encode("utf-8", "replace")
        self.table.append(zlib.crc32(b) << 32 | zlib.crc32(b[::-1] + b"#"))
        n = self[word] = len(self.table) - 1
        return n

    def clear(self) -> None:
        super().clear()
        self.table.clear()


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def shingle_sets(texts: list[str], n: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle hash) of the distinct shingles of each text, ordered by text; and a hash of each word sequence."""
    if len(hashes) > 1_000_000:
        hashes.clear()
    flat: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ws = words(t)
        count[k] = len(ws)
        flat += map(hashes.__getitem__, ws)
    w = np.array(hashes.table, np.uint64)[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), count)
    end = np.cumsum(count)
    begin = end - count
    with np.errstate(over="ignore"):
        place = np.arange(len(w), dtype=np.uint64) - np.repeat(begin, count).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w ^ (place * _M2)), dtype=np.uint64)])
        whole = mix(sums[end] - sums[begin] + count.astype(np.uint64) * _M3)
        m = len(w) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), whole
        s = w[:m]
        for j in range(1, n):
            s = mix(s * _U(3) + w[j : j + m])
    s = mix(s)
    ok = owner[:m] == owner[n - 1 :]
    key = ascending((owner[:m][ok] << _U(48)) | (s[ok] >> _U(16)))
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), whole


_STRIP = 2.0  # width of the rank strips


def _poisson_table(mean: float) -> np.ndarray:
    p, c, cdf = np.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * np.sqrt(mean) + 12)):
        c += p
        cdf.append(c)
        p *= mean / (k + 1)
    return np.array(cdf)


class Darts:
    """Throws the darts of elements, cell by cell: weights cut at powers of two, ranks in strips of equal width."""

    def __init__(self, k: int, seed: int = 1):
        self.k, self.seed = k, _U(seed)
        #: ranks are kept as 32-bit fixed point below this bound
        self.cap = 2.0 ** np.ceil(np.log2(6 * (k * np.log(k + 1) + 2 * k)))
        self.tables = {}

    def throw(self, elements: np.ndarray, ranks_below: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Darts of rank under the bound and weight under 2^top, ordered by element: (number of darts of each element,
        coordinate, rank and id packed in 64 bits, weight place)."""
        parts = []
        for nu in range(top + 1):
            w0, w1 = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0**nu)
            mean = (w1 - w0) * _STRIP
            if mean not in self.tables:
                self.tables[mean] = _poisson_table(mean)
            for strip in range(int(np.ceil(ranks_below / _STRIP))):
                with np.errstate(over="ignore"):
                    h = mix(elements ^ mix(np.array([(nu << 24) + strip], np.uint64) + (self.seed << _U(40))))
                    n = np.searchsorted(self.tables[mean], (h >> _U(11)) / 2.0**53, "right")
                    which = np.repeat(np.arange(len(elements), dtype=np.int32), n)
                    serial = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    ident = mix(h[which] + _M3 * (serial.astype(np.uint64) + _U(1)))
                rank = (strip + (ident >> _U(40)) / 2.0**24) * _STRIP
                packed = ((rank * (2.0**32 / self.cap)).astype(np.uint64) << _U(32)) | (ident & _U(0xFFFFFFFF))
                place = None if top == 0 else w0 + (w1 - w0) * ((mix(ident) >> _U(11)) / 2.0**53)
                parts.append((which, packed, place))
        which = np.concatenate([p[0] for p in parts])
        order = np.argsort(which, kind="stable")
        packed = np.concatenate([p[1] for p in parts])[order]
        place = np.concatenate([p[2] for p in parts])[order] if top else packed[:0]
        with np.errstate(over="ignore"):
            coordinate = ((mix(packed & _U(0xFFFFFFFF)) >> _U(32)) * _U(self.k) >> _U(32)).astype(np.int32)
        return np.bincount(which, minlength=len(elements)), coordinate, packed, place


def signatures(owner: np.ndarray, element: np.ndarray, n_sets: int, k: int, weight: np.ndarray | None = None, seed: int = 1, at_once: int = 60_000) -> np.ndarray:
    """n_sets x k 32-bit ids of the earliest darts (0 throughout where a set is empty). ``owner`` ascending."""
    out = np.zeros((n_sets, k), np.uint32)
    if not len(owner):
        return out
    darts = Darts(k, seed)
    total = np.bincount(owner, weight, n_sets)
    size = np.bincount(owner, minlength=n_sets)
    first = np.cumsum(size) - size
    bound = np.full(n_sets, np.inf)
    bound[total > 0] = (k * np.log(k) + 2 * k) / total[total > 0]
    top = 0 if weight is None else int(max(0, np.ceil(np.log2(max(1.0, float(weight.max()))))))
    uniq, inverse = np.unique(element, return_inverse=True)
    todo = np.flatnonzero((size > 0) & (total > 0))
    while len(todo):
        # sets of like bounds together: the bound rounded up to a fifth of an octave
        step = np.ceil(5 * np.log2(bound[todo])).astype(np.int64)
        again = []
        for g in np.unique(step):
            sets = todo[step == g]
            below = min(2.0 ** (g / 5), darts.cap)
            rows = np.repeat(first[sets] - (np.cumsum(size[sets]) - size[sets]), size[sets]) + np.arange(int(size[sets].sum()))
            need, inv = np.unique(inverse[rows], return_inverse=True)
            n, coordinate, packed, place = darts.throw(uniq[need], below, top)
            start = np.cumsum(n) - n
            local = np.repeat(np.arange(len(sets)), size[sets])
            cut = np.searchsorted(np.cumsum(size[sets]), np.arange(at_once, len(rows) + at_once, at_once), "left") + 1
            a = 0
            for b in np.unique(np.minimum(cut, len(sets))):
                lo, hi = np.searchsorted(local, [a, b])
                iv = inv[lo:hi]
                reps = n[iv]
                at = np.repeat(start[iv] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
                slot = np.repeat((local[lo:hi] - a) * k, reps) + coordinate[at]
                v = packed[at]
                if weight is not None:
                    keep = place[at] < np.repeat(weight[rows[lo:hi]], reps)
                    slot, v = slot[keep], v[keep]
                best = np.full((b - a) * k, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(best, slot, v)
                best = best.reshape(-1, k)
                full = (best != np.iinfo(np.uint64).max).all(1) | (below >= darts.cap)
                out[sets[a:b][full]] = (best[full] & _U(0xFFFFFFFF)).astype(np.uint32)
                again.append(sets[a:b][~full])
                a = b
        todo = np.sort(np.concatenate(again)) if again else todo[:0]
        bound[todo] *= 1.5
    return out


SKETCH = 192  # coordinates of the sketch at most, a bit each
WORDS = SKETCH // 64


def sketch(sig: np.ndarray) -> np.ndarray:
    """n x WORDS words of a bit a coordinate; missing coordinates are zero."""
    bits = np.zeros((len(sig), SKETCH), np.uint8)
    n = min(SKETCH, sig.shape[1])
    bits[:, :n] = sig[:, :n] * np.uint32(0x9E3779B1) >> np.uint32(31)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of sketch coordinates in which rows agree (missing ones do)."""
    return SKETCH - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def least_agreeing(threshold: float, coordinates: int = SKETCH, deviations: float = 4.0) -> int:
    """Coordinates in which a pair at the threshold agrees at least, up to so many standard deviations."""
    n, p = min(SKETCH, coordinates), threshold + (1 - threshold) / 2
    return SKETCH - n + int(np.floor(n * p - deviations * np.sqrt(n * p * (1 - p))))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """n x bands 64-bit keys."""
    bands = sig.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)[None, :] * _M3
        for j in range(rows):
            key = mix(key ^ sig[:, j : bands * rows : rows].astype(np.uint64))
    return key


def _ascending(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def run_pairs(order_len: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within runs of the given lengths and starts, run lengths taken together."""
    for n in np.unique(order_len):
        s = start[order_len == n]
        i, j = np.triu_indices(int(n), 1)
        most = max(1, 4_000_000 // len(i))
        for a in range(0, len(s), most):
            part = s[a : a + most, None]
            yield (part + i).ravel(), (part + j).ravel()


def often(key: np.ndarray, least: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Keys that stand over ``least`` times, with their places in the flattened array."""
    flat = key.ravel()
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    length = np.diff(np.append(begins, len(s)))
    for b, n in zip(begins[length > least].tolist(), length[length > least].tolist()):
        yield s[b], np.sort(order[b : b + n])


def slice_names(spark, slices: int) -> list[int]:
    """For each of ``slices`` shuffle partitions a number that hashes there: then every slice is a task of its own."""
    ids = spark.range(0, 40 * slices, 1, 1).select(F.col("id").cast("int").alias("i")).withColumn("p", F.pmod(F.hash("i"), F.lit(slices)))
    named = {r["p"]: r["i"] for r in ids.groupBy("p").agg(F.min("i").alias("i")).collect()}  # as many as there are slices
    return [named.get(k, 40 * slices + k) for k in range(slices)]


def candidates(
    classes: DataFrame, *, n: int, threshold: float, bands: int, rows: int, n_rows: int, block: int = 512, slice_entries: int = 2_000_000, seed: int = 1
) -> DataFrame:
    """a, b: pairs of classes (cid BIGINT, t STRING, rows of one cid having one text) that may reach the threshold."""
    from postgrain.session import checkpointed

    spark = classes.sparkSession
    slices = max(12, -(-n_rows * bands // slice_entries))
    k = bands * rows
    least = least_agreeing(threshold, k)
    names = slice_names(spark, slices)

    def pack(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                cid = part.column(0).to_numpy()
                _, first = np.unique(cid, return_index=True)  # copies within the batch once
                part, cid = part.take(pa.array(first)), cid[first]
                owner, element, _ = shingle_sets(part.column(1).to_pylist(), n, hashes)
                live, owner = np.unique(owner, return_inverse=True)
                if not len(live):
                    continue
                cid = cid[live]
                sig = signatures(owner, element, len(live), k, seed=seed)
                key, sk = band_keys(sig, rows), sketch(sig)
                where = ((key >> _U(40)) * _U(slices) >> _U(24)).ravel()
                cols: list[list] = [[], [], [], [], []]
                plain = np.ones(key.size, bool)
                for hot, members in often(key, max(64, len(cid) // 100)):
                    # the members go straight to the comparison of blocks; the key's slice gets a mark that it is hot
                    plain[members] = False
                    own = members // bands
                    name = names[int((hot ^ cid[own[0]].view(_U)) % _U(slices))]
                    for c, v in zip(cols, (name, b"", hot.tobytes(), cid[own].tobytes(), sk[own].tobytes())):
                        c.append(v)
                    low = hot.reshape(1).view(np.uint8)[:6].tobytes()
                    for c, v in zip(cols, (names[int(where[members[0]])], low, b"", b"", b"")):
                        c.append(v)
                flat = np.flatnonzero(plain)
                flat = flat[np.argsort(where[flat], kind="stable")]
                bound = np.searchsorted(where[flat], np.arange(slices + 1))
                for s in range(slices):
                    e = flat[bound[s] : bound[s + 1]]
                    if not len(e):
                        continue
                    own, idx = np.unique(e // bands, return_inverse=True)
                    low = (key.ravel()[e] & _U((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
                    for c, v in zip(cols, (names[s], low.tobytes(), idx.astype(np.uint16).tobytes(), cid[own].tobytes(), sk[own].tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["slice", "keys", "idx", "cids", "sketches"])

    def join(table: pa.Table) -> pa.Table:
        key, who, cid, sk = ([np.zeros(0, t)] for t in (_U, np.int64, np.int64, _U))
        sk = [sk[0].reshape(0, WORDS)]
        base = 0
        marked, hot_key, straight, straight_sk = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [sk[0]]
        for r in zip(*[table.column(c).to_pylist() for c in ("keys", "idx", "cids", "sketches")]):
            if not r[0]:
                straight.append(np.frombuffer(r[2], np.int64))
                straight_sk.append(np.frombuffer(r[3], np.uint64).reshape(-1, WORDS))
                hot_key.append(np.full(len(straight[-1]), np.frombuffer(r[1], np.uint64)[0] & _U((1 << 48) - 1)).view(np.int64))
                continue
            six = np.frombuffer(r[0], np.uint8).reshape(-1, 6)
            eight = np.zeros((len(six), 8), np.uint8)
            eight[:, :6] = six
            if not r[2]:
                marked.append(eight.view(np.uint64).ravel())
                continue
            key.append(eight.view(np.uint64).ravel())
            who.append(np.frombuffer(r[1], np.uint16).astype(np.int64) + base)
            cid.append(np.frombuffer(r[2], np.int64))
            sk.append(np.frombuffer(r[3], np.uint64).reshape(-1, WORDS))
            base += len(cid[-1])
        key, who, cid, sk = np.concatenate(key), np.concatenate(who), np.concatenate(cid), np.concatenate(sk)
        # copies of other batches: one number for each class
        ids, number = np.unique(cid, return_inverse=True)
        rep = np.zeros(len(ids), np.int64)
        rep[number] = np.arange(len(cid))
        who = number[who]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(begins, len(key)))
        sk = sk[rep]
        met = [np.zeros(0, np.int64)]
        mark = np.isin(key[begins], np.concatenate(marked)) if len(begins) else np.zeros(0, bool)
        short = (length > 1) & (length <= block) & ~mark
        for i, j in run_pairs(length[short], begins[short]):
            x, y = who[i], who[j]
            ok = agreeing(sk[x], sk[y]) >= least
            met.append(ascending(x[ok] * len(ids) + y[ok]))
        pair = ascending(np.concatenate(met))
        x, y = np.divmod(pair, max(1, len(ids)))
        a, b = _ascending(ids[x], ids[y])
        hot = (length > block) | mark
        size = length[hot]
        at = np.repeat(begins[hot] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        hot_cid = np.concatenate([ids[who[at]], *straight])
        none = len(a)
        return pa.table({
            "a": np.concatenate([a, hot_cid]),
            "b": np.concatenate([b, key[at].view(np.int64), *hot_key]),
            "sketch": pa.array([None] * none + [s.tobytes() for s in np.concatenate([sk[who[at]], *straight_sk])], pa.binary()),
        })

    packed = classes.mapInArrow(pack, "slice int, keys binary, idx binary, cids binary, sketches binary")
    found = checkpointed(packed.repartition(slices, "slice").groupBy("slice").applyInArrow(join, "a bigint, b bigint, sketch binary"))
    pairs = found.where("sketch is null").select("a", "b")
    hot = found.where("sketch is not null")
    if not hot.isEmpty():

        def compare(table: pa.Table) -> pa.Table:
            cid = table.column("a").to_numpy()
            mine = table.column("mine").to_numpy()
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, WORDS)
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in left:
                r = right[right > i] if lo == hi else right
                r = r[agreeing(sk[np.full(len(r), i)], sk[r]) >= least]
                x, y = _ascending(np.full(len(r), cid[i]), cid[r])
                out_a.append(x)
                out_b.append(y)
            return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

        hot = hot.groupBy("b", "a").agg(F.first("sketch").alias("sketch"))
        size = hot.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        hot = hot.join(size, "b")
        mine = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
        spread = hot.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("b", "a", "sketch", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        pairs = pairs.unionByName(spread.groupBy("b", "lo", "hi").applyInArrow(compare, "a bigint, b bigint"))
    return pairs.where("a <> b").distinct()


def near_duplicates(
    df: DataFrame, *, key: str, text: str, n: int = 5, threshold: float = 0.8, bands: int = 48, rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has key, cid (class of identical texts) of every text of ``n`` words or more;
    links has a, b (classes, a < b) and their exact similarity, at least ``threshold``."""
    word, between = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    base = df.where(F.col(text).rlike(f"(?:{word}{between}){{{n - 1}}}{word}" if n > 1 else word)).select(F.col(key).alias("key"), F.col(text).alias("t"), F.xxhash64(text).alias("cid"))
    pairs = candidates(base.select("cid", "t"), n=n, threshold=threshold, bands=bands, rows=rows, n_rows=df.count())
    need = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = base.groupBy("cid").agg(F.first("t").alias("t")).join(need, "cid", "left_semi")
    both = (
        pairs.join(texts.select(F.col("cid").alias("a"), F.col("t").alias("ta")), "a")
        .join(texts.select(F.col("cid").alias("b"), F.col("t").alias("tb")), "b")
    )

    def verify(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                size = part.num_rows
                # each text of the batch once, then the sets of each pair side by side
                ids = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                _, first, number = np.unique(ids, return_index=True, return_inverse=True)
                both_texts = pa.concat_arrays([part.column(2), part.column(3)])
                o, e, _ = shingle_sets(both_texts.take(pa.array(first)).to_pylist(), n, hashes)
                count = np.bincount(o, minlength=len(first))
                start = np.cumsum(count) - count
                x, y = number[:size], number[size:]
                which = np.concatenate([x, y])
                reps = count[which]
                row = np.repeat(np.tile(np.arange(size, dtype=np.uint64), 2), reps)
                joint = np.sort((row << _U(48)) | e[np.repeat(start[which] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))])
                same = joint[1:][joint[1:] == joint[:-1]]
                common = np.bincount((same >> _U(48)).astype(np.int64), minlength=size)
                union = count[x] + count[y] - common
                s = common / np.maximum(union, 1)
                ok = np.flatnonzero((union > 0) & (s >= threshold))
                kept = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(s[ok])], names=["a", "b", "similarity"])

    links = both.select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint, similarity double")
    return base.select("key", "cid"), links


def all_pairs(members: DataFrame, links: DataFrame, *, chunk: int = 1000) -> DataFrame:
    """key_a < key_b: every linked pair of rows, copies of one text among them. The rows of a text that stands often are paired in
    chunks, each with all rows of the text, so no task pairs a whole class."""
    x = members.select(F.col("key").alias("k1"), F.col("cid").alias("a"))
    y = members.select(F.col("key").alias("k2"), F.col("cid").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
    size = members.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    many = members.join(size, "cid")
    part = many.select("cid", F.col("key").alias("k1"), F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"))
    every = many.select("cid", F.col("key").alias("k2"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    copies = part.join(every, ["cid", "chunk"]).where("k1 < k2").select(F.col("k1").alias("key_a"), F.col("k2").alias("key_b"))
    return across.unionByName(copies)


def classes_with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, class_key (smallest key of the identical texts), copies, links (classes linked): one row for each member."""
    c = members.groupBy("cid").agg(F.min("key").alias("class_key"), F.count("*").alias("copies"))
    n = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    c = c.join(n, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(c, "cid").select("key", "class_key", "copies", "links")
