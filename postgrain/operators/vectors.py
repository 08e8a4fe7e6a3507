"""Nearest neighbours over vectors: queries in blocks against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_QUERY_BYTES = 64_000_000


def _best(s: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest values of each row, equal ones by the smaller key; only values not under the k-th are sorted."""
    if k >= s.shape[1]:
        return np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero(s >= least[:, None])
    order = np.lexsort((keys[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(s)))
    return col[first[:, None] + np.arange(k)[None, :]]


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int = 1, exclude_self: bool = True) -> DataFrame:
    """query, key, cosine: the k most similar rows of each query (ties by the smaller key).

    The queries are broadcast in blocks whose size is checked; each task keeps its own k best of a query, so what is shuffled is
    tasks x queries x k rows. Null and zero vectors match nothing.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    first = q.first()
    kind = rows.schema[key].dataType.simpleString()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"query {kind}, key {kind}, cosine double")
    width = 8 * max(1, len(first["v"]))
    blocks = max(1, -(-q.count() * width // MAX_QUERY_BYTES))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect() if blocks > 1 else q.collect()
        shared = rows.sparkSession.sparkContext.broadcast(([r["q"] for r in part], np.array([r["v"] for r in part], np.float64)))

        def run(batches, shared=shared):
            ids, m = shared.value
            norm = np.linalg.norm(m, axis=1)
            m = m / np.where(norm > 0, norm, 1)[:, None]
            qid = np.array(ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n = np.linalg.norm(v, axis=1)
                s = np.round(m @ (v / np.where(n > 0, n, 1)[:, None]).T, 9)
                s[:, n == 0] = -np.inf
                s[norm == 0] = -np.inf
                if exclude_self:
                    s[qid[:, None] == keys[None, :]] = -np.inf
                order = _best(s, keys, k)
                best = np.take_along_axis(s, order, 1)
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, ok.sum(1))), pa.array(keys[order][ok]), pa.array(best[ok])], names=["query", "key", "cosine"])

        near = rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query {kind}, key {kind}, cosine double")
        out = near if out is None else out.unionByName(near)
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
