"""Keyed merges as folds over snapshots: every update is one aggregation of the old rows and the new, written as a new snapshot.

Policies by column: ``first`` (first value that says something, in arrival order: fill only), ``last`` (last such value), ``min``, ``max``, ``sum``,
``any`` (logical or), ``union`` (ordered union of arrays), ``keep`` (the oldest row's value, null or not). Values that say nothing are null, ''
and 'unknown'. Rows with a null key are kept as they are. All policies aggregate partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postgrain.operators.running import with_previous


def says_something(c: Column, kind: str) -> Column:
    ok = c.isNotNull()
    return ok & ~F.lower(F.trim(c)).isin("", "unknown") if kind == "string" else ok


def fold(rows: DataFrame, *, key: list[str], order: str, policies: dict[str, str]) -> DataFrame:
    """One row for each key, the columns merged by their policies; ``order`` must be unique within a key for a defined result."""
    kinds = dict(rows.dtypes)
    aggs = []
    for c, p in policies.items():
        x, at = F.col(c), F.col(order)
        ok = says_something(x, kinds[c])
        if p == "first":
            a = F.min_by(x, F.when(ok, at))
        elif p == "last":
            a = F.max_by(x, F.when(ok, at))
        elif p == "keep":
            a = F.min_by(F.struct(x), at)[c]
        elif p in ("min", "max", "sum"):
            a = getattr(F, p)(x)
        elif p == "any":
            a = F.bool_or(x)
        elif p == "union":
            continue
        else:
            raise ValueError(f"unknown policy {p}")
        aggs.append(a.alias(c))
    keyed = None
    for k in key:
        keyed = F.col(k).isNotNull() if keyed is None else keyed & F.col(k).isNotNull()
    kept = rows.where(keyed)
    out = kept.groupBy(*key).agg(*aggs) if aggs else kept.select(*key).distinct()
    for c in (c for c, p in policies.items() if p == "union"):
        # each element once with its first place, before a key's elements come together
        e = kept.select(*key, F.col(order).alias("__o"), F.posexplode(c).alias("__p", "__e"))
        e = e.groupBy(*key, "__e").agg(F.min(F.struct("__o", "__p")).alias("__at"))
        u = e.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__e"))), lambda s: s["__e"]).alias(c))
        out = out.join(u, key, "left").withColumn(c, F.coalesce(c, F.array().cast(kinds[c])))
    return out.select(*key, *policies)


def upsert(snapshot: DataFrame, incoming: DataFrame, *, key: list[str], order: str, policies: dict[str, str]) -> DataFrame:
    """The new snapshot: old rows come before all incoming ones."""
    cols = [*key, *policies]
    old = snapshot.select(*cols, F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("o")).alias("__at"))
    new = incoming.select(*cols, F.struct(F.lit(1).alias("b"), F.col(order).cast("bigint").alias("o")).alias("__at"))
    return fold(old.unionByName(new), key=key, order="__at", policies=policies)


def insert_absent(snapshot: DataFrame, incoming: DataFrame, *, key: list[str]) -> DataFrame:
    """The incoming rows whose key the snapshot lacks, one for each key (the smallest by all columns)."""
    fresh = incoming.join(snapshot.select(*key).distinct(), key, "left_anti")
    rest = [c for c in incoming.columns if c not in key]
    return fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def transitions(events: DataFrame, allowed: DataFrame, *, key: str, order: str, state: str) -> DataFrame:
    """Every change of state with ``legal``: whether (from, to) is in the table of allowed changes."""
    e = with_previous(events.select(key, order, F.col(state).alias("to")), key=[key], order=order, value="to", out="from").where("not from_first")
    a = allowed.select(F.col("from").alias("a_from"), F.col("to").alias("a_to"))
    return e.join(a, (e["from"] == a["a_from"]) & (e["to"] == a["a_to"]), "left").select(key, order, "from", "to", F.col("a_to").isNotNull().alias("legal"))
