"""Decisions on rows of a snapshot: guarded column updates, each a join of the snapshot with the newest decision of a key.

A decision names an action; an action has a guard (a condition on the row and the decision's values) and the columns it sets. A
decision whose guard fails, whose action is unknown or whose row is missing changes nothing and is reported with the reason. The newest
decision of a key (by ``order``, then action) counts in a batch; earlier ones are ``superseded``. Decisions aggregate partially before
the shuffle, so a key with many decisions is no hot task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Action:
    """``sets``: column to its new value, over the row's columns and ``values`` (map<string,string>); ``guard``: when it is allowed."""

    sets: dict[str, Column]
    guard: Column = field(default_factory=lambda: F.lit(True))


def newest(decisions: DataFrame, key: str, order: str) -> DataFrame:
    """key, action, values, n: the newest decision of each key."""
    rest = F.struct(order, "action", F.to_json("values").alias("j"), "values")
    # maps can't be compared: their JSON stands for them
    g = decisions.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("action", "values"), F.struct(rest[order], rest["action"], rest["j"])).alias("d"), F.count("*").alias("n"))
    return g.select(key, F.col("d.action").alias("action"), F.col("d.values").alias("values"), "n")


def decide(rows: DataFrame, decisions: DataFrame, *, key: str, order: str, actions: dict[str, Action]) -> DataFrame:
    """The new snapshot: the rows with the sets of their newest allowed decision."""
    j = rows.join(newest(decisions, key, order).drop("n"), key, "left")
    out = []
    for c in rows.columns:
        x = None
        for name, a in actions.items():
            if c in a.sets:
                hit = (F.col("action") == name) & a.guard
                x = F.when(hit, a.sets[c]) if x is None else x.when(hit, a.sets[c])
        out.append((F.col(c) if x is None else x.otherwise(F.col(c))).cast(rows.schema[c].dataType).alias(c))
    return j.select(*out)


def outcomes(rows: DataFrame, decisions: DataFrame, *, key: str, order: str, actions: dict[str, Action]) -> DataFrame:
    """key, action, outcome (applied, refused, unknown action, no row), superseded (earlier decisions of the batch)."""
    there = rows.withColumn("__there", F.lit(True))
    j = newest(decisions, key, order).join(there, key, "left")
    known, allowed = F.lit(False), F.lit(False)
    for name, a in actions.items():
        known |= F.col("action") == name
        allowed |= (F.col("action") == name) & F.coalesce(a.guard, F.lit(False))
    o = F.when(F.col("__there").isNull(), "no row").when(~known, "unknown action").when(allowed, "applied").otherwise("refused")
    return j.select(key, "action", o.alias("outcome"), (F.col("n") - 1).alias("superseded"))


def release(claims: DataFrame, owners: DataFrame, *, owner: str) -> DataFrame:
    """The claims without those of the owners."""
    return claims.join(owners.select(owner).distinct(), owner, "left_anti")


def replace_children(children: DataFrame, incoming: DataFrame, *, parent: str) -> DataFrame:
    """Each parent with incoming rows has exactly those; other parents keep theirs. A parent that gets no child is an incoming row of nulls beside the key."""
    rest = [c for c in children.columns if c != parent]
    some = F.lit(False)
    for c in rest:
        some |= F.col(c).isNotNull()
    kept = children.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(incoming.where(some).select(*children.columns))


def only_active(rows: DataFrame, *, chosen: Column, flag: str = "is_active") -> DataFrame:
    """Exactly the chosen row carries the flag."""
    return rows.withColumn(flag, F.coalesce(chosen, F.lit(False)).cast(rows.schema[flag].dataType))


def edited(rows: DataFrame, edits: DataFrame, *, key: str, columns: list[str], source: str, by: str = "user") -> DataFrame:
    """Rows with the edits' columns (nulls leave the old value); the source becomes ``by`` where anything changed."""
    e = edits.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.join(e, F.col(key) == F.col("__k"), "left")
    changed = F.lit(False)
    for c in columns:
        changed |= F.col(f"__{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    new = {c: F.coalesce(f"__{c}", c) for c in columns} | {source: F.when(changed, F.lit(by)).otherwise(F.col(source))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def guarded_writes(old: DataFrame, new: DataFrame, *, key: str, columns: list[str], allowed: Column) -> DataFrame:
    """key, column: cells that differ from the old snapshot in rows where ``allowed`` (over the new row) doesn't hold; empty if the write may go on."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = new.join(o, F.col(key) == F.col("__k"), "left").where(~F.coalesce(allowed, F.lit(False)))
    bad = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return j.select(key, F.explode(bad).alias("column"))


def resolve_valid(asked: DataFrame, entries: DataFrame, *, key: str, at: str, precedence: list[str]) -> DataFrame:
    """asked with ``value`` and ``kind``: the entry of its key, else of its base key (before the first dot), of the first kind in ``precedence``
    whose validity [valid_from, valid_until] holds at ``at`` and whose condition, if any, equals the question's ``condition``; the newest, then
    the smallest value on ties. ``entries``: key, kind, value, valid_from, valid_until, condition. Unanswered questions stay with nulls."""
    e = entries.select(F.col(key).alias("e_key"), "kind", F.col("value").alias("e_value"), "valid_from", "valid_until", F.col("condition").alias("e_condition"))
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("kind"))
    a = asked.withColumn("__id", F.monotonically_increasing_id())
    tries = a.select("__id", at, "condition", F.explode(F.array_distinct(F.array(F.col(key), F.substring_index(key, ".", 1)))).alias("e_key"), F.col(key).alias("own"))
    m = tries.join(e, "e_key").where((rank > 0) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))) & (F.col("valid_until").isNull() | (F.col("valid_until") >= F.col(at))))
    m = m.where(F.col("e_condition").isNull() | F.col("e_condition").eqNullSafe(F.col("condition")))
    best = F.struct(rank, (F.col("e_key") != F.col("own")).cast("int").alias("base"), F.col("e_condition").isNull().cast("int").alias("loose"), (-F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(-(1 << 62)))).alias("newest"), "e_value")
    found = m.groupBy("__id").agg(F.min_by(F.struct(F.col("e_value").alias("value"), "kind"), best).alias("r"))
    return a.join(found, "__id", "left").select(*asked.columns, F.col("r.value").alias("value"), F.col("r.kind").alias("kind"))


def first_hit(probes: DataFrame, *, key: str, rank: list[str], hit: Column) -> DataFrame:
    """key, probe, result: the first probe of each key, in the order of ``rank`` and then of candidate, that hit."""
    place = F.array_position(F.array(*map(F.lit, rank)), F.col("probe"))
    g = probes.where(hit & (place > 0)).groupBy(key).agg(F.min_by(F.struct("probe", "result"), F.struct(place, "candidate")).alias("r"))
    return g.select(key, "r.probe", "r.result")
