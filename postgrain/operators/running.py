"""Running values over keys of any size: a key's rows are cut into segments of its order, each a group of its own; what
crosses segments is one row a segment. So a key that holds a third of all rows is spread over as many tasks as it has segments.

``order`` is an integer column, unique within a key; ``segment`` is the width of a segment in its units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_previous(df: DataFrame, *, key: list[str], order: str, value: str, out: str, segment: int = 1_000_000) -> DataFrame:
    """The rows with the value of the row before in ``out``, and ``<out>_first``: whether there is none."""
    d = df.withColumn("__s", F.floor(F.col(order) / segment))
    w = Window.partitionBy(*key, "__s").orderBy(order)
    d = d.withColumn("__p", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    last = d.groupBy(*key, "__s").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__last"))
    across = Window.partitionBy(*key).orderBy("__s")
    last = last.withColumn("__before", F.lag("__last").over(across)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__s").alias("__ls"), "__before")
    on = F.col("__s") == F.col("__ls")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    j = d.join(last, on, "left").withColumn("__prev", F.coalesce("__p", "__before"))
    return j.select(*df.columns, F.col("__prev.v").alias(out), F.col("__prev").isNull().alias(f"{out}_first"))


def running_sum(df: DataFrame, *, key: list[str], order: str, value: str, out: str, segment: int = 1_000_000) -> DataFrame:
    """The rows with the sum of the key's values up to and with the row."""
    d = df.withColumn("__s", F.floor(F.col(order) / segment))
    w = Window.partitionBy(*key, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    t = d.groupBy(*key, "__s").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__t"))
    before = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__b", F.coalesce(F.sum("__t").over(before), F.lit(0))).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__s").alias("__ls"), "__b")
    on = F.col("__s") == F.col("__ls")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return d.join(t, on, "left").select(*df.columns, (F.col("__in") + F.col("__b")).alias(out))
