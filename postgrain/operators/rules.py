"""Ordered rules: the first that matches gives the key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_match(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Key of the first pattern found in ``x``; one CASE expression, built from the table."""
    c = None
    for key, pattern in rules:
        c = F.when(x.rlike(pattern), key) if c is None else c.when(x.rlike(pattern), key)
    return F.lit(default) if c is None else c.otherwise(F.lit(default))


def first_of(*options: tuple[str, Column]) -> Column:
    """struct(value, origin) of the first option that is neither null nor empty: an ordered cascade."""
    c = None
    for name, value in options:
        hit = value.isNotNull() & (F.trim(value) != "")
        s = F.struct(value.alias("value"), F.lit(name).alias("origin"))
        c = F.when(hit, s) if c is None else c.when(hit, s)
    return c
