"""Whether a text keeps to its sources: numbers and names that the context lacks, values that must not occur."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unsupported_numbers(draft: Column, context: Column) -> Column:
    """Numbers of the draft that the context lacks."""
    number = F.lit("(\\d+(?:\\.\\d+)?)")
    return F.array_except(F.regexp_extract_all(F.coalesce(draft, F.lit("")), number, F.lit(1)), F.regexp_extract_all(F.coalesce(context, F.lit("")), number, F.lit(1)))


def unsupported_names(draft: Column, context: Column) -> Column:
    """Capitalised words of the draft that the context lacks."""
    word = F.lit("([A-Z][A-Za-z]+)")
    low = F.lower(F.coalesce(context, F.lit("")))
    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(draft, F.lit("")), word, F.lit(1))), lambda w: ~low.contains(F.lower(w)))


def leaked_values(text: Column, forbidden: Column) -> Column:
    """Forbidden values of three characters or more that occur in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda v: (F.length(F.trim(v)) >= 3) & low.contains(F.lower(F.trim(v))))
