"""Numbers that need the words around them: years of experience asked for, months that something lasts. Inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_YEAR = "years?|yrs?"
_MONTH = "months?"
# Words that tell what the number is about.
EXPERIENCE = "experience|exp"
LASTING = "duration|lasts?|lasting|internship|interns?|term|stay|placement|long|period|programme?"


def _numbers(text: Column, unit: str, topic: str, before: int, after: int) -> Column:
    """Numbers (the first of a range) of the unit, with a word of the topic at most so many characters before or after."""
    number = f"\\b(\\d{{1,3}})(?:\\s*(?:\\+|(?:-|–|to)\\s*\\d{{1,3}}))?[\\s-]*(?:{unit})\\b"
    # (?<=...) looks back over a bounded stretch, (?=...) ahead; both leave the text between for the next match
    near = f"(?is)(?:(?<=\\b(?:{topic})\\b[^\\n]{{0,{before}}}){number}|{number}(?=.{{0,{after}}}\\b(?:{topic})\\b))"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(near), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(near), F.lit(2)).alias("b"))
    return F.transform(pairs, lambda p: F.coalesce(F.nullif(p["a"], F.lit("")), F.nullif(p["b"], F.lit(""))).cast("int"))


def years_of_experience(x: Column) -> Column:
    """Fewest years within 30 characters of a word for experience; null if none."""
    return F.array_min(_numbers(F.coalesce(x, F.lit("")), _YEAR, EXPERIENCE, 30, 30)).cast("double")


def duration_months(x: Column) -> Column:
    """First number of months up to a year beside a word for lasting; null if none."""
    within = F.filter(_numbers(F.coalesce(x, F.lit("")), _MONTH, LASTING, 30, 30), lambda n: (n >= 1) & (n <= 12))
    return F.get(within, F.lit(0))
