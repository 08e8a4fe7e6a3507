"""Pay as sources write it, to one wording: amounts with their currency and period."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _amount(x: Column) -> Column:
    return F.format_number(x, 0)


def amount_range(lo: Column, hi: Column, currency: Column | None, period: Column | None = None) -> Column:
    """``INR 10,000 - 15,000 /month``; a missing bound is the other, one figure where both are equal; null without a figure."""
    a, z = F.coalesce(lo, hi), F.coalesce(hi, lo)
    figures = F.when(a == z, _amount(a)).otherwise(F.concat(_amount(a), F.lit(" - "), _amount(z)))
    per = F.concat(F.lit("/"), period) if period is not None else F.lit(None).cast("string")
    return F.when(a.isNotNull(), F.concat_ws(" ", currency if currency is not None else F.lit(None).cast("string"), figures, per))


def free_label(label: Column, internship: Column) -> Column:
    """A written label: ``25,000/month`` gets its currency, bare figures of an internship are monthly, undisclosed pay is null."""
    x = F.trim(label)
    low = F.lower(x)
    return (
        F.when((F.coalesce(low, F.lit("")) == "") | (low == "not disclosed"), F.lit(None).cast("string"))
        .when(x.rlike(r"^[\d,.\s-]+/\s*\w+"), F.concat(F.lit("INR "), F.trim(F.substring_index(x, "/", 1)), F.lit(" /"), F.trim(F.regexp_extract(x, "/(.*)$", 1))))
        .when(internship & x.rlike(r"^[\d,.\s-]+$"), F.concat(F.lit("INR "), x, F.lit(" /month")))
        .otherwise(x)
    )
