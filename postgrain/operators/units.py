"""Quantities in different units: pay texts and columns to INR per month, by SQL expressions and alias joins only.

Order of work: cut the remarks that are no pay (contract length, perks, team size), turn the text into
``number | scale | number | scale`` by one pattern, take the currency and period word of the text, map words to
units by a join with the alias table, coalesce text unit, column unit and (if asked for) the source's default,
then apply the factors as exact integers.

Defined results: no figure, no currency or no period gives null amounts (``resolved`` false); null and empty fields
count as missing; ``min`` is the smaller of two figures; half a rupee rounds up; repeated rows stay; other columns,
also of clashing names, are not touched since only the key and the three fields are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Written forms of currencies and pay periods.
CURRENCY_ALIASES = {
    "INR": ["inr", "₹", "rs", "rs.", "rupee", "rupees", "indian rupee", "indian rupees"],
    "USD": ["usd", "$", "us$", "dollar", "dollars", "us dollar", "us dollars"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pound", "pounds", "pound sterling"],
    "SGD": ["sgd", "s$", "singapore dollar", "singapore dollars"],
}
PERIOD_ALIASES = {
    "hour": ["hour", "hours", "hr", "hrs", "ph", "hourly", "stunde", "per hour", "an hour", "p.h."],
    "day": ["day", "days", "daily", "per day", "a day", "tag"],
    "week": ["week", "weeks", "wk", "weekly", "pw", "p.w.", "per week", "a week", "woche"],
    "fortnight": ["fortnight", "fortnightly", "per fortnight", "a fortnight", "biweekly"],
    "month": ["month", "months", "mo", "pm", "p.m.", "p.m", "monthly", "per month", "a month", "monat", "monatlich", "mth"],
    "year": ["year", "years", "yr", "yearly", "annual", "annually", "annum", "per annum", "per year", "a year", "p.a.", "p.a", "pa", "lpa", "jahr"],
}
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90,
}

_NUM = r"\d[\d,]*(?:\.\d+)*"
_SCALE = r"(?:k|thousand|lakhs?|lacs?|lpa|l|crores?|cr)(?![a-z])"
_CUR = r"us dollars?|us\$|s\$|\$|₹|€|£|(?<![a-z])(?:inr|rs|rupees?|usd|dollars?|eur|euros?|gbp|pounds?|sgd)(?![a-z])"
_PERIOD = (
    r"(?<![a-z])(hourly|hours?|hrs?|ph|p\.h\.|daily|day|weekly|week|wk|p\.w\.|fortnightly|fortnight|monthly|monatlich|monat"
    r"|months?|mo|pm|p\.m\.?|yearly|years?|yr|annually|annual|annum|lpa|p\.a\.?|pa|jahr|stunde|tag|woche)(?![a-z])"
)
# Remarks beside the pay, cut before anything is read.
_REMARKS = (
    r"401\s*\(k\)|\([^)]*\)|\|.*$|&.*$|\+.*$|\bplus\b.*$|,?\s*\d+[ -](?:month|week|year)s? (?:contract|internship|term).*$"
    r"|\bfor the (?:first|last|next)\b.*$"
)


def alias_table(spark: SparkSession) -> DataFrame:
    """unit_kind, alias, unit: one row for each written form (fixed, under a hundred rows)."""
    rows = [("currency", a, u) for u, al in CURRENCY_ALIASES.items() for a in al]
    rows += [("period", a, u) for u, al in PERIOD_ALIASES.items() for a in al]
    values = ", ".join(f"('{k}', '{a}', '{u}')" for k, a, u in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS a(unit_kind, alias, unit)")


def _spelled(t: Column) -> Column:
    """'twenty five thousand' as '25 thousand'."""
    words = "|".join(NUMBER_WORDS)
    found = F.regexp_extract(t, rf"\b((?:(?:{words})[ -])?(?:{words}))\s+(?:thousand|lakhs?|lacs?)\b", 1)
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    value = F.aggregate(F.split(found, "[ -]"), F.lit(0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0)))
    return F.when(found != "", F.replace(t, found, value.cast("string"))).otherwise(t)


def _figure(text: Column, euro: Column) -> Column:
    """A written number as decimal; in euro amounts a dot before exactly three digits groups thousands."""
    grouped = euro & text.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$")
    comma_decimal = euro & text.rlike(r"^\d+,\d{1,2}$")
    plain = (
        F.when(grouped, F.translate(F.translate(text, ".", ""), ",", "."))
        .when(comma_decimal, F.translate(text, ",", "."))
        .otherwise(F.regexp_replace(text, r",", ""))
    )
    return plain.try_cast("decimal(18,4)")


def _factor(scale: Column) -> Column:
    return (
        F.when(scale.isin("k", "thousand"), 1_000)
        .when(scale.rlike("^(l|la)"), 100_000)
        .when(scale.rlike("^cr"), 10_000_000)
        .otherwise(1)
        .cast("bigint")
    )


def pay_to_monthly_inr(
    pay: DataFrame,
    units: DataFrame,
    *,
    key: str,
    text: str = "compensation_text",
    currency: str = "stipend_currency",
    period: str = "stipend_period",
    defaults: DataFrame | None = None,
    source: str | None = None,
) -> DataFrame:
    """key, amount_min, amount_max, currency, period, month_inr_min, month_inr_max, resolved: one row for each row of ``pay``.

    ``units``: unit_kind, unit, num, den. ``defaults`` (source, currency, period) is the last resort where given;
    it needs ``source``, the column of ``pay`` that names the source.
    """
    spark = pay.sparkSession
    alias = alias_table(spark)
    cols = [F.col(key).alias("key"), F.lower(F.trim(F.col(text))).alias("t0"), F.lower(F.trim(F.col(currency))).alias("cc"), F.lower(F.trim(F.col(period))).alias("pc")]
    if defaults is not None:
        cols.append(F.col(source).alias("src"))
    t = F.regexp_replace("t0", _REMARKS, " ")
    canon = (
        rf"^.*?({_NUM})\s*({_SCALE})?(?:\s*(?:{_CUR})\.?)?"
        rf"(?:\s*(?:-|–|—|\bto\b|\bbis\b)\s*(?:(?:{_CUR})\.?\s*)?({_NUM})\s*({_SCALE})?)?.*$"
    )
    p = (
        pay.select(*cols)
        .withColumn("t", _spelled(t))
        .withColumn("parts", F.when(F.col("t").rlike(r"\d"), F.split(F.regexp_replace("t", canon, r"$1|$2|$3|$4"), r"\|")))
        .withColumn("tc", F.regexp_extract("t", f"({_CUR})", 1))
        .withColumn("tp", F.regexp_extract("t", _PERIOD, 1))
        .withColumn("lpa", F.col("t").rlike(r"(?<![a-z])lpa(?![a-z])"))
    )
    cur = alias.where("unit_kind = 'currency'")
    per = alias.where("unit_kind = 'period'")

    def mapped(df: DataFrame, col: str, table: DataFrame, out: str) -> DataFrame:
        a = table.select(F.col("alias").alias(f"{out}_a"), F.col("unit").alias(out))
        return df.join(a, F.col(col) == F.col(f"{out}_a"), "left").drop(f"{out}_a")

    p = mapped(mapped(mapped(mapped(p, "tc", cur, "cur_t"), "cc", cur, "cur_c"), "tp", per, "per_t"), "pc", per, "per_c")
    if defaults is not None:
        d = defaults.select(F.col("source").alias("d_src"), F.col("currency").alias("cur_d"), F.col("period").alias("per_d"))
        p = p.join(d, F.col("src") == F.col("d_src"), "left")
        cur_d, per_d = F.col("cur_d"), F.col("per_d")
    else:
        cur_d = per_d = F.lit(None).cast("string")
    p = p.withColumn("currency", F.coalesce(F.when(F.col("cur_t").isNotNull(), F.col("cur_t")).when(F.col("lpa"), "INR"), F.col("cur_c"), cur_d))
    p = p.withColumn("period", F.coalesce(F.when(F.col("lpa"), "year"), F.col("per_t"), F.col("per_c"), per_d))
    n1, s1, n2, s2 = (F.when(F.get("parts", F.lit(i)) != "", F.get("parts", F.lit(i))) for i in range(4))
    euro = F.coalesce(F.col("currency") == "EUR", F.lit(False))
    one, both = F.coalesce(s1, s2), F.coalesce(s2, s1)
    a1 = _figure(n1, euro) * _factor(F.coalesce(one, F.lit("")))
    a2 = F.coalesce(_figure(n2, euro) * _factor(F.coalesce(both, F.lit(""))), a1)
    p = p.withColumn("amount_min", F.least(a1, a2)).withColumn("amount_max", F.greatest(a1, a2))
    uc = units.where("unit_kind = 'currency'").select(F.col("unit").alias("uc"), F.col("num").alias("cn"), F.col("den").alias("cd"))
    up = units.where("unit_kind = 'period'").select(F.col("unit").alias("up"), F.col("num").alias("pn"), F.col("den").alias("pd"))
    p = p.join(uc, F.col("currency") == F.col("uc"), "left").join(up, F.col("period") == F.col("up"), "left")

    def monthly(a: Column) -> Column:
        top = (a * 10_000).cast("decimal(24,0)") * (F.col("cn") * F.col("pn")).cast("decimal(12,0)")
        den = (F.col("cd") * F.col("pd") * 10_000).cast("decimal(18,0)")
        return F.try_divide(2 * top + den - F.pmod(2 * top + den, 2 * den), 2 * den).cast("bigint")

    p = p.withColumn("month_inr_min", monthly(F.col("amount_min"))).withColumn("month_inr_max", monthly(F.col("amount_max")))
    return p.select(
        F.col("key").alias(key), "amount_min", "amount_max", "currency", "period", "month_inr_min", "month_inr_max",
        (F.col("month_inr_min").isNotNull() & F.col("month_inr_max").isNotNull()).alias("resolved"),
    )
