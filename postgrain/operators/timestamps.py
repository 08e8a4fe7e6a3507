"""Mixed timestamp texts to one instant in UTC.

A value is first brought to one canonical form ``family|fields`` by a chain of regular expressions, one for each
family: ISO-like, epoch, month by name, all-numeric, relative. Only all-numeric dates have more than one reading. Their
order is inferred for each source by expectation-maximisation over the mixture of readings: every value contributes its
likelihood under each valid parse (a calendar date, near the row's reference time, on the side that the field implies),
the posteriors update the source's mixture, and the final posterior chooses the reading. A registry's stated order
enters as a weak Dirichlet prior of ``registry_weight`` values: it decides where a source has few telling values, and the data
overrule it where a source has many. A value whose best posterior stays under ``sure`` is marked ``ambiguous`` and keeps both
instants; so is a local time that occurs twice when clocks are set back, whose second instant is ``other_us``.

The E and M steps run on eight counts a source (the likelihood patterns), made by one partial aggregation over all
values; nothing is collected to the driver, and a source that holds a third of all rows shrinks to its eight counts
before the shuffle.

Defined results: null, empty and wordy values (``Rolling``, ``TBD``) have status ``none``; impossible dates
``invalid``; a value without a zone is in its source's zone, UTC for a source without one; of two possible instants
(clocks set back) the first counts and the value is ``ambiguous``; a time skipped by a change of clocks counts as moved on by the gap; two-digit
years are 20xx; a date alone is its midnight. Relative values count from the reference time with its microseconds: days
of 24 hours, weeks of 7, months of 30 days; with a null reference time they are ``none``. Repeated rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "IST": 330, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "GST": 240, "PKT": 300, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AEST": 600,
    "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# First three letters of month names in English and German, accents removed.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10,
    "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

_TIME = r"(?:[T,\s]+(?:at\s+|um\s+)?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?|Uhr)?\s*(?:\(?(Z|[A-Z]{2,5}|(?:GMT|UTC)?[+-]\d{2}:?\d{2})\)?)?)?"
# family, pattern, canonical form: family|year|month|day|hour|minute|second|fraction|am-pm|zone
_FAMILIES = [
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", "I|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(Z)?$", "I|$1|$2|$3|$4|$5|$6|||$7"),
    ("day_name", rf"^(?:\p{{L}}{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+(?:of\s+)?(\p{{L}}{{3,10}})\.?[\s,'-]+(\d{{4}}|\d{{2}}){_TIME}$", "M|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("name_day", rf"^(?:\p{{L}}{{2,10}},\s+)?(\p{{L}}{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TIME}$", "M|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("numeric", rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}}){_TIME}$", "N|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)"


def _month_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])


def _zone_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns added and computed once a row: a generator keeps the optimizer from copying them into every use and filter."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def canonical(value: Column) -> Column:
    """``family|year|month|day|hour|minute|second|fraction|am-pm|zone``, or the value as it is."""
    v = F.regexp_replace(F.trim(value), r"[\s ]+", " ")
    return reduce(lambda c, fam: F.regexp_replace(c, fam[1], fam[2]), _FAMILIES, v)


def _plausible(days_off: Column, side: Column) -> Column:
    """Likelihood of a date that lies so many days from the reference; side 1: later expected, -1: earlier, 0: either."""
    d = F.when(side == 1, days_off).when(side == -1, -days_off).otherwise(F.abs(days_off))
    return F.when(d.isNull() | d.between(-2, 400), 1.0).otherwise(0.05)


def order_posteriors(values: DataFrame, *, rounds: int = 25, registry_weight: float = 20.0) -> DataFrame:
    """source, p_dmy: the mixture weight of day-month order of each source, by expectation-maximisation.

    ``values``: source, value, reference TIMESTAMP, side INT, day_first BOOLEAN (null: not registered). The registry's order
    counts as ``registry_weight`` values.
    """
    a, b = F.regexp_extract("value", _NUMERIC, 1), F.regexp_extract("value", _NUMERIC, 2)
    y = F.regexp_extract("value", _NUMERIC, 3)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int")

    def like(day: Column, month: Column) -> Column:
        date = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
        off = (F.unix_seconds(date) - F.unix_seconds("reference")) / 86400.0
        return F.when(date.isNull(), 0.0).otherwise(_plausible(off, F.col("side")))

    n = values.where(F.trim("value").rlike(_NUMERIC)).withColumn("value", F.trim("value"))
    first, second = a.cast("int"), b.cast("int")
    counts = (
        n.select("source", "day_first", like(first, second).alias("l_dmy"), like(second, first).alias("l_mdy"))
        .where("l_dmy + l_mdy > 0")
        .groupBy("source", "l_dmy", "l_mdy")
        .agg(F.count("*").cast("double").alias("n"), F.max("day_first").alias("day_first"))
    )
    classes = counts.groupBy("source").agg(F.collect_list(F.struct("l_dmy", "l_mdy", "n")).alias("cls"), F.sum("n").alias("total"), F.max("day_first").alias("day_first"))
    prior_d = 1.0 + F.when(F.col("day_first"), registry_weight).otherwise(0.0)
    prior_m = 1.0 + F.when(~F.col("day_first"), registry_weight).otherwise(0.0)

    def m_step(p: Column, _: Column) -> Column:
        e = F.aggregate("cls", F.lit(0.0), lambda acc, c: acc + c["n"] * p * c["l_dmy"] / (p * c["l_dmy"] + (1 - p) * c["l_mdy"]))
        return (e + prior_d) / (F.col("total") + prior_d + prior_m)

    start = prior_d / (prior_d + prior_m)
    return classes.select("source", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, m_step).alias("p_dmy"))


def to_utc(
    df: DataFrame,
    registry: DataFrame,
    *,
    key: str,
    fields: dict[str, int],
    source: str = "source",
    reference: str = "discovered_at",
    sure: float = 0.9,
    rounds: int = 25,
    registry_weight: float = 20.0,
) -> DataFrame:
    """key, field, value, utc_us, other_us, p_reading, status: one row for each row of ``df`` and field.

    ``fields``: column name to the side of the reference time where its values lie (-1 before, 1 after, 0 either).
    ``registry``: source, time_zone, day_first. status: ``exact``, ``inferred``, ``ambiguous`` (``utc_us`` is then the
    likelier reading, ``other_us`` the other), ``invalid`` or ``none``.
    """
    reg = registry.groupBy(F.col("source").alias("r_source")).agg(F.min(F.struct("time_zone", "day_first")).alias("r")).select("r_source", "r.time_zone", "r.day_first")
    long = df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.col(reference).alias("reference"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("side"), F.col(f).cast("string").alias("value")) for f, s in fields.items()])).alias("x"),
    ).select("key", "source", "reference", "x.field", "x.side", "x.value")
    long = long.join(reg, F.col("source") == F.col("r_source"), "left").drop("r_source")
    post = order_posteriors(long.where("value is not null"), rounds=rounds, registry_weight=registry_weight)
    post = post.select(F.col("source").alias("p_source"), "p_dmy")
    p = long.join(post, F.col("source") == F.col("p_source"), "left").drop("p_source")
    p = once(p, c=F.split(canonical(F.col("value")), r"\|"))
    p = p.withColumn("fam", F.when(F.size("c") == 10, F.get("c", F.lit(0))))

    def part(i: int) -> Column:
        return F.get("c", F.lit(i))

    def num(i: int) -> Column:
        return part(i).try_cast("int")

    year = F.when(F.length(part(1)) == 2, 2000 + num(1)).otherwise(num(1))
    name = F.substring(F.translate(F.lower(part(2)), "äáéû", "aaeu"), 1, 3)
    month = F.when(F.col("fam") == "M", F.try_element_at(_month_map(), name)).otherwise(num(2))
    ap = F.substring(F.lower(part(8)), 1, 1)
    hour0 = F.coalesce(num(4), F.lit(0))
    hour = F.when(ap == "p", F.when(hour0.between(1, 12), hour0 % 12 + 12)).when(ap == "a", F.when(hour0.between(1, 12), hour0 % 12)).otherwise(hour0)
    second = F.concat(F.when(part(6) == "", "0").otherwise(part(6)), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0")).try_cast("decimal(16,6)")
    z = F.regexp_replace(part(9), r"^(?:GMT|UTC)(?=[+-])", "")
    offset = (
        F.when(z.rlike(r"^[+-]\d{2}:?\d{2}$"), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, -2, 2)))
        .otherwise(F.transform(F.array(F.try_element_at(_zone_map(), z)), lambda m: F.when(m.isNotNull(), F.concat(F.when(m < 0, "-").otherwise("+"), F.lpad((F.abs(m) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(m) % 60).cast("string"), 2, "0"))))[0])
    )
    zone = F.when(z == "", F.coalesce(F.col("time_zone"), F.lit("UTC"))).otherwise(offset)
    written = F.col("fam").isNotNull()
    fields_ = {"y": year, "h": hour, "mi": F.coalesce(num(5), F.lit(0)), "s": second, "zone": zone, "a": month, "b": num(3)}
    p = once(p, **{n: F.when(written, c) for n, c in fields_.items()})

    def instant(mo: Column, d: Column) -> Column:
        return F.unix_micros(F.try_make_timestamp(F.col("y"), mo, d, F.col("h"), F.col("mi"), F.col("s"), F.col("zone")))

    # month and day as written in families I and M; in N "a" is the first number and "b" the second
    plain, dmy, mdy = instant(F.col("a"), F.col("b")), instant(F.col("b"), F.col("a")), instant(F.col("a"), F.col("b"))
    ref_us = F.unix_micros("reference")

    def like(us: Column) -> Column:
        return F.when(us.isNull(), 0.0).otherwise(_plausible((us - ref_us) / 86400e6, F.col("side")))

    digits = F.when(F.trim("value").rlike(r"^\d{9,19}$"), F.trim("value").try_cast("bigint"))
    epoch = F.when(digits < 100_000_000_000, digits * 1_000_000).when(digits < 100_000_000_000_000, digits * 1_000).when(digits < 100_000_000_000_000_000, digits).otherwise((digits / 1000).cast("bigint"))
    low = F.lower(F.trim("value"))
    rel = r"^(?:posted|closes|closing|updated|ends|due|expires|opened|listed)?:?\s*(in)?\s*(an?|\d{1,4})\+?\s*(minute|min|hour|hr|day|week|month|year)s?\s*(ago)?$"
    amount = F.when(F.regexp_extract(low, rel, 2).isin("a", "an"), 1).otherwise(F.regexp_extract(low, rel, 2).try_cast("int")).cast("bigint")
    unit_s = F.create_map(*[F.lit(x) for x in ("minute", 60, "min", 60, "hour", 3600, "hr", 3600, "day", 86400, "week", 604800, "month", 2592000, "year", 31536000)])
    sign = F.when(F.regexp_extract(low, rel, 4) == "ago", -1).when(F.regexp_extract(low, rel, 1) == "in", 1)
    now = r"^(?:posted|closes|updated|opened)?:?\s*(?:just now|now|right now|just posted|today)$"
    relative = (
        F.when(low.rlike(now), ref_us)
        .when(low.rlike(r"^(?:posted\s+)?yesterday$"), ref_us - 86_400_000_000)
        .when(low.rlike(r"^(?:closes\s+)?tomorrow$"), ref_us + 86_400_000_000)
        .otherwise(ref_us + sign * amount * F.try_element_at(unit_s, F.regexp_extract(low, rel, 3)) * 1_000_000)
    )
    other_form = F.when(~F.coalesce(written, F.lit(False)), F.coalesce(epoch, relative))
    p = once(p, plain=F.when(F.col("fam").isin("I", "M"), plain), dmy=F.when(F.col("fam") == "N", dmy), mdy=F.when(F.col("fam") == "N", mdy), other_form=other_form)
    p0 = F.coalesce(F.col("p_dmy"), F.when(F.col("day_first"), 0.95).when(~F.col("day_first"), 0.05).otherwise(0.5))
    ld, lm = p0 * like(F.col("dmy")), (1 - p0) * like(F.col("mdy"))
    p = once(p, post=F.try_divide(ld, ld + lm))
    numeric = F.col("fam") == "N"
    utc = (
        F.when(numeric, F.when(F.col("post") >= 0.5, F.col("dmy")).otherwise(F.col("mdy")))
        .otherwise(F.coalesce("plain", "other_form"))
    )
    other = F.when(numeric & (F.col("dmy") != F.col("mdy")), F.when(F.col("post") >= 0.5, F.col("mdy")).otherwise(F.col("dmy")))
    best = F.greatest(F.col("post"), 1 - F.col("post"))
    p = once(p, utc_us=utc, reading_us=other)
    # the same wall clock again half an hour or an hour later: clocks were set back
    local = written & (part(9) == "") & F.col("time_zone").isNotNull() & F.col("utc_us").isNotNull()

    def wall(us: Column) -> Column:
        return F.from_utc_timestamp(F.timestamp_micros(us), F.col("time_zone"))

    again = F.coalesce(*[F.when(local & (wall(F.col("utc_us") + s * 1_000_000) == wall(F.col("utc_us"))), F.col("utc_us") + s * 1_000_000) for s in (3600, 1800)])
    p = once(p, again_us=again)
    p = p.withColumn("other_us", F.coalesce("reading_us", "again_us"))
    p = p.withColumn("p_reading", F.when(numeric, best).when(F.col("utc_us").isNotNull(), 1.0))
    status = (
        F.when(F.col("utc_us").isNull(), F.when(F.col("fam").isNotNull(), "invalid").otherwise("none"))
        .when(F.col("again_us").isNotNull(), "ambiguous")
        .when(F.col("reading_us").isNotNull(), F.when(best >= sure, "inferred").otherwise("ambiguous"))
        .otherwise("exact")
    )
    return p.select(F.col("key").alias(key), "field", "value", "utc_us", "other_us", "p_reading", status.alias("status"))
