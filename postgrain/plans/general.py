"""Queries of the general training-data problems: mixed timestamps (4) and units (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrain.operators.timestamps import to_utc
from postgrain.operators.units import CURRENCY_ALIASES, NUMBER_WORDS, PERIOD_ALIASES, pay_to_monthly_inr
from postgrain.session import table


def p4_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date value of jobs with its status, the chosen instant, the other one and the posterior."""
    r = to_utc(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "source_registry"), key="id", fields={"posted_date": -1, "deadline": 1})
    return r.select(F.col("id").alias("job_id"), "field", "value", "utc_us", "other_us", F.round("p_reading", 6).alias("p_reading"), "status")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that name an instant, in microseconds of UTC."""
    return p4_readings(spark, sf_dir).where("utc_us is not null").select("job_id", "field", "utc_us")


def p4_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instants of values that say them outright: ISO date and time with a numeric zone or Z, and epoch seconds or milliseconds."""
    whole = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)|\d{10}|\d{13})$"
    return p4_readings(spark, sf_dir).where(F.col("value").rlike(whole)).select("job_id", "field", "utc_us", "status")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INR per month of each job whose figure, currency and period are known."""
    r = pay_to_monthly_inr(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "pay_units"), key="id")
    return r.where("resolved").select(F.col("id").alias("job_id"), "month_inr_min", "month_inr_max")


P4_WRITTEN_SQL = """
WITH v AS (SELECT id, 'posted_date' AS field, posted_date AS x FROM jobs UNION ALL SELECT id, 'deadline', deadline FROM jobs)
SELECT id AS job_id, field, 'exact' AS status, CASE WHEN regexp_full_match(x, '\\d{10}') THEN CAST(x AS BIGINT) * 1000000 WHEN regexp_full_match(x, '\\d{13}') THEN CAST(x AS BIGINT) * 1000
  ELSE epoch_us(CAST(regexp_replace(regexp_replace(x, 'T', ' '), '([+-]\\d\\d):?(\\d\\d)$', '\\1:\\2') AS TIMESTAMPTZ)) END AS utc_us
FROM v WHERE regexp_full_match(x, '\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d{1,6})?(Z|[+-]\\d\\d:?\\d\\d)|\\d{10}|\\d{13}')
"""

QUERIES = {"p4_found": p4_found, "p4_readings": p4_readings, "p4_written": p4_written, "p5_found": p5_found}


def _pay_sql() -> str:
    """The pay conversion in DuckDB's dialect, whose patterns know no look-around: scales are marked and currencies cut out first."""
    cur = ", ".join(f"('{a}', '{u}')" for u, al in CURRENCY_ALIASES.items() for a in al)
    per = ", ".join(f"('{a}', '{u}')" for u, al in PERIOD_ALIASES.items() for a in al)
    words = "|".join(NUMBER_WORDS)
    numbers = ", ".join(f"'{k}': {v}" for k, v in NUMBER_WORDS.items())
    named = "inr|rs|rupees?|usd|dollars?|eur|euros?|gbp|pounds?|sgd"
    periods = (
        "hourly|hours?|hrs?|ph|p\\.h\\.|daily|day|weekly|week|wk|p\\.w\\.|fortnightly|fortnight|monthly|monatlich|monat|months?|mo|pm|p\\.m\\.?"
        "|yearly|years?|yr|annually|annual|annum|lpa|p\\.a\\.?|pa|jahr|stunde|tag|woche"
    )
    remarks = "401\\s*\\(k\\)|\\([^)]*\\)|\\|.*$|&.*$|\\+.*$|\\bplus\\b.*$|,?\\s*\\d+[ -](?:month|week|year)s? (?:contract|internship|term).*$|\\bfor the (?:first|last|next)\\b.*$"
    num = "\\d[\\d,]*(?:\\.\\d+)*"

    def figure(n: str) -> str:
        return f"""TRY_CAST(CASE WHEN currency = 'EUR' AND regexp_matches({n}, '^\\d{{1,3}}(\\.\\d{{3}})+(,\\d{{1,2}})?$') THEN replace(replace({n}, '.', ''), ',', '.')
          WHEN currency = 'EUR' AND regexp_matches({n}, '^\\d+,\\d{{1,2}}$') THEN replace({n}, ',', '.') ELSE replace({n}, ',', '') END AS DECIMAL(18, 4))"""

    def factor(x: str) -> str:
        return f"CASE WHEN {x} IN ('k', 'thousand') THEN 1000 WHEN starts_with({x}, 'l') THEN 100000 WHEN starts_with({x}, 'cr') THEN 10000000 ELSE 1 END"

    def monthly(a: str) -> str:
        return f"CAST((2 * CAST({a} * 10000 AS HUGEINT) * cn * pn + 10000 * cd * pd) // (2 * 10000 * cd * pd) AS BIGINT)"

    return f"""
    WITH cur(a, u) AS (VALUES {cur}), per(a, u) AS (VALUES {per}),
    j AS (SELECT id, regexp_replace(lower(trim(compensation_text)), '{remarks}', ' ', 'g') AS t1, lower(trim(stipend_currency)) AS cc, lower(trim(stipend_period)) AS pc FROM jobs),
    w AS (SELECT *, regexp_extract(t1, '\\b((?:(?:{words})[ -])?(?:{words}))\\s+(?:thousand|lakhs?|lacs?)\\b', 1) AS w FROM j),
    t AS (SELECT id, cc, pc, CASE WHEN w <> '' THEN replace(t1, w, CAST(list_sum(list_transform(string_split_regex(w, '[ -]'), lambda x: MAP {{{numbers}}}[x])) AS VARCHAR)) ELSE t1 END AS t FROM w),
    m AS (SELECT *, regexp_matches(t, '(^|[^a-z])lpa([^a-z]|$)') AS lpa,
      trim(regexp_replace(regexp_extract(' ' || t || ' ', '(us dollars?|us\\$|s\\$|\\$|₹|€|£|[^a-z](?:{named})[^a-z])', 1), '[^a-z$₹€£ ]', '', 'g')) AS tc,
      regexp_extract(' ' || t, '[^a-z]({periods})(?:[^a-z]|$)', 1) AS tp,
      regexp_replace(regexp_replace(regexp_replace(t, '(\\d)\\s*(k|thousand|lakhs?|lacs?|lpa|l|crores?|cr)([^a-z]|$)', '\\1~\\2\\3', 'g'), 'us dollars?|us\\$|s\\$|\\$|₹|€|£', ' ', 'g'), '(^|[^a-z~])(?:{named})\\.?([^a-z]|$)', '\\1 \\2', 'g') AS f FROM t),
    x AS (SELECT id, cc, pc, lpa, tc, tp, regexp_extract(f, '^.*?({num})(?:~([a-z]+))?(?:\\s*(?:-|–|—|\\bto\\b|\\bbis\\b)\\s*({num})(?:~([a-z]+))?)?.*$', ['n1', 's1', 'n2', 's2']) AS p FROM m),
    u AS (SELECT id, p, coalesce(ct.u, CASE WHEN lpa THEN 'INR' END, cf.u) AS currency, coalesce(CASE WHEN lpa THEN 'year' END, pt.u, pf.u) AS period FROM x
      LEFT JOIN cur ct ON ct.a = tc LEFT JOIN cur cf ON cf.a = cc LEFT JOIN per pt ON pt.a = tp LEFT JOIN per pf ON pf.a = pc),
    a AS (SELECT id, currency, period, {figure("p['n1']")} * {factor("coalesce(nullif(p['s1'], ''), p['s2'])")} AS a1, {figure("nullif(p['n2'], '')")} * {factor("coalesce(nullif(p['s2'], ''), p['s1'])")} AS a2 FROM u WHERE p['n1'] <> ''),
    r AS (SELECT id, least(a1, coalesce(a2, a1)) AS lo, greatest(a1, coalesce(a2, a1)) AS hi, c.num AS cn, c.den AS cd, q.num AS pn, q.den AS pd FROM a
      JOIN pay_units c ON c.unit_kind = 'currency' AND c.unit = currency JOIN pay_units q ON q.unit_kind = 'period' AND q.unit = period)
    SELECT id AS job_id, {monthly('lo')} AS month_inr_min, {monthly('hi')} AS month_inr_max FROM r WHERE lo IS NOT NULL
    """


ORACLES = {"p4_written": P4_WRITTEN_SQL, "p5_found": _pay_sql()}
