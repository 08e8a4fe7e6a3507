"""Jobs by their whole identity and claims by brand and title, with SQL written from the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postgrain.functions import identity, text as tx
from postgrain.plans.registry import Tables, query
from postgrain.plans.scalars import _ALNUM, _BARE, _MODE, _TAIL


def _cities(t: Tables) -> identity.Cities:
    return identity.Cities((r[0], r[1], r[2]) for r in t.city_ref.select("city", "country", "other_names").where("city is not null").collect())  # fixed list


_CUT = _TAIL.format(x="bare")
_BRAND = _ALNUM.format(c=f"(CASE WHEN {_CUT} = '' THEN bare ELSE {_CUT} END)")
_COMPANY = f"CASE WHEN bare <> trim(coalesce(company, ''), ' .,') THEN {_BRAND} ELSE {_ALNUM.format(c='bare')} END"
_NOISE = "regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\\b(remote|hybrid|on[\\s-]?site|work from home|wfh|paid|unpaid)\\b', ' ', 'g'), '\\s+', ' ', 'g')"
# RE2 has no look-around: the neighbours of a city are matched and put back, twice for cities that share one.
_STRIPPED = "regexp_replace({x}, '(^|[^\\p{{L}}])(?:' || p || ')($|[^\\p{{L}}])', '\\1 \\2', 'gi')"
_ROLE = f"array_to_string(list_sort(regexp_extract_all(lower(regexp_replace({_STRIPPED.format(x=_STRIPPED.format(x=_NOISE))}, '(?i)\\b(interns|internships?)\\b', 'intern', 'g')), '[a-z0-9]+')), '-')"
_FIRST = "regexp_extract(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'), '(?:^|[^\\p{{L}}])(' || p || ')(?:$|[^\\p{{L}}])', 1)"
_COUNTRY = "CASE " + " ".join(f"WHEN regexp_matches(lower(location), '(^|[^\\p{{L}}])({w})($|[^\\p{{L}}])') THEN '{c}'" for c, w in identity.COUNTRY_NAMES.items()) + " " + " ".join(f"WHEN regexp_matches(location, '{p}') THEN '{c}'" for c, p in identity.COUNTRY_CODES.items()) + " END"
_KEYED = f"""names AS (SELECT alias, min(city) AS city FROM (SELECT city, lower(trim(city)) AS alias FROM city_ref UNION SELECT city, lower(trim(unnest(other_names))) FROM city_ref) WHERE alias <> '' GROUP BY 1),
  lands AS (SELECT city, min(country) AS land FROM city_ref GROUP BY 1), pat AS (SELECT string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) AS p FROM names),
  j AS (SELECT *, {_BARE.format(c='company')} AS bare FROM jobs, pat)"""


@query(f"""WITH {_KEYED}, a AS (SELECT *, {_COMPANY} AS ck, {_ROLE} AS role, {_FIRST.format(c='location')} AS a1, {_FIRST.format(c='city')} AS a2, CASE WHEN trim(coalesce(location, '')) = '' THEN {_FIRST.format(c='title')} ELSE '' END AS a3,
    CASE WHEN lower(trim(coalesce(work_mode, ''))) IN ('', 'unknown') THEN {_MODE} ELSE lower(trim(work_mode)) END AS m, {_COUNTRY} AS said FROM j),
  b AS (SELECT a.*, n.city AS listed, l.land FROM a LEFT JOIN names n ON n.alias = coalesce(nullif(a1, ''), nullif(a2, ''), nullif(a3, '')) LEFT JOIN lands l ON l.city = n.city),
  c AS (SELECT id, ck, role, CASE WHEN m = 'remote' THEN CASE WHEN coalesce(said, nullif(trim(country), ''), land, '') = '' THEN 'remote' ELSE 'remote-' || {_ALNUM.format(c="coalesce(said, nullif(trim(country), ''), land)")} END
    ELSE coalesce(nullif({_ALNUM.format(c='listed')}, ''), nullif({_ALNUM.format(c='city')}, ''), nullif(left({_ALNUM.format(c='location')}, 60), ''), 'unknown') END AS place FROM b)
  SELECT sha256(ck || '::' || role || '::' || place) AS dedup_hash, min(id) AS kept, count(*) - 1 AS merged FROM c GROUP BY 1""")
def keep_first_by_identity(t: Tables) -> DataFrame:
    c = _cities(t)
    place = identity.place_key(F.col("location"), F.col("title"), F.col("city"), F.col("country"), F.col("work_mode"), c)
    key = F.concat_ws("::", tx.company_key(F.col("company")), identity.title_key(F.col("title"), c), place)
    return t.jobs.groupBy(F.sha2(key, 256).alias("dedup_hash")).agg(F.min("id").alias("kept"), (F.count("*") - 1).alias("merged"))


@query(f"WITH {_KEYED} SELECT cluster, min(id) AS winner, count(*) - 1 AS refused FROM (SELECT id, {_BRAND} || '|' || {_ROLE} AS cluster FROM j) GROUP BY 1")
def claim_by_brand(t: Tables) -> DataFrame:
    j = t.jobs.select("id", identity.cluster_key(F.col("company"), F.col("title"), _cities(t)).alias("cluster"))
    return j.groupBy("cluster").agg(F.min("id").alias("winner"), (F.count("*") - 1).alias("refused"))


@query(f"""WITH {_KEYED}, a AS (SELECT id, trim(coalesce(location, '')) AS location, title, CASE WHEN trim(coalesce(location, '')) <> '' THEN {_FIRST.format(c='location')} ELSE {_FIRST.format(c='title')} END AS a1 FROM j),
  b AS (SELECT a.*, n.city, l.land, lower(concat_ws(' ', location, title)) AS hint FROM a LEFT JOIN names n ON n.alias = nullif(a1, '') LEFT JOIN lands l ON l.city = n.city)
  SELECT id, city, coalesce({_COUNTRY}, nullif(land, '')) AS country, CASE WHEN regexp_matches(hint, '\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches(hint, '\\b({tx.REMOTE_WORDS})\\b') THEN 'remote'
    WHEN regexp_matches(hint, '\\b({tx.ONSITE_WORDS})\\b') OR city IS NOT NULL OR lower(location) NOT IN ({", ".join(repr(x) for x in tx.NO_PLACE)}) THEN 'onsite' ELSE 'unknown' END AS work_mode FROM b""")
def location_structs(t: Tables) -> DataFrame:
    return t.jobs.select("id", identity.location_struct(F.col("location"), F.col("title"), _cities(t)).alias("l")).select("id", "l.city", "l.country", "l.work_mode")
