"""Places, references, grounding, sections, claims and cadence over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postgrain.functions import grounding, places, robots
from postgrain.operators import merge, rules
from postgrain.plans.registry import Tables, query
from postgrain.sources import textfiles

_NAMES = "SELECT city, lower(city) AS alias FROM city_ref UNION SELECT city, lower(unnest(other_names)) FROM city_ref"


@query(f"""WITH names AS ({_NAMES}), one AS (SELECT j.id, lower(coalesce(j.location, '')) AS t FROM jobs j),
  hit AS (SELECT id, city FROM one JOIN names ON contains(' ' || regexp_replace(replace(t, '.', ''), '[^\\p{{L}}-]+', ' ', 'g') || ' ', ' ' || replace(alias, '.', '') || ' '))
  SELECT id, list_sort(list(DISTINCT city)) AS cities FROM hit GROUP BY 1""")
def places_in_text(t: Tables) -> DataFrame:
    aliases = {a: c for c, others in t.city_ref.select("city", "other_names").collect() for a in [c, *(others or [])]}  # fixed list
    p = t.jobs.select("id", F.array_sort(places.places_in(F.col("location"), aliases)).alias("cities"))
    return p.where(F.size("cities") > 0)


@query("SELECT id, regexp_extract(application_url, '//([a-z-]+)\\.example/', 1) AS host, regexp_extract(application_url, '/(\\d+)', 1) AS token FROM jobs WHERE regexp_matches(application_url, '//[a-z-]+\\.example/') AND regexp_matches(application_url, '/\\d+')")
def refs_in_address(t: Tables) -> DataFrame:
    refs = places.refs_in(F.col("application_url"), {"host": "//([a-z-]+)\\.example/", "token": "/(\\d+)"})
    r = t.jobs.where("application_url is not null").select("id", refs.alias("r"))
    pick = lambda kind: F.get(F.filter("r", lambda x: x["kind"] == kind), F.lit(0))["token"]
    return r.select("id", pick("host").alias("host"), pick("token").alias("token")).where("host is not null and token is not null")


@query("SELECT id, CASE ats_type WHEN 'pillarhire' THEN 'https://pillarhire.example/' || normalized_name WHEN 'ferryboard' THEN 'https://' || normalized_name || '.ferryboard.example' END AS url FROM companies")
def board_address(t: Tables) -> DataFrame:
    templates = {"pillarhire": "https://pillarhire.example/{token}", "ferryboard": "https://{token}.ferryboard.example"}
    return t.companies.select("id", places.templated(F.col("ats_type"), F.col("normalized_name"), templates).alias("url"))


@query("""SELECT id, len(list_distinct(list_filter(regexp_extract_all(coalesce(compensation_text, ''), '\\d+(?:\\.\\d+)?'), lambda x: NOT list_contains(regexp_extract_all(coalesce(description_text, ''), '\\d+(?:\\.\\d+)?'), x)))) AS numbers FROM jobs""")
def ungrounded_numbers(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.size(grounding.unsupported_numbers(F.col("compensation_text"), F.col("description_text"))).alias("numbers"))


@query("""SELECT id, list_sort(list_filter(coalesce(tags, []), lambda v: length(trim(v)) >= 3 AND contains(lower(coalesce(description_text, '')), lower(trim(v))))) AS found FROM jobs""")
def values_in_text(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.array_sort(grounding.leaked_values(F.col("description_text"), F.col("tags"))).alias("found"))


@query("""WITH l AS (SELECT id, generate_subscripts(string_split(description_text, chr(10)), 1) - 1 AS line_no, unnest(string_split(description_text, chr(10))) AS line FROM jobs WHERE description_text IS NOT NULL),
  s AS (SELECT id, line, CASE WHEN NOT regexp_matches(line, '^\\s*[-•]') THEN line_no END AS h, line_no FROM l)
  SELECT id, last_value(h IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS under, line_no FROM s WHERE true QUALIFY h IS NULL""")
def bullets_under_heading(t: Tables) -> DataFrame:
    ls = textfiles.lines(t.jobs, "id", "description_text")
    heading = F.when(~F.col("line").rlike("^\\s*[-•]"), F.col("line_no"))
    return textfiles.sections(ls, "id", heading).select("id", F.col("section").alias("under"), "line_no")


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY id) = 1 THEN domain END AS domain FROM companies WHERE domain IS NOT NULL")
def unique_domain_claims(t: Tables) -> DataFrame:
    c = t.companies.where("domain is not null").select("id", "domain")
    first = c.groupBy("domain").agg(F.min("id").alias("holder"))
    return c.join(first, "domain").select("id", F.when(F.col("id") == F.col("holder"), F.col("domain")).alias("domain"))


@query("SELECT source, epoch_us(max(fetched_at)) AS last_us, epoch_us(max(fetched_at)) + 3 * 86400000000 <= 1787000000000000 AS due FROM raw_posting WHERE source <> 'career_pages' GROUP BY 1")
def cadence_due(t: Tables) -> DataFrame:
    last = F.unix_micros(F.max("fetched_at"))
    return t.raw_posting.where("source <> 'career_pages'").groupBy("source").agg(last.alias("last_us"), (last + 3 * 86_400_000_000 <= 1_787_000_000_000_000).alias("due"))


@query("""WITH e AS (SELECT company_id, id, generate_subscripts(tags, 1) AS p, unnest(tags) AS tag FROM jobs WHERE company_id IS NOT NULL),
  f AS (SELECT company_id, tag, min(id * 1000 + p) AS pos FROM e GROUP BY 1, 2)
  SELECT c.company_id, coalesce(list(tag ORDER BY pos) FILTER (WHERE tag IS NOT NULL), []) AS tags FROM (SELECT DISTINCT company_id FROM jobs WHERE company_id IS NOT NULL) c LEFT JOIN f USING (company_id) GROUP BY 1""")
def ordered_union(t: Tables) -> DataFrame:
    return merge.fold(t.jobs, key=["company_id"], order="id", policies={"tags": "union"})


_FAMILIES = [("data", "\\bdata\\b|\\banalytics?\\b"), ("learning", "\\bmachine learning\\b|\\bml\\b|\\bnlp\\b|\\bcomputer vision\\b"), ("design", "\\bdesign(er)?\\b|\\bui/ux\\b"), ("software", "\\bsoftware\\b|\\bdeveloper\\b|\\bdevelopment\\b|\\bengineer(ing)?\\b")]
_FAMILY_SQL = " ".join(f"WHEN regexp_matches(lower(coalesce(title, '')), '{p}') THEN '{k}'" for k, p in _FAMILIES)


@query(f"SELECT id, CASE {_FAMILY_SQL} ELSE 'other' END AS family FROM jobs")
def title_family(t: Tables) -> DataFrame:
    return t.jobs.select("id", rules.first_match(F.lower(F.coalesce("title", F.lit(""))), _FAMILIES, "other").alias("family"))


@query("""SELECT id, regexp_matches(path, '^/p/') OR NOT (regexp_matches(path, '^/internship/') OR regexp_matches(path, '/application$')) AS allowed FROM (SELECT id, regexp_extract(application_url, '^https?://[^/]+(/.*)$', 1) AS path FROM jobs WHERE application_url LIKE 'http%')""")
def robots_allowed(t: Tables) -> DataFrame:
    text = "User-agent: *\nDisallow: /internship/\nDisallow: /*/application$\nAllow: /p/\n"
    rows = t.spark.createDataFrame([(text,)], "text string").select(F.explode(robots.rules_of(F.col("text"))).alias("r")).select("r.*")
    hosts = t.jobs.where("application_url like 'http%'").select("id", F.regexp_extract("application_url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("application_url", "^https?://[^/]+(/.*)$", 1).alias("path"))
    r = hosts.select("host").distinct().crossJoin(F.broadcast(rows))  # three fixed rules for each host
    return robots.allowed(hosts, r, key="id", host="host", path="path", agent="grainbot").select(F.col("key").alias("id"), "allowed")
