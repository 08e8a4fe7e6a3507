"""Rewrites of snapshots and the values behind them, over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postgrain.functions import identity, labels, text as tx, values
from postgrain.operators import decisions
from postgrain.plans.identities import _cities, _COMPANY, _FIRST, _KEYED, _ROLE  # noqa: F401
from postgrain.plans.registry import Tables, query
from postgrain.plans.relational import weighted_volume_line

_HOST = "regexp_extract(lower(coalesce({c}, '')), '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1)"


@query(f"SELECT id, CASE WHEN {_HOST.format(c='application_url')} <> '' AND {_HOST.format(c='application_url')} <> {_HOST.format(c='source_url')} THEN 'external' ELSE apply_channel END AS apply_channel FROM jobs")
def retag_off_platform(t: Tables) -> DataFrame:
    host = lambda c: F.coalesce(tx.domain_of(F.col(c)), F.lit(""))
    off = (host("application_url") != "") & (host("application_url") != host("source_url"))
    return t.jobs.select("id", F.when(off, "external").otherwise(F.col("apply_channel")).alias("apply_channel"))


@query("SELECT id, 'queued' AS status FROM jobs WHERE is_active = 1 ORDER BY discovered_at, id LIMIT 50")
def queue_oldest(t: Tables) -> DataFrame:
    return t.jobs.where("is_active = 1").orderBy("discovered_at", "id").limit(50).select("id", F.lit("queued").alias("status"))


@query("SELECT id, ats_type, (row_number() OVER (PARTITION BY ats_type ORDER BY ats_confidence DESC NULLS LAST, id) = 1) AS is_active FROM companies WHERE ats_type IS NOT NULL")
def one_active_per_type(t: Tables) -> DataFrame:
    c = t.companies.where("ats_type is not null").select("id", "ats_type", "ats_confidence")
    best = c.groupBy("ats_type").agg(F.max_by("id", F.struct(F.coalesce("ats_confidence", F.lit(-1.0)), -F.col("id"))).alias("best"))
    rows = c.join(best, "ats_type").withColumn("is_active", F.lit(False))
    return decisions.only_active(rows, chosen=F.col("id") == F.col("best")).select("id", "ats_type", "is_active")


_FILLED = ["name", "domain", "website", "ats_type", "updated_at"]


@query("SELECT id, CAST(floor(100 * (" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _FILLED) + f") / {len(_FILLED)}.0) AS INT) AS complete FROM companies")
def company_completeness(t: Tables) -> DataFrame:
    return t.companies.select("id", values.completeness(**{c: F.col(c).isNotNull() for c in _FILLED}).alias("complete"))


@query("""WITH o AS (SELECT company_id AS id, count(*) AS n, count(*) FILTER (WHERE is_active = 1) AS live, max(last_seen) AS seen FROM jobs WHERE company_id IS NOT NULL GROUP BY 1)
  SELECT id, CASE WHEN live > 0 THEN 0 ELSE coalesce(ats_resolve_failures, 0) + CAST(n IS NULL OR live = 0 AS INT) END AS failures,
  CASE WHEN (CASE WHEN live > 0 THEN 0 ELSE coalesce(ats_resolve_failures, 0) + 1 END) >= 4 THEN 'generic' ELSE ats_type END AS crawl FROM companies LEFT JOIN o USING (id)""")
def crawl_bookkeeping(t: Tables) -> DataFrame:
    o = t.jobs.where("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(F.count_if(F.col("is_active") == 1).alias("live"))
    c = t.companies.select("id", "ats_type", "ats_resolve_failures").join(o, "id", "left")
    failures = F.when(F.col("live") > 0, 0).otherwise(F.coalesce("ats_resolve_failures", F.lit(0)) + 1)
    return c.select("id", failures.alias("failures"), F.when(failures >= 4, "generic").otherwise(F.col("ats_type")).alias("crawl"))


@query("""WITH f AS (SELECT posting_key, arg_min(capture_id, capture_id) AS a, max(capture_id) AS z FROM raw_posting WHERE posting_key IS NOT NULL GROUP BY 1),
  o AS (SELECT f.posting_key, r.title, r.location, r.source FROM f JOIN raw_posting r ON r.capture_id = f.a AND r.posting_key = f.posting_key), n AS (SELECT f.posting_key, r.title, r.location FROM f JOIN raw_posting r ON r.capture_id = f.z AND r.posting_key = f.posting_key),
  s AS (SELECT DISTINCT o.posting_key, coalesce(n.title, o.title) AS title, coalesce(n.location, o.location) AS location,
    CASE WHEN (n.title IS NOT NULL AND n.title IS DISTINCT FROM o.title) OR (n.location IS NOT NULL AND n.location IS DISTINCT FROM o.location) THEN 'edit' ELSE o.source END AS source FROM o JOIN n USING (posting_key)) SELECT * FROM s""")
def edits_of_captures(t: Tables) -> DataFrame:
    r = t.raw_posting.where("posting_key is not null")
    ends = r.groupBy("posting_key").agg(F.min_by(F.struct("title", "location", "source"), "capture_id").alias("a"), F.max_by(F.struct("title", "location"), "capture_id").alias("z"))
    old, new = ends.select("posting_key", "a.title", "a.location", "a.source"), ends.select("posting_key", "z.title", "z.location")
    return decisions.edited(old, new, key="posting_key", columns=["title", "location"], source="source", by="edit")


@query("""SELECT id, tag FROM (SELECT id, CASE WHEN is_active = 1 THEN 'open' END AS tag FROM jobs WHERE apply_channel = 'email' UNION ALL
  SELECT id, unnest(tags) FROM jobs WHERE apply_channel IS DISTINCT FROM 'email') WHERE tag IS NOT NULL""")
def replaced_tags(t: Tables) -> DataFrame:
    children = t.jobs.select("id", F.explode("tags").alias("tag"))
    incoming = t.jobs.where("apply_channel = 'email'").select("id", F.when(F.col("is_active") == 1, "open").alias("tag"))
    return decisions.replace_children(children, incoming, parent="id").where("tag is not null")


@query(f"""WITH {_KEYED}, k AS (SELECT id, source, source_url, sha256({_COMPANY} || '::' || {_ROLE}) AS h FROM j), m AS (SELECT h, min(id) AS kept FROM k GROUP BY 1)
  SELECT id, kept, CASE WHEN id = kept THEN 'KEPT' ELSE 'MERGED' END AS status FROM k JOIN m USING (h)""")
def merge_rewrite(t: Tables) -> DataFrame:
    c = _cities(t)
    k = t.jobs.select("id", F.sha2(F.concat_ws("::", tx.company_key(F.col("company")), identity.title_key(F.col("title"), c)), 256).alias("h"))
    m = k.groupBy("h").agg(F.min("id").alias("kept"))
    return k.join(m, "h").select("id", "kept", F.when(F.col("id") == F.col("kept"), "KEPT").otherwise("MERGED").alias("status"))


@query(f"""WITH {_KEYED}, k AS (SELECT id, source, source_url, discovered_at, last_seen, sha256({_COMPANY} || '::' || {_ROLE}) AS h FROM j), m AS (SELECT h, min(id) AS kept FROM k GROUP BY 1)
  SELECT kept AS job_id, source, source_url, epoch_us(min(discovered_at)) AS first_us, epoch_us(max(last_seen)) AS last_us FROM k JOIN m USING (h) WHERE source IS NOT NULL AND source_url IS NOT NULL GROUP BY 1, 2, 3""")
def repointed_sightings(t: Tables) -> DataFrame:
    j = merge_rewrite_rows(t)
    return j.where("source is not null and source_url is not null").groupBy(F.col("kept").alias("job_id"), "source", "source_url").agg(F.unix_micros(F.min("discovered_at")).alias("first_us"), F.unix_micros(F.max("last_seen")).alias("last_us"))


def merge_rewrite_rows(t: Tables) -> DataFrame:
    """Jobs with the lowest id of their identity."""
    c = _cities(t)
    k = t.jobs.select("id", "source", "source_url", "discovered_at", "last_seen", F.sha2(F.concat_ws("::", tx.company_key(F.col("company")), identity.title_key(F.col("title"), c)), 256).alias("h"))
    return k.join(k.groupBy("h").agg(F.min("id").alias("kept")), "h")


@query("""WITH c AS (SELECT id AS claim, company_id AS owner FROM jobs WHERE company_id IS NOT NULL) SELECT claim, owner FROM c WHERE owner NOT IN (SELECT id FROM companies WHERE domain IS NULL)""")
def released_claims(t: Tables) -> DataFrame:
    claims = t.jobs.where("company_id is not null").select(F.col("id").alias("claim"), F.col("company_id").alias("owner"))
    return decisions.release(claims, t.companies.where("domain is null").select(F.col("id").alias("owner")), owner="owner").select("claim", "owner")


@query("""WITH q AS (SELECT platform, company_key, trim(regexp_replace(regexp_replace(lower(coalesce(raw_label, '')), '\\((optional|required)\\)|\\b(please|kindly)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM form_question WHERE raw_label IS NOT NULL),
  s AS (SELECT platform, count(DISTINCT company_key) AS sampled FROM q GROUP BY 1),
  p AS (SELECT platform, count(*) / sum(count(*)) OVER () AS weight FROM jobs j JOIN (SELECT DISTINCT platform FROM form_question) f ON f.platform = j.source GROUP BY 1),
  v AS (SELECT k, round(sum(coalesce(weight, 0) * c / sampled), 9) AS volume FROM (SELECT k, platform, count(DISTINCT company_key) AS c FROM q GROUP BY 1, 2) x JOIN s USING (platform) LEFT JOIN p USING (platform) GROUP BY 1),
  r AS (SELECT k, volume, row_number() OVER (ORDER BY volume DESC, k) AS place FROM v)
  SELECT k AS label_key, place, place = (SELECT min(place) FROM r WHERE volume < 0.02) AS stopping_line FROM r WHERE volume >= 0.02 OR place = (SELECT min(place) FROM r WHERE volume < 0.02)""")
def ranked_questions(t: Tables) -> DataFrame:
    """Rank by weighted volume down to the stopping line, the first label under two per cent: the part above it is a report, as short as 1 / 0.02 of the mean volume allows."""
    from pyspark.sql import Window

    v = weighted_volume_line(t)
    line = v.where("under_line").orderBy(F.desc("volume"), "label_key").limit(1)
    top = v.where("not under_line").withColumn("stopping_line", F.lit(False)).unionByName(line.withColumn("stopping_line", F.lit(True)))
    # only labels over the line reach the one ordered partition: volumes are shares of companies, so they are few
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("volume"), "label_key"))).select("label_key", "place", "stopping_line")


@query("SELECT id, CASE WHEN lower(trim(work_mode)) IN ('remote', 'hybrid', 'onsite') THEN lower(trim(work_mode)) ELSE 'unknown' END AS mode, CASE WHEN field IS NULL THEN '' ELSE field END AS facts FROM (SELECT id, work_mode, array_to_string(list_filter(['Title: ' || nullif(trim(title), ''), 'Company: ' || nullif(trim(company), ''), 'Place: ' || nullif(trim(location), '')], lambda x: x IS NOT NULL), chr(10)) AS field FROM jobs)")
def job_passages(t: Tables) -> DataFrame:
    return t.jobs.select("id", values.enum_or_default(F.col("work_mode"), ["remote", "hybrid", "onsite"], "unknown").alias("mode"), values.labelled_lines(Title=F.col("title"), Company=F.col("company"), Place=F.col("location")).alias("facts"))


@query("""SELECT id, coalesce(len(coalesce(options_json, [])) = 0 AND field_type NOT IN ('file', 'select', 'multi_select', 'boolean', 'radio', 'checkbox', 'date', 'email', 'phone', 'number', 'url', 'location')
  AND (field_type = 'textarea' OR (length(raw_label) >= 20 AND regexp_matches(raw_label, '(?i)\\b(why|how|describe|tell us|explain|share|what)\\b'))), false) AS free FROM form_question WHERE field_type IS NOT NULL""")
def open_questions(t: Tables) -> DataFrame:
    return t.form_question.where("field_type is not null").select("id", values.open_question(F.col("raw_label"), F.col("field_type"), F.col("options_json")).alias("free"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(k, '\\b(european union|united kingdom|united states|netherlands|australia|singapore|america|canada|france|germany|ireland|india|japan|u s|usa|eu|uk|us)\\b'),
  lambda x: CASE x WHEN 'united states' THEN 'us' WHEN 'u s' THEN 'us' WHEN 'usa' THEN 'us' WHEN 'america' THEN 'us' WHEN 'united kingdom' THEN 'uk' WHEN 'european union' THEN 'eu' ELSE x END))), ',') AS countries
  FROM (SELECT id, trim(regexp_replace(lower(title || ' ' || coalesce(location, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM jobs WHERE title IS NOT NULL)""")
def countries_named(t: Tables) -> DataFrame:
    k = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "title", F.coalesce("location", F.lit("")))), "[^a-z0-9]+", " "))
    return t.jobs.where("title is not null").select("id", F.array_join(labels.countries_in(k), ",").alias("countries"))


@query("SELECT source, greatest(1000 - count(*) FILTER (WHERE is_active = 1) - count(*) FILTER (WHERE is_active = 0), 0) AS left_today FROM jobs WHERE source IS NOT NULL GROUP BY 1")
def budget_left(t: Tables) -> DataFrame:
    g = t.jobs.where("source is not null").groupBy("source").agg(F.count_if(F.col("is_active") == 1).alias("a"), F.count_if(F.col("is_active") == 0).alias("b"))
    return g.select("source", values.remaining(F.lit(1000), F.col("a"), F.col("b")).alias("left_today"))
