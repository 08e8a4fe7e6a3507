"""Lookups with defaults, aliases, typed inputs, gates and samples over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from postgrain.functions import text as tx, values
from postgrain.operators import merge
from postgrain.plans.registry import Tables, query


@query("SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY is_active DESC NULLS LAST, discovered_at DESC NULLS LAST, id) AS rn FROM jobs WHERE application_url LIKE 'http%') WHERE rn = 1 AND source IS NOT NULL")
def sample_posting(t: Tables) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.desc_nulls_last("is_active"), F.desc_nulls_last("discovered_at"), "id")
    j = t.jobs.where(F.col("application_url").like("http%") & F.col("source").isNotNull()).select("source", "id", "is_active", "discovered_at")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("source", "id")


@query("SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM jobs WHERE is_active = 1) AS active, (SELECT min(id) FROM jobs WHERE is_active = 1) AS first_active")
def counts_and_first(t: Tables) -> DataFrame:
    c = t.companies.agg(F.count("*").alias("companies"))
    return c.crossJoin(t.jobs.where("is_active = 1").agg(F.count("*").alias("active"), F.min("id").alias("first_active")))  # one row each


@query("SELECT id, array_to_string(list_filter(['city=' || nullif(trim(city), ''), 'country=' || nullif(trim(country), ''), 'mode=' || nullif(nullif(trim(work_mode), ''), 'unknown')], lambda x: x IS NOT NULL), ';') AS facts, len(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL)) AS n_tags FROM jobs")
def compact_profiles(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("city"), F.nullif(F.trim("city"), F.lit("")), F.lit("country"), F.nullif(F.trim("country"), F.lit("")), F.lit("mode"), F.nullif(F.nullif(F.trim("work_mode"), F.lit("")), F.lit("unknown")))
    said = F.map_filter(m, lambda _, v: v.isNotNull())
    facts = F.array_join(F.transform(F.map_entries(said), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.jobs.select("id", facts.alias("facts"), F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("n_tags"))


_SLUG = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT j.id, c.domain FROM (SELECT id, company_id, {_SLUG} AS slug FROM jobs) j JOIN companies c ON c.id = j.company_id WHERE j.slug <> '' AND c.domain IS NOT NULL")
def one_lookup_per_group(t: Tables) -> DataFrame:
    slug = F.btrim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    j = t.jobs.select("id", "company_id", slug.alias("slug")).where("slug <> ''")
    asked = j.select("company_id", "slug").distinct()
    found = asked.join(t.companies.select(F.col("id").alias("company_id"), "domain").where("domain is not null"), "company_id")
    return j.join(found, ["company_id", "slug"]).select("id", "domain")


_KEY = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\((optional|required)\\)|\\b(please|kindly)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT {_KEY.format(c='label')} AS alias, canonical_key AS key, 0 AS rank FROM question_ref UNION ALL SELECT {_KEY.format(c='sample_phrasing')}, canonical_key, 1 FROM question_ref
  UNION ALL SELECT {_KEY.format(c='raw_label')}, 'custom', 2 FROM form_question WHERE raw_label IS NOT NULL) SELECT alias, arg_min(key, rank || key) AS key FROM a WHERE alias <> '' GROUP BY 1""")
def alias_table(t: Tables) -> DataFrame:
    q, f = t.question_ref, t.form_question.where("raw_label is not null")
    a = q.select(tx.label_key(F.col("label")).alias("alias"), F.col("canonical_key").alias("key"), F.lit(0).alias("rank"))
    a = a.unionByName(q.select(tx.label_key(F.col("sample_phrasing")).alias("alias"), F.col("canonical_key").alias("key"), F.lit(1).alias("rank")))
    a = a.unionByName(f.select(tx.label_key(F.col("raw_label")).alias("alias"), F.lit("custom").alias("key"), F.lit(2).alias("rank")))
    return a.where("alias <> ''").groupBy("alias").agg(F.min_by("key", F.struct("rank", "key")).alias("key"))


@query(f"""WITH known AS (SELECT {_KEY.format(c='label')} AS alias FROM question_ref UNION SELECT {_KEY.format(c='sample_phrasing')} FROM question_ref),
  f AS (SELECT {_KEY.format(c='raw_label')} AS alias, min(id) AS id FROM form_question WHERE raw_label IS NOT NULL AND times_seen >= 5 GROUP BY 1) SELECT alias, id FROM f WHERE alias <> '' AND alias NOT IN (SELECT alias FROM known)""")
def learned_aliases(t: Tables) -> DataFrame:
    """Aliases written back: labels seen often that no alias has yet."""
    q = t.question_ref
    known = q.select(tx.label_key(F.col("label")).alias("alias")).unionByName(q.select(tx.label_key(F.col("sample_phrasing")).alias("alias")))
    f = t.form_question.where("raw_label is not null and times_seen >= 5").select(tx.label_key(F.col("raw_label")).alias("alias"), "id").where("alias <> ''")
    return merge.insert_absent(known, f, key=["alias"])


@query("SELECT DISTINCT j.source, coalesce(r.tier, 3) AS tier, coalesce(r.time_zone, 'UTC') AS time_zone, coalesce(r.day_first, true) AS day_first FROM jobs j LEFT JOIN source_registry r ON r.source = j.source AND r.tier < 3 WHERE j.source IS NOT NULL")
def settings_with_defaults(t: Tables) -> DataFrame:
    over = t.source_registry.where("tier < 3").select("source", "tier", "time_zone", "day_first")
    s = t.jobs.where("source is not null").select("source").distinct().join(over, "source", "left")
    return s.select("source", F.coalesce("tier", F.lit(3)).alias("tier"), F.coalesce("time_zone", F.lit("UTC")).alias("time_zone"), F.coalesce("day_first", F.lit(True)).alias("day_first"))


@query("SELECT id, CASE WHEN regexp_matches(coalesce(application_url, ''), '//[a-z-]+\\.example/') THEN regexp_extract(application_url, '//([a-z-]+)\\.example/', 1) WHEN regexp_matches(coalesce(source_url, ''), '//[a-z-]+\\.example/') THEN regexp_extract(source_url, '//([a-z-]+)\\.example/', 1) END AS board, CASE WHEN regexp_matches(coalesce(application_url, ''), '//[a-z-]+\\.example/') THEN 0.95::DOUBLE WHEN regexp_matches(coalesce(source_url, ''), '//[a-z-]+\\.example/') THEN 0.85::DOUBLE END AS confidence FROM jobs")
def board_of_page(t: Tables) -> DataFrame:
    pattern = "//([a-z-]+)\\.example/"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))
    a, b = found("application_url"), found("source_url")
    return t.jobs.select("id", F.coalesce(a, b).alias("board"), F.when(a.isNotNull(), 0.95).when(b.isNotNull(), 0.85).alias("confidence"))


@query("SELECT platform, count(*) AS n, count(*) FILTER (WHERE company_key IS NULL) AS missing, bool_and(company_key IS NOT NULL) AS ready FROM form_question WHERE platform IS NOT NULL GROUP BY 1")
def all_confirmed(t: Tables) -> DataFrame:
    ok = F.col("company_key").isNotNull()
    return t.form_question.where("platform is not null").groupBy("platform").agg(F.count("*").alias("n"), F.count_if(~ok).alias("missing"), F.bool_and(ok).alias("ready"))


@query("SELECT id, try_cast(regexp_replace(compensation_text, '[^0-9.]', '', 'g') AS DOUBLE) AS amount, upper(trim(stipend_currency)) AS currency, upper(trim(stipend_currency)) IN (SELECT unit FROM pay_units WHERE unit_kind = 'currency') AND try_cast(regexp_replace(compensation_text, '[^0-9.]', '', 'g') AS DOUBLE) > 0 AS valid FROM jobs WHERE compensation_text IS NOT NULL AND stipend_currency IS NOT NULL")
def typed_inputs(t: Tables) -> DataFrame:
    amount, cur = F.regexp_replace("compensation_text", "[^0-9.]", "").try_cast("double"), F.upper(F.trim("stipend_currency"))
    known = t.pay_units.where("unit_kind = 'currency'").select(F.col("unit").alias("currency"), F.lit(True).alias("known")).distinct()
    j = t.jobs.where("compensation_text is not null and stipend_currency is not null").select("id", amount.alias("amount"), cur.alias("currency")).join(known, "currency", "left")
    return j.select("id", "amount", "currency", (F.coalesce("known", F.lit(False)) & (F.col("amount") > 0)).alias("valid"))


@query("""WITH o AS (SELECT company_id AS id, arg_max(city, struct_pack(a := last_seen, b := -id)) AS city FROM jobs WHERE company_id IS NOT NULL AND city <> '' AND last_seen IS NOT NULL GROUP BY 1)
  SELECT id, name, o.city AS mirrored FROM companies LEFT JOIN o USING (id)""")
def mirrored_city(t: Tables) -> DataFrame:
    """The newest child's value on the parent row."""
    o = t.jobs.where("company_id is not null and city <> '' and last_seen is not null").groupBy(F.col("company_id").alias("id")).agg(F.max_by("city", F.struct("last_seen", -F.col("id"))).alias("mirrored"))
    return t.companies.select("id", "name").join(o, "id", "left")


@query("SELECT id, nullif(coalesce(nullif(trim(posted_date), ''), nullif(trim(deadline), ''), 'unknown'), '') AS said, coalesce(regexp_extract(compensation_text, '(\\d+)', 1), '') AS digits FROM jobs")
def date_or_text(t: Tables) -> DataFrame:
    said = values.date_of(F.col("posted_date"), F.col("deadline"), F.lit("unknown"))
    return t.jobs.select("id", said.alias("said"), F.coalesce(values.widget_value(F.col("compensation_text"), F.lit("number")), F.lit("")).alias("digits"))
