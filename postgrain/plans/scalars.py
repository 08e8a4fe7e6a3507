"""Text, date, array, JSON and key expressions; clusters and vectors; parsers and streams over landed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postgrain.functions import context, html, text as tx
from postgrain.operators import cluster, rules, vectors
from postgrain.plans.registry import Tables, query
from postgrain.sources import payloads
from postgrain.streaming import ingest

_ALNUM = "regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"
_BARE = "trim(regexp_replace(coalesce({c}, ''), '(?i)\\b(private limited|pvt\\.? ltd\\.?|pvt|ltd|limited|inc|llc|llp|corp|corporation|gmbh|co)\\b\\.?', ' ', 'g'), ' .,')"
_TAIL = "regexp_replace({x}, '(?i)(\\s+(software|technologies|technology|tech|solutions|services|systems|labs|india|ventures|innovations|global|digital|internet|consulting))+\\s*$', '')"


@query("SELECT id, regexp_replace(lower(CASE WHEN bare <> trim(coalesce(company, ''), ' .,') THEN CASE WHEN cut = '' THEN bare ELSE cut END ELSE bare END), '[^a-z0-9]', '', 'g') AS company_key, regexp_replace(lower(CASE WHEN cut = '' THEN bare ELSE cut END), '[^a-z0-9]', '', 'g') AS brand_key FROM (SELECT *, " + _TAIL.format(x="bare") + " AS cut FROM (SELECT id, company, " + _BARE.format(c="company") + " AS bare FROM jobs))")
def company_and_brand_key(t: Tables) -> DataFrame:
    return t.jobs.select("id", tx.company_key(F.col("company")).alias("company_key"), tx.brand_key(F.col("company")).alias("brand_key"))


_TITLE = "array_to_string(list_sort(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\\b(remote|hybrid|on[\\s-]?site|work from home|wfh|paid|unpaid)\\b', ' ', 'g'), '(?i)\\b(interns|internships?)\\b', 'intern', 'g')), '[a-z0-9]+')), '-')"


@query(f"SELECT id, {_TITLE} AS title_key FROM jobs")
def title_key(t: Tables) -> DataFrame:
    return t.jobs.select("id", tx.title_key(F.col("title")).alias("title_key"))


_MODE = """CASE WHEN regexp_matches(lower(concat_ws(' ', location, title)), '\\bhybrid\\b') THEN 'hybrid'
  WHEN regexp_matches(lower(concat_ws(' ', location, title)), '\\bremote\\b|\\bwork[ -]from[ -]home\\b|\\bwfh\\b|\\banywhere\\b|\\bdistributed\\b|\\bvirtual\\b') THEN 'remote'
  WHEN lower(trim(coalesce(location, ''))) NOT IN ('', 'unknown', 'n/a', 'na', 'tbd', '-', 'various', 'multiple locations') THEN 'onsite' ELSE 'unknown' END"""


@query(f"SELECT id, {_MODE} AS mode FROM jobs")
def work_mode_from_text(t: Tables) -> DataFrame:
    return t.jobs.select("id", tx.work_mode(F.col("location"), F.col("title")).alias("mode"))


@query(f"""WITH k AS (SELECT id, sha256({_ALNUM.format(c='company')} || '::' || {_TITLE} || '::' || CASE WHEN {_MODE} = 'remote' THEN 'remote' WHEN {_ALNUM.format(c='city')} <> '' THEN {_ALNUM.format(c='city')}
  WHEN left({_ALNUM.format(c='location')}, 60) <> '' THEN left({_ALNUM.format(c='location')}, 60) ELSE 'unknown' END) AS dedup_hash FROM jobs)
  SELECT dedup_hash, min(id) AS kept, count(*) - 1 AS merged FROM k GROUP BY 1""")
def keep_first_dedup(t: Tables) -> DataFrame:
    key = F.concat_ws("::", tx.alnum_key(F.col("company")), tx.title_key(F.col("title")), tx.place_key(F.col("location"), F.col("title"), F.col("city")))
    return t.jobs.groupBy(F.sha2(key, 256).alias("dedup_hash")).agg(F.min("id").alias("kept"), (F.count("*") - 1).alias("merged"))


@query("""SELECT id, CASE WHEN h <> '' AND contains(h, '.') AND NOT regexp_matches(h, '(^|\\.)(quagudahu\\.example|hireloop\\.example)$') THEN h END AS host
  FROM (SELECT id, regexp_extract(CASE WHEN regexp_matches(u, '^[a-z]+://') THEN u ELSE 'http://' || u END, '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1) AS h FROM (SELECT id, lower(trim(coalesce(website, domain))) AS u FROM companies))""")
def domain_of(t: Tables) -> DataFrame:
    return t.companies.select("id", tx.domain_of(F.coalesce("website", "domain"), "quagudahu\\.example|hireloop\\.example").alias("host"))


@query("SELECT listing_id, left(trim(regexp_replace(regexp_replace(company, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g'), '\\s+', ' ', 'g'), ' -|,;:.'), 200) AS name FROM board_listings")
def clean_name(t: Tables) -> DataFrame:
    return t.board_listings.select("listing_id", tx.clean_name(F.col("company")).alias("name"))


_LABEL = "trim(regexp_replace(regexp_replace(lower(coalesce(raw_label, '')), '\\((optional|required)\\)|\\b(please|kindly)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(raw_label, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '[\\s*✱:]+$', '') AS label, {_LABEL} AS label_key, left(array_to_string(string_split({_LABEL}, ' ')[1:6], '_'), 60) AS slug FROM form_question")
def label_normalise(t: Tables) -> DataFrame:
    x = F.col("raw_label")
    return t.form_question.select("id", tx.clean_label(x).alias("label"), tx.label_key(x).alias("label_key"), tx.slug(x).alias("slug"))


@query("""SELECT company_id, sha1(array_to_string(list_sort(list(DISTINCT k)), '|')) AS fingerprint, count(*) AS fields FROM (SELECT company_id, """ + _LABEL + """ AS k FROM form_question WHERE company_id IS NOT NULL) GROUP BY 1""")
def form_fingerprint(t: Tables) -> DataFrame:
    k = t.form_question.where("company_id is not null").select("company_id", tx.label_key(F.col("raw_label")).alias("k"))
    d = k.groupBy("company_id", "k").agg(F.count("*").alias("n"))
    return d.groupBy("company_id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("k")), "|")).alias("fingerprint"), F.sum("n").alias("fields"))


@query("""SELECT id, CASE WHEN regexp_matches(u, '^mailto:') THEN 'email' WHEN regexp_matches(u, 'docs\\.google\\.com/forms|forms\\.gle') THEN 'form'
  WHEN regexp_matches(u, '//[a-z-]+\\.example/[a-z0-9-]+/\\d+/application') THEN 'ats_direct' WHEN regexp_matches(u, '/careers/\\d+/apply') THEN 'company_site' WHEN regexp_matches(u, '//[a-z]+\\.example/internship/') THEN 'board' ELSE 'unknown' END AS channel
  FROM (SELECT id, lower(coalesce(application_url, '')) AS u FROM jobs)""")
def channel_of_address(t: Tables) -> DataFrame:
    table = [("email", "^mailto:"), ("form", "docs\\.google\\.com/forms|forms\\.gle"), ("ats_direct", "//[a-z-]+\\.example/[a-z0-9-]+/\\d+/application"), ("company_site", "/careers/\\d+/apply"), ("board", "//[a-z]+\\.example/internship/")]
    return t.jobs.select("id", rules.first_match(F.lower(F.coalesce("application_url", F.lit(""))), table, "unknown").alias("channel"))


@query("SELECT id, title, nullif(regexp_extract(concat_ws(' ', title, location), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS number, nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(country), '')), '') AS place, repeat('X', greatest(length(source_id) - 4, 0)::INTEGER) || right(source_id, 4) AS masked FROM jobs")
def value_expressions(t: Tables) -> DataFrame:
    return t.jobs.select("id", "title", tx.first_number(F.concat_ws(" ", "title", "location")).alias("number"), tx.joined(", ", F.col("city"), F.col("country")).alias("place"), tx.mask(F.col("source_id")).alias("masked"))


@query("""SELECT id, CASE WHEN v IS NULL OR options_json IS NULL THEN NULL WHEN list_contains(options_json, v) THEN v WHEN len(same) >= 1 THEN same[1] WHEN len(part) = 1 THEN part[1] END AS chosen FROM (
  SELECT id, options_json, v, list_filter(options_json, lambda o: lower(trim(o)) = lower(trim(v))) AS same, list_filter(options_json, lambda o: contains(lower(o), lower(trim(v))) OR contains(lower(trim(v)), lower(o))) AS part
  FROM (SELECT id, options_json, CASE id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN options_json[1] ELSE 'No' END AS v FROM form_question))""")
def match_option(t: Tables) -> DataFrame:
    v = F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, F.get("options_json", F.lit(0))).otherwise("No")
    return t.form_question.withColumn("v", v).select("id", tx.match_option(F.col("v"), F.col("options_json")).alias("chosen"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(date_trunc('day', ts)) AS day_us, strftime(ts, '%d %m %Y') AS shown FROM events")
def json_and_day(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    day = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    return t.events.select("event_id", k.alias("k"), day.alias("day_us"), F.date_format("ts", "dd MM yyyy").alias("shown"))


@query("""SELECT id, list_sort(list_distinct(list_concat(coalesce(tags, []), ['open', 'intern']))) AS merged, list_sort(list_filter(coalesce(tags, []), lambda x: x NOT IN ('docker', 'linux'))) AS rest, list_contains(coalesce(tags, []), 'docker') AS has FROM jobs""")
def array_expressions(t: Tables) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return t.jobs.select("id", F.array_sort(F.array_union(tags, F.array(F.lit("open"), F.lit("intern")))).alias("merged"), F.array_sort(F.filter(tags, lambda x: ~x.isin("docker", "linux"))).alias("rest"), F.array_contains(tags, "docker").alias("has"))


@query()
def html_text_lengths(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null")
    return d.select("doc_id", F.length(html.html_to_text(F.col("text"))).alias("n"), F.size(html.html_links(F.col("text"))).alias("links"))


@query()
def years_and_months(t: Tables) -> DataFrame:
    j = t.jobs.where("description_text is not null")
    return j.select("id", context.years_of_experience(F.col("description_text")).alias("years"), context.duration_months(F.col("description_text")).alias("months"))


@query()
def leader_clusters(t: Tables) -> DataFrame:
    q = t.form_question.select("id", "raw_label", "field_type", tx.label_key(F.col("raw_label")).alias("k"))
    return cluster.question_clusters(q, label="k", raw="raw_label", kind="field_type", row="id")


@query("""SELECT q.vec_id AS query, arg_max(r.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) * 1e12 - r.vec_id) AS key FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1""")
def cosine_top1(t: Tables) -> DataFrame:
    e = t.embeddings
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), key="vec_id", vector="embedding", k=1).select("query", "key")


@query("""SELECT id, source_url AS url, title, company AS employer, coalesce(nullif(location, ''), 'Worldwide') AS place, len(coalesce(tags, [])) AS n_tags FROM jobs WHERE coalesce(title, '') <> '' AND coalesce(company, '') <> ''""")
def json_payload_scan(t: Tables) -> DataFrame:
    return payloads.postings_of_json(payloads.as_json_payload(t.jobs), "payload")


@query("SELECT posting_key, count(*) AS n, max(capture_id) AS last_capture FROM raw_posting WHERE posting_key IS NOT NULL GROUP BY 1")
def stream_counts(t: Tables) -> DataFrame:
    return ingest.counts_by_stream(t.spark, f"{t.dir}/raw_posting.parquet")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    return ingest.hourly_by_stream(t.spark, f"{t.dir}/events.parquet")
