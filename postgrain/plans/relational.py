"""Filters, pages, joins, aggregations, windows and set operations over postings, companies and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from postgrain.functions import text as tx
from postgrain.operators import merge, rules, running
from postgrain.plans.registry import Tables, query


@query("SELECT id, title, company FROM jobs WHERE is_active = 1 AND (title ILIKE '%engineer%' OR company ILIKE '%engineer%') ORDER BY discovered_at DESC, id LIMIT 25 OFFSET 50")
def search_ilike_page(t: Tables) -> DataFrame:
    j = t.jobs.where((F.col("is_active") == 1) & (F.col("title").ilike("%engineer%") | F.col("company").ilike("%engineer%")))
    return j.orderBy(F.desc("discovered_at"), "id").offset(50).limit(25).select("id", "title", "company")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE is_active = 1) AS active FROM jobs")
def count_active(t: Tables) -> DataFrame:
    return t.jobs.agg(F.count("*").alias("n"), F.count_if(F.col("is_active") == 1).alias("active"))


@query("SELECT id, title, source, is_active FROM jobs WHERE id = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.jobs.where("id = 7").select("id", "title", "source", "is_active")


@query("SELECT DISTINCT source FROM jobs WHERE source IS NOT NULL")
def facet_distinct(t: Tables) -> DataFrame:
    return t.jobs.where("source is not null").select("source").distinct()


@query("SELECT j.id, c.name FROM jobs j LEFT JOIN companies c ON j.company_id = c.id WHERE j.source IN ('internbox', 'hireloop')")
def status_in_with_lookup(t: Tables) -> DataFrame:
    c = t.companies.select(F.col("id").alias("cid"), "name")
    return t.jobs.where(F.col("source").isin("internbox", "hireloop")).join(c, F.col("company_id") == F.col("cid"), "left").select("id", "name")


@query("""SELECT id, CAST(power(2, ats_resolve_failures) AS BIGINT) AS wait_days,
  epoch_us(updated_at) + CAST(power(2, ats_resolve_failures) AS BIGINT) * 86400000000 <= 1780000000000000 AS due FROM companies""")
def due_by_backoff(t: Tables) -> DataFrame:
    wait = F.pow(F.lit(2), F.col("ats_resolve_failures")).cast("bigint")
    return t.companies.select("id", wait.alias("wait_days"), (F.unix_micros("updated_at") + wait * 86_400_000_000 <= 1_780_000_000_000_000).alias("due"))


@query("""SELECT DISTINCT v FROM (SELECT trim(name) AS v FROM companies UNION ALL SELECT trim(company) FROM jobs UNION ALL SELECT unnest(tags) FROM jobs)
  WHERE length(v) >= 3 AND v NOT IN ('docker', 'linux')""")
def union_of_values(t: Tables) -> DataFrame:
    v = t.companies.select(F.trim("name").alias("v")).union(t.jobs.select(F.trim("company"))).union(t.jobs.select(F.explode("tags")))
    return v.where((F.length("v") >= 3) & ~F.col("v").isin("docker", "linux")).distinct()


_LABEL_SQL = "trim(regexp_replace(regexp_replace(lower(coalesce(raw_label, '')), '\\((optional|required)\\)|\\b(please|kindly)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT platform, k AS label_key, min(id) AS first_id, count(*) AS n FROM (SELECT platform, id, {_LABEL_SQL} AS k FROM form_question) WHERE k <> '' GROUP BY 1, 2")
def keep_first_per_label(t: Tables) -> DataFrame:
    q = t.form_question.select("platform", "id", tx.label_key(F.col("raw_label")).alias("label_key")).where("label_key <> ''")
    return q.groupBy("platform", "label_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


_RULES = [("identity", "name|email|phone"), ("document", "resume|cv|letter"), ("work", "visa|author|sponsor|relocat"), ("pay", "pay|salary|stipend|ctc"), ("study", "degree|college|gpa|graduat")]
_RULES_SQL = " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{k}'" for k, p in _RULES)


@query(f"SELECT c AS concept, count(*) AS n FROM (SELECT CASE {_RULES_SQL} ELSE 'custom' END AS c FROM (SELECT {_LABEL_SQL} AS k FROM form_question)) GROUP BY 1")
def rule_first_match(t: Tables) -> DataFrame:
    return t.form_question.select(rules.first_match(tx.label_key(F.col("raw_label")), _RULES, "custom").alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query("SELECT q.id, q.raw_label, j.title FROM form_question q JOIN jobs j ON q.job_id = j.id WHERE q.is_required AND j.is_active = 1")
def join_filter(t: Tables) -> DataFrame:
    j = t.jobs.where("is_active = 1").select(F.col("id").alias("jid"), "title")
    return t.form_question.where("is_required").join(j, F.col("job_id") == F.col("jid")).select("id", "raw_label", "title")


@query("SELECT count(*) AS n FROM jobs j JOIN companies c ON j.company_id = c.id WHERE c.ats_type = 'pillarhire' AND date_trunc('day', j.discovered_at AT TIME ZONE 'UTC') >= TIMESTAMP '2026-01-01'")
def join_count_since_day(t: Tables) -> DataFrame:
    c = t.companies.where("ats_type = 'pillarhire'").select(F.col("id").alias("cid"))
    return t.jobs.where(F.date_trunc("day", "discovered_at") >= F.lit("2026-01-01").cast("timestamp")).join(c, F.col("company_id") == F.col("cid")).agg(F.count("*").alias("n"))


@query("SELECT id, name FROM companies c WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.company_id = c.id AND j.is_active = 1) AND domain IS NULL")
def semi_lookup(t: Tables) -> DataFrame:
    j = t.jobs.where("is_active = 1").select(F.col("company_id").alias("cid"))
    return t.companies.where("domain is null").join(j, F.col("id") == F.col("cid"), "left_semi").select("id", "name")


@query("""SELECT k AS company_key, min(id) AS first_job FROM (SELECT id, regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]', '', 'g') AS k FROM jobs)
  WHERE k <> '' AND k NOT IN (SELECT normalized_name FROM companies WHERE normalized_name IS NOT NULL) GROUP BY 1""")
def anti_insert(t: Tables) -> DataFrame:
    new = t.jobs.select(tx.alnum_key(F.col("company")).alias("company_key"), F.col("id").alias("first_job")).where("company_key <> ''")
    return merge.insert_absent(t.companies.select(F.col("normalized_name").alias("company_key")), new, key=["company_key"])


@query("""SELECT j.id, coalesce(a.id, b.id) AS matched, CASE WHEN a.id IS NOT NULL THEN 'key' WHEN b.id IS NOT NULL THEN 'name' ELSE 'none' END AS match_type
  FROM jobs j LEFT JOIN companies a ON j.company_id = a.id
  LEFT JOIN (SELECT normalized_name, min(id) AS id FROM companies GROUP BY 1) b ON b.normalized_name = regexp_replace(lower(coalesce(j.company, '')), '[^a-z0-9]', '', 'g')""")
def fallback_join(t: Tables) -> DataFrame:
    a = t.companies.select(F.col("id").alias("a"))
    b = t.companies.groupBy("normalized_name").agg(F.min("id").alias("b"))
    j = t.jobs.select("id", "company_id", tx.alnum_key(F.col("company")).alias("k")).join(a, F.col("company_id") == F.col("a"), "left").join(b, F.col("k") == F.col("normalized_name"), "left")
    kind = F.when(F.col("a").isNotNull(), "key").when(F.col("b").isNotNull(), "name").otherwise("none")
    return j.select("id", F.coalesce("a", "b").alias("matched"), kind.alias("match_type"))


@query("""SELECT l.listing_id, min(j.source_url) AS url FROM board_listings l JOIN jobs j ON lower(trim(l.title)) = lower(trim(j.title)) GROUP BY 1 HAVING count(DISTINCT j.source_url) = 1""")
def unique_match_only(t: Tables) -> DataFrame:
    by_title = t.jobs.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.min("source_url").alias("url"), F.max("source_url").alias("most")).where("url = most")
    l = t.board_listings.select("listing_id", F.lower(F.trim("title")).alias("lk"))
    return l.join(by_title, F.col("lk") == F.col("k")).select("listing_id", "url")


@query("""SELECT company_id, count(*) AS jobs_kept, count(DISTINCT h) AS hosts FROM (
  SELECT company_id, unnest([source_url, application_url]) AS u, rn FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id) AS rn FROM jobs WHERE company_id IS NOT NULL) WHERE rn <= 50),
  LATERAL (SELECT nullif(regexp_extract(lower(u), '^https?://(?:www\\.)?([^/:?#]+)', 1), '') AS h) GROUP BY 1""")
def capped_children(t: Tables) -> DataFrame:
    w = W.partitionBy("company_id").orderBy("id")
    j = t.jobs.where("company_id is not null").select("company_id", "id", "source_url", "application_url").withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    u = j.select("company_id", F.explode(F.array("source_url", "application_url")).alias("u"))
    host = F.nullif(F.regexp_extract(F.lower("u"), "^https?://(?:www\\.)?([^/:?#]+)", 1), F.lit(""))
    return u.groupBy("company_id").agg(F.count("*").alias("jobs_kept"), F.countDistinct(host).alias("hosts"))


@query("""SELECT c.id, CASE WHEN trim(coalesce(website, '')) <> '' THEN website WHEN trim(coalesce(domain, '')) <> '' THEN domain WHEN trim(coalesce(u, '')) <> '' THEN u END AS site,
  CASE WHEN trim(coalesce(website, '')) <> '' THEN 'website' WHEN trim(coalesce(domain, '')) <> '' THEN 'domain' WHEN trim(coalesce(u, '')) <> '' THEN 'posting' END AS origin
  FROM companies c LEFT JOIN (SELECT company_id, arg_min(application_url, id) AS u FROM jobs WHERE source = 'career_pages' AND application_url LIKE 'http%' GROUP BY 1) j ON j.company_id = c.id""")
def precedence_cascade(t: Tables) -> DataFrame:
    j = t.jobs.where("source = 'career_pages' and application_url like 'http%'").groupBy("company_id").agg(F.min_by("application_url", "id").alias("u"))
    c = t.companies.join(j, F.col("id") == F.col("company_id"), "left")
    s = rules.first_of(("website", F.col("website")), ("domain", F.col("domain")), ("posting", F.col("u")))
    return c.select("id", s["value"].alias("site"), s["origin"].alias("origin"))


@query("""SELECT kind, pos, label FROM (SELECT 'S' AS kind, row_number() OVER (ORDER BY canonical_key) AS pos, label FROM question_ref
  UNION ALL SELECT 'B', row_number() OVER (ORDER BY city_id), city FROM city_ref)""")
def numbered_union(t: Tables) -> DataFrame:
    # fixed reference lists: a numbering of all rows is one small task
    s = t.question_ref.select(F.lit("S").alias("kind"), F.row_number().over(W.orderBy("canonical_key")).alias("pos"), "label")
    b = t.city_ref.select(F.lit("B").alias("kind"), F.row_number().over(W.orderBy("city_id")).alias("pos"), F.col("city").alias("label"))
    return s.unionByName(b)


@query("SELECT company, count(*) AS cnt FROM jobs WHERE company IS NOT NULL GROUP BY 1")
def group_count_desc(t: Tables) -> DataFrame:
    return t.jobs.where("company is not null").groupBy("company").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "company")


@query("""SELECT s.v AS status, coalesce(n, 0) AS n FROM (VALUES ('remote'), ('hybrid'), ('onsite'), ('unknown'), ('satellite')) s(v)
  LEFT JOIN (SELECT work_mode, count(*) AS n FROM jobs GROUP BY 1) g ON g.work_mode = s.v UNION ALL SELECT 'total', count(*) FROM jobs""")
def status_counts_zero_filled(t: Tables) -> DataFrame:
    s = t.spark.sql("SELECT * FROM VALUES ('remote'), ('hybrid'), ('onsite'), ('unknown'), ('satellite') AS s(status)")
    g = t.jobs.groupBy("work_mode").agg(F.count("*").alias("g"))
    filled = s.join(g, F.col("status") == F.col("work_mode"), "left").select("status", F.coalesce("g", F.lit(0)).alias("n"))
    return filled.unionByName(g.agg(F.lit("total").alias("status"), F.sum("g").alias("n")))


@query("SELECT coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0)::BIGINT AS cents FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15'")
def coalesce_sum_since_day(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'purchase' and ts >= timestamp_ntz '2024-01-15 00:00:00'")
    return e.agg(F.coalesce(F.sum(F.round(F.col("value") * 100).cast("bigint")), F.lit(0)).alias("cents"))


@query("""SELECT source, count(*) AS fetched, count(*) FILTER (WHERE rn = 1) AS fresh, count(*) FILTER (WHERE rn > 1) AS merged
  FROM (SELECT source, row_number() OVER (PARTITION BY posting_key ORDER BY loaded_at, capture_id) AS rn FROM raw_posting) GROUP BY 1""")
def run_counters(t: Tables) -> DataFrame:
    # the first capture of each posting by a partial aggregation, so a posting of very many captures stays small
    first = t.raw_posting.groupBy("posting_key").agg(F.min_by("source", F.struct("loaded_at", "capture_id")).alias("source"))
    fresh = first.groupBy(F.col("source").alias("f_source")).agg(F.count("*").alias("fresh"))
    all_ = t.raw_posting.groupBy("source").agg(F.count("*").alias("fetched"))
    n = F.coalesce("fresh", F.lit(0))
    return all_.join(fresh, F.col("source").eqNullSafe(F.col("f_source")), "left").select("source", "fetched", n.alias("fresh"), (F.col("fetched") - n).alias("merged"))


@query("""SELECT count(*) AS users, count(*) FILTER (WHERE err) AS with_error, count(*) FILTER (WHERE err AND ok) AS recovered,
  coalesce(round(count(*) FILTER (WHERE err AND ok) / nullif(count(*) FILTER (WHERE err), 0), 6), 0.0) AS rate
  FROM (SELECT user_id, bool_or(event_type = 'error') AS err, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1)""")
def two_level_recovery(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("err"), F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    rec, err = F.count_if(F.col("err") & F.col("ok")), F.count_if("err")
    return u.agg(F.count("*").alias("users"), err.alias("with_error"), rec.alias("recovered"), F.coalesce(F.round(F.try_divide(rec.cast("double"), err.cast("double")), 6), F.lit(0.0)).alias("rate"))


@query("""SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewed, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clicked,
  count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS bought,
  count(DISTINCT user_id) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90) AS high,
  (SELECT count(*) FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) WHERE last = 'error') AS ended_in_error FROM events""")
def funnel(t: Tables) -> DataFrame:
    kinds = {"viewed": "view", "clicked": "click", "bought": "purchase"}
    flags = [F.bool_or(F.col("event_type") == v).alias(k) for k, v in kinds.items()]
    u = t.events.groupBy("user_id").agg(*flags, F.bool_or(F.get_json_object("props", "$.k").cast("int") > 90).alias("high"), F.max_by("event_type", "event_id").alias("last"))
    return u.agg(*[F.count_if(k).alias(k) for k in kinds], F.count_if("high").alias("high"), F.count_if(F.col("last") == "error").alias("ended_in_error"))


@query("""SELECT tag, count(*) AS n, count(*) FILTER (WHERE country = 'India') AS india FROM
  (SELECT country, unnest(CASE WHEN len(coalesce(tags, [])) > 0 THEN tags ELSE ['(none)'] END) AS tag FROM jobs) GROUP BY 1""")
def explode_with_default(t: Tables) -> DataFrame:
    tag = F.explode(F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(F.lit("(none)"))))
    return t.jobs.select("country", tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("country") == "India").alias("india"))


@query("""SELECT source, count(*) FILTER (WHERE work_mode = 'remote') AS remote, count(*) FILTER (WHERE work_mode = 'hybrid') AS hybrid, count(*) FILTER (WHERE work_mode = 'onsite') AS onsite,
  count(*) FILTER (WHERE work_mode IS NULL OR work_mode NOT IN ('remote', 'hybrid', 'onsite')) AS other FROM jobs GROUP BY 1""")
def crosstab(t: Tables) -> DataFrame:
    m = F.col("work_mode")
    cells = [F.count_if(m == k).alias(k) for k in ("remote", "hybrid", "onsite")]
    return t.jobs.groupBy("source").agg(*cells, F.count_if(m.isNull() | ~m.isin("remote", "hybrid", "onsite")).alias("other"))


@query(f"""WITH k AS (SELECT id, platform, company_key, {_LABEL_SQL} AS k FROM form_question)
  SELECT k.id, n AS distinct_companies FROM k JOIN (SELECT platform, k, count(DISTINCT company_key) AS n FROM k GROUP BY 1, 2) g ON g.platform = k.platform AND g.k = k.k""")
def distinct_back_join(t: Tables) -> DataFrame:
    q = t.form_question.select("id", "platform", "company_key", tx.label_key(F.col("raw_label")).alias("k"))
    n = q.groupBy("platform", "k").agg(F.countDistinct("company_key").alias("distinct_companies"))
    return q.join(n, ["platform", "k"]).select("id", "distinct_companies")


@query("SELECT platform, round(coalesce(avg(CASE WHEN is_required THEN 1.0 WHEN is_required IS NULL THEN NULL ELSE 0.0 END), 0), 9) AS required_rate FROM form_question GROUP BY 1")
def mean_of_boolean(t: Tables) -> DataFrame:
    return t.form_question.groupBy("platform").agg(F.round(F.coalesce(F.avg(F.col("is_required").cast("double")), F.lit(0.0)), 9).alias("required_rate"))


@query(f"""SELECT k AS label_key, raw_label, n FROM (SELECT k, raw_label, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, first_id) AS rn FROM
  (SELECT k, raw_label, count(*) AS n, min(id) AS first_id FROM (SELECT id, raw_label, {_LABEL_SQL} AS k FROM form_question WHERE raw_label IS NOT NULL) GROUP BY 1, 2)) WHERE rn <= 6""")
def histogram_top_phrasings(t: Tables) -> DataFrame:
    q = t.form_question.where("raw_label is not null").select("id", "raw_label", tx.label_key(F.col("raw_label")).alias("label_key"))
    g = q.groupBy("label_key", "raw_label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    w = W.partitionBy("label_key").orderBy(F.desc("n"), "first_id")
    return g.withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("label_key", "raw_label", "n")


@query("""WITH g AS (SELECT coalesce(nullif(trim(apply_channel), ''), 'unknown') AS ch, count(*) AS n FROM jobs GROUP BY 1),
  tot AS (SELECT sum(n) FILTER (WHERE ch <> 'unknown') AS known, coalesce(sum(n) FILTER (WHERE ch = 'unknown'), 0) AS unk FROM g),
  w AS (SELECT ch, n, n + CAST(round_even(unk * n / known, 0) AS BIGINT) AS weighted FROM g, tot WHERE ch <> 'unknown')
  SELECT ch AS channel, CAST(n AS BIGINT) AS n, CAST(weighted AS BIGINT) AS weighted, round(weighted / sum(weighted) OVER (), 9) AS share FROM w""")
def weights_redistributed(t: Tables) -> DataFrame:
    g = t.jobs.groupBy(F.coalesce(F.nullif(F.trim("apply_channel"), F.lit("")), F.lit("unknown")).alias("channel")).agg(F.count("*").alias("n"))
    tot = g.agg(F.sum(F.when(F.col("channel") != "unknown", F.col("n"))).alias("known"), F.coalesce(F.sum(F.when(F.col("channel") == "unknown", F.col("n"))), F.lit(0)).alias("unk"))
    w = g.where("channel <> 'unknown'").crossJoin(F.broadcast(tot)).withColumn("weighted", F.col("n") + F.bround(F.col("unk") * F.col("n") / F.col("known"), 0).cast("bigint"))
    total = w.agg(F.sum("weighted").alias("total"))  # one row
    return w.crossJoin(F.broadcast(total)).select("channel", "n", "weighted", F.round(F.col("weighted") / F.col("total"), 9).alias("share"))


@query(f"""WITH q AS (SELECT platform, company_key, {_LABEL_SQL} AS k FROM form_question WHERE raw_label IS NOT NULL),
  s AS (SELECT platform, count(DISTINCT company_key) AS sampled FROM q GROUP BY 1),
  p AS (SELECT platform, count(*) / sum(count(*)) OVER () AS weight FROM jobs j JOIN (SELECT DISTINCT platform FROM form_question) f ON f.platform = j.source GROUP BY 1),
  v AS (SELECT k, round(sum(coalesce(weight, 0) * c / sampled), 9) AS volume FROM (SELECT k, platform, count(DISTINCT company_key) AS c FROM q GROUP BY 1, 2) x JOIN s USING (platform) LEFT JOIN p USING (platform) GROUP BY 1)
  SELECT k AS label_key, volume, volume < 0.02 AS under_line FROM v""")
def weighted_volume_line(t: Tables) -> DataFrame:
    q = t.form_question.where("raw_label is not null").select("platform", "company_key", tx.label_key(F.col("raw_label")).alias("label_key"))
    sampled = q.groupBy("platform").agg(F.countDistinct("company_key").alias("sampled"))
    n = t.jobs.join(q.select(F.col("platform").alias("source")).distinct(), "source").groupBy("source").agg(F.count("*").alias("n"))
    weight = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(F.col("source").alias("platform"), (F.col("n") / F.col("total")).alias("weight"))
    v = q.groupBy("label_key", "platform").agg(F.countDistinct("company_key").alias("c")).join(sampled, "platform").join(weight, "platform", "left")
    v = v.groupBy("label_key").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("c") / F.col("sampled")), 9).alias("volume"))
    return v.select("label_key", "volume", (F.col("volume") < 0.02).alias("under_line"))


@query("""SELECT priority, count(*) AS n, count(*) FILTER (WHERE domain IS NULL) AS remaining, min(id) FILTER (WHERE domain IS NULL) AS resume_at,
  count(*) FILTER (WHERE domain IS NULL AND website IS NULL) AS blank FROM companies GROUP BY 1""")
def progress_by_pass(t: Tables) -> DataFrame:
    no = F.col("domain").isNull()
    return t.companies.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(no).alias("remaining"), F.min(F.when(no, F.col("id"))).alias("resume_at"), F.count_if(no & F.col("website").isNull()).alias("blank"))


@query("SELECT canonical_key FROM question_ref EXCEPT SELECT ats_type FROM companies")
def set_difference(t: Tables) -> DataFrame:
    return t.question_ref.select("canonical_key").subtract(t.companies.select("ats_type"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS last_type FROM events WHERE event_type <> 'view' GROUP BY 1")
def latest_per_key(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'view'").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("last_type"))


_SAYS = "{c} IS NOT NULL AND lower(trim({c})) NOT IN ('', 'unknown')"


@query("SELECT posting_key, count(*) AS captures, " + ", ".join(f"arg_min({c}, capture_id) FILTER (WHERE {_SAYS.format(c=c)}) AS {c}" for c in ("location", "application_url", "apply_channel", "ats_platform")) + ", min(epoch_us(fetched_at)) AS first_seen, max(epoch_us(fetched_at)) AS last_seen FROM raw_posting WHERE posting_key IS NOT NULL GROUP BY 1")
def fill_only_merge(t: Tables) -> DataFrame:
    r = t.raw_posting.withColumns({"captures": F.lit(1).cast("bigint"), "first_seen": F.unix_micros("fetched_at"), "last_seen": F.unix_micros("fetched_at")})
    return merge.fold(r, key=["posting_key"], order="capture_id", policies={"captures": "sum", "location": "first", "application_url": "first", "apply_channel": "first", "ats_platform": "first", "first_seen": "min", "last_seen": "max"})


@query("SELECT posting_key, source, coalesce(source_url, '') AS url, min(epoch_us(fetched_at)) AS first_seen, max(epoch_us(fetched_at)) AS last_seen FROM raw_posting WHERE posting_key IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2, 3")
def upsert_sightings(t: Tables) -> DataFrame:
    s = t.raw_posting.select("posting_key", "source", F.coalesce("source_url", F.lit("")).alias("url"), F.unix_micros("fetched_at").alias("first_seen"), F.unix_micros("fetched_at").alias("last_seen"), "capture_id")
    old, new = s.where("capture_id % 2 = 0"), s.where("capture_id % 2 = 1")  # a snapshot and a batch that together are all captures
    return merge.upsert(old, new, key=["posting_key", "source", "url"], order="capture_id", policies={"first_seen": "min", "last_seen": "max"})


@query("""SELECT platform, company_key, field_type, CAST(sum(times_seen) AS BIGINT) AS times_seen, bool_or(is_required) AS is_required,
  arg_max(section, id) FILTER (WHERE section IS NOT NULL AND lower(trim(section)) NOT IN ('', 'unknown')) AS section, max(epoch_us(last_seen)) AS last_us
  FROM form_question WHERE platform IS NOT NULL AND company_key IS NOT NULL AND field_type IS NOT NULL GROUP BY 1, 2, 3""")
def upsert_policies(t: Tables) -> DataFrame:
    q = t.form_question.withColumns({"times_seen": F.col("times_seen").cast("bigint"), "last_us": F.unix_micros("last_seen")})
    return merge.fold(q, key=["platform", "company_key", "field_type"], order="id", policies={"times_seen": "sum", "is_required": "any", "section": "last", "last_us": "max"})


@query("""SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN title ILIKE '%intern%' THEN 0 ELSE 1 END), discovered_at, id) AS rn FROM jobs) WHERE rn <= 2""")
def topk_per_group(t: Tables) -> DataFrame:
    w = W.partitionBy("source").orderBy(F.when(F.col("title").ilike("%intern%"), 0).otherwise(1), "discovered_at", "id")
    return t.jobs.select("source", "id", "title", "discovered_at").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("source", "id")


@query("""SELECT company_id, source FROM (SELECT company_id, source, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, min(id)) AS rn FROM jobs WHERE company_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def modal_pick(t: Tables) -> DataFrame:
    g = t.jobs.where("company_id is not null").groupBy("company_id", "source").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return g.groupBy("company_id").agg(F.max_by("source", F.struct("n", -F.col("first"))).alias("source"))


@query("""SELECT cluster, min(id) AS winner, count(*) - 1 AS refused FROM (SELECT id, regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]', '', 'g') || '|' ||
  regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS cluster FROM jobs) GROUP BY 1""")
def claim_first(t: Tables) -> DataFrame:
    j = t.jobs.select("id", F.concat_ws("|", tx.alnum_key(F.col("company")), tx.alnum_key(F.col("title"))).alias("cluster"))
    return j.groupBy("cluster").agg(F.min("id").alias("winner"), (F.count("*") - 1).alias("refused"))


@query("""SELECT user_id, event_id, prev AS "from", event_type AS "to", (prev, event_type) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'), ('error', 'view')) AS legal
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL""")
def state_transitions(t: Tables) -> DataFrame:
    allowed = t.spark.sql("SELECT * FROM VALUES ('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'), ('error', 'view') AS a(`from`, `to`)")
    return merge.transitions(t.events, allowed, key="user_id", order="event_id", state="event_type")


@query("""SELECT event_id, spent, spent <= 40 AS within FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def running_budget(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", F.date_trunc("day", "ts").alias("day"), F.lit(1).cast("bigint").alias("one"))
    r = running.running_sum(e, key=["event_type", "day"], order="event_id", value="one", out="spent")
    return r.select("event_id", "spent", (F.col("spent") <= 40).alias("within"))


@query("""SELECT id, CASE WHEN is_active = 1 AND last_seen < TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN (CASE WHEN id % 4 + 1 >= 3 THEN 'failed' ELSE 'queued' END) ELSE 'kept' END AS state FROM jobs""")
def stalled_reset(t: Tables) -> DataFrame:
    stalled = (F.col("is_active") == 1) & (F.col("last_seen") < F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return t.jobs.select("id", F.when(stalled, F.when(F.col("id") % 4 + 1 >= 3, "failed").otherwise("queued")).otherwise("kept").alias("state"))


@query("""SELECT company_id, CASE WHEN count(country) = 0 THEN NULL ELSE bool_and(country = 'India') END AS all_india, count(DISTINCT country) AS countries FROM jobs WHERE company_id IS NOT NULL GROUP BY 1""")
def home_country(t: Tables) -> DataFrame:
    g = t.jobs.where("company_id is not null").groupBy("company_id")
    return g.agg(F.bool_and(F.col("country") == "India").alias("all_india"), F.countDistinct("country").alias("countries"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_totals(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT s.s_name AS supplier, CAST(sum(l_quantity) AS BIGINT) AS qty, count(DISTINCT l_partkey) AS parts FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' AND l.l_returnflag = 'R' GROUP BY 1""")
def three_way_join(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    l = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", "l_quantity", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s = t.supplier.select("s_suppkey", "s_name")
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_name").alias("supplier")).agg(F.sum("l_quantity").cast("bigint").alias("qty"), F.countDistinct("l_partkey").alias("parts"))
