"""Landed pages of boards and feeds, read from the files beside the package; the SQL reads the same files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from postgrain.plans.registry import Tables, query
from postgrain.sources import shapes

PAGES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "fixtures", "pages.jsonl")
# shape, list, id, title, address, date: where DuckDB finds them
_PATHS = [
    ("greenhouse", "$.jobs[*]", "id", "title", "first_published"), ("lever", "$[*]", "id", "text", "createdAt"), ("ashby", "$.jobs[*]", "id", "title", "publishedAt"), ("workable", "$.results[*]", "shortcode", "title", "published"),
    ("smartrecruiters", "$.content[*]", "id", "name", "releasedDate"), ("recruitee", "$.offers[*]", "id", "title", "published_at"), ("keka", "$[*]", "id", "title", "publishedOn"), ("zoho_recruit", "$[*]", "id", "Posting_Title", "Date_Opened"),
    ("mynexthire", "$.reqDetailsBOList[*]", "reqId", "reqTitle", "approvedOn"), ("breezy", "$[*]", "id", "name", "published_date"), ("darwinbox", "$.jobs[*]", "id", "designation_name", "posted_on"),
    ("unstop", "$.data.data[*]", "id", "title", "regnRequirements.start_regn_dt"), ("instahyre", "$.objects[*]", "id", "candidate_title", "none"), ("himalayas", "$.jobs[*]", "guid", "title", "pubDate"), ("adzuna", "$.results[*]", "id", "title", "created"),
    ("naukri", "$.jobDetails[*]", "jobId", "title", "createdDate"), ("wellfound", "$.jobs[*]", "id", "title", "liveStartAt"), ("yc_waas", "$.props.jobs[*]", "id", "title", "none"), ("remoteok", "$[*]", "id", "position", "none"),
    ("remotive", "$.jobs[*]", "id", "title", "none"), ("arbeitnow", "$.data[*]", "slug", "title", "none"),
]
_LISTS = " UNION ALL ".join(
    f"SELECT shape, board, json_extract_string(i, '$.{i}') AS source_id, trim(json_extract_string(i, '$.{t}')) AS title, coalesce(json_extract_string(i, '$.{d}'), json_extract_string(i, '$.updated_at')) AS posted, json_extract(i, '$.isListed') AS l FROM (SELECT shape, board, unnest(json_extract(payload, '{rows}')) AS i FROM ok WHERE shape = '{name}')"
    for name, rows, i, t, d in _PATHS
)
_FILE = f"read_json('{PAGES}', format = 'newline_delimited', columns = {{shape: 'VARCHAR', board: 'VARCHAR', company: 'VARCHAR', page: 'INT', payload: 'VARCHAR'}})"


@query(f"WITH ok AS (SELECT * FROM {_FILE} WHERE json_valid(payload)) SELECT shape, board, source_id, title, posted FROM ({_LISTS}) WHERE coalesce(title, '') <> '' AND coalesce(source_id, '') <> '' AND coalesce(CAST(l AS VARCHAR), 'true') <> 'false'")
def board_records(t: Tables) -> DataFrame:
    names = [p[0] for p in _PATHS]
    return shapes.records(shapes.scan(t.spark, PAGES), names).select("shape", "board", "source_id", "title", "posted")


@query(f"SELECT shape, board, CASE WHEN json_valid(payload) THEN 'no list of postings' ELSE 'no JSON' END AS error FROM {_FILE} WHERE NOT json_valid(payload) OR json_exists(payload, '$.error')")
def board_errors(t: Tables) -> DataFrame:
    return shapes.page_errors(shapes.scan(t.spark, PAGES))


@query(f"WITH ok AS (SELECT * FROM {_FILE} WHERE json_valid(payload)) SELECT shape, count(*) AS fetched, count(DISTINCT source_id) AS postings FROM ({_LISTS}) WHERE coalesce(title, '') <> '' AND coalesce(source_id, '') <> '' AND coalesce(CAST(l AS VARCHAR), 'true') <> 'false' GROUP BY 1")
def run_all_sources(t: Tables) -> DataFrame:
    return shapes.run_counts(shapes.records(shapes.scan(t.spark, PAGES), [p[0] for p in _PATHS]))


@query("SELECT o.o AS opportunity, j.j AS job_type, NULL AS term, 'opportunity=' || o.o || coalesce('&job_type=' || replace(j.j, ' ', '+'), '') AS address FROM (VALUES ('jobs'), ('internships')) o(o), (VALUES ('full time'), ('part time')) j(j)")
def query_grid(t: Tables) -> DataFrame:
    g = shapes.query_grid(t.spark, opportunity=["jobs", "internships"], job_type=["full time", "part time"], term=[])
    return g.select("opportunity", "job_type", "term", shapes.query_string("opportunity", "job_type", "term").alias("address"))


@query("SELECT id FROM (SELECT id, title, count(*) OVER (PARTITION BY company_id) AS n FROM jobs WHERE company_id IS NOT NULL) WHERE n <= 60 OR regexp_matches(title, '(?i)\\bintern|\\btrainee|\\bgraduate')")
def needs_detail(t: Tables) -> DataFrame:
    return shapes.needs_detail(t.jobs.where("company_id is not null").select("id", "title", "company_id"), board=["company_id"], title="title").select("id")


@query("SELECT id, ats_type, domain FROM companies WHERE ats_type IS NOT NULL AND domain IS NOT NULL AND ats_type IN ('pillarhire', 'ferryboard', 'orchardats') ORDER BY priority DESC, id LIMIT 50")
def scan_targets(t: Tables) -> DataFrame:
    c = t.companies.where(F.col("ats_type").isNotNull() & F.col("domain").isNotNull() & F.col("ats_type").isin("pillarhire", "ferryboard", "orchardats"))
    return c.orderBy(F.desc_nulls_last("priority"), "id").limit(50).select("id", "ats_type", "domain")
