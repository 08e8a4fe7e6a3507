"""Landed JSON of boards and job feeds to one record, by a table of mappings.

A landed page is a row (shape, board, company, payload text). A shape says where the items of a payload are and how each column of the
record comes from an item; all of it is native: the payload is parsed once into a variant and read by path. A payload that is no
JSON, or lacks its list, is no exception but an error value of its board (``page_errors``); other boards go on.

Records: shape, board, company, source_id, title, url, apply_url, location, mode, kind, html, text, pay, posted (as written), deadline,
tags. Items without a title are left out; missing values are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postgrain.functions.cards import unescaped
from postgrain.functions.pay_labels import amount_range, free_label

ITEM = "item"
COLUMNS = ["source_id", "title", "company", "url", "apply_url", "location", "mode", "kind", "html", "text", "pay", "posted", "deadline", "tags"]


def s(path: str) -> Column:
    """A text value of the item; null where it is missing or empty."""
    return F.nullif(F.btrim(F.try_variant_get(ITEM, f"$.{path}", "string"), F.lit(" \t\r\n")), F.lit(""))


def b(path: str) -> Column:
    return F.coalesce(F.try_variant_get(ITEM, f"$.{path}", "boolean"), F.try_variant_get(ITEM, f"$.{path}", "string").isin("1", "true"), F.lit(False))


def num(path: str) -> Column:
    """A number above zero; null otherwise."""
    n = F.try_variant_get(ITEM, f"$.{path}", "double")
    return F.when(n > 0, n)


def items(path: str, value: str | None = None) -> Column:
    """Texts of an array, or of one field of its objects, without nulls and blanks."""
    a = F.coalesce(F.try_variant_get(ITEM, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    t = F.transform(a, lambda x: F.btrim(F.try_variant_get(x, f"$.{value}" if value else "$", "string"), F.lit(" \t\r\n")))
    return F.filter(t, lambda x: F.coalesce(x, F.lit("")) != "")


def joined(sep: str, *parts: Column) -> Column:
    return F.nullif(F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull())), sep), F.lit(""))


def listed(a: Column, sep: str = ", ") -> Column:
    return F.nullif(F.array_join(F.array_distinct(a), sep), F.lit(""))


def mode_of(workplace: Column | None = None, *, remote: Column | None = None, hybrid: Column | None = None, onsite: Column | None = None) -> Column:
    """A stated workplace before flags: remote, hybrid, onsite or unknown."""
    w = F.regexp_replace(F.lower(F.coalesce(workplace if workplace is not None else F.lit(""), F.lit(""))), "[-_ ]", "")
    c = F.when(w == "remote", "remote").when(w == "hybrid", "hybrid").when(w.isin("onsite", "inoffice", "office"), "onsite")
    for flag, name in ((remote, "remote"), (hybrid, "hybrid"), (onsite, "onsite")):
        if flag is not None:
            c = c.when(flag, name)
    return c.otherwise("unknown")


def sections(path: str, title: str, text: str) -> Column:
    """Titled parts of an array as one HTML text."""
    a = F.coalesce(F.try_variant_get(ITEM, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda x, k: F.coalesce(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    return F.nullif(F.array_join(F.transform(a, lambda x: F.concat_ws("\n", get(x, title), get(x, text))), "\n"), F.lit(""))


def section_map(path: str) -> Column:
    """Titled parts of an object of objects, in the order of their keys."""
    m = F.try_variant_get(ITEM, f"$.{path}", "map<string,variant>")
    get = lambda x, k: F.coalesce(F.try_variant_get(x, f"$.{k}", "string"), F.lit(""))
    return F.nullif(F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat_ws("\n", get(F.element_at(m, k), "title"), get(F.element_at(m, k), "text"))), "\n"), F.lit(""))


def spread(lo: str, hi: str, currency: Column, period: Column | None = None) -> Column:
    return amount_range(num(lo), num(hi), currency, period)


@dataclass(frozen=True)
class Shape:
    """Where the items are, the columns of the record, and which items count."""

    rows: str
    columns: dict[str, Callable[[], Column]]
    keep: Callable[[], Column] = field(default=lambda: F.lit(True))


def _url(prefix: str, ident: str, suffix: str = "") -> Callable[[], Column]:
    """An address made of the board's token and the item's id."""
    return lambda: F.concat(F.replace(F.lit(prefix), F.lit("{board}"), F.col("board")), s(ident), F.lit(suffix))


_PERIODS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "annual": "year", "yearly": "year"}


def _period(path: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in _PERIODS.items() for x in kv]), F.lower(s(path)))


def _opportunity_pay() -> Column:
    """Unpaid is said; a yearly internship figure under 100,000 is monthly."""
    lo, hi = num("jobDetail.min_salary"), num("jobDetail.max_salary")
    period = F.when((s("jobDetail.pay_in") == "monthly") | ((s("subtype") == "internships") & (F.coalesce(hi, lo) < 100_000)), "month").otherwise("year")
    return F.when(s("jobDetail.paid_unpaid") == "unpaid", "Unpaid").when(~b("jobDetail.not_disclosed"), amount_range(lo, hi, F.lit("INR"), period))


def _opportunity_place() -> Column:
    cities = items("locations", "city")
    named = listed(F.when(F.size(cities) > 0, cities).otherwise(items("jobDetail.locations")))
    return F.coalesce(named, F.when(s("jobDetail.type") == "wfh", "Remote"))


def _restricted_place() -> Column:
    lands = items("locationRestrictions")
    return F.when(F.size(lands) > 0, F.concat(F.lit("Remote - "), F.array_join(lands, ", "))).otherwise("Remote (Worldwide)")


def _graph_mode() -> Column:
    kind = F.upper(F.coalesce(s("remoteConfig.kind"), F.lit("")))
    return F.when(b("remote") | (kind == "REMOTE"), "remote").when(kind == "HYBRID", "hybrid").when(F.size(items("locationNames")) > 0, "onsite").otherwise("unknown")


def _graph_place() -> Column:
    lands = items("acceptedRemoteLocationNames")
    return F.when(_graph_mode() == "remote", F.when(F.size(lands) > 0, F.concat(F.lit("Remote - "), F.array_join(lands, ", "))).otherwise("Remote")).otherwise(listed(items("locationNames")))


def _graph_text() -> Column:
    years = F.try_variant_get(ITEM, "$.yearsExperienceMin", "int")
    return F.nullif(F.concat(F.coalesce(F.concat(F.lit("Experience: "), years.cast("string"), F.lit("+ years\n")), F.lit("")), F.coalesce(s("description"), F.lit(""))), F.lit(""))


# Names and field names of public board and feed payloads.
SHAPES: dict[str, Shape] = {
    "greenhouse": Shape("jobs", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "url": lambda: s("absolute_url"), "location": lambda: s("location.name"), "html": lambda: unescaped(s("content")),
        "posted": lambda: F.coalesce(s("first_published"), s("updated_at")),
    }),
    "lever": Shape("", {
        "source_id": lambda: s("id"), "title": lambda: s("text"), "url": lambda: s("hostedUrl"), "apply_url": lambda: F.coalesce(s("applyUrl"), s("hostedUrl")),
        "location": lambda: F.coalesce(s("categories.location"), listed(items("categories.allLocations"))), "mode": lambda: mode_of(s("workplaceType")), "kind": lambda: s("categories.commitment"),
        "html": lambda: sections("lists", "text", "content"), "text": lambda: F.nullif(F.concat_ws("\n\n", s("descriptionPlain"), s("additionalPlain")), F.lit("")),
        "pay": lambda: s("salaryDescriptionPlain"), "posted": lambda: s("createdAt"),
    }),
    "ashby": Shape("jobs", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "url": lambda: s("jobUrl"), "apply_url": lambda: F.coalesce(s("applyUrl"), s("jobUrl")),
        "location": lambda: listed(F.concat(F.filter(F.array(s("location")), lambda x: x.isNotNull()), items("secondaryLocations", "location")), " / "),
        "mode": lambda: mode_of(s("workplaceType"), remote=b("isRemote")), "kind": lambda: s("employmentType"), "html": lambda: s("descriptionHtml"), "text": lambda: s("descriptionPlain"),
        "pay": lambda: s("compensation.compensationTierSummary"), "posted": lambda: s("publishedAt"),
    }, lambda: F.coalesce(F.try_variant_get(ITEM, "$.isListed", "boolean"), F.lit(True))),
    "workable": Shape("results", {
        "source_id": lambda: s("shortcode"), "title": lambda: s("title"), "url": _url("https://apply.workable.com/{board}/j/", "shortcode", "/"),
        "location": lambda: joined(", ", s("location.city"), s("location.region"), s("location.country")), "mode": lambda: mode_of(s("workplace"), remote=b("remote")), "kind": lambda: s("type"), "posted": lambda: s("published"),
    }),
    "smartrecruiters": Shape("content", {
        "source_id": lambda: s("id"), "title": lambda: s("name"), "url": _url("https://jobs.smartrecruiters.com/{board}/", "id"),
        "location": lambda: F.coalesce(s("location.fullLocation"), joined(", ", s("location.city"), s("location.country"))), "mode": lambda: mode_of(remote=b("location.remote"), hybrid=b("location.hybrid")),
        "kind": lambda: s("typeOfEmployment.label"), "html": lambda: section_map("jobAd.sections"), "posted": lambda: s("releasedDate"),
    }),
    "recruitee": Shape("offers", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "url": lambda: s("careers_url"), "apply_url": lambda: F.coalesce(s("careers_apply_url"), s("careers_url")), "location": lambda: s("location"),
        "mode": lambda: mode_of(remote=b("remote"), hybrid=b("hybrid"), onsite=b("on_site")), "kind": lambda: s("employment_type_code"), "html": lambda: F.nullif(F.concat_ws("\n", s("description"), s("requirements")), F.lit("")),
        "pay": lambda: spread("salary.min", "salary.max", s("salary.currency"), s("salary.period")), "posted": lambda: s("published_at"),
    }),
    "keka": Shape("", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "url": _url("https://{board}.keka.com/careers/jobdetails/", "id"), "location": lambda: listed(items("jobLocations", "name"), " / "), "html": lambda: s("description"),
        "pay": lambda: spread("salaryRange.minimum", "salaryRange.maximum", F.coalesce(s("salaryRange.currency"), F.lit("INR")), F.when(F.try_variant_get(ITEM, "$.salaryRange.salaryPeriod", "int") == 3, "month")), "posted": lambda: s("publishedOn"),
    }),
    "zoho_recruit": Shape("", {
        "source_id": lambda: s("id"), "title": lambda: F.coalesce(s("Posting_Title"), s("Job_Opening_Name")), "url": _url("https://{board}/jobs/Careers/", "id"), "location": lambda: joined(", ", s("City"), s("State"), s("Country")),
        "mode": lambda: mode_of(remote=b("Remote_Job")), "kind": lambda: s("Job_Type"), "html": lambda: s("Job_Description"), "pay": lambda: s("Salary"), "posted": lambda: s("Date_Opened"),
    }, lambda: F.coalesce(F.try_variant_get(ITEM, "$.Publish", "boolean"), F.lit(True))),
    "mynexthire": Shape("reqDetailsBOList", {
        "source_id": lambda: s("reqId"), "title": lambda: s("reqTitle"), "url": _url("https://{board}.mynexthire.com/employer/jobs?src=careers#/reqDetails/", "reqId"), "location": lambda: F.coalesce(s("location"), s("locationAddress")),
        "kind": lambda: F.coalesce(s("employmentType"), F.when(b("fresher"), "Fresher")), "html": lambda: s("jdDisplay"), "pay": lambda: spread("ctcBandLowEnd", "ctcBandHighEnd", s("reqCurrency")), "posted": lambda: s("approvedOn"),
    }),
    "workday": Shape("jobPostings", {
        "source_id": lambda: F.coalesce(F.nullif(F.substring_index(s("externalPath"), "_", -1), F.lit("")), s("externalPath")), "title": lambda: s("title"),
        "url": lambda: F.coalesce(s("externalUrl"), F.concat(F.regexp_replace("board", r"^([^|]+)\|([^|]+)\|(.+)$", "https://$1.$2.myworkdayjobs.com/$3"), s("externalPath"))),
        "location": lambda: F.coalesce(s("location"), s("locationsText")), "kind": lambda: s("timeType"), "html": lambda: s("jobDescription"), "posted": lambda: s("startDate"),
    }),
    "breezy": Shape("", {
        "source_id": lambda: s("id"), "title": lambda: s("name"), "url": lambda: s("url"), "location": lambda: s("location.name"), "mode": lambda: mode_of(remote=b("location.is_remote")), "kind": lambda: s("type.name"),
        "pay": lambda: s("salary"), "posted": lambda: s("published_date"),
    }),
    "darwinbox": Shape("jobs", {
        "source_id": lambda: s("id"), "title": lambda: F.coalesce(s("designation_name"), s("title")), "url": _url("https://{board}.darwinbox.in/ms/candidatev2/main/careers/jobDetails/", "id"),
        "location": lambda: F.coalesce(listed(items("officelocations_without_area"), " / "), s("officelocation_show_arr")), "mode": lambda: mode_of(remote=b("is_remote")), "kind": lambda: s("emp_type_name"),
        "html": lambda: F.nullif(s("jd"), F.lit("Please enter job description")), "pay": lambda: spread("salary_min", "salary_max", s("salary_currency"), s("salary_timeframe")), "posted": lambda: s("posted_on"),
    }),
    "unstop": Shape("data.data", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "company": lambda: s("organisation.name"), "url": lambda: F.coalesce(s("seo_url"), F.concat(F.lit("https://unstop.com/"), s("public_url"))), "location": _opportunity_place,
        "mode": lambda: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("wfh", "remote", "in_office", "onsite", "on_field", "onsite", "hybrid", "hybrid")]), s("jobDetail.type")), F.lit("unknown")),
        "kind": lambda: F.when(s("subtype") == "internships", "Internship").otherwise(F.coalesce(s("jobDetail.timing"), s("subtype"))), "html": lambda: s("details"), "pay": _opportunity_pay,
        "posted": lambda: F.coalesce(s("regnRequirements.start_regn_dt"), s("updated_at")), "deadline": lambda: F.coalesce(s("regnRequirements.end_regn_dt"), s("end_date")), "tags": lambda: F.array_distinct(items("required_skills", "skill_name")),
    }),
    "instahyre": Shape("objects", {
        "source_id": lambda: s("id"), "title": lambda: F.coalesce(s("title"), s("candidate_title")), "company": lambda: s("employer.company_name"), "url": lambda: s("public_url"), "location": lambda: s("locations"),
        "mode": lambda: F.when(F.lower(s("locations")).rlike("work from home|remote"), "remote").otherwise("unknown"), "text": lambda: F.when(F.size(items("keywords")) > 0, F.concat(F.lit("Skills: "), F.array_join(items("keywords"), ", "))), "tags": lambda: items("keywords"),
    }, lambda: s("employer.company_name").isNotNull()),
    "himalayas": Shape("jobs", {
        "source_id": lambda: F.coalesce(s("guid"), s("applicationLink")), "title": lambda: s("title"), "company": lambda: s("companyName"), "url": lambda: F.coalesce(s("guid"), s("applicationLink")), "apply_url": lambda: F.coalesce(s("applicationLink"), s("guid")),
        "location": _restricted_place, "mode": lambda: F.lit("remote"), "kind": lambda: s("employmentType"), "html": lambda: s("description"), "text": lambda: s("excerpt"),
        "pay": lambda: spread("minSalary", "maxSalary", s("currency"), _period("salaryPeriod")), "posted": lambda: s("pubDate"), "deadline": lambda: s("expiryDate"), "tags": lambda: F.concat(items("categories"), items("seniority")),
    }),
    "adzuna": Shape("results", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "company": lambda: s("company.display_name"), "url": lambda: s("redirect_url"), "location": lambda: s("location.display_name"), "text": lambda: s("description"),
        "kind": lambda: joined(" ", s("contract_time"), s("contract_type")), "pay": lambda: F.when(~b("salary_is_predicted"), spread("salary_min", "salary_max", F.lit("INR"), F.lit("year"))), "posted": lambda: s("created"),
        "tags": lambda: F.filter(F.array(s("category.label")), lambda x: x.isNotNull()),
    }),
    "naukri": Shape("jobDetails", {
        "source_id": lambda: s("jobId"), "title": lambda: s("title"), "company": lambda: s("companyName"), "url": lambda: s("jdURL"), "location": lambda: _placeholder("location"), "text": lambda: s("jobDescription"),
        "pay": lambda: free_label(_placeholder("salary"), F.lower(s("title")).contains("intern")), "posted": lambda: s("createdDate"), "tags": lambda: F.filter(F.split(F.coalesce(s("tagsAndSkills"), F.lit("")), ","), lambda x: x != ""),
    }),
    "wellfound": Shape("jobs", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "company": lambda: s("startup.name"), "url": lambda: F.concat_ws("-", F.concat(F.lit("https://wellfound.com/jobs/"), s("id")), s("slug")), "location": _graph_place, "mode": _graph_mode,
        "kind": lambda: F.when(s("jobType") == "internship", "Internship").otherwise(s("jobType")), "text": _graph_text, "pay": lambda: s("compensation"), "posted": lambda: s("liveStartAt"),
    }, lambda: s("id").isNotNull()),
    "yc_waas": Shape("props.jobs", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "company": lambda: s("companyName"), "url": lambda: F.concat(F.lit("https://www.workatastartup.com/jobs/"), s("id")), "location": lambda: s("location"), "kind": lambda: s("jobType"),
        "pay": lambda: s("salary"), "tags": lambda: F.filter(F.array(s("roleType"), s("companyBatch")), lambda x: x.isNotNull()),
    }, lambda: s("id").isNotNull()),
    "remoteok": Shape("", {
        "source_id": lambda: s("id"), "title": lambda: s("position"), "company": lambda: s("company"), "url": lambda: s("url"), "apply_url": lambda: F.coalesce(s("apply_url"), s("url")), "location": lambda: s("location"), "html": lambda: s("description"), "tags": lambda: items("tags"),
    }, lambda: s("id").isNotNull() & s("legal").isNull()),
    "remotive": Shape("jobs", {
        "source_id": lambda: s("id"), "title": lambda: s("title"), "company": lambda: s("company_name"), "url": lambda: s("url"), "location": lambda: s("candidate_required_location"), "html": lambda: s("description"), "tags": lambda: items("tags"),
    }),
    "arbeitnow": Shape("data", {
        "source_id": lambda: s("slug"), "title": lambda: s("title"), "company": lambda: s("company_name"), "url": lambda: s("url"), "location": lambda: s("location"), "html": lambda: s("description"), "tags": lambda: items("tags"),
    }),
}


def _placeholder(kind: str) -> Column:
    a = F.coalesce(F.try_variant_get(ITEM, "$.placeholders", "array<struct<type:string,label:string>>"), F.array().cast("array<struct<type:string,label:string>>"))
    return F.nullif(F.trim(F.try_element_at(F.filter(a, lambda p: p["type"] == kind), F.lit(-1))["label"]), F.lit(""))


def _parsed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("__v", F.try_parse_json("payload"))


def _list(shape: Shape) -> Column:
    return F.try_variant_get("__v", "$." + shape.rows if shape.rows else "$", "array<variant>")


def page_errors(pages: DataFrame) -> DataFrame:
    """shape, board, error: pages that can't be read, as values."""
    lists = None
    for name, shape in SHAPES.items():
        lists = F.when(F.col("shape") == name, _list(shape).isNotNull()) if lists is None else lists.when(F.col("shape") == name, _list(shape).isNotNull())
    p = _parsed(pages).select("shape", "board", F.when(F.col("__v").isNull(), "no JSON").when(lists.isNull(), "unknown shape").when(~lists, "no list of postings").alias("error"))
    return p.where("error is not null")


def records(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The postings of pages (shape, board, company, payload) of the named shapes, all by default."""
    out = None
    parsed = _parsed(pages)
    for name in names or SHAPES:
        shape = SHAPES[name]
        r = parsed.where(F.col("shape") == name).select("shape", "board", F.col("company").alias("__company"), F.explode(_list(shape)).alias(ITEM)).where(shape.keep())
        cols = {c: f() for c, f in shape.columns.items()}
        cols["company"] = F.coalesce(cols["company"], F.col("__company")) if "company" in cols else F.col("__company")
        cols.setdefault("apply_url", cols["url"])
        cols.setdefault("mode", F.lit("unknown"))
        empty = F.lit(None).cast("string")
        made = r.select("shape", "board", *[cols.get(c, F.array().cast("array<string>") if c == "tags" else empty).alias(c) for c in COLUMNS]).where("title is not null")
        out = made if out is None else out.unionByName(made)
    return out


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages: JSON lines of shape, board, company, page number and payload text."""
    return spark.read.schema("shape string, board string, company string, page int, payload string").json(folder)


def first_records(rows: DataFrame, *order: str) -> DataFrame:
    """One record for each (shape, source_id) over pages, terms and branches of a scan: the first by ``order``; without an id all stay."""
    key = F.coalesce("source_id", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    rest = [c for c in rows.columns if c != "shape"]
    g = rows.withColumn("__k", key).groupBy("shape", "__k").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select("shape", *[F.col(f"r.{c}").alias(c) for c in rest])


def needs_detail(rows: DataFrame, *, board: list[str], title: str, hint: str = r"(?i)\bintern|\btrainee|\bgraduate", small: int = 60) -> DataFrame:
    """The rows whose details are worth fetching: those of a small board, and titles with a hint."""
    size = rows.groupBy(*board).agg((F.count("*") <= small).alias("__small"))
    return rows.join(size, board).where(F.col("__small") | F.col(title).rlike(hint)).drop("__small")


def query_grid(spark: SparkSession, **dimensions: list[str]) -> DataFrame:
    """Every combination of the parameters; an empty dimension is one null member."""
    out = spark.range(1).drop("id")
    for name, values in dimensions.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values or [None]], f"{name} string"))  # a few members each, fixed by the caller
    return out


def query_string(*params: str) -> Column:
    """``a=1&b=2`` of the columns that aren't null, encoded."""
    return F.concat_ws("&", *[F.concat(F.lit(p + "="), F.url_encode(F.col(p).cast("string"))) for p in params])


def active_sources(sources: dict[str, dict], *, tier: int | None = None, off: set[str] = frozenset()) -> list[str]:
    """Names of the registered sources that are switched on and of the tier, in order of registration; a scan is ``records`` of these."""
    unknown = set(sources) - set(SHAPES)
    if unknown:
        raise ValueError(f"no such shape: {sorted(unknown)}")
    return [n for n, c in sources.items() if n not in off and c.get("on", True) and (tier is None or c.get("tier", 1) == tier)]


def run_counts(rows: DataFrame) -> DataFrame:
    """shape, fetched, distinct postings of a scan of all sources."""
    return rows.groupBy("shape").agg(F.count("*").alias("fetched"), F.count_distinct("source_id").alias("postings"))
