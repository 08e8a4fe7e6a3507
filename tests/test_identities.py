from pyspark.sql import functions as F

from postgrain.functions import identity
from postgrain.plans import catalog

CITIES = [("Mumbai", "India", ["Bombay"]), ("Berlin", "Germany", [])]
ROWS = [  # company, title, location, city, country, work_mode
    (1, "Brontavia Systems Pvt Ltd", "SDE Internship", "Bombay", None, None, "unknown"),
    (2, "Brontavia", "Intern - SDE (Mumbai)", "Mumbai, India", None, None, None),
    (3, "Acme", "SDE Intern", "Remote, India", None, None, "unknown"),
    (4, "Acme Ltd", "SDE Intern", "Remote, United States", None, None, "unknown"),
    (5, "ACME", "SDE Intern", "Remote", None, None, "unknown"),
    (6, "Acme", "SDE Intern", "Remote", None, "United States", "remote"),
    (7, "Acme Labs Pvt. Ltd.", "SDE Intern", "Berlin / Remote", None, None, "unknown"),
    (8, "ACME LABS", "SDE Intern - Berlin", None, "", None, "onsite"),
    (9, None, None, None, None, None, None),
]


def tables(spark, path):
    spark.createDataFrame(ROWS, "id bigint, company string, title string, location string, city string, country string, work_mode string").coalesce(1).write.parquet(f"{path}/jobs.parquet")
    spark.createDataFrame(CITIES, "city string, country string, other_names array<string>").coalesce(1).write.parquet(f"{path}/city_ref.parquet")
    return str(path)


def test_identity_keeps_countries_apart_and_merges_legal_forms(spark, tmp_path):
    got = {(r["kept"], r["merged"]) for r in catalog.QUERIES["keep_first_by_identity"](spark, tables(spark, tmp_path)).collect()}
    assert got == {(1, 1), (3, 0), (4, 1), (5, 0), (7, 0), (8, 0), (9, 0)}


def test_claims_hold_across_spellings(spark, tmp_path):
    got = {(r["cluster"], r["winner"], r["refused"]) for r in catalog.QUERIES["claim_by_brand"](spark, tables(spark, tmp_path)).collect()}
    assert got == {("brontavia|intern-sde", 1, 1), ("acme|intern-sde", 3, 5), ("|", 9, 0)}


def test_no_listed_cities(spark):
    c = identity.Cities([])
    r = spark.range(1).selectExpr("'Fort (Remote)' l", "'SDE' t", "cast(null as string) n").select(identity.place_key(*map(F.col, "ltnnn"), c).alias("p"))
    assert r.first()["p"] == "remote"
