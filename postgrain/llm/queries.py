"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrain.llm import canonical, encode as bpe, leaks, matching, neardup, reading, survivors, wordings
from postgrain.llm.oracles import ORACLES
from postgrain.session import table


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_of_groups(table(spark, sf_dir, "raw_posting"), table(spark, sf_dir, "source_registry"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures whose description, address and channel survive, for each posting of two or more captures."""
    return _best(spark, sf_dir).where("n_records >= 2").select(
        F.col("grp").alias("posting_key"), F.col("description_rec").alias("description_capture_id"),
        F.col("url_rec").alias("url_capture_id"), F.col("channel_rec").alias("channel_capture_id"),
    )


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each posting."""
    r = survivors.surviving_records(table(spark, sf_dir, "raw_posting"), _best(spark, sf_dir))
    return r.withColumnRenamed("grp", "posting_key")


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, sf_dir, "jobs"), key="id", text="description_text", n=3, threshold=0.5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of jobs whose descriptions share at least half of their three-word sequences."""
    return neardup.all_pairs(*_near(spark, sf_dir)).select(F.col("key_a").alias("job_id_a"), F.col("key_b").alias("job_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's class of identical descriptions, its copies and the number of linked classes."""
    return neardup.classes_with_links(*_near(spark, sf_dir)).select(F.col("key").alias("job_id"), F.col("class_key").alias("class_job_id"), "copies", "links")


# Syntax around names: brackets, numbering of questions, signs between parts of a place.
REMARKS = r"\([^)]*\)|\[[^\]]*\]"
SEGMENTS = r"[,;|/:]|\s[-–—]\s"
NUMBERING = r"|^\W*(?:\w+\s*)?\d{1,3}\s*[.):]\s+"


def _city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "city_ref")
    return cities.select(F.col("city_id").cast("string").alias("ref_key"), F.explode(F.concat(F.array("city"), F.coalesce("other_names", F.array().cast("array<string>")))).alias("name"))


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, names = table(spark, sf_dir, "jobs"), _city_names(spark, sf_dir)
    noise = wordings.noise_tokens(jobs, "city", canonical.vocabulary(canonical.listed(names), REMARKS))
    return canonical.map_to_list(jobs, names, key="id", value="city", ignore=noise, decoration=REMARKS, segments=SEGMENTS, threshold=0.38)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, ref = table(spark, sf_dir, "form_question"), table(spark, sf_dir, "question_ref")
    both = F.concat_ws(" ", "label", "sample_phrasing")
    names = ref.select(F.col("canonical_key").alias("ref_key"), F.explode(F.array("label", "sample_phrasing", both)).alias("name"))
    rows = wordings.distinct_tokens(asked, "raw_label")
    shares = wordings.shares(rows)
    return canonical.map_to_list(asked, names, key="id", value="raw_label", decoration=REMARKS + NUMBERING, remarks=wordings.remarks(asked, "raw_label"), shares=shares, threshold=0.28)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    city, label = _cities(spark, sf_dir), _labels(spark, sf_dir)
    return city.select(F.lit("city").alias("field"), "row_id", "ref_key", "score").unionByName(label.select(F.lit("raw_label").alias("field"), "row_id", "ref_key", "score"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and listings that mean the same opening, with the calibrated confidence."""
    jobs, listings = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "board_listings")
    cities = canonical.listed(_city_names(spark, sf_dir))
    known = canonical.vocabulary(cities, REMARKS)
    noise = wordings.noise_tokens(jobs.select(F.col("location").alias("v")).unionByName(listings.select(F.col("location").alias("v"))), "v", known)
    learned = matching.learn((jobs, "title", "company"), (listings, "title", "company"))
    args = {"names": cities, "ignore": noise, "decoration": REMARKS, "segments": SEGMENTS, "threshold": 0.38}
    left = matching.profiles(jobs, learned, key="id", title="title", company="company", places=["location", "city"], cities=args)
    right = matching.profiles(listings, learned, key="listing_id", title="title", company="company", places=["location"], cities=args)
    m = matching.match(left, right, learned["counts"])
    return m.select(F.col("left_key").alias("job_id"), F.col("right_key").alias("listing_id"), F.round("confidence", 6).alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and listings of the same role at the same employer in the same place."""
    return p3_scores(spark, sf_dir).select("job_id", "listing_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed city and question label with its entry of the reference list, or none."""
    return _mapped(spark, sf_dir).select("field", "row_id", "ref_key")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of values mapped or reported, by field."""
    return _mapped(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"))


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct token of the typed cities with the vocabulary tokens nearest to it."""
    t = canonical.repaired_tokens(table(spark, sf_dir, "jobs"), _city_names(spark, sf_dir), value="city")
    return t.select("token", F.array_join("nearest", " ").alias("nearest"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of unmatched rows by field."""
    return _mapped(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("ref_key") == canonical.NONE).alias("unmatched"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they hold as a phrase or by proximity, with the longest run of words and the words met in order."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), near=True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of the English texts of 50 words or more."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels")).select("doc_id", "reading_level")


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_scores": p3_scores, "p6_found": p6_found, "p6_counts": p6_counts, "p6_tokens": p6_tokens, "p6_unmatched": p6_unmatched, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found}
