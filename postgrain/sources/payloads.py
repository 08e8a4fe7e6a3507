"""Scans over landed payloads: JSON, XML and HTML columns or files to the fixed posting record.

A scan reads landed files with an explicit schema and maps each payload natively; only HTML goes through Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from postgrain.functions.html import html_links, html_to_text

POSTING = T.StructType([
    T.StructField("source", T.StringType(), False), T.StructField("source_id", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("application_url", T.StringType()), T.StructField("title", T.StringType(), False), T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("description_text", T.StringType()), T.StructField("compensation_text", T.StringType()),
    T.StructField("posted_date", T.StringType()), T.StructField("deadline", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
])

_PAYLOAD = "data array<struct<id:bigint,title:string,employer:struct<name:string>,places:array<string>,url:string,skills:array<string>>>, next string"


def as_json_payload(jobs: DataFrame) -> DataFrame:
    """Jobs as a feed delivers them: one JSON page a row, a list of nested postings."""
    item = F.struct("id", "title", F.struct(F.col("company").alias("name")).alias("employer"), F.array("location").alias("places"), F.col("source_url").alias("url"), F.col("tags").alias("skills"))
    return jobs.select(F.to_json(F.struct(F.array(item).alias("data"), F.lit(None).cast("string").alias("next"))).alias("payload"))


def postings_of_json(pages: DataFrame, payload: str) -> DataFrame:
    """Rows of JSON pages: postings without a title or an employer are left out, a missing place means worldwide."""
    d = pages.select(F.explode(F.from_json(payload, _PAYLOAD)["data"]).alias("d")).select("d.*")
    place = F.coalesce(F.nullif(F.array_join(F.array_distinct("places"), ", "), F.lit("")), F.lit("Worldwide"))
    place = F.when(F.get("places", F.lit(0)).isNull(), "Worldwide").otherwise(place)
    name = F.col("employer.name")
    return d.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")).select(
        "id", "url", "title", name.alias("employer"), place.alias("place"), F.size(F.coalesce("skills", F.array().cast("array<string>"))).alias("n_tags")
    )


def labels_to_map(pairs: Column) -> Column:
    """array<struct<type,label>> to a map, the last of a type holding."""
    kept = F.filter(pairs, lambda p: p["type"].isNotNull())
    types = F.array_distinct(F.transform(kept, lambda p: p["type"]))
    return F.map_from_arrays(types, F.transform(types, lambda k: F.element_at(F.filter(kept, lambda p: p["type"] == k), -1)["label"]))


def explode_lists(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """key, part, pos, value: the union of several list columns of a payload."""
    out = None
    for name in lists:
        part = df.select(F.col(key), F.lit(name).alias("part"), F.posexplode(name).alias("pos", "value"))
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key over pages and branches; rows without a key are left out."""
    rest = [c for c in df.columns if c != key]
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Rows of XML or RSS files, by the built-in reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_pages(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Landed JSON documents, one a file, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML: path, text and links of each file."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    return raw.select("path", html_to_text(F.col("html")).alias("text"), html_links(F.col("html")).alias("links"))


def embedded_json(page: Column, script_id: str) -> Column:
    """The JSON text of a script element."""
    return F.nullif(F.regexp_extract(page, f'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def data_attribute(page: Column, name: str) -> Column:
    """A data attribute's JSON, entities resolved."""
    raw = F.regexp_extract(page, f'{name}="([^"]*)"', 1)
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.nullif(raw, F.lit(""))


def find_misses(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys whose details aren't cached."""
    return keys.join(cache.select(key), key, "left_anti").distinct()


def overlay(cards: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cards with their details laid over: a detail that says something holds, a card without details stays."""
    d = details.select(F.col(key).alias("d_key"), *[F.col(c).alias(f"d_{c}") for c in columns])
    j = cards.join(d, F.col(key) == F.col("d_key"), "left")
    return j.select(*[F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in cards.columns])
