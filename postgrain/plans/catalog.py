"""All queries outside the subpackage for language-model data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrain.plans import feeds, general, identities, lookups, more, mutations, registry, relational, scalars  # noqa: F401
from postgrain.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised texts kept first, merged counts and weighted share by source and language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9]+", " ")).alias("norm"))
    kept = d.groupBy(F.sha2("norm", 256).alias("text_key")).agg(F.min_by(F.struct("source", "lang"), "doc_id").alias("k"), F.count("*").alias("n"))
    by = kept.groupBy("k.source", "k.lang").agg(F.count("*").alias("texts"), F.sum("n").alias("documents"))
    total = by.agg(F.sum("documents").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("source", "lang", "texts", "documents", F.round(F.col("documents") / F.col("total"), 9).alias("share"))


FLAGSHIP_SQL = """
WITH d AS (SELECT doc_id, source, lang, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS norm FROM documents),
kept AS (SELECT sha256(norm) AS text_key, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, count(*) AS n FROM d GROUP BY 1),
g AS (SELECT source, lang, count(*) AS texts, CAST(sum(n) AS BIGINT) AS documents FROM kept GROUP BY 1, 2)
SELECT source, lang, texts, documents, round(documents / sum(documents) OVER (), 9) AS share FROM g
"""

QUERIES = {"flagship_text_share": flagship, **general.QUERIES, **registry.QUERIES}
ORACLES = {"flagship_text_share": FLAGSHIP_SQL, **general.ORACLES, **registry.ORACLES}
