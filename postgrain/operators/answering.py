"""Answers to form fields from several stores: which holds, where it comes from, and what is missing; whole CVs as one record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postgrain.operators.decisions import resolve_valid
from postgrain.operators.merge import insert_absent
from postgrain.sources import records, textfiles


def answers_map(**answers: Column) -> Column:
    """map of field to answer, without those that say nothing."""
    pairs = F.create_map(*[x for k, c in answers.items() for x in (F.lit(k), F.nullif(F.trim(c.cast("string")), F.lit("")))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def explain(asked: DataFrame, entries: DataFrame, *, key: str, at: str, precedence: list[str], sensitive: list[str], guarded: list[str] = ("user",)) -> DataFrame:
    """asked with value, kind, sensitive and status. A sensitive field (by its base key) is answered only by entries of the ``guarded``
    kinds and is ``parked`` without one; other fields are ``answered`` or ``open``. Nothing is written."""
    base = F.substring_index(key, ".", 1)
    tagged = asked.withColumn("sensitive", F.coalesce(base.isin(*sensitive), F.lit(False)) if sensitive else F.lit(False))
    plain = resolve_valid(tagged.where("not sensitive"), entries, key=key, at=at, precedence=precedence)
    careful = resolve_valid(tagged.where("sensitive"), entries.where(F.col("kind").isin(*guarded)), key=key, at=at, precedence=[p for p in precedence if p in guarded])
    status = F.when(F.col("value").isNotNull(), "answered").when(F.col("sensitive"), "parked").otherwise("open")
    return plain.unionByName(careful).withColumn("status", status)


def gate(rows: DataFrame, confirmed: Column) -> DataFrame:
    """open (all rows confirmed, and there are rows), waiting: one row."""
    g = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(confirmed, F.lit(False))).alias("waiting"))
    return g.select(((F.col("n") > 0) & (F.col("waiting") == 0)).alias("open"), "waiting")


def probe_list(companies: DataFrame, *, probes: list[str], home: Column, tail: int) -> DataFrame:
    """The companies with place and probe of each probe in order; those at home leave out the last ``tail`` ones."""
    p = F.posexplode(F.when(F.coalesce(home, F.lit(False)), F.array(*map(F.lit, probes[: len(probes) - tail]))).otherwise(F.array(*map(F.lit, probes))))
    return companies.select("*", p.alias("place", "probe"))


def insert_all(snapshots: dict[str, DataFrame], incoming: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """New rows for several tables from one source, each by its key; inserting again gives none."""
    return {name: insert_absent(snapshots[name], rows, key=keys[name]) for name, rows in incoming.items()}


def cv_records(texts: DataFrame, *, key: str, text: str, headings: dict[str, str]) -> DataFrame:
    """key, name, email, links, entries (array of dated entries with their section), skills (map): a CV as one record.

    ``headings``: heading as written, in lower case, to section; sections named ``skills`` hold ``Category: a, b`` lines, others dated entries.
    The name is the first line that says something. A CV's lines are one text, so its windows are bounded by its length."""
    ls = textfiles.lines(texts, key, text)
    table = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    body = textfiles.sections(ls, key, F.try_element_at(table, F.lower(F.btrim("line", F.lit(" :#*\t")))))
    parts = body.where("section is not null").groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    dated = parts.where("section <> 'skills'").select(key, "section", F.explode(records.dated_entries("lines")).alias("e"))
    entries = dated.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "e"))).alias("entries"))
    pairs = parts.where("section = 'skills'").select(key, F.explode("lines").alias("line")).select(key, textfiles.key_values(F.col("line")).alias("k")).where("k is not null")
    skills = pairs.groupBy(key, "k.name").agg(F.array_distinct(F.flatten(F.collect_list("k.values"))).alias("v")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("skills"))
    head = texts.where(F.col(text).isNotNull()).select(
        key, F.nullif(F.trim(F.regexp_extract(text, r"^\s*([^\r\n]+)", 1)), F.lit("")).alias("name"), F.nullif(F.regexp_extract(text, r"([\w.+-]+@[\w-]+\.[\w.-]+\w)", 1), F.lit("")).alias("email"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)>\]]+)"), F.lit(1))).alias("links"),
    )
    return reduce(lambda a, b: a.join(b, key, "left"), [head, entries, skills])
