"""Company directories: JSON lists, pages of links, sitemaps, and scans that resume."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postgrain.functions.text import domain_of
from postgrain.functions.values import names_country

ENOUGH = 8  # entries that make a way of reading a page good enough


def directory_seeds(payloads: DataFrame, *, rows: str, name: str, website: str, regions: str, places: str, status: str, country: str, statuses: list[str], payload: str = "payload") -> DataFrame:
    """name, website, status of the entries of JSON lists that lie in the country and have one of the statuses; ``name`` to ``status``: paths within an entry."""
    item = F.explode(F.try_variant_get(F.try_parse_json(payload), rows, "array<variant>")).alias("i")
    get = lambda path, kind="string": F.try_variant_get("i", path, kind)
    d = payloads.select(item).select(F.trim(get(name)).alias("name"), F.nullif(F.trim(get(website)), F.lit("")).alias("website"), get(status).alias("status"), get(regions, "array<string>").alias("r"), get(places).alias("p"))
    kept = (F.coalesce("name", F.lit("")) != "") & names_country(F.col("r"), F.col("p"), country) & F.col("status").isin(*statuses)
    return d.where(kept).select("name", "website", "status").distinct()


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.at: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a":
            self.close_anchor()
            self.at = {"href": (a.get("href") or "").strip(), "said": a.get("aria-label") or a.get("title") or "", "text": "", "alt": ""}
        elif tag == "img" and self.at is not None and not self.at["alt"]:
            self.at["alt"] = a.get("alt") or ""

    def handle_data(self, data):
        if self.at is not None:
            self.at["text"] += data

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_anchor()

    def close_anchor(self):
        if self.at and self.at["href"]:
            labels = (" ".join(self.at[k].split()) for k in ("said", "text", "alt"))
            label = next((x for x in labels if x), "")
            self.found.append((self.at["href"], "" if "://" in label or label.lower().startswith("www.") else label))
        self.at = None


def anchors_of_html(html: str | None) -> list[tuple[str, str]]:
    p = _Anchors()
    p.feed(html or "")
    p.close()
    p.close_anchor()
    return p.found


def anchors(x: Column) -> Column:
    """array<struct<href,label>> of a page's links in order; the label is what they say for readers, their text, or their image's; an address is no label."""

    @F.pandas_udf("array<struct<href:string,label:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"href": h, "label": label} for h, label in anchors_of_html(t)])

    return run(x)


def links(pages: DataFrame, *, html: str = "html", base: str = "url", excluded: list[str] = ()) -> DataFrame:
    """url (of the page), place, href, label, domain, outbound: absolute http links; outbound: to a domain that is neither the page's own (or over or under it) nor excluded."""
    a = pages.select(F.col(base).alias("url"), F.posexplode(anchors(F.col(html))).alias("place", "a"))
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    href = F.when(F.col("a.href").rlike("^/(?!/)"), F.concat(root, F.col("a.href"))).when(F.col("a.href").startswith("//"), F.concat(F.lit("https:"), F.col("a.href"))).otherwise(F.col("a.href"))
    d = a.select("url", "place", F.regexp_replace(href, "#.*$", "").alias("href"), F.col("a.label").alias("label")).where(F.col("href").rlike("^https?://"))
    d = d.withColumn("domain", domain_of(F.col("href"))).withColumn("own", domain_of(F.col("url"))).where("domain is not null")
    same = (F.col("domain") == F.col("own")) | F.col("domain").endswith(F.concat(F.lit("."), F.col("own"))) | F.col("own").endswith(F.concat(F.lit("."), F.col("domain")))
    bad = F.lit(False)
    for x in excluded:
        bad |= (F.col("domain") == x) | F.col("domain").endswith(f".{x}")
    return d.select("url", "place", "href", "label", "domain", (~same & ~bad).alias("outbound"), same.alias("internal"))


def outbound_entries(found: DataFrame) -> DataFrame:
    """url, name, website: one entry for each outbound domain of a page, named by its first label that says something."""
    g = found.where("outbound").groupBy("url", "domain").agg(F.min_by("label", F.when(F.col("label") != "", F.col("place"))).alias("name"), F.min_by("href", "place").alias("website"), F.min("place").alias("place"))
    return g.select("url", F.coalesce("name", F.lit("")).alias("name"), "website", "place")


def internal_entries(found: DataFrame, path: str) -> DataFrame:
    """url, name, website (the page of the entry): links within the site whose path matches, by their first label that says something."""
    g = found.where(F.col("internal") & F.col("href").rlike(path)).groupBy("url", "href").agg(F.min_by("label", F.when(F.col("label") != "", F.col("place"))).alias("name"), F.min("place").alias("place"))
    return g.select("url", F.coalesce("name", F.lit("")).alias("name"), F.col("href").alias("website"), "place")


def best_entries(*ways: tuple[str, DataFrame]) -> DataFrame:
    """url, way, name, website, place: of each page the entries of the first way that finds ``ENOUGH``, else of the one that finds most (the earlier on ties)."""
    every = None
    for k, (name, df) in enumerate(ways):
        d = df.select("url", F.lit(name).alias("way"), F.lit(k).alias("rank"), "name", "website", "place")
        every = d if every is None else every.unionByName(d)
    n = every.groupBy("url", "way", "rank").agg(F.count("*").alias("n"))
    # enough: by rank alone; otherwise by number, then rank
    order = F.struct((F.col("n") < ENOUGH).cast("int"), F.when(F.col("n") < ENOUGH, -F.col("n")).otherwise(0), "rank")
    best = n.groupBy("url").agg(F.min_by("way", order).alias("way"))
    return every.join(best, ["url", "way"]).drop("rank")


def website_of_detail(found: DataFrame) -> DataFrame:
    """url, website: a page's first labelled outbound link, else its first outbound link."""
    order = F.struct((F.col("label") == "").cast("int"), "place")
    return found.where("outbound").groupBy("url").agg(F.min_by("href", order).alias("website"))


def sitemap_addresses(pages: DataFrame, *, xml: str = "xml", match: str = ".") -> DataFrame:
    """address: the distinct locations of sitemaps and sitemap indexes that match."""
    locs = F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return pages.select(F.explode(locs).alias("address")).where(F.col("address").rlike(match)).distinct()


def still_to_do(addresses: DataFrame, done: DataFrame, *, key: str, at_once: int) -> DataFrame:
    """The next addresses of a scan that resumes: those not done yet, in their order, as many as a run takes."""
    return addresses.join(done.select(key), key, "left_anti").orderBy(key).limit(at_once)


def new_texts(texts: DataFrame, cache: DataFrame, *, text: str, model: str) -> DataFrame:
    """digest, text: the distinct texts whose vectors the cache (by digest of text and model) lacks."""
    d = texts.where(F.col(text).isNotNull()).select(F.sha1(F.concat_ws("\x00", F.lit(model), F.col(text))).alias("digest"), F.col(text).alias("text")).distinct()
    return d.join(cache.select("digest"), "digest", "left_anti")


def table_lines(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """line, text: a ranked table as lines of a report; ``df`` holds ``place``; ``columns``: heading to column. Bars in values become slashes."""
    spark = df.sparkSession
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns.values()]), F.lit(" |"))
    head = spark.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "line bigint, text string")
    return head.unionByName(df.select(F.col("place").cast("bigint").alias("line"), text.alias("text")))
