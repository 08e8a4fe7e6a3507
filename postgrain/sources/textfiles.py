"""Line-structured texts: sections, tables, key-value lists; structured data in HTML; a file-per-partition data source."""

from __future__ import annotations

import glob
import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: one row a line. A document's lines are one text, so windows over them are bounded by its length."""
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def sections(ls: DataFrame, key: str, heading: Column) -> DataFrame:
    """The lines with the last heading before them; ``heading``: the heading a line holds, else null."""
    w = Window.partitionBy(key).orderBy("line_no")
    h = ls.withColumn("__h", heading)
    return h.withColumn("section", F.last("__h", ignorenulls=True).over(w)).where("__h is null").drop("__h")


def flag_after(ls: DataFrame, key: str, stop: Column) -> DataFrame:
    """The lines with whether a stopping line stands before."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return ls.withColumn("after", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0)) == 1)


def table_row(line: Column) -> Column:
    """Cells of a Markdown table row; null for other lines and for rules."""
    t = F.trim(line)
    return F.when(t.rlike("^\\|.*\\|$") & ~t.rlike("^\\|[\\s|:-]+\\|$"), F.transform(F.split(F.btrim(t, F.lit("|")), "\\|"), lambda c: F.trim(c)))


def key_values(line: Column) -> Column:
    """``Name: a, b; c`` as struct(name, values); null for other lines."""
    name = F.trim(F.regexp_extract(line, "^\\s*([^:]{1,60}):", 1))
    rest = F.regexp_extract(line, "^[^:]{1,60}:(.*)$", 1)
    return F.when(name != "", F.struct(name.alias("name"), F.filter(F.transform(F.split(rest, "[,;]"), lambda v: F.trim(v)), lambda v: v != "").alias("values")))


class _Scripts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.on = [], False

    def handle_starttag(self, tag, attrs):
        self.on = tag == "script" and dict(attrs).get("type") == "application/ld+json"
        if self.on:
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def handle_endtag(self, tag):
        self.on = False


def linked_data(html: str | None, kind: str) -> list[str]:
    """JSON of every node of the type in the page's linked data, at any depth, in order."""
    p = _Scripts()
    p.feed(html or "")
    out = []

    def walk(x):
        if isinstance(x, dict):
            t = x.get("@type")
            if t == kind or isinstance(t, list) and kind in t:
                out.append(json.dumps(x, sort_keys=True))
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    for b in p.blocks:
        try:
            walk(json.loads(b))
        except ValueError:
            continue
    return out


class _Form(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.fields, self.label, self.in_label, self.select = [], "", False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "label":
            self.in_label, self.label = True, ""
        elif tag in ("input", "textarea", "select") and a.get("type") not in ("hidden", "submit"):
            self.fields.append({"label": " ".join(self.label.split()), "type": a.get("type", "text") if tag == "input" else tag, "required": "required" in a, "options": []})
            self.select = self.fields[-1] if tag == "select" else None
            self.label = ""
        elif tag == "option" and self.select is not None and a.get("value"):
            self.select["options"].append(a["value"])

    def handle_endtag(self, tag):
        if tag == "label":
            self.in_label = False
        elif tag == "select":
            self.select = None

    def handle_data(self, data):
        if self.in_label:
            self.label += data


def form_fields(html: str | None) -> list[dict]:
    """label, type, required, options of each visible field of a page's forms."""
    p = _Form()
    p.feed(html or "")
    return p.fields


def html_form_fields(x: Column) -> Column:
    @F.pandas_udf("array<struct<label:string,type:string,required:boolean,options:array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(form_fields)

    return run(x)


def html_linked_data(x: Column, kind: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: linked_data(h, kind))

    return run(x)


class LandedFiles(DataSource):
    """Landed payloads as ``spark.read.format("landed").load(pattern)``: path, payload, error; a partition a file, so one unreadable
    file is a row with its error and doesn't fail the scan."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return "path string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _LandedReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _LandedReader(DataSourceReader):
    def __init__(self, options):
        self.pattern = options["path"]

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition):
        if partition is None or getattr(partition, "path", None) is None:
            return
        try:
            with open(partition.path, encoding="utf-8") as f:
                yield partition.path, f.read(), None
        except (OSError, UnicodeDecodeError) as e:
            yield partition.path, None, type(e).__name__
