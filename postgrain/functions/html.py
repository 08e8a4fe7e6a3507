"""HTML to text in Arrow batches, by the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data := data.strip():
            self.parts.append(data)


def text_of_html(html: str | None) -> str:
    """The text nodes, stripped, one a line; '' for null."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.label = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.label = dict(attrs).get("href"), ""

    def handle_data(self, data):
        if self.href is not None:
            self.label += data

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.links.append((self.href, " ".join(self.label.split())))
            self.href = None


def links_of_html(html: str | None) -> list[tuple[str, str]]:
    """(address, label) of every link."""
    p = _Links()
    p.feed(html or "")
    p.close()
    return p.links


def html_to_text(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(text_of_html)

    return run(x)


def html_links(x: Column) -> Column:
    @F.pandas_udf("array<struct<href:string,label:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"href": a, "label": b} for a, b in links_of_html(h)])

    return run(x)
