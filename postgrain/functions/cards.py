"""Listing and detail pages of HTML to fields, by class or id of their elements; Arrow batches over the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Fields(HTMLParser):
    """Cards of a page (elements matching ``card``) and the fields in each.

    A matcher is ``tag``, ``.class``, ``#id`` or ``tag.class``. A field is (matcher, attribute or '' for the text); a field marked with ``[]``
    in its name takes all its elements, others the first that says something. Without a card matcher the page is one card."""

    def __init__(self, card: str, fields: dict[str, tuple[str, str]]):
        super().__init__(convert_charrefs=True)
        self.card, self.fields = card, fields
        self.cards: list[dict[str, list[str]]] = [] if card else [{}]
        self.depth, self.inside = 0, 0 if not card else None
        self.open: list[tuple[int, str, list[str]]] = []

    @staticmethod
    def matches(matcher: str, tag: str, attrs: dict[str, str | None]) -> bool:
        if matcher.startswith("#"):
            return attrs.get("id") == matcher[1:]
        name, _, cls = matcher.partition(".")
        return (not name or name == tag) and (not cls or cls in (attrs.get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.card and self.inside is None and self.matches(self.card, tag, a):
            self.cards.append({})
            self.inside = self.depth
            if a.get("id"):
                self.cards[-1]["id"] = [a["id"]]
        if self.inside is not None:
            for name, (matcher, attr) in self.fields.items():
                if self.matches(matcher, tag, a):
                    if attr:
                        self.cards[-1].setdefault(name, []).append((a.get(attr) or "").strip())
                    elif tag not in _VOID:
                        self.open.append((self.depth, name, []))
        if tag not in _VOID:
            self.depth += 1

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        self.depth = max(0, self.depth - 1)
        self._close(self.depth)
        if self.card and self.inside is not None and self.depth <= self.inside:
            self.inside = None

    def _close(self, depth: int) -> None:
        while self.open and self.open[-1][0] >= depth:
            _, name, parts = self.open.pop()
            self.cards[-1].setdefault(name, []).append(" ".join("".join(parts).split()))

    def result(self) -> list[dict[str, str]]:
        self._close(0)
        out = []
        for c in self.cards:
            said = {n: [v for v in vs if v] for n, vs in c.items()}
            out.append({n: "\x1f".join(vs) if n.endswith("[]") else vs[0] for n, vs in said.items() if vs})
        return out


def fields_of_html(html: str | None, card: str, fields: dict[str, tuple[str, str]]) -> list[dict[str, str]]:
    p = Fields(card, fields)
    p.feed(html or "")
    p.close()
    return p.result()


def html_cards(x: Column, card: str, fields: dict[str, tuple[str, str]]) -> Column:
    """array<map<string,string>>: the fields of each card of a page; a list field's values are joined by U+001F."""

    @F.pandas_udf("array<map<string,string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fields_of_html(t, card, fields))

    return run(x)


def html_fields(x: Column, fields: dict[str, tuple[str, str]]) -> Column:
    """map<string,string>: the fields of a whole page."""
    return F.get(html_cards(x, "", fields), F.lit(0))


# Classes of public listing pages.
LISTINGS = {
    "internshala": ("div.individual_internship", {
        "source_id": ("div.individual_internship", "internshipid"), "path": ("div.individual_internship", "data-href"), "title": (".job-internship-name", ""), "company": (".company-name", ""), "location": (".locations", ""),
        "pay": (".stipend", ""), "text": (".text", ""), "tags[]": (".job_skill", ""), "posted": (".status-success", ""),
    }),
    "linkedin": ("li", {
        "title": ("h3.base-search-card__title", ""), "company": ("h4.base-search-card__subtitle", ""), "url": ("a.base-card__full-link", "href"), "location": ("span.job-search-card__location", ""),
    }),
}


def listing_records(pages, shape: str, *, html: str = "html", base: str = ""):
    """shape, source_id, title, company, url, location, pay, text, posted, tags of the cards of listing pages; cards without title and address or id are left out."""
    card, fields = LISTINGS[shape]
    c = pages.select(F.explode(html_cards(F.col(html), card, fields)).alias("c"))
    get = lambda k: F.try_element_at("c", F.lit(k))
    url = F.coalesce(F.substring_index(get("url"), "?", 1), F.concat(F.lit(base), get("path")))
    ident = F.coalesce(get("source_id"), F.nullif(F.regexp_extract(url, "view/([^/]+)", 1), F.lit("")))
    return c.select(
        F.lit(shape).alias("shape"), ident.alias("source_id"), get("title").alias("title"), get("company").alias("company"), url.alias("url"), get("location").alias("location"), get("pay").alias("pay"),
        get("text").alias("text"), get("posted").alias("posted"), F.split(get("tags[]"), "\x1f").alias("tags"),
    ).where("title is not null and url is not null")


def listing_total(x: Column) -> Column:
    """The number at the start of the page's main heading; null without one."""
    return F.try_to_number(F.regexp_replace(F.regexp_extract(x, r"(?is)<h1[^>]*>\s*([\d,]+)", 1), ",", ""), F.lit("999999999")).cast("bigint")


def unescaped(x: Column) -> Column:
    """The five entities of XML and non-breaking spaces as characters; the ampersand last."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def first_tag_text(x: Column, tag: str) -> Column:
    """The text of the first element of that name, unescaped; null if there is none."""
    return F.nullif(F.trim(unescaped(F.regexp_extract(x, f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1))), F.lit(""))


def page_facts(x: Column) -> Column:
    """struct(title, description, paragraphs): title, meta description and up to six different paragraphs of over 40 characters, in order."""
    f = html_fields(x, {"title": ("title", ""), "p[]": ("p", "")})
    meta = F.nullif(unescaped(F.regexp_extract(x, r'(?i)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)), F.lit(""))
    ps = F.filter(F.array_distinct(F.split(F.coalesce(F.try_element_at(f, F.lit("p[]")), F.lit("")), "\x1f")), lambda p: F.length(p) > 40)
    return F.struct(F.try_element_at(f, F.lit("title")).alias("title"), meta.alias("description"), F.slice(ps, 1, 6).alias("paragraphs"))
