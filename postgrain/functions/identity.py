"""Identity of a job across sources (company, title, place) and the cluster that is claimed once (brand, title).

In doubt the identity keeps rows apart: an unlisted city is keyed by its text, and a remote role keeps its country, which tells who may
apply. The claim cluster errs the other way: it holds across cities and across legal and brand spellings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from postgrain.functions import places, text as tx

#: Country to its whole-word names, lower-case, in the order they are tried; states count for their country.
COUNTRY_NAMES = {
    "India": "india|karnataka|maharashtra|telangana|tamil nadu|haryana|uttar pradesh|west bengal|gujarat|kerala|rajasthan|odisha|punjab|andhra pradesh|madhya pradesh",
    "United States": "united states|united states of america", "United Kingdom": "united kingdom|england|scotland", "Canada": "canada",
    "Germany": "germany|deutschland", "Singapore": "singapore", "United Arab Emirates": "united arab emirates|uae",
}
#: Codes that are words in lower case.
COUNTRY_CODES = {"United States": "\\bUSA?\\b|\\bU\\.S\\.A?\\.?", "United Kingdom": "\\bUK\\b", "India": "(?:,|\\()\\s*IN\\b"}


class Cities:
    """Aliases of the listed cities and the country of each; an alias of two cities goes to the first by name."""

    def __init__(self, rows: Iterable[tuple[str, str | None, list[str] | None]]):
        self.aliases: dict[str, str] = {}
        self.countries: dict[str, str] = {}
        for city, country, others in sorted(rows, key=lambda r: r[0]):
            self.countries.setdefault(city, country or "")
            for a in [city, *(others or [])]:
                if a and a.strip():
                    self.aliases.setdefault(a.strip().lower(), city)

    def first(self, x: Column) -> Column:
        """The first listed city named in a text; null if none."""
        return F.get(places.places_in(x, self.aliases), F.lit(0)) if self.aliases else F.lit(None).cast("string")

    def country(self, city: Column) -> Column:
        if not self.countries:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(self.countries.items()) for x in kv]), city)


def title_key(title: Column, cities: Cities) -> Column:
    """``text.title_key`` without listed cities: the place has its own part in the key."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), f"(?i)\\b({tx.TITLE_NOISE})\\b", " "), "\\s+", " ")
    return tx.title_key(places.without_places(t, cities.aliases) if cities.aliases else t)


def country_in(x: Column) -> Column:
    """Country named in a text, by name, else by code; null if none."""
    low, c = F.lower(x), None
    for name, words in COUNTRY_NAMES.items():
        hit = low.rlike(f"(^|[^\\p{{L}}])({words})($|[^\\p{{L}}])")
        c = F.when(hit, name) if c is None else c.when(hit, name)
    for name, pattern in COUNTRY_CODES.items():
        c = c.when(x.rlike(pattern), name)
    return c


def place_key(location: Column, title: Column, city: Column, country: Column, mode: Column, cities: Cities) -> Column:
    """'remote' with its country where known, else the listed city, else the written city, else the written place, else 'unknown'.

    A stored work mode goes before the text's; the title names a city only where there is no location."""
    blank = F.trim(F.coalesce(location, F.lit(""))) == ""
    listed = F.coalesce(cities.first(location), cities.first(city), F.when(blank, cities.first(title)))
    stored = F.lower(F.trim(mode))
    remote = F.when(F.coalesce(stored, F.lit("")).isin("", "unknown"), tx.work_mode(location, title)).otherwise(stored) == "remote"
    land = tx.alnum_key(F.coalesce(country_in(location), F.nullif(F.trim(country), F.lit("")), cities.country(listed)))
    some = lambda x: F.nullif(x, F.lit(""))
    where = F.coalesce(some(tx.alnum_key(listed)), some(tx.alnum_key(city)), some(F.substring(tx.alnum_key(location), 1, 60)), F.lit("unknown"))
    return F.when(remote, F.when(land != "", F.concat(F.lit("remote-"), land)).otherwise("remote")).otherwise(where)


def cluster_key(company: Column, title: Column, cities: Cities) -> Column:
    """Brand and title: one claim across spellings, sources and cities."""
    return F.concat_ws("|", tx.brand_key(company), title_key(title, cities))


def location_struct(location: Column, title: Column, cities: Cities) -> Column:
    """struct(city, country, work_mode, cities): the listed cities a place names, in order; the title's only where there is no place.

    A country is the one written, else the first city's. hybrid goes before remote before onsite; a known city, or any place that isn't a
    placeholder, means onsite."""
    place = F.trim(F.coalesce(location, F.lit("")))
    named = places.places_in(F.when(place != "", place).otherwise(title), cities.aliases) if cities.aliases else F.array().cast("array<string>")
    first = F.get(named, F.lit(0))
    hint = F.lower(F.concat_ws(" ", place, title))
    mode = (
        F.when(hint.rlike("\\bhybrid\\b"), "hybrid")
        .when(hint.rlike(f"\\b({tx.REMOTE_WORDS})\\b"), "remote")
        .when(hint.rlike(f"\\b({tx.ONSITE_WORDS})\\b") | first.isNotNull() | ~F.lower(place).isin(*tx.NO_PLACE), "onsite")
        .otherwise("unknown")
    )
    return F.struct(first.alias("city"), F.coalesce(country_in(place), F.nullif(cities.country(first), F.lit(""))).alias("country"), mode.alias("work_mode"), named.alias("cities"))
