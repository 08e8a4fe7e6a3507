"""Places named in a text: every alias of a list, the longest first, as whole words."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

MAX_ALIASES = 5_000


def alias_pattern(aliases: list[str]) -> str:
    """One alternation of the aliases, longest first, not within other letters."""
    if len(aliases) > MAX_ALIASES:
        raise ValueError("too many aliases for one pattern; use a join")
    longest = sorted({a.lower() for a in aliases if a}, key=lambda a: (-len(a), a))
    return "(?<![\\p{L}])(" + "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", a) for a in longest) + ")(?![\\p{L}])"


def places_in(text: Column, aliases: dict[str, str]) -> Column:
    """Canonical places in order of appearance, each once."""
    table = F.create_map(*[F.lit(x) for k, v in sorted(aliases.items()) for x in (k.lower(), v)])
    hits = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\s+", " "), F.lit(alias_pattern(list(aliases))), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda h: F.element_at(table, h)))


def without_places(text: Column, aliases: dict[str, str]) -> Column:
    """The text with every alias blanked."""
    return F.regexp_replace(text, "(?iu)" + alias_pattern(list(aliases)), " ")


def refs_in(text: Column, patterns: dict[str, str]) -> Column:
    """array<struct<pos,kind,token>> of all pattern hits (group 1 is the token) by position, the first of each kind and token."""

    def hits(kind: str, pattern: str) -> Column:
        # the whole match tells the place; the n-th match is looked for after the end of the one before
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        token = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("places"))

        def step(acc: Column, w: Column) -> Column:
            at = F.position(w, text, acc["end"] + 1)
            return F.struct((at + F.length(w) - 1).alias("end"), F.array_append(acc["places"], at).alias("places"))

        places = F.aggregate(whole, start, step)["places"]
        return F.transform(F.arrays_zip(places.alias("at"), token.alias("token")), lambda h: F.struct(h["at"].alias("pos"), F.lit(kind).alias("kind"), h["token"].alias("token")))

    found = F.concat(*[hits(k, p) for k, p in patterns.items()])
    return F.aggregate(
        F.array_sort(found), F.array().cast("array<struct<pos:int,kind:string,token:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["kind"] == x["kind"]) & (F.lower(y["token"]) == F.lower(x["token"]))), acc).otherwise(F.array_append(acc, x)),
    )


def templated(kind: Column, token: Column, templates: dict[str, str]) -> Column:
    """The template of the kind with {token} filled in; null for an unknown kind."""
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    return F.replace(F.try_element_at(table, kind), F.lit("{token}"), token)


def slug_candidates(name: Column) -> Column:
    """Up to two ways to write a name in an address: words joined, words with dashes; of three characters or more."""
    w = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.slice(F.filter(F.array_distinct(F.array(F.array_join(w, ""), F.array_join(w, "-"))), lambda s: F.length(s) >= 3), 1, 2)
