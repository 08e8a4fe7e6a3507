"""Typed values: dates, money, widgets, enumerations, digests, tokens and page states. All native."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Truthy and falsy words, and the currencies a sign stands for.
TRUE_WORDS, FALSE_WORDS = ["yes", "true", "1", "y"], ["no", "false", "0", "n"]
SIGNS = {"$": ["USD", "CAD", "AUD"], "€": ["EUR"], "£": ["GBP"], "₹": ["INR"]}
CODES = "INR|USD|GBP|EUR|CAD|AUD|SGD|JPY"


def date_of(start: Column, end: Column, text: Column) -> Column:
    """The first of start, end and text that says something."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(start), some(end), some(text))


def enum_or_default(x: Column, members: list[str], default: str) -> Column:
    """The member, whatever its case and surrounding blanks; the default for others and null."""
    v = F.lower(F.trim(x))
    return F.when(v.isin(*members), v).otherwise(F.lit(default))


def widget_value(value: Column, kind: Column) -> Column:
    """A text as its widget takes it: digits for numbers (null if there are none), true or false for boxes where it says so, the text otherwise."""
    low = F.lower(F.trim(value))
    digits = F.nullif(F.regexp_extract(value, r"(\d+)", 1), F.lit(""))
    return F.when(kind == "number", digits).when(kind.isin("checkbox", "radio"), F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false").otherwise(value)).otherwise(value)


def money_text(amount: Column, currency: Column, period: Column, *, wanted: Column, label: Column, number: Column) -> Column:
    """``amount currency`` (the amount alone for number fields) if the period is the wanted one and the label asks for no other currency; else null."""
    cur = F.upper(F.coalesce(currency, F.lit("")))
    code = F.upper(F.regexp_extract(label, rf"(?i)\b({CODES})\b", 1))
    sign = F.regexp_extract(label, "([$€£₹])", 1)
    signs = F.create_map(*[x for k, v in SIGNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fits = F.when(F.coalesce(code, F.lit("")) != "", code == cur).when(F.coalesce(sign, F.lit("")) != "", F.array_contains(F.try_element_at(signs, sign), cur)).otherwise(True)
    text = F.when(number, amount.cast("string")).otherwise(F.trim(F.concat_ws(" ", amount.cast("string"), cur)))
    return F.when(F.coalesce(period.eqNullSafe(wanted), F.lit(False)) & fits & amount.isNotNull(), text)


def digest(*columns: Column) -> Column:
    """SHA-1 of the canonical JSON of a row's values: an array in the order given, nulls kept."""
    return F.sha1(F.to_json(F.struct(F.array(*[c.cast("string") for c in columns]).alias("v"))))


def labelled_lines(**parts: Column) -> Column:
    """``name: value`` lines of the parts that say something."""
    lines = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in parts.items()]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def board_token(kind: Column, token: Column, deny: dict[str, list[str]]) -> Column:
    """A board's token without edge signs; null where it is empty or a word denied for its kind."""
    t = F.rtrim(F.trim(token), F.lit(".-_"))
    table = F.create_map(*[x for k, v in deny.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if deny else None
    denied = F.coalesce(F.array_contains(F.try_element_at(table, kind), F.lower(t)), F.lit(False)) if table is not None else F.lit(False)
    return F.when((t != "") & ~denied, t)


def page_challenge(status: Column, title: Column, body: Column) -> Column:
    """Why a page is a block and no content: its status, its title, or words at its start; null if it isn't one."""
    # Titles and words of challenge pages
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    said = F.regexp_extract(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500)), "(captcha required|access denied|are you a robot)", 1)
    return (
        F.when(status.isin(403, 429), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(t.rlike("^(just a moment|attention required|verify you are human|security check)"), F.concat(F.lit("challenge page: "), F.substring(t, 1, 60)))
        .when(status.isin(401, 406) | (said != ""), F.concat_ws(": ", F.concat(F.lit("HTTP "), status.cast("string")), F.nullif(said, F.lit(""))))
    )


def open_question(label: Column, kind: Column, options: Column) -> Column:
    """Whether an answer in free words is asked for: a long field, or a label of 20 characters that asks why, how or to tell."""
    closed = kind.isin("file", "select", "multi_select", "boolean", "radio", "checkbox", "date", "email", "phone", "number", "url", "location")
    asks = (F.length(label) >= 20) & label.rlike(r"(?i)\b(why|how|describe|tell us|explain|share|what)\b")
    return F.coalesce((F.size(F.coalesce(options, F.array().cast("array<string>"))) == 0) & ~F.coalesce(closed, F.lit(False)) & (F.coalesce(kind == "textarea", F.lit(False)) | asks), F.lit(False))


def remaining(limit: Column, spent: Column, used: Column) -> Column:
    """What is left of a budget, never below zero."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(limit, zero) - F.coalesce(spent, zero) - F.coalesce(used, zero), zero)


def completeness(**flags: Column) -> Column:
    """Whole per cent of the flags that hold, cut off."""
    held = sum((F.coalesce(c, F.lit(False)).cast("int") for c in flags.values()), F.lit(0))
    return F.floor(100 * held / len(flags)).cast("int")


def names_country(regions: Column, text: Column, country: str) -> Column:
    """Whether an array of regions or a delimited text names the country."""
    return F.coalesce(F.array_contains(regions, country), F.lit(False)) | F.coalesce(text.rlike(f"(?i)(^|[,;|/\\s]){country}($|[,;|/\\s])"), F.lit(False))
