"""Values to what a field takes: yes or no, several options, dates and numbers by the field's type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postgrain.functions.text import first_number, match_option

# Words that mean yes or no.
YES = ["yes", "y", "true", "1", "ja", "oui", "si", "agree", "i agree", "confirmed"]
NO = ["no", "n", "false", "0", "nein", "non", "disagree", "i do not agree"]


def as_boolean(x: Column) -> Column:
    """true, false, or null for words that mean neither."""
    t = F.lower(F.trim(x))
    return F.when(t.isin(YES) | t.rlike("^yes\\b"), True).when(t.isin(NO) | t.rlike("^no\\b"), False)


def boolean_option(x: Column, options: Column) -> Column:
    """The only option that means what the value means; null if none or several do."""
    b = as_boolean(x)
    same = F.filter(options, lambda o: as_boolean(o).eqNullSafe(b))
    return F.when(b.isNotNull() & (F.size(same) == 1), F.get(same, F.lit(0)))


def match_many(x: Column, options: Column) -> Column:
    """Options named by a comma-separated value, each once in the order named; null if none is."""
    hits = F.array_distinct(F.filter(F.transform(F.split(x, ","), lambda v: match_option(v, options)), lambda o: o.isNotNull()))
    return F.when(F.size(hits) > 0, hits)


def adapt(x: Column, field_type: Column, options: Column) -> Column:
    """The value as text for a field of the type: boolean, number, select, multi_select or free text."""
    yes_no = as_boolean(x)
    has = F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0
    return (
        F.when(field_type == "boolean", F.coalesce(boolean_option(x, options), F.when(yes_no, "Yes").when(~yes_no, "No")))
        .when(field_type == "number", first_number(x))
        .when((field_type == "multi_select") & has, F.array_join(match_many(x, options), ", "))
        .when(field_type.isin("select", "radio") & has, F.coalesce(match_option(x, options), boolean_option(x, options)))
        .otherwise(F.nullif(F.trim(x), F.lit("")))
    )
