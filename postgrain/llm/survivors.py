"""Best representative of each duplicate group, field by field.

Records are ranked by completeness, trust and recency with window ordering, the smallest record id breaking ties:

* description: whole texts only, the last fetched first;
* address: usable addresses only, lowest tier first, then the last fetched;
* channel: stated channels only, lowest tier first, then the last fetched.

A description is whole if it is no placeholder and no mere headline (under ``min_words`` words), has no sign of being cut
(``Read more``, dots, another page's list of jobs), ends as a sentence ends, and has at least ``whole_share`` of the words of
the longest such text of its group: a text cut at a sentence's end can only be told beside the others.

Ranking takes two windows. The first keeps the top record for each (group, field, word count, tier); Spark keeps
the top of each map task before the shuffle, so a group that holds a third of all rows leaves a few rows a task. The
second sees a group's survivors only, as many as there are word counts and tiers, never the whole group. Texts are
not shuffled; the values are fetched for the survivors alone.

Defined results: rows with a null group key belong to no group; a null record id or time sorts last; a group without
a usable value has null in that field; sources that the registry doesn't know come after all tiers; records delivered
twice count twice in ``n_records`` and leave the same survivor. Only the named columns are read, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Texts and channels that say nothing.
NO_TEXT = r"^(?:null|none|nan|n/?a|tbd|tba|-+|\.+|as discussed|not available|description not available|no description.*|see job page.*|click apply.*)$"
NO_CHANNEL = ["", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "not stated", "tbd", "?"]
CUT_MARK = r"(?:\.\.\.|…|\[\.\.\.\]|\[…\])\s*\]?\s*(?:\(?(?:read|show|see|view) (?:more|full.*)\)?\.?)?\s*$|(?:read|show|see) more\s*$|similar (?:jobs|roles|postings) on "
DEAD_PATH = r"^(?:login|log-in|signin|sign-in|sign_in|auth|sso|register|account|404|403|410|500|error|not-?found|oops|expired|home|index(?:\.html?)?|search)(?:[/?.#]|$)"


def words(text: Column) -> Column:
    """Number of words split at white space; 0 for null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def seems_whole(text: Column, n_words: Column, min_words: int) -> Column:
    """Whether the text by itself may be whole."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (n_words >= min_words) & ~t.rlike(NO_TEXT) & ~t.rlike(CUT_MARK) & F.regexp_replace(t, r"\s+$", "").rlike(r"[.!?。।)\"'»”]$")


def usable_address(url: Column) -> Column:
    """Whether the address leads to an application: mail, or a web page that is no start, sign-in or error page."""
    u = F.trim(F.coalesce(url, F.lit("")))
    mail = u.rlike(r"(?i)^mailto:[^@\s]+@[^@\s]+\.[^@\s]+$")
    path = F.lower(F.regexp_extract(u, r"(?i)^https?://[^/?#\s]+\.[^/?#\s]+/+([^#\s]+)", 1))
    return mail | ((path != "") & ~path.rlike(DEAD_PATH) & ~path.rlike(r"^\?") & ~path.rlike(r"/(?:login|signin|sign-in|404|error)(?:[/?.]|$)"))


def stated_channel(channel: Column) -> Column:
    """Whether the channel is stated."""
    return ~F.lower(F.trim(F.coalesce(channel, F.lit("")))).isin(NO_CHANNEL)


def best_of_groups(
    records: DataFrame,
    registry: DataFrame,
    *,
    group: str = "posting_key",
    record: str = "capture_id",
    source: str = "source",
    time: str = "fetched_at",
    description: str = "description_text",
    address: str = "application_url",
    channel: str = "apply_channel",
    min_words: int = 30,
    whole_share: float = 0.65,
) -> DataFrame:
    """grp, n_records, and for description, address and channel the record id whose value survives (null: none usable)."""
    reg = registry.select(F.col("source").alias("r_source"), F.col("tier").alias("r_tier")).groupBy("r_source").agg(F.min("r_tier").alias("r_tier"))
    r = records.where(F.col(group).isNotNull()).select(
        F.col(group).alias("grp"), F.col(record).alias("rec"), F.col(source).alias("src"), F.col(time).alias("ts"),
        words(F.col(description)).alias("nw"), F.col(description).alias("d"), F.col(address).alias("u"), F.col(channel).alias("c"),
    )
    r = r.join(reg, F.col("src") == F.col("r_source"), "left").withColumn("tier", F.coalesce("r_tier", F.lit(1_000_000)))
    counts = r.groupBy("grp").agg(F.count("*").alias("n_records"))
    long = r.select(
        "grp", "rec", "ts",
        F.explode(F.array(
            F.struct(F.lit("d").alias("field"), seems_whole(F.col("d"), F.col("nw"), min_words).alias("ok"), F.col("nw").alias("size"), F.lit(0).alias("tier")),
            F.struct(F.lit("u").alias("field"), usable_address(F.col("u")).alias("ok"), F.lit(0).alias("size"), F.col("tier").alias("tier")),
            F.struct(F.lit("c").alias("field"), stated_channel(F.col("c")).alias("ok"), F.lit(0).alias("size"), F.col("tier").alias("tier")),
        )).alias("x"),
    ).where("x.ok").select("grp", "rec", "ts", "x.field", "x.size", "x.tier")
    order = [F.col("ts").desc_nulls_last(), F.col("rec").asc_nulls_last()]
    first = Window.partitionBy("grp", "field", "size", "tier").orderBy(*order)
    top = long.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    group_w = Window.partitionBy("grp", "field")
    top = top.withColumn("most", F.max("size").over(group_w)).where(F.col("size") >= whole_share * F.col("most"))
    best = top.withColumn("rn", F.row_number().over(group_w.orderBy(F.col("tier").asc(), *order))).where("rn = 1")
    wide = best.groupBy("grp").agg(*[F.max(F.when(F.col("field") == f, F.col("rec"))).alias(n) for f, n in (("d", "description_rec"), ("u", "url_rec"), ("c", "channel_rec"))])
    return counts.join(wide, "grp", "left")


def surviving_records(records: DataFrame, best: DataFrame, *, record: str = "capture_id", description: str = "description_text", address: str = "application_url", channel: str = "apply_channel") -> DataFrame:
    """The built record of each group: grp, n_records and the three surviving values, fetched by record id."""
    need = best.select("grp", F.explode(F.array(
        F.struct(F.lit("d").alias("field"), F.col("description_rec").alias("rec")),
        F.struct(F.lit("u").alias("field"), F.col("url_rec").alias("rec")),
        F.struct(F.lit("c").alias("field"), F.col("channel_rec").alias("rec")),
    )).alias("x")).select("grp", "x.field", "x.rec").where("rec is not null")
    v = records.select(F.col(record).alias("v_rec"), F.col(description).alias("vd"), F.col(address).alias("vu"), F.col(channel).alias("vc"))
    got = need.join(v, F.col("rec") == F.col("v_rec"))
    values = got.groupBy("grp").agg(
        F.max(F.when(F.col("field") == "d", F.col("vd"))).alias("description_text"),
        F.max(F.when(F.col("field") == "u", F.col("vu"))).alias("application_url"),
        F.max(F.when(F.col("field") == "c", F.trim("vc"))).alias("apply_channel"),
    )
    return best.select("grp", "n_records").join(values, "grp", "left")
