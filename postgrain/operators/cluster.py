"""Clusters of question labels: the ordered rules of ``functions.labels`` first, equal labels next, then leaders at a Jaccard similarity.

Leader clustering depends on its order: groups by size (ties by first row), each joining the first leader that is similar enough. It is
done within blocks of labels that share their rarest token with some leader candidate, which leaves its result as it is: two
labels at Jaccard ``t`` share a token of each one's prefix of the rarest ``n - ceil(t n) + 1`` tokens.

A label's leader depends only on labels similar to it, on their leaders, and so on: on its connected component in the graph of
similar labels. So up to ``max_labels`` distinct labels take one pass in one task, and more are cut into components by a prefix-filtered
similarity join, each of which is a pass of its own; the result is the same.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postgrain.functions import labels as lb


def leaders(groups: list[tuple[str, int, int]], threshold: float) -> dict[str, str]:
    """label to leader, for (label, size, first row)."""
    order = sorted(groups, key=lambda g: (-g[1], g[2]))
    sets = {g[0]: frozenset(g[0].split()) for g in order}
    df: dict[str, int] = defaultdict(int)
    for s in sets.values():
        for w in s:
            df[w] += 1
    at: dict[str, list[int]] = defaultdict(list)
    heads: list[str] = []
    out = {}
    for label, _, _ in order:
        s = sets[label]
        words = sorted(s, key=lambda w: (df[w], w))
        prefix = words[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]
        found = None
        for h in sorted({h for w in prefix for h in at[w]}):
            o = sets[heads[h]]
            if s and len(s & o) >= threshold * len(s | o) - 1e-9:
                found = h
                break
        if found is None:
            found = len(heads)
            heads.append(label)
            for w in prefix:
                at[w].append(found)
        out[label] = heads[found]
    return out


def similar_labels(g: DataFrame, threshold: float) -> DataFrame:
    """a, b: labels (column ``label``, distinct) at the threshold or more, both ways."""
    t = g.select("label", F.array_remove(F.array_distinct(F.split(F.trim("label"), r"\s+")), "").alias("ts")).where(F.size("ts") > 0)
    e = t.select("label", F.explode("ts").alias("w"))
    df = e.groupBy("w").agg(F.count("*").alias("df"))
    ordered = e.join(df, "w").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("ts"))
    size = F.size("ts")
    prefix = F.slice("ts", 1, (size - F.ceil(threshold * size - 1e-9) + 1).cast("int"))
    p = ordered.select("label", "ts", F.explode(prefix).alias("w"))
    q = p.select(F.col("label").alias("other"), F.col("ts").alias("ots"), "w")
    met = p.join(q, "w").where((F.col("label") < F.col("other")) & (F.least(F.size("ts"), F.size("ots")) >= threshold * F.greatest(F.size("ts"), F.size("ots")) - 1e-9))
    common = F.size(F.array_intersect("ts", "ots"))
    met = met.where(common >= threshold * (F.size("ts") + F.size("ots") - common) - 1e-9).select(F.col("label").alias("a"), F.col("other").alias("b")).distinct()
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, part (the least label of its connected component): least labels travel along edges and jump to the least label's own, until nothing changes."""
    from postgrain.session import checkpointed

    edges = checkpointed(edges)
    part = checkpointed(nodes.select("label", F.col("label").alias("part")))
    while True:
        near = edges.join(part.select(F.col("label").alias("b"), "part"), "b").groupBy(F.col("a").alias("label")).agg(F.min("part").alias("near"))
        low = part.join(near, "label", "left").select("label", "part", F.least("part", "near").alias("low"))
        jump = part.select(F.col("label").alias("low"), F.col("part").alias("far"))
        new = checkpointed(low.join(jump, "low").select("label", F.least("low", "far").alias("part"), (F.least("low", "far") != F.col("part")).alias("changed")))
        part = new.select("label", "part")
        if new.where("changed").isEmpty():
            return part


def assigned(g: DataFrame, threshold: float, max_labels: int) -> DataFrame:
    """label, leader of distinct labels (label, n, first)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = leaders(list(pdf[["label", "n", "first"]].itertuples(index=False, name=None)), threshold)
        return pd.DataFrame({"label": pdf["label"], "leader": pdf["label"].map(m)})

    parts = g.withColumn("part", F.lit("")) if g.limit(max_labels + 1).count() <= max_labels else g.join(components(g, similar_labels(g, threshold)), "label")
    return parts.groupBy("part").applyInPandas(run, "label string, leader string")


def leader_clusters(labels: DataFrame, *, label: str, row: str, threshold: float = 0.8, max_labels: int = 200_000) -> DataFrame:
    """label, cluster, n: distinct labels with their leader."""
    g = labels.where(F.col(label).isNotNull() & (F.trim(F.col(label)) != "")).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    return g.join(assigned(g, threshold, max_labels), "label").select("label", F.col("leader").alias("cluster"), "n")


def question_clusters(rows: DataFrame, *, label: str, raw: str, kind: str, row: str, threshold: float = 0.8, max_labels: int = 200_000, minority: float = 0.1) -> DataFrame:
    """label, cluster, how, n, reasons: the ordered rules first, then equal labels ('exact') and leaders ('similarity') of the rest.

    ``cluster`` is the rule's key, or custom.<first words of the leader> with '_' added where an earlier cluster has it. ``reasons`` tell
    why a cluster is to be reviewed: merged by overlap, claimed by a broad rule, kinds of answer that differ with at least ``minority``
    each, more than one country. Null labels count as empty ones, which are one cluster."""
    x = F.coalesce(F.col(label), F.lit("")).alias("label")
    from postgrain.session import checkpointed

    g = rows.groupBy(x, F.col(raw).alias("raw"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    g = checkpointed(g)
    each = checkpointed(g.groupBy("label").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("rule", lb.rule_key(F.col("label"))))

    free = each.where("rule is null").select("label", "n", "first")
    led = checkpointed(free.join(assigned(free, threshold, max_labels), "label"))
    heads = led.groupBy("leader").agg(F.count("*").alias("members"), F.max(F.when(F.col("label") == F.col("leader"), F.struct("n", "first"))).alias("at"))
    said = F.substring(F.array_join(F.slice(F.filter(F.split("leader", r"\s+"), lambda w: w != ""), 1, 6), "_"), 1, 60)
    heads = heads.withColumn("base", F.concat(F.lit("custom."), F.coalesce(F.nullif(said, F.lit("")), F.lit("unlabelled"))))
    w = Window.partitionBy("base").orderBy(F.desc("at.n"), F.asc("at.first"))  # leaders of one beginning: few
    heads = heads.select("leader", "members", F.concat("base", F.repeat(F.lit("_"), F.row_number().over(w) - 1)).alias("cluster"))
    loose = led.join(heads, "leader").select("label", "cluster", F.when(F.col("members") > 1, "similarity").otherwise("exact").alias("how"), F.lit(False).alias("broad"), "n")
    ruled = each.where("rule is not null").select("label", F.col("rule.key").alias("cluster"), F.lit("rule").alias("how"), F.col("rule.broad").alias("broad"), "n")
    named = ruled.unionByName(loose)

    full = g.join(named.select("label", "cluster"), "label")
    families = full.groupBy("cluster", lb.family(F.col("kind")).alias("family")).agg(F.sum("n").alias("n")).groupBy("cluster").agg(F.min("n").alias("least"), F.sum("n").alias("all"), F.count("*").alias("families"), F.array_sort(F.collect_list(F.concat_ws(" ", "family", "n"))).alias("kinds"))
    raws = full.groupBy("cluster").agg(F.countDistinct(F.coalesce("raw", F.lit(""))).alias("phrasings"))
    seen = named.withColumn("c", F.explode_outer(lb.countries_in(F.col("label")))).groupBy("cluster").agg(F.first("how").alias("h"), F.first("broad").alias("b"), F.countDistinct("label").alias("labels"), F.array_sort(F.collect_set("c")).alias("countries"))
    reasons = F.array_compact(F.array(
        F.when(F.col("h") == "similarity", F.format_string("merged %d different phrasings by word overlap", "phrasings")),
        F.when(F.col("b") & (F.col("labels") > 1), "claimed by a broad rule; check every phrasing belongs"),
        F.when((F.col("families") > 1) & (F.col("least") >= F.col("all") * minority), F.concat(F.lit("answer kinds differ: "), F.array_join("kinds", ", "))),
        F.when(F.size("countries") > 1, F.concat(F.lit("phrasings name different countries: "), F.array_join("countries", ", "))),
    ))
    why = seen.join(raws, "cluster").join(families, "cluster").select("cluster", reasons.alias("reasons"))
    return named.join(why, "cluster").select("label", "cluster", "how", "n", "reasons")
