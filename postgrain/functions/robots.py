"""robots.txt: parsing to rules, and which rule holds for a path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RULES = "array<struct<agent:string,allow:boolean,path:string>>"


def parse(text: str | None) -> list[dict]:
    """Rules of all groups; consecutive agent lines share the rules that follow."""
    out, agents, open_ = [], [], False
    for line in (text or "").splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents = [value.lower()] if open_ or not agents else [*agents, value.lower()]
            open_ = False
        elif name in ("allow", "disallow") and agents:
            open_ = True
            if value:
                out += [{"agent": a, "allow": name == "allow", "path": value} for a in agents]
    return out


def rules_of(text: Column) -> Column:
    @F.pandas_udf(RULES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(parse)

    return run(text)


def path_pattern(path: Column) -> Column:
    """The rule's path as an anchored pattern: * is anything, a final $ the end."""
    escaped = F.regexp_replace(path, r"([.^+?{}\[\]\\|()$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.replace(escaped, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))


def allowed(pages: DataFrame, rules: DataFrame, *, key: str, host: str, path: str, agent: str) -> DataFrame:
    """key, allowed: the agent's own group where the host has one, else that of '*'; the longest matching rule holds, Allow on a tie;
    no rule allows. ``rules``: host, agent, allow, path."""
    mine = F.lit(agent.lower()).contains(F.col("agent"))
    r = rules.withColumn("own", mine.cast("int")).where(mine | (F.col("agent") == "*"))
    best = r.groupBy("host").agg(F.max("own").alias("best"))
    r = r.join(best, "host").where("own = best").select(F.col("host").alias("r_host"), "allow", F.length("path").alias("len"), path_pattern(F.col("path")).alias("pattern"))
    p = pages.select(F.col(key).alias("key"), F.col(host).alias("h"), F.col(path).alias("p"))
    hit = p.join(r, (F.col("h") == F.col("r_host")) & F.rlike(F.col("p"), F.col("pattern")))
    held = hit.groupBy("key").agg(F.max_by("allow", F.struct("len", "allow")).alias("allow"))
    return p.join(held, "key", "left").select("key", F.coalesce("allow", F.lit(True)).alias("allowed"))
