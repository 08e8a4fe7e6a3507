"""Records that span lines, nested configurations and script strings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

_DATES = re.compile(
    r"[\s|,(–—-]*((?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+)?(?:19|20)\d{2})\s*(?:-|–|—|to)\s*((?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+)?(?:19|20)\d{2}|present|current|now)\)?\s*$",
    re.I,
)
_BULLET = re.compile(r"^\s*[-*•–]\s+")


def dated(line: str) -> tuple[str, str | None, str | None]:
    """The line without its date range at the end, and the range."""
    m = _DATES.search(line)
    return (line[: m.start()].strip(), m[1].strip(), m[2].strip()) if m else (line.strip(), None, None)


def entries(lines: list[str]) -> list[dict]:
    """Entries of a section: a line with a date range opens one, bullets belong to the last opened, an indented or lower-case line goes
    on with the last bullet, another line is the entry's second line."""
    out: list[dict] = []
    for raw in lines or []:
        if not raw or not raw.strip():
            continue
        head, start, end = dated(raw)
        if start is not None and not _BULLET.match(raw):
            out.append({"title": head, "detail": "", "start": start, "end": end, "bullets": []})
        elif not out:
            continue
        elif _BULLET.match(raw):
            out[-1]["bullets"].append(_BULLET.sub("", raw).strip())
        elif out[-1]["bullets"] and (raw[0] in " \t" or raw.strip()[0].islower()):
            out[-1]["bullets"][-1] += " " + raw.strip()
        elif not out[-1]["detail"]:
            out[-1]["detail"] = raw.strip()
    return out


def dated_entries(lines: Column) -> Column:
    """entries() of an array of lines."""

    @F.pandas_udf("array<struct<title:string,detail:string,start:string,end:string,bullets:array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: entries(list(x)) if x is not None else [])

    return run(lines)


def visible_nodes(config: str | None, kind: str = "field") -> list[str]:
    """JSON of all nodes of the kind in a configuration tree of any depth, in order; a hidden node hides what is under it."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, list):
            for v in x:
                walk(v)
        elif isinstance(x, dict):
            if x.get("hidden") is True or x.get("visible") is False:
                return
            if x.get("type") == kind or x.get("kind") == kind:
                out.append(json.dumps({k: v for k, v in x.items() if not isinstance(v, (dict, list))}, sort_keys=True))
            for v in x.values():
                walk(v)

    try:
        walk(json.loads(config or "null"))
    except ValueError:
        pass
    return out


def tree_fields(config: Column, kind: str = "field") -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: visible_nodes(x, kind))

    return run(config)


_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def script_string(s: str | None) -> str | None:
    """A script string literal's text, its escapes resolved."""
    return None if s is None else _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s)


def script_unescape(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(script_string)

    return run(x)
