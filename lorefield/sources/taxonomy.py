"""Taxonomies in YAML: the shapes that the usual writers give, read without a YAML library."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.python import per_value

LISTS = ("aliases", "keywords")
ENTRY = re.compile(r"^(\s*)(- +)?(?:([A-Za-z_][\w-]*)\s*:(?:\s+|$))?(.*?)\s*$")


def _scalar(raw: str):
    try:
        return json.loads(raw)
    except json.JSONDecodeError:
        return raw


def _items(raw: str) -> list[str]:
    """A flow list, with items quoted or not, or a single item."""
    value = _scalar(raw)
    if isinstance(value, list):
        return [str(v) for v in value]
    if raw.startswith("[") and raw.endswith("]"):
        parts = re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", raw[1:-1])
        return [str(_scalar(p.strip())) for p in parts if p.strip()]
    return [str(value)] if raw else []


def read_taxonomy(text: str) -> str | None:
    """The taxonomy as JSON: ``version, course, exam_scope, types`` with ``id, name, aliases, keywords``; null where a type lacks its id.

    A key decides by its place: at the margin it belongs to the taxonomy, below a dash
    to the type that the dash began, and a dash deeper than that is an item of the list
    whose key stood last.
    """
    whole: dict = {"version": 1, "course": "", "exam_scope": "", "types": []}
    dash, into = -1, None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, mark, key, rest = ENTRY.match(line.expandtabs(2)).groups()
        at = len(indent)
        if mark is None and at == 0:
            dash, into = (-1, None) if key == "types" else (-2, None)
            if key in ("version", "course", "exam_scope"):
                whole[key] = _scalar(rest)
            continue
        if dash == -2:  # below a key that is not known
            continue
        own = whole["types"][-1] if whole["types"] else None
        if mark and own is not None and into and at > dash:
            own[into].append(str(_scalar(f"{key}: {rest}" if key else rest)))
            continue
        if mark:
            own = {"id": "", "name": "", "aliases": [], "keywords": []}
            whole["types"].append(own)
            dash, into = at, None
        if own is None or key is None or (not mark and at <= dash):
            continue
        into = key if key in LISTS and rest in ("", "|", ">") else None
        if key in LISTS:
            own[key] = [] if into else _items(rest)
        elif key in ("id", "name"):
            own[key] = str(_scalar(rest)).strip()
    if any(not t["id"] for t in whole["types"]):
        return None
    version = whole["version"]
    whole |= {"version": version if isinstance(version, int) else 1, "course": str(whole["course"]), "exam_scope": str(whole["exam_scope"])}
    whole["types"] = [t | {"name": t["name"] or t["id"]} for t in whole["types"]]
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


taxonomy_json = per_value(read_taxonomy)

SCHEMA = "version int, course string, exam_scope string, types array<struct<id:string,name:string,aliases:array<string>,keywords:array<string>>>"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def taxonomy_yaml(record: Column) -> Column:
    """The text of a taxonomy, lists in one line each."""
    listed = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(xs, F.array().cast("array<string>")), _quoted), ", "), F.lit("]"))
    kind = lambda t: F.concat_ws("\n", F.concat(F.lit("  - id: "), _quoted(t["id"])), F.concat(F.lit("    name: "), _quoted(F.coalesce(F.nullif(t["name"], F.lit("")), t["id"]))), F.concat(F.lit("    aliases: "), listed(t["aliases"])), F.concat(F.lit("    keywords: "), listed(t["keywords"])))
    head = [F.concat(F.lit("version: "), F.coalesce(record["version"], F.lit(1)).cast("string")), F.concat(F.lit("course: "), _quoted(F.coalesce(record["course"], F.lit("")))), F.concat(F.lit("exam_scope: "), _quoted(F.coalesce(record["exam_scope"], F.lit("")))), F.lit("types:")]
    return F.concat(F.array_join(F.concat(F.array(*head), F.transform(record["types"], kind)), "\n"), F.lit("\n"))
