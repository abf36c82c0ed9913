"""Lookups by one of several keys, by selector, and of errors that repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids that may name a state file, selectors of lines.
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
LINES = r"\A(?:line|lines)[-: ](\d+)(?:\s*(?:-|\.\.)\s*(\d+))?\z"


def find_items(requests: DataFrame, items: DataFrame, root: Column) -> DataFrame:
    """Queue items by id, path or relative path: ``request, key, item, state``.

    ``requests``: ``request, key``; ``items``: ``id, path, relative_path``.  The three ways
    are equi joins over one exploded column of names, so no pair that does not match is
    looked at.  A request that several items answer is ambiguous and gets none; an item with
    an unsafe id, or outside ``root``, is told and not given.
    """
    names = F.array_distinct(F.array_compact(F.array("id", "path", "relative_path")))
    named = items.select(F.explode(names).alias("key"), "id", "path")
    held = requests.join(named, "key", "left").groupBy("request", "key").agg(F.count("path").alias("n"), F.min(F.struct("id", "path")).alias("item"))
    path = F.col("item.path")
    inside = F.startswith(path, F.concat(root, F.lit("/"))) & F.lower(path).endswith(".md") & ~F.contains(path, F.lit("/../"))
    state = (
        F.when(F.col("n") == 0, "not-found").when(F.col("n") > 1, "ambiguous").when(~F.coalesce(F.col("item.id").rlike(SAFE_ID), F.lit(False)), "unsafe-id")
        .when(~F.coalesce(inside, F.lit(False)), "outside-root").otherwise("found")
    )
    return held.select("request", "key", F.when(state == "found", F.col("item.id")).alias("item"), state.alias("state"))


def select_sections(sections: DataFrame, selectors: DataFrame) -> DataFrame:
    """Sections or lines that selectors name: ``doc_id, selector, kind, start_line, end_line, met``.

    ``sections``: ``doc_id, section_id, start_line, end_line``; ``selectors``: ``doc_id,
    selector``.  A selector is a section's id, else ``line 5`` or ``lines 3-9``; each is
    answered once, and unknown ones are told.  ``met`` counts the sections that the lines
    meet: a range join within a document, by its id first.
    """
    asked = selectors.select("doc_id", F.btrim("selector").alias("selector")).distinct()
    by_id = asked.join(sections, (asked.doc_id == sections.doc_id) & (F.col("selector") == F.col("section_id")), "left").select(asked.doc_id, "selector", "section_id", "start_line", "end_line")
    first = F.regexp_extract("selector", LINES, 1)
    last = F.coalesce(F.nullif(F.regexp_extract("selector", LINES, 2), F.lit("")), first)
    is_range = F.col("section_id").isNull() & (first != "")
    kind = F.when(F.col("section_id").isNotNull(), "section").when(is_range, "lines").otherwise("unknown")
    told = by_id.select("doc_id", "selector", kind.alias("kind"), F.when(is_range, first.cast("int")).otherwise(F.col("start_line")).alias("start_line"), F.when(is_range, last.cast("int")).otherwise(F.col("end_line")).alias("end_line"))
    other = sections.select(F.col("doc_id").alias("d"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    meets = (F.col("doc_id") == F.col("d")) & (F.col("kind") != "unknown") & (F.col("start_line") <= F.col("b")) & (F.col("end_line") >= F.col("a"))
    return told.join(other, meets, "left").groupBy("doc_id", "selector", "kind", "start_line", "end_line").agg(F.count("d").alias("met"))


def compare_errors(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, new, cleared, unchanged``: errors before and after as multisets, where the k-th of a key meets the k-th.

    Counts say as much as numbered rows would, so each side is aggregated before they meet,
    and a key with a third of all errors is one row.
    """
    sides = [side.groupBy(key).agg(F.count("*").alias(name)) for side, name in ((before, "b"), (after, "a"))]
    b, a = (F.coalesce(c, F.lit(0)) for c in ("b", "a"))
    both = reduce(lambda x, y: x.join(y, key, "full_outer"), sides)
    return both.select(key, F.greatest(a - b, F.lit(0)).alias("new"), F.greatest(b - a, F.lit(0)).alias("cleared"), F.least(a, b).alias("unchanged"))
