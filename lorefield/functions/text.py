"""Column functions over Markdown and plain text, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def front_matter(text: Column) -> Column:
    """The block between the fences at the start, null without one (BOM and CRLF allowed)."""
    block = _block(text)
    return F.when(block != "", block)


def _block(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)^\\x{FEFF}?---\\r?\\n(.*?)\\r?\\n---(?:\\r?\\n|$)", 1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def body(text: Column) -> Column:
    """The text after its front matter, all of it without one."""
    return F.regexp_replace(text, "(?s)\\A\\x{FEFF}?---\\r?\\n.*?\\r?\\n---(?:\\r?\\n|\\z)", "")


def front_matter_map(text: Column) -> Column:
    """Keys and values of unindented ``key: value`` lines; quotes and trailing comments go, the last of equal keys stays."""
    rows = F.filter(F.split(F.coalesce(_block(text), F.lit("")), "\\r?\\n"), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*:"))
    pairs = F.transform(rows, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), scalar(x).alias("v")))
    later = lambda all_, i: F.slice(all_, i + 2, F.size(all_))
    # bound once: each look at the rows would cut them out of the whole text again
    return let(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda s, i: ~F.exists(later(all_, i), lambda other: other["k"] == s["k"]))))


def scalar(row: Column) -> Column:
    """The value of a ``key: value`` line without quotes and trailing comment."""
    value = F.regexp_replace(F.btrim(F.regexp_replace(row, "^[^:]*:", "")), " +#.*$", "")
    return F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2")


def field(text: Column, name: str) -> Column:
    """A front-matter style ``name: value`` anywhere in the text, the first one."""
    return F.btrim(F.regexp_extract(text, f"(?md)^{name}:[ \\t]*(.*)$", 1))


def detail(text: Column, label: str) -> Column:
    """The value of the first ``- Label: value`` line, whatever the case of the label."""
    return F.btrim(F.regexp_extract(text, f"(?imd)^[ \\t]*- {label}:[ \\t]*(.*)$", 1))


def title(text: Column, fallback: Column) -> Column:
    """The first level-one heading."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_extract(text, "(?md)^# (.+)$", 1)), F.lit("")), fallback)


def slug(text: Column) -> Column:
    """ASCII slug: other characters become single dashes."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def iso_date(text: Column) -> Column:
    """A date from ``2026-07-04`` or ``20260704``, null otherwise."""
    whole = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    compact = F.when(text.rlike("^[0-9]{8}$"), text)
    return F.coalesce(whole.try_cast("date"), F.try_to_date(compact, "yyyyMMdd"))


def percent(ratio: Column) -> Column:
    """A ratio in whole per cent, halves to even."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def pairs(xs: Column) -> Column:
    """All unordered pairs of an array, in its order."""
    return F.flatten(F.transform(xs, lambda x, i: F.transform(F.slice(xs, i + 2, F.greatest(F.size(xs) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("left"), y.alias("right")))))


def strip_fences(text: Column) -> Column:
    """Text without fenced blocks; the fence that opened one closes it."""
    return F.regexp_replace(text, "(?msd)^[ \\t]{0,3}(`{3,}|~{3,})[^\\n]*\\n.*?(?:^[ \\t]{0,3}\\1[ \\t]*(?:\\n|\\z)|\\z)", "")


def visible_html(html: Column) -> Column:
    """What a reader sees: no comments, scripts, styles or tags, white space as one blank."""
    bare = F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


# --------------------------------------------------------------------------
# scalars of notes: slugs, cells, lists, sections


def safe_slug(text: Column) -> Column:
    """A file name from a title; ``issue`` where nothing safe is left."""
    raw = F.btrim(text)
    unsafe = (raw == "") | raw.rlike(r"[/\\]|\.\.")
    slug = F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9._-]+", "-"), F.lit("-."))
    return F.when(unsafe | (slug == ""), "issue").otherwise(slug)


def table_cell(text: Column) -> Column:
    """A cell whose bare pipes cannot split it; absolute values become delimiters of their own."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    flat = F.regexp_replace(flat, r"\$\|([^|$]+)\|\$", r"\$\\lvert $1\\rvert\$")
    flat = F.regexp_replace(flat, r"(?<![\\|$])\|([A-Za-zΑ-Ωα-ωλΛ*][A-Za-z0-9Α-Ωα-ωλΛ*+\-−–]*)\|(?![\\|$\w])", r"\$\\lvert $1\\rvert\$")
    return F.regexp_replace(flat, r"(?<!\\)\|", r"\\|")


def yaml_scalar(value: Column) -> Column:
    """What a scalar says: up to its closing quote, or without a comment."""
    raw = F.btrim(value)
    quoted = F.regexp_extract(raw, r"""\A(["'])(.*?)\1""", 2)
    plain = F.btrim(F.btrim(F.get(F.split(raw, r"\s+#", 2), F.lit(0))), F.lit("\"'"))
    return F.when(raw.rlike(r"""\A(["']).*?\1"""), quoted).otherwise(plain)


def simple_list(value: Column) -> Column:
    """``[a, "b"]`` split at every comma, without quotes."""
    inner = F.regexp_extract(F.btrim(value), r"(?s)\A\[(.*)\]\z", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.btrim(F.btrim(F.btrim(x), F.lit('"')), F.lit("'")))
    return F.filter(items, lambda x: x != "")


def quoted_list(value: Column) -> Column:
    """The quoted items of ``[…]``, unescaped; where there are none, those between commas."""
    inner = F.btrim(F.regexp_extract(F.btrim(value), r"(?s)\A\[(.*)\]\z", 1))
    quoted = F.transform(F.regexp_extract_all(inner, F.lit(r'"((?:\\.|[^"])*)"'), F.lit(1)), lambda x: F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    plain = F.filter(F.transform(F.split(inner, ","), lambda x: F.btrim(F.btrim(x), F.lit('"'))), lambda x: x != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(plain)


def string_list(value: Column) -> Column:
    """A JSON list, or items between commas that no quotes hold, or a single item."""
    raw = F.btrim(value)
    listed = F.from_json(raw, "array<string>")
    items = F.transform(F.regexp_extract_all(F.regexp_extract(raw, r"(?s)\A\[(.*)\]\z", 1), F.lit("""(?:[^,"']|"[^"]*"|'[^']*')+"""), F.lit(0)), lambda x: F.btrim(x))
    bare = F.transform(F.filter(items, lambda x: x != ""), lambda x: F.when(x.rlike(r'\A".*"\z'), F.substring(x, F.lit(2), F.char_length(x) - 2)).otherwise(x))
    return F.when(raw == "", F.array().cast("array<string>")).when(raw.rlike(r"\A\[.*\]\z"), F.coalesce(listed, bare)).otherwise(F.array(F.btrim(raw, F.lit('"'))))


def note_section(text: Column, heading: str) -> Column:
    """The body of a ``## heading`` up to the next heading of that level."""
    found = F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"(?md)^[ \t]*## {heading}[ \t]*$\n?((?s:.*?))(?=^## |\z)", 1)
    return F.regexp_replace(found, r"(?U)\A\s+|\s+\z", "")


def replace_section(text: Column, heading: str, content: Column) -> Column:
    """Puts ``content`` below ``## heading``, in place of what stands there or at the end."""
    whole = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)\A\s+|\s+\z", "")
    block = F.concat(F.lit(f"## {heading}\n\n"), content, F.lit("\n"))
    found = F.regexp_extract(whole, rf"(?md)^[ \t]*## {heading}[ \t]*$(?s:.*?)(?=^## |\z)", 0)
    placed = F.overlay(whole, F.concat(block, F.lit("\n")), F.position(found, whole), F.char_length(found))
    added = F.when(whole == "", block).otherwise(F.concat(whole, F.lit("\n\n"), block))
    return F.concat(F.regexp_replace(F.when(found != "", placed).otherwise(added), r"(?U)\s+\z", ""), F.lit("\n"))


def decoded(target: Column) -> Column:
    """A link target without per-cent codes; a plus sign is one."""
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)


def strip_code(text: Column) -> Column:
    """Text without fenced blocks and code spans."""
    return F.regexp_replace(strip_fences(text), r"(?s)(`+).*?\1", "")


def release_notes(changelog: Column, version: Column) -> Column:
    """The body of a version's section; null for an unreleased, missing or empty one."""
    rows = F.split(F.replace(changelog, F.lit("\r\n"), F.lit("\n")), "\n")
    name = lambda v: F.lower(F.regexp_replace(F.btrim(v), r"^[vV](?=\d)", ""))
    head = r"^## \[([^\]]+)\](?:\s+-\s+.+)?\s*$"
    heads = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("at"), F.when(x.rlike(head), name(F.regexp_extract(x, head, 1))).alias("name"))), lambda h: h["name"].isNotNull())
    start = F.get(F.filter(heads, lambda h: h["name"] == name(version)), F.lit(0))["at"]
    end = F.coalesce(F.get(F.filter(heads, lambda h: h["at"] > start), F.lit(0))["at"], F.size(rows))
    held = F.regexp_replace(F.array_join(F.slice(rows, start + 2, end - start - 1), "\n"), r"\A\s+|\s+\z", "")
    return F.when((name(version) != "unreleased") & (held != ""), F.concat(held, F.lit("\n")))


def json_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def json_text(raw: Column) -> Column:
    """``title|body`` of JSON that is a string, or an object with a text ``body`` or ``text``; null otherwise."""
    v = F.try_parse_json(raw)
    part = lambda key: F.when(json_kind(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    body = F.coalesce(F.when(json_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), part("body"), part("text"))
    return F.concat(F.coalesce(part("title"), F.lit("")), F.lit("|"), body)
