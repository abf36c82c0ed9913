"""Gates over JSON records of a preparation pack, and the binding of annotations to papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

from .pages import codes

# Labels that records may bear.
CONFIDENCE = ["high", "medium", "low", "uncertain", "needs-review"]
REPEATS = ["unknown-pending-cross-paper-analysis", "original-repeat", "close-variant", "same-type", "unique", "needs-review"]
EARLY_REPEATS = ["unknown-pending-cross-paper-analysis", "needs-review"]
DOSSIER_LISTS = ["source_question_refs", "recognition_cues", "common_variants", "method_cards", "formula_cards", "pitfalls", "worked_example_candidates", "self_test_candidates"]
SOURCE_LISTS = ["source_priority", "textbook_refs", "lecture_refs", "assignment_refs", "paper_refs", "answer_refs", "high_quality_examples"]
WORKFLOW = "ai-first-exam-prep"
QUESTION_TOKEN = r"[\w.-]+\.json#[^\s,，;；)）\]}】、。\"]+"
MADE_UP = "自编题|模拟题|改编题|原创题"

CARD = "source string, confidence string, questions array<struct<question_id:string,id:string,prompt_summary:string,solution_summary:string,initial_type:string,type:string,evidence_refs:array<string>,evidence:array<string>,repeat_status:string>>"


def parsed(text: Column, schema: str) -> Column:
    """The record, null where the text is no JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def is_object(text: Column) -> Column:
    return is_json(text) & text.rlike(r"\A\s*\{")


def blank(value: Column) -> Column:
    return F.coalesce(F.btrim(value), F.lit("")) == ""


def slashes(value: Column) -> Column:
    return F.replace(value, F.lit("\\"), F.lit("/"))


def _first(q: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.btrim(q[n]), F.lit("")) for n in names), F.lit(""))


def card_codes(text: Column, sources: Column, stage: Column) -> Column:
    """Faults of one paper card; ``sources``: what the manifest lists."""
    card, ok = parsed(text, CARD), is_object(text)
    qs = F.coalesce(card["questions"], F.array().cast("array<struct<question_id:string,id:string,prompt_summary:string,solution_summary:string,initial_type:string,type:string,evidence_refs:array<string>,evidence:array<string>,repeat_status:string>>"))
    some = lambda test: ok & F.exists(qs, test)
    empty = lambda q, *names: _first(q, *names) == ""
    lacking = lambda q: F.coalesce(F.size(q["evidence_refs"]), F.lit(0)) + F.coalesce(F.size(q["evidence"]), F.lit(0)) <= 0
    repeat = lambda q: F.coalesce(F.btrim(q["repeat_status"]), F.lit(""))
    source = slashes(card["source"])
    return codes({
        "paper-card-invalid-json": ~is_json(text),
        "paper-card-not-object": is_json(text) & ~ok,
        "paper-card-missing-source": ok & blank(source),
        "paper-card-source-not-in-manifest": ok & ~blank(source) & ~F.array_contains(sources, source),
        "paper-card-invalid-confidence": ok & ~F.coalesce(F.btrim(card["confidence"]).isin(*CONFIDENCE), F.lit(False)),
        "paper-card-missing-questions": ok & (F.size(qs) == 0),
        "paper-card-question-missing-id": some(lambda q: empty(q, "question_id", "id")),
        "paper-card-question-missing-prompt-summary": some(lambda q: empty(q, "prompt_summary")),
        "paper-card-question-missing-solution-summary": some(lambda q: empty(q, "solution_summary")),
        "paper-card-question-missing-initial-type": some(lambda q: empty(q, "initial_type", "type")),
        "paper-card-question-missing-evidence": some(lacking),
        "paper-card-invalid-repeat-status": some(lambda q: ~repeat(q).isin(*REPEATS)),
        "paper-card-premature-repeat-claim": (stage == "paper-v0") & some(lambda q: repeat(q).isin(*REPEATS) & ~repeat(q).isin(*EARLY_REPEATS)),
    })


TAXONOMY = "workflow string, types array<struct<id:string,name:string,confidence:string,source_refs:array<string>,representative_questions:array<string>>>"


def taxonomy_codes(text: Column, cards: Column) -> Column:
    """Faults of a taxonomy of question types; ``cards``: names of the card files."""
    record, ok = parsed(text, TAXONOMY), is_object(text)
    kinds = F.coalesce(record["types"], F.array().cast("array<struct<id:string,name:string,confidence:string,source_refs:array<string>,representative_questions:array<string>>>"))
    refs = lambda t: F.coalesce(F.when(F.size(t["source_refs"]) > 0, t["source_refs"]), t["representative_questions"], F.array().cast("array<string>"))
    some = lambda test: ok & F.exists(kinds, test)
    foreign = lambda t: (F.size(refs(t)) > 0) & (F.size(cards) > 0) & ~F.exists(cards, lambda c: F.contains(F.array_join(refs(t), " "), c))
    return codes({
        "missing-taxonomy": text.isNull() | (text == ""),
        "taxonomy-not-object": (text != "") & ~ok,
        "taxonomy-workflow": ok & ~F.coalesce(record["workflow"] == WORKFLOW, F.lit(False)),
        "taxonomy-empty": ok & (F.size(kinds) == 0),
        "taxonomy-type-missing-field": some(lambda t: blank(t["id"]) | blank(t["name"]) | blank(t["confidence"])),
        "taxonomy-type-missing-source-refs": some(lambda t: F.size(refs(t)) == 0),
        "taxonomy-type-source-not-card": some(foreign),
    })


def source_map_codes(text: Column, sources: Column) -> Column:
    ok = is_object(text)
    listed = lambda name: F.coalesce(F.from_json(F.get_json_object(text, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    keys = F.coalesce(F.json_object_keys(F.when(ok, text)), F.array().cast("array<string>"))
    papers = F.transform(listed("paper_refs"), slashes)
    return codes({
        "missing-source-map": text.isNull() | (text == ""),
        "source-map-not-object": (text != "") & ~ok,
        "source-map-workflow": ok & ~F.coalesce(F.get_json_object(text, "$.workflow") == WORKFLOW, F.lit(False)),
        "source-map-missing-field": ok & (F.size(F.array_except(F.array(*map(F.lit, SOURCE_LISTS)), keys)) > 0),
        "source-map-missing-paper-ref": ok & (F.size(F.array_except(sources, papers)) > 0),
        "source-map-empty-textbook-refs": ok & ~F.exists(listed("textbook_refs"), lambda x: ~blank(x)),
    })


MANIFEST = "papers array<struct<id:string,path:string,canonical_problem_source:string,canonical_answer_source:string,all_sources:array<string>,source_roles:map<string,array<string>>,paper_card:string,deep_dive:string>>"


def manifest_sources(text: Column) -> Column:
    """All paths that the papers of a manifest name, sorted."""
    papers = F.coalesce(parsed(text, MANIFEST)["papers"], F.array().cast(MANIFEST.removeprefix("papers ")))
    own = lambda p: F.concat(F.array(p["path"], p["canonical_problem_source"], p["canonical_answer_source"]), F.coalesce(p["all_sources"], F.array().cast("array<string>")), F.flatten(F.coalesce(F.map_values(p["source_roles"]), F.array().cast("array<array<string>>"))))
    found = F.transform(F.array_compact(F.flatten(F.transform(papers, own))), slashes)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.btrim(x) != "")))


def manifest_codes(text: Column, files: Column) -> Column:
    """Faults of a manifest against the files there are."""
    papers = F.coalesce(parsed(text, MANIFEST)["papers"], F.array().cast(MANIFEST.removeprefix("papers ")))
    card = lambda p: F.coalesce(F.nullif(p["paper_card"], F.lit("")), F.concat(F.lit("paper-cards/"), F.coalesce(p["id"], F.lit("")), F.lit(".json")))
    dive = lambda p: F.coalesce(F.nullif(p["deep_dive"], F.lit("")), F.concat(F.lit("试卷精析/"), F.coalesce(p["id"], F.lit("")), F.lit(".md")))
    return codes({
        "missing-paper-card": F.exists(papers, lambda p: ~F.array_contains(files, card(p))),
        "missing-paper-deep-dive": F.exists(papers, lambda p: ~F.array_contains(files, dive(p))),
        "manifest-paper-missing-canonical-source-role": F.exists(papers, lambda p: blank(p["canonical_problem_source"]) | (F.coalesce(F.size(p["source_roles"]), F.lit(0)) <= 0)),
    })


def question_refs(text: Column, *names: str) -> Column:
    """References to questions of cards below the named fields, in order, however they are nested."""
    whole = F.concat_ws(" ", *(F.coalesce(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names))
    return F.regexp_extract_all(whole, F.lit(QUESTION_TOKEN), F.lit(0))


def dossier_codes(text: Column, type_id: Column, known_refs: Column) -> Column:
    """Faults of the dossier of one type; ``known_refs``: questions of the cards, as ``card.json#id``."""
    value = lambda n: F.get_json_object(text, f"$.{n}")
    empty = lambda n: F.coalesce(F.btrim(value(n)), F.lit("")).isin("", "[]", "{}", "null")
    needed = reduce(lambda a, b: a | b, (empty(n) for n in ["type_id", "type_name", "confidence", *DOSSIER_LISTS]))
    notes = empty("insufficient_evidence_notes") & (value("quality") == "needs-review")
    shown, tests = question_refs(text, "worked_example_candidates"), question_refs(text, "self_test_candidates")
    every = F.array_distinct(F.concat(question_refs(text, "source_question_refs"), shown, tests))
    ok = is_object(text)
    return codes({
        "type-dossier-invalid-json": ~is_json(text),
        "type-dossier-not-object": is_json(text) & ~ok,
        "type-dossier-missing-field": ok & (needed | F.coalesce(notes, F.lit(False))),
        "type-dossier-type-mismatch": ok & ~F.coalesce(F.btrim(value("type_id")) == type_id, F.lit(False)),
        "type-dossier-invalid-confidence": ok & ~F.coalesce(F.btrim(value("confidence")).isin(*CONFIDENCE), F.lit(False)),
        "type-dossier-unknown-question-ref": ok & (F.size(known_refs) > 0) & (F.size(F.array_except(every, known_refs)) > 0),
        "type-dossier-example-selftest-overlap": ok & F.arrays_overlap(shown, tests),
        "type-dossier-duplicate-worked-example": ok & (F.size(F.array_distinct(shown)) < F.size(shown)),
        "type-dossier-duplicate-self-test": ok & (F.size(F.array_distinct(tests)) < F.size(tests)),
        "type-dossier-fabricated-question": ok & text.rlike(MADE_UP),
    })


# What the codes of a check say about a pack.
FLAGS = {
    "mechanical_ok": ["render-risk", "markdown-table", "placeholder-content"],
    "source_ok": ["source", "ref", "card", "dossier", "taxonomy", "manifest"],
    "textbook_grounding_ok": ["textbook"],
    "problem_completeness_ok": ["problem", "solution", "answer", "too-thin"],
    "example_selftest_ok": ["example", "self-test", "worked"],
}


def check_flags(found: Column) -> dict[str, Column]:
    """Five flags from the codes of errors: the first asks for whole codes, the others for parts of them."""
    part = lambda names: ~F.exists(found, lambda c: reduce(lambda a, b: a | b, (F.contains(c, F.lit(n)) for n in names)))
    return {name: ~F.arrays_overlap(found, F.array(*map(F.lit, names))) if name == "mechanical_ok" else part(names) for name, names in FLAGS.items()}


# --------------------------------------------------------------------------
# binding annotations to papers


def normal_path(path: Column) -> Column:
    return F.regexp_replace(slashes(F.coalesce(path, F.lit(""))), r"\A(?:\./)+", "")


def _suffixes(path: Column) -> Column:
    """A path, and what is left of it below each of its folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def bind(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotations bound to papers in their order, each by the first of five rules that finds any.

    ``papers``: ``seq, stem, path, annotation`` (the declared file, or null); ``notes``:
    ``file, source``.  Exact file, file of that name, file named after the source's
    suffix, exact source, source that is a suffix of the path or the other way round.
    Two files by one rule are ambiguous.  A file is bound once: a paper that wants one that
    an earlier paper has gets an error by the first three rules, and does not see it by
    the last two.  A loose source that fits other papers too, but for those bound before, is
    bound to none.  So a binding may free another paper from ambiguity, or take its file.

    What a paper wants depends on earlier papers alone.  Rounds work it out for all papers
    at once from who had which file in the round before, until nothing changes; each is a
    few equi joins, and the first k papers of any chain are right after k rounds.  Rules by
    name are joins of base names; sources meet paths by their suffixes, so only pairs that
    fit become rows.

    Returns ``stem, file, tier, error``; a paper without any is not told.
    """
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    p = papers.select("seq", "stem", normal_path(F.col("path")).alias("path"), normal_path(F.coalesce(F.nullif("annotation", F.lit("")), F.concat(F.lit("annotations/"), "stem", F.lit(".json")))).alias("exact")).where("stem <> ''")
    n = notes.select("file", base(F.col("file")).alias("name"), normal_path(F.col("source")).alias("source"))
    named = F.array_distinct(F.array(base(F.col("exact")), F.concat("stem", F.lit(".json"))))
    alias = F.array(F.concat("stem", F.lit(".pdf.md.json")), F.concat("stem", F.lit(".md.json")))
    by_name = lambda names, tier: p.withColumn("name", F.explode(names)).join(n, "name").where("file <> exact").select("seq", "stem", "file", F.lit(tier).alias("tier")).distinct()
    tiers = [p.join(n, F.col("exact") == F.col("file")).select("seq", "stem", "file", F.lit(1).alias("tier")), by_name(named, 2), by_name(alias, 3)]
    found = reduce(DataFrame.union, tiers)
    fixed = found.groupBy("seq", "stem").agg(F.min("tier").alias("tier")).join(found, ["seq", "stem", "tier"]).groupBy("seq", "stem", "tier").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    fixed = materialise(fixed)
    sources, paths = n.where("source <> ''").select("file", "source"), p.where("path <> ''").select("seq", "stem", "path")
    fits = (
        paths.withColumn("source", F.explode(_suffixes(F.col("path")))).join(sources, "source")
        .unionByName(sources.withColumn("path", F.explode(_suffixes(F.col("source")))).join(paths, "path"))
        .select("seq", "stem", "file", (F.col("source") == F.col("path")).alias("same")).distinct()
    )
    fits = materialise(fits)
    open_ = materialise(fits.join(fixed, "seq", "left_anti"))
    wants = fixed.where("n = 1").select("seq", "stem", "file", "tier", F.lit(True).alias("sure"))
    while True:  # ends, as each round settles one paper more at least
        wants = materialise(wants)
        taken = wants.where("sure").groupBy("file").agg(F.min("seq").alias("by"))
        bound = wants.where("sure").join(taken, "file").where("seq = by").select(F.col("stem").alias("other"), F.col("seq").alias("other_seq"), F.lit(True).alias("is_bound"))
        free = open_.join(taken, "file", "left").where("by is null or by >= seq").drop("by")
        best = free.groupBy("seq", "stem").agg(F.count_if("same").alias("exact"), F.count("*").alias("n"), F.min_by("file", F.struct(~F.col("same"), "file")).alias("file"))
        chosen = best.select("seq", "stem", "file", F.when(F.col("exact") > 0, 4).otherwise(5).alias("tier"), (F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("n")) == 1).alias("one"))
        # a loose source must fit no other paper, but for those that an earlier binding has served
        loose = chosen.where("tier = 5 and one").select("seq", "stem", "file").join(fits.select("file", F.col("stem").alias("other")).distinct(), "file").where("other <> stem")
        shared = loose.join(bound, "other", "left").where("is_bound is null or other_seq >= seq").select("seq").distinct().withColumn("shared", F.lit(True))
        told = chosen.join(shared, "seq", "left").select("seq", "stem", "file", "tier", (F.col("one") & F.col("shared").isNull()).alias("sure"))
        now = fixed.where("n = 1").select("seq", "stem", "file", "tier", F.lit(True).alias("sure")).unionByName(told)
        same = now.exceptAll(wants).isEmpty() and wants.exceptAll(now).isEmpty()
        if same:
            break
        wants = now
    taken = wants.where("sure").groupBy("file").agg(F.min("seq").alias("by"))
    many = fixed.where("n > 1").select("seq", "stem", F.lit(None).cast("string").alias("file"), "tier", F.when(F.col("tier") == 2, "ambiguous_preferred_annotation").otherwise("ambiguous_annotation_fallback").alias("error"))
    late = wants.join(taken, "file", "left").select(
        "seq", "stem", "file", "tier",
        F.when(~F.col("sure"), F.when(F.col("tier") == 4, "ambiguous_annotation_fallback").otherwise("ambiguous_source_fallback")).when(F.col("by") != F.col("seq"), "annotation_already_bound").alias("error"),
    )
    return many.unionByName(late).select("stem", F.when(F.col("error").isNull(), F.col("file")).alias("file"), "tier", "error")
