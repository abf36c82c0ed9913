"""Review of proposals: one for each document, over its whole text, sound or with one fault."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import proposals as Q
from ..sources.tables import dealt_table
from .cases import sql_literal
from .registry import register

ROOT = "/vault"
SHA = lambda c: F.sha2(c, 256)

#: What is changed in a sound proposal, by name, and the codes that follow.  Names in capitals are columns.
FAULTS: list[tuple[dict[str, object], list[str]]] = [
    ({}, []),
    ({"target": None}, ["proposal-target-missing"]),
    ({"proposal-schema": ""}, ["proposal-schema-missing"]),
    ({"evidence-mode": "guess"}, ["proposal-evidence-mode-invalid", "proposal-evidence-mode-mismatch"]),
    ({"model-capability": "all"}, ["proposal-model-capability-invalid"]),
    ({"changed-sections": ""}, ["proposal-changed-sections-missing"]),
    ({"remaining-risks": ""}, ["proposal-remaining-risks-missing"]),
    ({"note": "see a/notes.fixed"}, ["proposal-derived-from-scratch-fix"]),
    ({"case-json": ""}, ["proposal-case-json-missing"]),
    ({"case-json": "/vault/.state/none.json"}, ["proposal-case-json-unavailable"]),
    ({"case_path": "OUTSIDE"}, ["proposal-case-json-outside-vault"]),
    ({"payload": "{no json"}, ["proposal-case-json-invalid"]),
    ({"payload": "[1]"}, ["proposal-case-json-top-level-invalid"]),
    ({"case_schema": "9"}, ["proposal-case-schema-invalid"]),
    ({"case_ok": False}, ["proposal-case-not-ok"]),
    ({"case-sha256": ""}, ["proposal-case-sha256-missing"]),
    ({"stored": "0"}, ["proposal-case-hash-mismatch"]),
    ({"case-sha256": "0", "stored": "0"}, ["proposal-case-stale"]),
    ({"item": None}, ["proposal-case-queue-item-missing"]),
    ({"recommended": ""}, ["proposal-case-queue-item-incomplete"]),
    ({"blocked": None}, ["proposal-case-queue-item-incomplete"]),
    ({"evidence-sha256": ""}, ["proposal-evidence-sha256-missing"]),
    ({"evidence": "[]"}, ["proposal-evidence-mode-mismatch", "proposal-evidence-payload-invalid", "proposal-evidence-schema-invalid", "proposal-evidence-stale"]),
    ({"evidence_schema": "9"}, ["proposal-evidence-schema-invalid"]),
    ({"evidence_stored": "0"}, ["proposal-evidence-hash-mismatch"]),
    ({"evidence-sha256": "0", "evidence_stored": "0"}, ["proposal-evidence-stale"]),
    ({"mode": "vision-assisted", "evidence-mode": "vision-assisted"}, ["vision-evidence-unavailable", "vision-model-capability-required"]),
    ({"mode": "vision-assisted", "evidence-mode": "vision-assisted", "model-capability": "vision", "vision": "PAGE"}, []),
    ({"mode": "vision-assisted", "evidence-mode": "vision-assisted", "model-capability": "vision", "vision": "STALE"}, ["vision-evidence-page-missing"]),
    ({"mode": "ocr-assisted", "evidence-mode": "ocr-assisted"}, ["ocr-evidence-unavailable"]),
    ({"mode": "ocr-assisted", "evidence-mode": "ocr-assisted", "ocr": "OCR"}, []),
    ({"AFTER": ("repair_status: raw", "verify_status: verified")}, ["ai-claimed-verification"]),
    ({"AFTER": ("repair_status: raw", "repair_status: human-verified")}, ["ai-claimed-human-repair"]),
    ({"target": "OTHER"}, ["proposal-case-target-mismatch", "proposal-target-outside-vault"]),
    ({"single": True, "AFTER": ("second words", "Second words")}, ["proposal-full-replacement-for-single-section", "proposal-scope-widened-without-authorization"]),
    ({"single": True}, ["proposal-full-replacement-for-single-section"]),
    ({"single": True, "AFTER": ("second words", "Second words"), "repair-scope": "widened"}, []),
    ({"AFTER": ("source_file: ", "other: ")}, ["source-file-dropped"]),
    ({"AFTER": ("source_file: ", "source_file: x")}, ["source-file-changed"]),
    ({"AFTER": ("source_file: src", "source_file: \\u0073rc")}, ["remaining-unicode-escape"]),
    ({"AFTER": ("derived_from_import: ", "other: ")}, ["derived-from-import-dropped"]),
    ({"AFTER": ("derived_from_import: ", "derived_from_import: x")}, ["derived-from-import-changed"]),
    ({"target-sha256": ""}, ["proposal-target-sha256-missing"]),
    ({"target-sha256": "0"}, ["proposal-target-stale"]),
    ({"item_schema": "9"}, ["proposal-queue-item-schema-invalid"]),
    ({"item_path": "/vault/x.md"}, ["proposal-case-target-mismatch"]),
    ({"item_sha": "0"}, ["proposal-case-target-stale"]),
    ({"target": "/vault/none.md"}, ["proposal-target-missing-file"]),
    ({"blocked": "requires-vision-evidence"}, ["text-model-blocked-by-vision-risk", "text-only-cannot-resolve-vision-risk"]),
    ({"recommended": "vision-assisted"}, ["text-only-cannot-resolve-vision-risk"]),
    ({"AFTER": ("\n\n2. second", "\n2. second")}, ["markdown-paragraph-boundary-regression"]),
    ({"AFTER": ("2. second", "9. second")}, ["question-number-missing"]),
    ({"AFTER": ("2. second", "second")}, ["question-number-count-decreased", "question-number-missing"]),
    ({"AFTER": ("first words", "first words \\begin{cases}")}, ["latex-environment-unbalanced"]),
    ({"AFTER": ("first words", "$ x = 1 $")}, ["remaining-inline-math-delimiter-space"]),
    ({"SHORT": True}, ["replacement-body-erased"]),
    ({"SPANS": [[13, 13, None, "1. First words"]]}, []),
    ({"SPANS": [[13, 13, "0", "1. First words"]]}, ["proposal-marker-invalid"]),
    ({"SPANS": [[11, 13, None, "x"], [13, 14, None, "y"]]}, ["proposal-marker-invalid"]),
    ({"SPANS": [[13, 13, None, "1. First words"]], "single": True}, []),
]


def proposals(spark, sf_dir):
    """Proposals, cases and files of the documents."""
    docs = dealt_table(spark, sf_dir, "documents", "doc_id", once=True)  # the three tables are made of it, and each is read more than once
    k = F.pmod("doc_id", F.lit(len(FAULTS)))

    def of(name: str, default: Column | object, also: dict[str, Column] | None = None) -> Column:
        """The default, or what a fault puts in its place."""
        out = default if isinstance(default, Column) else F.lit(default)
        for at, (changed, _) in enumerate(FAULTS):
            if name in changed:
                value = changed[name]
                out = F.when(k == at, (also or {}).get(value) if value in (also or {}) else F.lit(value)).otherwise(out)
        return out

    here = F.concat(F.lit(f"{ROOT}/"), F.col("doc_id").cast("string"))
    front = F.concat(F.lit("---\nsource_file: src/"), "source", F.lit(".pdf\nderived_from_import: "), F.col("doc_id").cast("string"), F.lit(".raw.md\nimport_method: pymupdf\nrepair_status: raw\n---\n\n# Notes\n\n## Part one\n\n\n1. first words\n\n## Part two\n\n2. second words\n\n"))
    rows = docs.select("doc_id", here.alias("here"), F.concat(front, F.regexp_replace("text", r"[$\\\\`~#{}]", "")).alias("before")).withColumn("current", SHA("before"))
    after = F.replace(F.col("before"), F.lit("first words"), F.lit("First words"))
    for at, (changed, _) in enumerate(FAULTS):
        if "AFTER" in changed:
            old, new = changed["AFTER"]
            after = F.when(k == at, F.replace("before", F.lit(old), F.lit(new)) if not changed.get("single") else F.replace(F.replace("before", F.lit("first words"), F.lit("First words")), F.lit(old), F.lit(new))).otherwise(after)
        elif "SHORT" in changed:
            after = F.when(k == at, F.concat(F.substring_index("before", "## Part one", 1), F.lit("1. a\n\n2. b\n"))).otherwise(after)
        elif "SPANS" in changed:
            after = F.when(k == at, F.lit(None).cast("string")).otherwise(after)
    spans = F.lit(None).cast("string")
    for at, (changed, _) in enumerate(FAULTS):
        if "SPANS" in changed:
            spans = F.when(k == at, json.dumps(changed["SPANS"])).otherwise(spans)
    md = F.concat("here", F.lit(".pdf.md"))
    state = F.concat(F.lit(f"{ROOT}/.state/"), F.col("doc_id").cast("string"))
    page, read = F.concat(state, F.lit("/pages/1.png")), F.concat(state, F.lit("/ocr.md"))
    target = of("target", md, {"OTHER": F.concat(F.lit("/elsewhere/"), F.col("doc_id").cast("string"), F.lit(".md"))})
    item = F.struct(of("item_schema", Q.QUEUE_SCHEMA).alias("schema_version"), of("item_path", md).alias("path"), of("item_sha", F.col("current")).alias("content_sha256"), of("recommended", "text-only").alias("recommended_evidence_mode"), of("blocked", "").alias("blocked"), of("single", False).alias("single_section_candidate"))
    payload = F.to_json(F.struct(of("case_schema", Q.CASE_SCHEMA).alias("schema_version"), of("case_ok", True).alias("ok"), F.when(k != next(i for i, (c, _) in enumerate(FAULTS) if "item" in c), item).alias("queue_item")))
    pages = lambda digest: F.struct(F.lit(True).alias("ok"), F.array(F.struct(page.alias("path"), digest.alias("sha256"))).alias("pages"))
    none = F.lit(None)
    shown = F.to_json(F.struct(
        of("evidence_schema", Q.CASE_SCHEMA).alias("schema_version"), of("mode", "text-only").alias("mode"), state.alias("state_dir"),
        of("vision", none, {"PAGE": pages(SHA(page)), "STALE": pages(F.lit("0"))}).alias("vision"), of("ocr", none, {"OCR": F.struct(F.lit(True).alias("ok"), read.alias("path"), SHA(read).alias("sha256"))}).alias("ocr"),
    ))
    rows = rows.withColumns({"after": after, "spans": spans, "target": target, "payload": of("payload", payload), "evidence": of("evidence", shown), "state": state})
    case_path = of("case_path", F.concat("state", F.lit("/case.json")), {"OUTSIDE": F.concat(F.lit("/tmp/"), F.col("doc_id").cast("string"), F.lit(".json"))})
    said = {
        "proposal-schema": Q.PROPOSAL_SCHEMA, "evidence-mode": "text-only", "model-capability": "text-only", "changed-sections": "Part one", "remaining-risks": "none", "case-json": case_path,
        "case-sha256": SHA("payload"), "evidence-sha256": SHA("evidence"), "target-sha256": F.col("current"), "repair-scope": "", "note": "",
    }
    text = F.concat(*(F.concat(F.lit(f"<!-- {name}: "), of(name, default), F.lit(" -->\n")) for name, default in said.items()))
    made = rows.select(F.col("doc_id").alias("id"), text.alias("text"), "target", F.col("after").alias("replacement"), "spans")
    cases = rows.select(case_path.alias("path"), "payload", of("stored", SHA("payload")).alias("case_sha256"), "evidence", of("evidence_stored", SHA("evidence")).alias("evidence_sha256"))
    other = F.concat(F.lit("/elsewhere/"), F.col("doc_id").cast("string"), F.lit(".md"))
    own = rows.select(F.explode(F.array(F.struct(md.alias("path"), F.col("before").alias("text"), F.col("current").alias("digest")), F.struct(other.alias("path"), F.col("before").alias("text"), F.col("current").alias("digest")))).alias("f")).select("f.*")
    proofs = rows.where(k.isin(*(i for i, (c, _) in enumerate(FAULTS) if "vision" in c or "ocr" in c))).select(F.explode(F.array(page, read)).alias("path")).select("path", F.lit("").alias("text"), SHA("path").alias("digest"))
    return made, cases, own.unionByName(proofs)


def _is_mild(code: str) -> bool:
    return code in Q.WARNINGS or (code.startswith("remaining-") and code.removeprefix("remaining-") not in Q.R.BLOCKING)


def _known(pairs: str) -> str:
    values = ", ".join(f"({k}, {sql_literal(code)}, {sql_literal('warning' if _is_mild(code) else 'error')})" for k, (_, found) in enumerate(FAULTS) for code in found)
    return f"select doc_id id, {pairs} from documents join (values {values}) v(k, code, severity) on doc_id % {len(FAULTS)} = k"


@register("qc_proposal", _known("code, severity"))
def qc_proposal(spark, sf_dir):
    """What is wrong with each proposal, but for what any repaired page keeps until a person has read it."""
    found = Q.review_proposals(*proposals(spark, sf_dir))
    return found.where("code <> 'remaining-frontmatter-repair-risk'").select("id", "code", "severity")


def _reason(found: list[str]) -> str:
    errors = [c for c in found if not _is_mild(c)]
    return next((told for codes, told in Q.REASONS if set(codes) & set(errors)), "proposal-review-failed") if errors else ""


@register("qc_proposal_verdict", "select doc_id id, reason = '' review_pass, reason failure_reason from documents join (values " + ", ".join(f"({k}, {sql_literal(_reason(found))})" for k, (_, found) in enumerate(FAULTS)) + f") v(k, reason) on doc_id % {len(FAULTS)} = k")
def qc_proposal_verdict(spark, sf_dir):
    made, cases, files = proposals(spark, sf_dir)
    return Q.verdicts(Q.review_proposals(made, cases, files), made)
