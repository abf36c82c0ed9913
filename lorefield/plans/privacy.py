"""Privacy queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy as P
from .cases import cases
from ..sources.tables import dealt_table
from .registry import register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("pii_email_redact", "select doc_id, regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g') redacted from documents")
def pii_email_redact(spark, sf_dir):
    pattern = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}"
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", pattern, "[REDACTED_EMAIL]").alias("redacted"))


@register("pii_redact")
def pii_redact(spark, sf_dir):
    docs = dealt_table(spark, sf_dir, "documents", "doc_id")
    clean = docs.select("doc_id", "text", P.redact(F.col("text")).alias("redacted"))
    return clean.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


#: Whether each warning and blocker fires, without lookaround: for that alone, what stands around a match may be part of it.
PATH = "(?:Users|home|var|tmp|opt|srv|mnt)"
FIRES = {
    "windows_path": r"[A-Za-z]:\\[^\r\n`]+", "unix_path": rf"(?:\s|^)/{PATH}/[^\r\n`]+", "env_file": r"(?i)\.env", "token": P.TOKEN,
    "secret_kv": r"(?i)\b(?:token|password|secret|api[_-]?key|access[_-]?key|database_url)\b\s*[:=]\s*[^\r\n`]", "vault_path": r"(?i)[\\/]vault", "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b",
    "private_ip": r"\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b", "internal_host": r"(?i)\b(?:[A-Za-z0-9-]+\.)+(?:local|lan|internal|corp)\b", "file_count": r"(?i)\b\d{2,5}\s+(?:files?|pdfs?|docx|pptx|images?)\b",
    "semester": r"(?i)\b(?:20\d{2}\s*(?:spring|summer|fall|winter)|freshman|sophomore|junior|senior|semester)\b", "local_file": rf"(?im)(?:^|\s)(?:[A-Za-z]:\\|/){PATH}/[^\r\n`]+",
}
BLOCKS = {"jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "secret_kv": FIRES["secret_kv"], "phone": r"(?:^|\W)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?:\W|$)|(?:^|\D)1[3-9]\d{9}(?:\D|$)"}


def _fired(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in rules.items()) + ")"


@register("pii_warnings", f"select doc_id, {_fired(FIRES)} warnings from documents")
def pii_warnings(spark, sf_dir):
    return dealt_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.array_join(P.warnings(F.col("text")), ",").alias("warnings"))


@register("pii_blockers", f"select doc_id, {_fired(BLOCKS)} blockers from documents where {_fired(BLOCKS)} <> ''")
def pii_blockers(spark, sf_dir):
    found = dealt_table(spark, sf_dir, "documents", "doc_id").select("doc_id", P.blockers(F.col("text")).alias("b"))
    return found.where(F.size("b") > 0).select("doc_id", F.array_join("b", ",").alias("blockers"))


@register("pii_gate", f"select doc_id, case when {_fired(BLOCKS)} <> '' or {_fired(FIRES)} <> '' then 'hold' else 'allow' end decision, case when {_fired(BLOCKS)} <> '' then 'hold' else 'allow' end lenient from documents")
def pii_gate(spark, sf_dir):
    """All blockers and the warnings rule; beside it the decision where warnings are allowed."""
    text = F.col("text")
    return dealt_table(spark, sf_dir, "documents", "doc_id").select("doc_id", P.gate(text).alias("decision"), P.gate(text, allow_warnings=True).alias("lenient"))


@cases("fn_privacy_messages", [
    ("plain words", ""), ("mail a@b.com", P.WARNING_MESSAGES["email"]), ("token = abc", P.WARNING_MESSAGES["secret_kv"] + "|" + P.BLOCKER_MESSAGES["secret_kv"]), ("call 415-555-0100", P.BLOCKER_MESSAGES["phone"]),
    ("see /home/me/x and 10.0.0.1", "|".join(P.WARNING_MESSAGES[k] for k in ("unix_path", "private_ip", "local_file"))), ("C:\\vault\\x", P.WARNING_MESSAGES["windows_path"] + "|" + P.WARNING_MESSAGES["vault_path"]), ("150 files in my junior semester", P.WARNING_MESSAGES["file_count"] + "|" + P.WARNING_MESSAGES["semester"]),
    ("host db.internal\u2028next", P.WARNING_MESSAGES["internal_host"]), ("a\u00a0.env", P.WARNING_MESSAGES["env_file"]),
])
def privacy_messages(text):
    return F.array_join(F.concat(P.messages(P.warnings(text), P.WARNING_MESSAGES), P.messages(P.blockers(text), P.BLOCKER_MESSAGES)), "|")


@cases("pii_gate_modes", [("plain", "allow,allow,check-only"), ("a@b.com", "hold,allow,hold"), ("password: x", "hold,hold,hold"), ("eyJa.b.c", "hold,hold,hold"), ("1 415 555 0100", "hold,hold,hold")])
def gate_modes(text):
    # a JWT and a phone number give no warning, and block all the same
    return F.concat_ws(",", P.gate(text), P.gate(text, allow_warnings=True), P.gate(text, check_only=True))


_R = "## What Happened\nIt broke.\n\n## Expected Behavior\nIt works.\n\n## Evidence\nlog\n\n## Likely Cause\ncode\n\n## Suggested Improvement\nfix\n"


@cases("pii_completeness", [
    (_R, "run it", ""), (_R, " Unknown", P.REPORT_RULES[3][1]), (_R.replace("It broke.", "-"), "run it", P.REPORT_RULES[0][1]), (_R.replace("log", "a ... b"), "run it", P.TRUNCATED), (_R.replace("## Likely Cause\ncode\n", ""), "run it", P.REPORT_RULES[4][1]),
    ("", "", "|".join(m for _, m in P.REPORT_RULES)), (_R.replace("\n", "\r\n").replace("fix", ""), "run it", P.REPORT_RULES[5][1]),
])
def report_lacks(body, context):
    return F.array_join(P.completeness(body, context), "|")


@register("pii_turn_gate")
def pii_turn_gate(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", P.gate(F.col("text")).alias("decision"), F.array_join(P.warnings(F.col("text")), ",").alias("warnings"))
