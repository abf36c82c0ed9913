"""Privacy: warnings, blockers, ordered redaction and the publishing gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, note_section

# Patterns and messages that the results must agree on.
WINDOWS_PATH = r"[A-Za-z]:\\[^\r\n`]+"
UNIX_PATH = r"(?:(?<=\s)|^)/(?:Users|home|var|tmp|opt|srv|mnt)/[^\r\n`]+"
TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9][A-Za-z0-9\-]{19,}|AIza[0-9A-Za-z\-_]{20,})"
JWT = r"(?U)\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
PHONE = r"(?U)(?:(?<!\w)(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})(?!\w)|(?<!\d)1[3-9]\d{9}(?!\d))"
VAULT_PATH = r"(?iu)(?:[A-Za-z]:\\|/)[^\s`]*(?:vault)[^\s`]*"
ENV_FILE = r"(?im)(?<![A-Za-z0-9_.-])\.env(?:\.[A-Za-z0-9_.-]+)*(?::[^\r\n]*)?"
SECRET_KV = "(?imU)\\b(?:token|password|secret|api[_-]?key|access[_-]?key|database_url)\\b\\s*[:=]\\s*(?:\"[^\\r\\n\"]*\"|'[^\\r\\n']*'|[^\\r\\n`]+)"
EMAIL = r"(?U)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b"
PRIVATE_IP = r"(?U)\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b"
INTERNAL_HOST = r"(?iU)\b(?:[A-Za-z0-9-]+\.)+(?:local|lan|internal|corp)\b"
SEMESTER = r"(?iU)\b(?:20\d{2}\s*(?:spring|summer|fall|winter)|freshman|sophomore|junior|senior|semester)\b"
FILE_COUNT = r"(?iU)\b\d{2,5}\s+(?:files?|pdfs?|docx|pptx|images?)\b"
LOCAL_FILE = r"(?im)(?:^|\s)(?:[A-Za-z]:\\|/)(?:Users|home|var|tmp|opt|srv|mnt)/[^\r\n`]+"

#: The order counts: tokens go before the key-value rule, phones before vault paths.  Each rule has a cheap
#: sign without which it cannot match, so that most texts meet no costly pattern at all.
REDACTIONS = [
    (WINDOWS_PATH, "WINDOWS_PATH", r":\\"),
    (UNIX_PATH, "UNIX_PATH", "/(?:Users|home|var|tmp|opt|srv|mnt)/"),
    (TOKEN, "TOKEN", "gh[pousr]_|github_pat_|sk-|AIza"),
    (JWT, "JWT", "eyJ"),
    (PHONE, "PHONE", r"(?U)\d{4}"),
    (VAULT_PATH, "VAULT_PATH", "(?iu)vault"),
    (ENV_FILE, "ENV_FILE", r"(?iu)\.env"),
    (SECRET_KV, "SECRET_KV", "(?iu)token|password|secret|api|access|database"),
    (EMAIL, "EMAIL", "@"),
    (PRIVATE_IP, "PRIVATE_IP", r"10\.|172\.|192\.168"),
    (INTERNAL_HOST, "INTERNAL_HOST", r"(?iu)\.(?:local|lan|internal|corp)"),
]


def _redaction(pattern: str, name: str, sign: str):
    plain = not set(sign) & set("\\.()|[?")
    return lambda t: F.when(F.contains(t, F.lit(sign)) if plain else t.rlike(sign), F.regexp_replace(t, pattern, f"[REDACTED_{name}]")).otherwise(t)


def redact(text: Column) -> Column:
    for rule in REDACTIONS:
        text = let(text, _redaction(*rule))
    return text


# What is told of each warning and blocker.
WARNING_MESSAGES = {
    "windows_path": "Contains Windows absolute paths; redact user-specific local paths before public posting.",
    "unix_path": "Contains Unix-style absolute paths; redact user-specific local paths before public posting.",
    "env_file": "Mentions .env or environment files; verify no secrets or private configuration are included.",
    "token": "Contains token-like strings; remove secrets before posting publicly.",
    "secret_kv": "Contains secret-like key/value pairs; remove credentials before posting publicly.",
    "vault_path": "References a private vault path; redact private repository or note locations before posting.",
    "email": "Contains email addresses; replace personal addresses before public posting.",
    "private_ip": "Contains private network IP addresses; replace internal infrastructure details before public posting.",
    "internal_host": "Contains internal hostnames or domains; replace internal network references before public posting.",
    "file_count": "Contains file-count or dataset-size details; consider generalizing counts or ranges for public reports.",
    "semester": "Contains semester or academic-stage details; consider generalizing study metadata for public reports.",
    "local_file": "References local files developers cannot access; inline the relevant snippet or remove the path.",
}
BLOCKER_MESSAGES = {
    "jwt": "Contains JWT-like tokens; remove credentials before publishing.",
    "secret_kv": "Contains secret-like key/value assignments; remove credentials before publishing.",
    "phone": "Contains phone-number-like personal data; remove personal contact details before publishing.",
}
# What is told of a report that lacks something.
REPORT_RULES = [
    ("What Happened", "Missing a concrete problem description; add one sentence describing what broke."),
    ("Expected Behavior", "Missing expected behavior; add a clear actual-vs-expected comparison."),
    ("Evidence", "Missing evidence or repro data; add logs, snippets, or a minimal failing example."),
    ("", "Missing reproduction context; add a self-contained reproduction path developers can follow."),
    ("Likely Cause", "Likely cause is missing; include a suspected area when available to speed triage."),
    ("Suggested Improvement", "Suggested improvement is missing; add a fix direction or note that none is known."),
]
TRUNCATED = "Contains ellipsis-truncated content; inline complete commands or snippets when they are needed for reproduction."


def messages(codes: Column, table: dict[str, str]) -> Column:
    return F.transform(codes, lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c))


def completeness(body: Column, context: Column) -> Column:
    """What a report lacks: six parts that say something, and no shortened evidence."""
    told = lambda heading: note_section(body, heading)
    lacks = [F.when(F.lower(F.btrim(context)).isin("", "unknown") if not heading else told(heading).isin("", "-"), F.lit(message)) for heading, message in REPORT_RULES]
    cut = F.when(told("Evidence").contains("...") | told("What Happened").contains("..."), F.lit(TRUNCATED))
    return F.array_compact(F.array(*lacks, cut))


def warnings(text: Column) -> Column:
    """Names of the rules that fire, in order."""
    low = F.lower(text)
    rules = [
        ("windows_path", text.rlike(WINDOWS_PATH)), ("unix_path", text.rlike(UNIX_PATH)), ("env_file", low.contains(".env")), ("token", text.rlike(TOKEN)),
        ("secret_kv", text.rlike(SECRET_KV)), ("vault_path", low.contains("\\vault") | low.contains("/vault")), ("email", text.rlike(EMAIL)), ("private_ip", text.rlike(PRIVATE_IP)),
        ("internal_host", text.rlike(INTERNAL_HOST)), ("file_count", text.rlike(FILE_COUNT)), ("semester", text.rlike(SEMESTER)), ("local_file", text.rlike(LOCAL_FILE)),
    ]
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules)))


def blockers(text: Column) -> Column:
    rules = [("jwt", text.rlike(JWT)), ("secret_kv", text.rlike(SECRET_KV)), ("phone", text.rlike(PHONE))]
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules)))


def gate(text: Column, allow_warnings: bool = False, check_only: bool = False) -> Column:
    """hold where a blocker fires, or a warning unless warnings are allowed; otherwise allow.

    A check tells of warnings whatever is allowed, and publishes nothing.
    """
    blocked, warned = F.size(blockers(text)) > 0, F.size(warnings(text)) > 0
    held = blocked if allow_warnings and not check_only else blocked | warned
    return F.when(held, F.lit("hold")).otherwise(F.lit("check-only" if check_only else "allow"))
