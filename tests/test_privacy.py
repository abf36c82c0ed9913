"""The publishing gate against a plain version."""

import re

from lorefield.operators import privacy as P
from lorefield.plans import registry

SF = "/root/testdata/sf0.001"
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b")
PHONE = re.compile(r"(?:(?<!\w)(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})(?!\w)|(?<!\d)1[3-9]\d{9}(?!\d))")
SECRET = re.compile(r"(?im)\b(?:token|password|secret|api[_-]?key|access[_-]?key|database_url)\b\s*[:=]\s*(?:\"[^\r\n\"]*\"|'[^\r\n']*'|[^\r\n`]+)")
WARN = [
    r"[A-Za-z]:\\[^\r\n`]+", r"(?:(?<=\s)|^)/(?:Users|home|var|tmp|opt|srv|mnt)/[^\r\n`]+", r"(?i)\.env", r"(?i)[\\/]vault",
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9][A-Za-z0-9\-]{19,}|AIza[0-9A-Za-z\-_]{20,})",
    r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b", r"\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b",
    r"(?i)\b(?:[A-Za-z0-9-]+\.)+(?:local|lan|internal|corp)\b", r"(?i)\b(?:20\d{2}\s*(?:spring|summer|fall|winter)|freshman|sophomore|junior|senior|semester)\b",
    r"(?i)\b\d{2,5}\s+(?:files?|pdfs?|docx|pptx|images?)\b", r"(?im)(?:^|\s)(?:[A-Za-z]:\\|/)(?:Users|home|var|tmp|opt|srv|mnt)/[^\r\n`]+",
]


def decision(text, allow_warnings=False):
    blocked = any(r.search(text) for r in (JWT, PHONE, SECRET))
    return "hold" if blocked or (not allow_warnings and any(re.search(w, text) for w in WARN)) else "allow"


def test_publishing_gate_equals_the_plain_version(spark):
    texts = ["fine", "call 555-123-4567", "eyJab.cd.ef", "password: x", "mail a@b.org", "see .env", "at 10.0.0.1", "db.corp", "12 files", "junior", "/home/me/x", "C:\\x", "sk-" + "a" * 20, "in /vault"]
    df = spark.createDataFrame([*enumerate(texts)], "i long, text string")
    for allow in (False, True):
        got = df.select("i", P.gate(df.text, allow).alias("d")).collect()
        assert {r.i: r.d for r in got} == {i: decision(t, allow) for i, t in enumerate(texts)}
        assert [r.i for r in got if r.d == "allow"] == ([0, *range(4, 14)] if allow else [0])


def test_publishing_gate_over_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["pii_gate"](spark, SF).collect()
    assert {r.doc_id: r.decision for r in got} == {i: decision(t or "") for i, t in texts.items()}
