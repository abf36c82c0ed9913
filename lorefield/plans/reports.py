"""Reports: sections of lines that are rows until the last step puts them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import census as C
from ..operators import privacy as P
from ..sources.tables import table
from .casebook import AREAS, LABELS, infer_runtime
from .cases import cases, sql_literal
from .census import EV, event_presence
from .registry import register


def page(parts: list[DataFrame], *keys: str) -> DataFrame:
    """``keys, page`` from parts of ``keys, a, b, line``: lines in the order of ``a``, then ``b``, then themselves.

    Lines are few for each page: a part is a fixed text or one line for each type, status or kind.
    """
    rows = reduce(DataFrame.union, parts)
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b", "line"))).alias("rows"))
    return grouped.select(*keys, F.array_join("rows.line", "\n").alias("page"))


def fixed(spark, at: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(at, k, x) for k, x in enumerate(lines)], "a int, b bigint, line string")


def listed(at: int, rows: DataFrame, order: Column, line: Column, none: str) -> DataFrame:
    """A line for each row; ``none`` where there is no row."""
    found = rows.select(F.lit(at).alias("a"), order.cast("bigint").alias("b"), line.alias("line"))
    empty = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(at).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(none).alias("line"))
    return found.union(empty)


def shown_rate(rate: Column) -> Column:
    return X.percent(rate)


# Headings of the report and what stands below them where there is nothing to tell.
VALIDATION = [
    "Missing annotations", "Low-confidence annotations", "Medium-confidence annotations", "Invalid confidence values", "Annotation source vs manifest path mismatches", "Annotation filename aliases used",
    "Annotation load errors", "Unknown type ids in types_present", "Unknown or unmatched type_counts keys", "Invalid type_counts values",
]
HEAD = ["---", "type: exam-type-frequency-report", 'course: "events"', "status: active", "created: 2026-07-04", "updated: 2026-07-04", "tags: [course/events, review, exam-census]", "review_scope: exam-census", 'exam_scope: "final"', "---", "", "# events · final · 题型频率统计", "", "## Census Metadata", "", "- Taxonomy version: 1"]
TABLE = ["- Ranking key: paper appearance count (not raw question repeats)", "", "## Frequency Table", "", "| Rank | Type | Papers | Appearance rate | Questions | Must-know | Sample papers |", "| --- | --- | ---: | ---: | ---: | --- | --- |"]
NEXT = ["## Next Steps", "", "- Fill `reviews/final/题型解析/` skeletons in frequency order.", "- Draft `备考指南.md`, `公式总卡.md`, `答题模板速查.md`, and `考前1小时清单.md`.", ""]
LOW_IDS = "select paper, case when n % 3 = 0 then 'low' else 'medium' end confidence from (select paper, sum(n) n from ev group by 1) where n >= 9"


def _text(lines: list[str]) -> str:
    return " || chr(10) || ".join(map(sql_literal, lines)).replace("\n", " ")


def _section_sql(name: str, query: str | None) -> str:
    none = _text([f"### {name}", "", "- None", ""])
    return none if query is None else f"coalesce((select '### {name}' || chr(10) || string_agg(line, chr(10) order by line) || chr(10) from ({query})), {none})"


SECTION_SQL = [
    None, "select '- `' || paper || '` (low)' line from conf where confidence = 'low'", "select '- `' || paper || '` (medium)' line from conf where confidence = 'medium'", None, None, None, None,
    "select distinct '- `' || paper || '` -> `' || type_id || '`' line from ev where type_id = 'signup' and n >= 3", None, None,
]


@register(
    "sink_frequency_report",
    f"""with {EV}, conf as ({LOW_IDS}), known as (select * from ev where type_id <> 'signup'), ann as (select count(distinct paper) c from ev),
 st as (select type_id, count(*) papers, cast(sum(n) as bigint) questions, list_sort(list(paper))[1:3] samples from known group by 1),
 r as (select *, row_number() over (order by papers desc, questions desc, type_id) rank_no, cast(papers as double) / c rate from st cross join ann)
select {_text(HEAD)} || chr(10) || '- Papers total: ' || c || chr(10) || '- Annotated: ' || c || chr(10) || '- Coverage: 100%' || chr(10) || {_text(TABLE)} || chr(10) ||
 (select string_agg('| ' || rank_no || ' | ' || type_id || ' (`' || type_id || '`) | ' || papers || ' | ' || cast(round_even(100 * rate, 0) as int) || '% | ' || questions || ' | ' || case when rate >= 0.401 then 'yes' else 'no' end || ' | ' || array_to_string(list_transform(samples, lambda s: '[' || s || '](../papers/' || s || '.md)'), ', ') || ' |', chr(10) order by rank_no) from r)
 || chr(10) || chr(10) || '## Validation' || chr(10) || chr(10) || {" || chr(10) || ".join(_section_sql(n, q) for n, q in zip(VALIDATION, SECTION_SQL))} || chr(10) || {_text(NEXT)} report from ann""",
)
def sink_frequency_report(spark, sf_dir):
    """Ranks, samples and ten sections of diagnostics; days of a user are papers, one event type is not in the taxonomy."""
    found = event_presence(spark, sf_dir)
    papers = found.agg(F.count_distinct("paper").alias("c"))
    known = found.where("type_id <> 'signup'")
    stats = known.groupBy("type_id").agg(F.count("*").alias("papers"), F.sum("n").alias("questions"), F.slice(F.sort_array(F.collect_list("paper")), 1, 3).alias("samples"))
    from pyspark.sql import Window as W

    ranked = stats.crossJoin(F.broadcast(papers)).withColumn("rate", F.col("papers") / F.col("c")).withColumn("rank_no", F.row_number().over(W.orderBy(F.desc("papers"), F.desc("questions"), "type_id")))  # over types
    links = F.array_join(F.transform("samples", lambda s: F.concat(F.lit("["), X.table_cell(s), F.lit("](../papers/"), s, F.lit(".md)"))), ", ")
    cell = [F.col("rank_no").cast("string"), F.concat(X.table_cell(F.col("type_id")), F.lit(" (`"), X.table_cell(F.col("type_id")), F.lit("`)")), F.col("papers").cast("string"), shown_rate(F.col("rate")), F.col("questions").cast("string"), F.when(F.col("rate") >= 0.401, "yes").otherwise("no"), links]
    confidence = found.groupBy("paper").agg(F.sum("n").alias("n")).where("n >= 9").select("paper", F.when(F.col("n") % 3 == 0, "low").otherwise("medium").alias("confidence"))
    bullet = lambda *xs: F.concat(F.lit("- `"), xs[0], *xs[1:])
    told = {
        1: confidence.where("confidence = 'low'").select(bullet("paper", F.lit("` (low)")).alias("line")),
        2: confidence.where("confidence = 'medium'").select(bullet("paper", F.lit("` (medium)")).alias("line")),
        7: found.where("type_id = 'signup' and n >= 3").select(bullet("paper", F.lit("` -> `"), "type_id", F.lit("`")).alias("line")).distinct(),
    }
    parts = [fixed(spark, 0, *HEAD), papers.select(F.lit(1).alias("a"), F.lit(0).cast("bigint").alias("b"), F.format_string("- Papers total: %d\n- Annotated: %d\n- Coverage: 100%%", "c", "c").alias("line")), fixed(spark, 2, *TABLE)]
    parts.append(listed(3, ranked, F.col("rank_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")), "| - | _(no taxonomy types yet)_ | 0 | 0% | 0 | no | - |"))
    parts.append(fixed(spark, 4, "", "## Validation", ""))
    for k, name in enumerate(VALIDATION):
        at = 10 + 4 * k
        if k not in told:
            parts.append(fixed(spark, at, f"### {name}", "", "- None", ""))
            continue
        # a heading, lines without a blank line before them, and a blank line; or the empty form
        joined = told[k].agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("x"))
        parts.append(joined.select(F.lit(at).alias("a"), F.lit(0).cast("bigint").alias("b"), F.when(F.col("x") == "", f"### {name}\n\n- None\n").otherwise(F.concat(F.lit(f"### {name}\n"), "x", F.lit("\n"))).alias("line")))
    parts.append(fixed(spark, 100, *NEXT))
    whole = page([p.withColumn("report_key", F.lit(1)).select("report_key", "a", "b", "line") for p in parts], "report_key")
    return whole.select(F.col("page").alias("report"))


@register("sink_multi_dim", f"""with {EV}, co as (select '共现' kind, '| ' || a.type_id || ' | ' || b.type_id || ' | ' || count(*) || ' |' line, -count(*) k, a.type_id || b.type_id t from ev a join ev b on a.paper = b.paper and a.type_id < b.type_id group by a.type_id, b.type_id),
 lab as (select d.doc_id, coalesce(case quality when 1 then '选择' when 0 then '填空' end, '未标注') fmt, case when doc_id % 5 = 0 then '未标注' else repeat('★', doc_id % 5) end stars from documents d left join labels l using (doc_id)),
 fm as (select '格式' kind, '| ' || fmt || ' | ' || count(*) || ' |' line, -count(*) k, fmt t from lab group by fmt),
 df as (select '难度' kind, '| ' || stars || ' | ' || count(*) || ' |' line, 0 k, stars t from lab group by stars),
 re as (select '可靠性' kind, '| ' || case role when 'user' then '回忆版' when 'assistant' then '答案卷' else role end || ' | ' || count(*) || ' |' line, 0 k, role t from conversations group by role),
 u as (select * from co union all select * from fm union all select * from df union all select * from re)
select kind, string_agg(line, chr(10) order by k, t) page from u group by kind""")
def sink_multi_dim(spark, sf_dir):
    """Four reports: pairs that occur together, formats, difficulties and reliabilities, with labels as users see them."""
    label = lambda table_, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS[table_].items() for x in kv)), c), c)
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells, F.col("n").cast("string")), F.lit(" |"))
    part = lambda rows, kind, order, tie, line: rows.select(F.lit(kind).alias("kind"), order.cast("bigint").alias("a"), tie.alias("b"), line.alias("line"))
    zero = F.lit(0)
    pairs = C.cooccurrence(event_presence(spark, sf_dir), "paper", "type_id").withColumnRenamed("papers", "n")
    labels = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    named = labels.select(label("format", F.when(F.col("quality") == 1, "choice").when(F.col("quality") == 0, "fill").otherwise("unspecified")).alias("fmt"), label("difficulty", F.when(F.col("doc_id") % 5 == 0, "unspecified").otherwise((F.col("doc_id") % 5).cast("string"))).alias("stars"))
    roles = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    source = label("reliability", F.when(F.col("role") == "user", "recall").when(F.col("role") == "assistant", "answer-key").otherwise(F.col("role")))
    formats, stars = (named.groupBy(c).agg(F.count("*").alias("n")) for c in ("fmt", "stars"))
    parts = [
        part(pairs, "共现", -F.col("n"), F.concat("left_type", "right_type"), row("left_type", "right_type")), part(formats, "格式", -F.col("n"), F.col("fmt"), row("fmt")),
        part(stars, "难度", zero, F.col("stars"), row("stars")), part(roles, "可靠性", zero, F.col("role"), row(source)),
    ]
    return page(parts, "kind")


@register("sink_feedback_summary", """with f as (select doc_id, case doc_id % 4 when 0 then 'open' when 1 then 'triaged' when 2 then 'resolved' else 'archived' end status, source kind, case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end severity from documents where doc_id < 1000000),
 s as (select '- Total feedback items: ' || count(*) || chr(10) || '- Open items: ' || count(*) filter (status = 'open') || chr(10) || '- Triaged items: ' || count(*) filter (status = 'triaged') || chr(10) || '- Resolved items: ' || count(*) filter (status = 'resolved') || chr(10) || '- Archived items: ' || count(*) filter (status = 'archived') x from f),
 k as (select string_agg('- ' || kind || ': ' || n, chr(10) order by kind) x from (select kind, count(*) n from f group by 1)),
 h as (select coalesce(string_agg('- Doc ' || doc_id || ': ' || kind || ' / ' || status, chr(10) order by doc_id), '- No high-priority open items.') x from (select * from f where severity = 'high' and status in ('open', 'triaged') order by doc_id limit 10)),
 p as (select string_agg('- Doc ' || doc_id || ': ' || kind || ' / ' || severity || ' / ' || status, chr(10) order by doc_id) x from (select * from f where status in ('open', 'triaged') order by doc_id limit 10)),
 d as (select string_agg('- fb-' || doc_id || ': Doc ' || doc_id || ' (' || kind || ', ' || severity || ')', chr(10) order by doc_id) x from (select * from f where status in ('open', 'triaged') order by doc_id limit 10)),
 r as (select string_agg('- Doc ' || doc_id || ': ' || kind, chr(10) order by doc_id desc) x from (select * from f where status in ('resolved', 'archived') order by doc_id desc limit 5)),
 base as (select '## Snapshot' || chr(10) || chr(10) || s.x || chr(10) || chr(10) || '## By Kind' || chr(10) || chr(10) || k.x || chr(10) || chr(10) || '## High Priority Open Items' || chr(10) || chr(10) || h.x || chr(10) || chr(10) || '## Pending Queue' || chr(10) || chr(10) || p.x || chr(10) || chr(10) || '## Recent Resolutions' || chr(10) || chr(10) || r.x x from s, k, h, p, r)
select 'workspace' audience, base.x page from base union all select 'developer', base.x || chr(10) || chr(10) || '## Developer Handoff' || chr(10) || chr(10) || d.x from base, d""")
def sink_feedback_summary(spark, sf_dir):
    """Two layouts of a summary; lists of items are top rows, never a whole group."""
    n = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 4 == 0, "open").when(n % 4 == 1, "triaged").when(n % 4 == 2, "resolved").otherwise("archived").alias("status"), F.col("source").alias("kind"), F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("severity"))
    name = F.concat(F.lit("- Doc "), n.cast("string"))
    status = lambda s: F.count_if(F.col("status") == s).cast("string")
    snapshot = items.agg(F.concat(F.lit("- Total feedback items: "), F.count("*").cast("string"), *(x for s in ("Open", "Triaged", "Resolved", "Archived") for x in (F.lit(f"\n- {s} items: "), status(s.lower())))).alias("line"))
    pending = items.where(F.col("status").isin("open", "triaged"))
    kinds = items.groupBy("kind").agg(F.count("*").alias("n"))
    heading = lambda at, title: fixed(spark, at, *([""] if at else []), f"## {title}", "")
    first = lambda rows, k: rows.orderBy("doc_id").limit(k)
    from pyspark.sql import Window as W

    by_kind = kinds.withColumn("at", F.row_number().over(W.orderBy("kind")))  # over kinds
    parts = [
        heading(0, "Snapshot"), snapshot.select(F.lit(1).alias("a"), F.lit(0).cast("bigint").alias("b"), "line"), heading(2, "By Kind"), listed(3, by_kind, F.col("at"), F.concat(F.lit("- "), "kind", F.lit(": "), F.col("n").cast("string")), "- No feedback recorded yet."),
        heading(4, "High Priority Open Items"), listed(5, first(pending.where("severity = 'high'"), 10), n, F.concat(name, F.lit(": "), "kind", F.lit(" / "), "status"), "- No high-priority open items."),
        heading(6, "Pending Queue"), listed(7, first(pending, 10), n, F.concat(name, F.lit(": "), F.concat_ws(" / ", "kind", "severity", "status")), "- No pending feedback items."),
        heading(8, "Recent Resolutions"), listed(9, items.where(F.col("status").isin("resolved", "archived")).orderBy(F.desc("doc_id")).limit(5), -n, F.concat(name, F.lit(": "), "kind"), "- No resolved items yet."),
    ]
    handoff = [heading(10, "Developer Handoff"), listed(11, first(pending, 10), n, F.concat(F.lit("- fb-"), n.cast("string"), F.lit(": Doc "), n.cast("string"), F.lit(" ("), "kind", F.lit(", "), "severity", F.lit(")")), "- No open developer follow-up items.")]
    both = [p.withColumn("audience", F.explode(F.array(F.lit("workspace"), F.lit("developer")))) for p in parts] + [p.withColumn("audience", F.lit("developer")) for p in handoff]
    return page([p.select("audience", "a", "b", "line") for p in both], "audience")


@cases("sink_hw_review_index", [
    ("hw1.md,hw1-solution.md,hw2.md", "2026-hw1-review.md,hw10.md", "### Homework\n- hw1.md\n- hw2.md\n\n### Solutions\n- hw1-solution.md\n\n### Reviews\n- 2026-hw1-review.md\n- hw10.md\n\n### Homework To Review Links\n- hw1.md -> solution: hw1-solution.md -> review: 2026-hw1-review.md\n- hw2.md -> solution: None -> review: None\n"),
    ("", "", "### Homework\n- None\n\n### Solutions\n- None\n\n### Reviews\n- None\n\n### Homework To Review Links\n- None\n"),
    ("a-solution.md", "a.md", "### Homework\n- None\n\n### Solutions\n- a-solution.md\n\n### Reviews\n- a.md\n\n### Homework To Review Links\n- None\n"),
])
def review_index(homework, reviews):
    """Homework, solutions and reviews of a course, and what belongs together."""
    names = lambda x: F.array_sort(F.filter(F.split(x, ","), lambda v: v != ""))
    solutions = F.filter(names(homework), lambda x: x.endswith("-solution.md"))
    assignments = F.filter(names(homework), lambda x: ~x.endswith("-solution.md"))
    bullets = lambda xs: F.coalesce(F.nullif(F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- None"))

    def link(name: Column) -> Column:
        base = F.regexp_replace(name, r"\.md$", "")
        solution = F.concat(base, F.lit("-solution.md"))
        whole = lambda r: F.contains(F.concat(F.lit("-"), F.regexp_replace(r, r"\.md$", ""), F.lit("-")), F.concat(F.lit("-"), base, F.lit("-")))
        review = F.coalesce(F.get(F.filter(names(reviews), whole), F.lit(0)), F.lit("None"))
        return F.concat(name, F.lit(" -> solution: "), F.when(F.array_contains(solutions, solution), solution).otherwise("None"), F.lit(" -> review: "), review)

    blocks = [("Homework", assignments), ("Solutions", solutions), ("Reviews", names(reviews)), ("Homework To Review Links", F.transform(assignments, link))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"### {title}\n"), bullets(xs), F.lit("\n")) for title, xs in blocks))


@cases("sink_indexes", [
    ("courses/la/index.md\nsemesters/2026/b.md\nsemesters/2026/a.md\nprojects/p/x.md\ntasks/weekly/w.md\ndashboards/home.md\ndashboards/x/y.md", "dashboards:dashboards/home.md,dashboards/x/y.md|projects:p|semesters:2026|semesters/2026:a.md,b.md|tasks:weekly"),
    ("notes.md", "dashboards:|projects:|semesters:|tasks:"), ("semesters/2025/a/b.md\nsemesters/2026/c.txt", "dashboards:|projects:|semesters:2025,2026|semesters/2025:|semesters/2026:|tasks:"),
])
def indexes(files):
    """Folders below each root, dashboards with their whole paths, and the notes of each semester."""
    rows = F.array_sort(F.split(files, "\n"))
    below = lambda root: F.array_distinct(F.transform(F.filter(rows, lambda f: f.rlike(f"^{root}/[^/]+/")), lambda f: F.get(F.split(f, "/"), F.lit(1))))
    semester = lambda s: F.concat(F.lit("semesters/"), s, F.lit(":"), F.array_join(F.transform(F.filter(rows, lambda f: F.startswith(f, F.concat(F.lit("semesters/"), s, F.lit("/"))) & f.rlike(r"^semesters/[^/]+/[^/]+\.md$")), lambda f: F.regexp_extract(f, "([^/]*)$", 1)), ","))
    named = lambda root: F.concat(F.lit(f"{root}:"), F.array_join(below(root), ","))
    boards = F.concat(F.lit("dashboards:"), F.array_join(F.filter(rows, lambda f: f.rlike(r"^dashboards/.*\.md$")), ","))
    return F.array_join(F.concat(F.array(boards, named("projects"), named("semesters")), F.transform(below("semesters"), semester), F.array(named("tasks"))), "|")


_BODY = "# Feedback - x\n\n## What Happened\nIt broke, mail a@b.com.\n\n## Expected Behavior\nIt works.\n\n## Evidence\nlog\n\n## Likely Cause\ncode\n\n## Suggested Improvement\nfix\n"


def _issue(*parts: tuple[str, str]) -> str:
    return "\n\n".join(f"## {title}\n\n{text}" for title, text in parts) + "\n"


@cases("sink_issue_body", [
    (_BODY, "import", "high", "run on Linux", _issue(("Feedback ID", "- `fb-public-1`"), ("Installed Version", "- unknown"), ("Environment", "- OS: Linux\n- Python: unknown"), ("What Happened", "It broke, mail [REDACTED_EMAIL]."), ("Expected Behavior", "It works."), ("Evidence", "log"), ("Workflow Failure Analysis", "-"), ("Evidence From Current Conversation", "-"), ("Related Outputs", "-"),
        ("Reproduction Steps", "- Source context: run on Linux\n- Follow the workflow described in the linked feedback entry.\n- Observe the mismatch between actual and expected behavior."), ("Likely Area", "- document import pipeline"), ("Severity", "- high"), ("Privacy Check", f"- {P.WARNING_MESSAGES['email']}"), ("Completeness Check", "- Minimum issue sections detected for public triage."), ("Suggested Improvement", "fix"), ("Developer Summary", "-"), ("Likely Cause", "code"))),
    ("## Evidence\nx ... y\n", "none", "", "", _issue(("Feedback ID", "- `fb-public-1`"), ("Installed Version", "- unknown"), ("Environment", "- OS: unknown\n- Python: unknown"), ("What Happened", "-"), ("Expected Behavior", "-"), ("Evidence", "x ... y"), ("Workflow Failure Analysis", "-"), ("Evidence From Current Conversation", "-"), ("Related Outputs", "-"),
        ("Reproduction Steps", "- Source context: unknown\n- Follow the workflow described in the linked feedback entry.\n- Observe the mismatch between actual and expected behavior."), ("Likely Area", "- general tool behavior"), ("Severity", "- medium"), ("Privacy Check", "- No obvious privacy warnings detected."),
        ("Completeness Check", "\n".join(f"- {m}" for m in [P.REPORT_RULES[0][1], P.REPORT_RULES[1][1], P.REPORT_RULES[3][1], P.REPORT_RULES[4][1], P.REPORT_RULES[5][1], P.TRUNCATED])), ("Suggested Improvement", "-"), ("Developer Summary", "-"), ("Likely Cause", "-"))),
])
def issue_body(body, kind, severity, context):
    """A report as it is published: its sections without what identifies anyone, and what is known of it."""
    told = lambda heading: F.coalesce(F.nullif(P.redact(X.note_section(body, heading)), F.lit("")), F.lit("-"))
    where = F.coalesce(F.nullif(F.btrim(context), F.lit("")), F.lit("unknown"))
    known = F.split(infer_runtime(F.concat(context, F.lit("\n"), body)), r"\|")
    bullets = lambda codes, none: F.array_join(F.transform(F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(none))), lambda x: F.concat(F.lit("- "), x)), "\n")
    area = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in AREAS.items() for x in kv)), kind), F.lit(AREAS["other"]))
    privacy = F.concat(P.messages(P.blockers(body), P.BLOCKER_MESSAGES), P.messages(P.warnings(body), P.WARNING_MESSAGES))
    steps = F.concat(F.lit("- Source context: "), P.redact(where), F.lit("\n- Follow the workflow described in the linked feedback entry.\n- Observe the mismatch between actual and expected behavior."))
    sections = [
        ("Feedback ID", F.lit("- `fb-public-1`")), ("Installed Version", F.concat(F.lit("- "), F.get(known, F.lit(2)))), ("Environment", F.concat(F.lit("- OS: "), F.get(known, F.lit(0)), F.lit("\n- Python: "), F.get(known, F.lit(1)))),
        *((h, told(h)) for h in ("What Happened", "Expected Behavior", "Evidence", "Workflow Failure Analysis", "Evidence From Current Conversation", "Related Outputs")), ("Reproduction Steps", steps), ("Likely Area", F.concat(F.lit("- "), area)),
        ("Severity", F.concat(F.lit("- "), F.coalesce(F.nullif(severity, F.lit("")), F.lit("medium")))), ("Privacy Check", bullets(privacy, "No obvious privacy warnings detected.")), ("Completeness Check", bullets(P.completeness(body, context), "Minimum issue sections detected for public triage.")),
        *((h, told(h)) for h in ("Suggested Improvement", "Developer Summary", "Likely Cause")),
    ]
    return F.concat(F.concat_ws("\n\n", *(F.concat(F.lit(f"## {title}\n\n"), part) for title, part in sections)), F.lit("\n"))
