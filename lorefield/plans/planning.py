"""Planning family: orders are tasks, customers' segments are courses, the day is a literal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import iso_date
from ..sources.tables import table
from .registry import register

TODAY, DAYS = "1998-01-01", 30
TASKS = """tasks as (select o_orderkey id, cast(o_orderdate as date) due, case o_orderstatus when 'F' then 'done' when 'P' then 'archived' else 'active' end status, o_orderpriority priority, c_mktsegment course from orders join customer on o_custkey = c_custkey)"""


def tasks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "archived").otherwise("active")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("due"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("course"))


def actionable(df):
    return df.where(~F.col("status").isin("done", "archived"))


def _today():
    return F.lit(TODAY).cast("date")


def _horizon():
    return F.date_add(_today(), DAYS)


@register("filt_actionable", f"with {TASKS} select id, status from tasks where status not in ('done', 'archived')")
def filt_actionable(spark, sf_dir):
    return actionable(tasks(spark, sf_dir)).select("id", "status")


@register("filt_due_window", f"with {TASKS} select id, due from tasks where status = 'active' and (due < date '{TODAY}' or due between date '{TODAY}' and date '{TODAY}' + {DAYS})")
def filt_due_window(spark, sf_dir):
    return actionable(tasks(spark, sf_dir)).where((F.col("due") < _today()) | F.col("due").between(_today(), _horizon())).select("id", "due")


@register("filt_overdue", f"with {TASKS} select id, due, cast(date '{TODAY}' - due as int) late from tasks where status = 'active' and due < date '{TODAY}'")
def filt_overdue(spark, sf_dir):
    return actionable(tasks(spark, sf_dir)).where(F.col("due") < _today()).select("id", "due", F.date_diff(_today(), "due").alias("late"))


@register("filt_upcoming", f"with {TASKS} select id, due from tasks where status = 'active' and due between date '{TODAY}' and date '{TODAY}' + {DAYS}")
def filt_upcoming(spark, sf_dir):
    return actionable(tasks(spark, sf_dir)).where(F.col("due").between(_today(), _horizon())).select("id", "due")


@register("filt_exam", f"with {TASKS} select id, due, course from tasks where status = 'active' and due <= date '{TODAY}' + {max(DAYS, 14)} and (contains(lower(priority), 'urgent') or course = 'MACHINERY')")
def filt_exam(spark, sf_dir):
    near = F.col("due") <= F.date_add(_today(), max(DAYS, 14))
    return actionable(tasks(spark, sf_dir)).where(near & (F.lower("priority").contains("urgent") | (F.col("course") == "MACHINERY"))).select("id", "due", "course")


@register("filt_recent", "select event_id, ts from events where ts >= timestamp '2024-01-30 00:00:00' - interval 7 days and event_type <> 'view'")
def filt_recent(spark, sf_dir):
    since = F.expr("timestamp '2024-01-30 00:00:00' - interval 7 days")
    return table(spark, sf_dir, "events").where((F.col("ts") >= since) & (F.col("event_type") != "view")).select("event_id", "ts")


@register("argmin_nearest", f"with {TASKS} select course, arg_min(id, concat(cast(due as string), lpad(cast(id as string), 12, '0'))) id, min(due) due from tasks where status = 'active' and due >= date '{TODAY}' group by course")
def argmin_nearest(spark, sf_dir):
    due = actionable(tasks(spark, sf_dir)).where(F.col("due") >= _today())
    return due.groupBy("course").agg(F.min_by("id", F.struct("due", "id")).alias("id"), F.min("due").alias("due"))


@register("join_course_tasks", f"""with {TASKS}, courses as (select distinct c_mktsegment title, lower(c_mktsegment) slug from customer),
 hit as (select c.title, t.id, t.due from courses c join tasks t on t.course = c.title or t.course = c.slug where t.status = 'active' and t.due >= date '{TODAY}')
select title, count(distinct id) n_tasks, min(due) nearest from hit group by title""")
def join_course_tasks(spark, sf_dir):
    courses = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("title"), F.lower("c_mktsegment").alias("slug")).distinct()
    open_ = actionable(tasks(spark, sf_dir)).where(F.col("due") >= _today()).select("id", "due", "course")
    # an OR of two equalities as a union of two equi joins
    hits = [courses.join(open_, courses[k] == open_["course"]).select("title", "id", "due") for k in ("title", "slug")]
    once = hits[0].union(hits[1]).dropDuplicates(["title", "id"])
    return once.groupBy("title").agg(F.count("*").alias("n_tasks"), F.min("due").alias("nearest"))


@register("topk_per_group", f"with {TASKS}, r as (select course, id, due, row_number() over (partition by course order by due desc, id) rn from tasks) select course, id, due, cast(rn as int) rn from r where rn <= 10")
def topk_per_group(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("course").orderBy(F.desc("due"), "id"))
    return tasks(spark, sf_dir).withColumn("rn", rn).where("rn <= 10").select("course", "id", "due", "rn")


@register("tail_k", f"with {TASKS}, r as (select status, id, due, row_number() over (partition by status order by due desc, id desc) rn from tasks) select status, id, due from r where rn <= 5")
def tail_k(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("status").orderBy(F.desc("due"), F.desc("id")))
    return tasks(spark, sf_dir).withColumn("rn", rn).where("rn <= 5").select("status", "id", "due")


@register("topk_recent", "select event_id, ts from events order by ts desc, event_id limit 20")
def topk_recent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(20)


@register("merge_sorted", f"with {TASKS} select due as day, 'task' kind, id from tasks where status = 'active' and due between date '{TODAY}' and date '{TODAY}' + {DAYS} union all select cast(l_shipdate as date), 'exam', l_orderkey from lineitem where l_linenumber = 1 and cast(l_shipdate as date) between date '{TODAY}' and date '{TODAY}' + 7")
def merge_sorted(spark, sf_dir):
    due = actionable(tasks(spark, sf_dir)).where(F.col("due").between(_today(), _horizon())).select(F.col("due").alias("day"), F.lit("task").alias("kind"), "id")
    ship = F.col("l_shipdate").cast("date")
    exams = table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") == 1) & ship.between(_today(), F.date_add(_today(), 7))).select(ship.alias("day"), F.lit("exam").alias("kind"), F.col("l_orderkey").alias("id"))
    return due.union(exams).orderBy("day", "kind", "id")


@register("agg_counts_payload", f"""with {TASKS} select count(*) total, count(*) filter (status = 'active') active, count(*) filter (status = 'done') done, count(*) filter (status = 'archived') archived, count(*) filter (status = 'active' and due < date '{TODAY}') overdue, count(*) filter (status = 'active' and due between date '{TODAY}' and date '{TODAY}' + {DAYS}) upcoming from tasks""")
def agg_counts_payload(spark, sf_dir):
    is_ = lambda s: F.col("status") == s
    return tasks(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(is_("active")).alias("active"), F.count_if(is_("done")).alias("done"), F.count_if(is_("archived")).alias("archived"),
        F.count_if(is_("active") & (F.col("due") < _today())).alias("overdue"), F.count_if(is_("active") & F.col("due").between(_today(), _horizon())).alias("upcoming"),
    )


@register("agg_feedback_counts", f"with {TASKS} select course, status, count(*) n, cast(grouping(course) as int) g_course, cast(grouping(status) as int) g_status from tasks group by grouping sets ((course), (status), ())")
def agg_feedback_counts(spark, sf_dir):
    sets = tasks(spark, sf_dir).groupingSets([[F.col("course")], [F.col("status")], []], "course", "status")
    return sets.agg(F.count("*").alias("n"), F.grouping("course").cast("int").alias("g_course"), F.grouping("status").cast("int").alias("g_status"))


@register("agg_dup_course_keys", "with k as (select s_suppkey, case s_suppkey % 3 when 0 then concat('Linear_Algebra ', cast(s_suppkey // 3 as string)) when 1 then concat(' linear-algebra  ', cast(s_suppkey // 3 as string)) else concat('optics ', cast(s_suppkey as string)) end title from supplier), n as (select s_suppkey, trim(regexp_replace(lower(title), '[-_ ]+', ' ', 'g')) course_key from k) select s_suppkey, course_key, count(*) over (partition by course_key) > 1 duplicate from n")
def agg_dup_course_keys(spark, sf_dir):
    """Courses whose titles differ only in case, dashes, underscores and blanks."""
    n = F.col("s_suppkey")
    third = F.floor(n / 3).cast("string")
    title = F.when(n % 3 == 0, F.concat(F.lit("Linear_Algebra "), third)).when(n % 3 == 1, F.concat(F.lit(" linear-algebra  "), third)).otherwise(F.concat(F.lit("optics "), n.cast("string")))
    keyed = table(spark, sf_dir, "supplier").select("s_suppkey", F.trim(F.regexp_replace(F.lower(title), "[-_ ]+", " ")).alias("course_key"))
    counts = keyed.groupBy("course_key").agg((F.count("*") > 1).alias("duplicate"))
    return keyed.join(counts, "course_key").select("s_suppkey", "course_key", "duplicate")


@register("fn_date_plus", f"with {TASKS} select id, due + {DAYS} horizon, case when due < date '{TODAY}' then 'overdue' when due <= date '{TODAY}' + {DAYS} then 'window' else 'later' end bucket from tasks")
def fn_date_plus(spark, sf_dir):
    bucket = F.when(F.col("due") < _today(), "overdue").when(F.col("due") <= _horizon(), "window").otherwise("later")
    return tasks(spark, sf_dir).select("id", F.date_add("due", DAYS).alias("horizon"), bucket.alias("bucket"))


@register("fn_iso_date", "select o_orderkey, case o_orderkey % 3 when 2 then null else cast(o_orderdate as date) end parsed from orders")
def fn_iso_date(spark, sf_dir):
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.lit("someday"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_date(raw).alias("parsed"))


@register("fmt_task_line", f"with {TASKS} select id, concat('- [', course, '] ', cast(id as string), ' due ', coalesce(cast(case when id % 9 = 0 then null else due end as string), 'no-date'), ' (', priority, ')') line from tasks")
def fmt_task_line(spark, sf_dir):
    due = F.coalesce(F.when(F.col("id") % 9 != 0, F.col("due")).cast("string"), F.lit("no-date"))
    return tasks(spark, sf_dir).select("id", F.concat(F.lit("- ["), "course", F.lit("] "), F.col("id").cast("string"), F.lit(" due "), due, F.lit(" ("), "priority", F.lit(")")).alias("line"))


# --------------------------------------------------------------------------
# pages: a plan and a dashboard for each customer

#: Customers' tasks with the sections that they belong to; a task without a priority is in the inbox.
OWN_TASKS = f"""own as (select o_custkey who, o_orderkey id, cast(o_orderdate as date) due, o_orderpriority priority from orders where o_orderstatus = 'O'),
 placed as (select *, due < date '{TODAY}' overdue, due between date '{TODAY}' and date '{TODAY}' + {DAYS} upcoming, contains(priority, 'NOT SPECIFIED') inbox, contains(priority, 'URGENT') and due <= date '{TODAY}' + {DAYS} exam from own)"""
HEAD = f"---\ntype: weekly-dashboard\nstatus: active\ncreated: {TODAY}\nupdated: {TODAY}\ntags: [planning, weekly, dashboard]\n---\n\n# Weekly Dashboard - "


def placed_tasks(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("due"), F.col("o_orderpriority").alias("priority"))
    exam = F.contains("priority", F.lit("URGENT")) & (F.col("due") <= _horizon())
    return own.select("*", (F.col("due") < _today()).alias("overdue"), F.col("due").between(_today(), _horizon()).alias("upcoming"), F.contains("priority", F.lit("NOT SPECIFIED")).alias("inbox"), exam.alias("exam"))


def _top(name: str, prefix: str) -> str:
    return f"(select who, string_agg(concat('- {prefix}', 'task ', cast(id as string), ' :: tasks/', cast(id as string), '.md'), chr(10) order by due, id) body from (select *, row_number() over (partition by who order by due, id) nth from placed where {name}) where nth <= 5 group by who)"


@register("sink_dashboard", f"""with {OWN_TASKS}, n as (select who, count(*) filter (overdue) o, count(*) filter (upcoming) u, count(*) filter (inbox) i, count(*) filter (exam) e from placed group by who)
select n.who, concat({", chr(10), ".join(f"'{line}'" for line in HEAD.split(chr(10)))}, cast(n.who as string), chr(10), chr(10), '## Snapshot', chr(10), chr(10), '- Overdue tasks: ', cast(o as string), chr(10), '- Upcoming deadlines: ', cast(u as string), chr(10), '- Inbox items: ', cast(i as string), chr(10), '- Exams in range: ', cast(e as string), chr(10), chr(10),
 '## Immediate Focus', chr(10), chr(10), coalesce(a.body, b.body, '- No urgent deadlines.'), chr(10), chr(10), '## Inbox Queue', chr(10), chr(10), coalesce(c.body, '- Inbox is clear.'), chr(10)) page
from n left join {_top("overdue", "Overdue -> ")} a using (who) left join {_top("upcoming", "Upcoming -> ")} b using (who) left join {_top("inbox", "")} c using (who)""")
def sink_dashboard(spark, sf_dir):
    """A page for each customer: counts, then the five most urgent tasks and the first of the inbox, or that there are none.

    Sections are ranked in one pass, where the window keeps five rows of each before it
    moves any; a page is then put together from fifteen lines at most.
    """
    rows = placed_tasks(spark, sf_dir)
    kinds = ("overdue", "upcoming", "inbox")
    counts = rows.groupBy("who").agg(*(F.count_if(k).alias(k) for k in (*kinds, "exam")))
    sections = rows.select("who", "id", "due", F.explode(F.array_compact(F.array(*(F.when(F.col(k), k) for k in kinds)))).alias("kind"))
    best = sections.withColumn("nth", F.row_number().over(W.partitionBy("who", "kind").orderBy("due", "id"))).where("nth <= 5")
    said = F.when(F.col("kind") == "overdue", "Overdue -> ").when(F.col("kind") == "upcoming", "Upcoming -> ").otherwise("")
    line = F.concat(F.lit("- "), said, F.lit("task "), F.col("id").cast("string"), F.lit(" :: tasks/"), F.col("id").cast("string"), F.lit(".md"))
    body = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("nth", line.alias("line"))))), lambda r: r["line"]), "\n").alias(f"{k}_lines")
    pages = counts.join(best.groupBy("who").agg(*map(body, kinds)), "who", "left")
    told = lambda *names, none: F.coalesce(*(F.nullif(F.col(f"{k}_lines"), F.lit("")) for k in names), F.lit(none))
    number = lambda label, k: F.concat(F.lit(f"- {label}: "), F.col(k).cast("string"), F.lit("\n"))
    return pages.select("who", F.concat(
        F.lit(HEAD), F.col("who").cast("string"), F.lit("\n\n## Snapshot\n\n"), number("Overdue tasks", "overdue"), number("Upcoming deadlines", "upcoming"), number("Inbox items", "inbox"), number("Exams in range", "exam"),
        F.lit("\n## Immediate Focus\n\n"), told("overdue", "upcoming", none="- No urgent deadlines."), F.lit("\n\n## Inbox Queue\n\n"), told("inbox", none="- Inbox is clear."), F.lit("\n"),
    ).alias("page"))


#: Sections of a plan, with what stands for an empty one.
PLAN = {"overdue": ("Overdue Carryover", "- None"), "upcoming": ("Deadlines This Week", "- None"), "exam": ("Exams And Countdowns", "- No exam signals found"), "inbox": ("Inbox To Triage", "- Inbox is clear")}


@register("sink_week_plan", f"with {OWN_TASKS} select who, concat(" + ", chr(10), ".join(
    f"'## {title}', chr(10), chr(10), coalesce(string_agg(concat('- [ ] ', cast(due as string), ' task ', cast(id as string), ' (', priority, ')'), chr(10) order by due, id) filter ({kind}), '{none}'), chr(10)" for kind, (title, none) in PLAN.items()
) + ") page from placed group by who")
def sink_week_plan(spark, sf_dir):
    """All open tasks of a customer by section, each in the order of its days; one grouping makes the page."""
    line = F.concat(F.lit("- [ ] "), F.col("due").cast("string"), F.lit(" task "), F.col("id").cast("string"), F.lit(" ("), "priority", F.lit(")"))
    ordered = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(kind), F.struct("due", "id", line.alias("line"))))), lambda r: r["line"]), "\n")
    grouped = placed_tasks(spark, sf_dir).groupBy("who").agg(*(ordered(kind).alias(kind) for kind in PLAN))
    part = lambda kind, title, none: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit(none)), F.lit("\n"))
    return grouped.select("who", F.concat_ws("\n", *(part(kind, *told) for kind, told in PLAN.items())).alias("page"))
