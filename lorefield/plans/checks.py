"""Checks of edited imports over risk records of whole sidecars, and compact payloads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks as C
from ..operators import risks as R
from ..sources.sidecars import risky_sidecars
from ..sources.tables import table
from .registry import register
from .risks import RISKS

RESULTS = RISKS + """, told as (select doc_id, severity, case when severity = 'error' then 'error' else 'warning' end as level, case when line_no is null then code else concat(code, ':', cast(line_no as string)) end named from risks join meta using (code)),
 results as (select s.doc_id, s.path, s.doc_id % 5 = 0 skipped, count(named) filter (level = 'error' and s.doc_id % 5 <> 0) errors, count(named) filter (level = 'warning' and s.doc_id % 5 <> 0) warnings,
  coalesce(string_agg(named, ',' order by named) filter (level = 'error' and s.doc_id % 5 <> 0), '') error_sample, coalesce(string_agg(named, ',' order by named) filter (level = 'warning' and s.doc_id % 5 <> 0), '') warning_sample
  from sidecars s left join told using (doc_id) group by 1, 2, 3)"""


def _results(spark, sf_dir):
    docs = risky_sidecars(spark, sf_dir)
    verified = X.field(F.col("md"), "verify_status") == "verified"
    return C.file_results(docs, R.detect(docs), verified)


@register("out_compact_check", f"with {RESULTS} select doc_id, path, skipped, errors, warnings, error_sample, warning_sample, errors = 0 ok from results")
def out_compact_check(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("ok", F.col("errors") == 0)


@register("agg_check_totals", f"with {RESULTS} select count(*) scanned, count(*) filter (not skipped) checked, count(*) filter (skipped) skipped, cast(sum(errors) as bigint) errors, cast(sum(warnings) as bigint) warnings, sum(errors) = 0 ok, case when sum(errors) = 0 then 'review passed' else 'review failed' end label from results")
def agg_check_totals(spark, sf_dir):
    return C.totals(_results(spark, sf_dir))


@register("topk_recommended_file", f"with {RESULTS} select path, errors, warnings from results where not skipped order by errors desc, warnings desc, path limit 1")
def topk_recommended_file(spark, sf_dir):
    return C.recommended(_results(spark, sf_dir))


@register("out_compact_queue", "select user_id, count(*) total, array_to_string(list_sort(list(event_id))[1:8], ',') sample, count(*) > 8 truncated from events group by 1")
def out_compact_queue(spark, sf_dir):
    """Eight events of a user and how many there are; no more are gathered."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    best = events.withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where("nth <= 8").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("s"))
    totals = events.groupBy("user_id").agg(F.count("*").alias("total"))
    same = F.col("b.user_id").eqNullSafe(F.col("t.user_id"))
    return totals.alias("t").join(best.alias("b"), same).select("t.user_id", "total", F.array_join(F.col("s").cast("array<string>"), ",").alias("sample"), (F.col("total") > 8).alias("truncated"))


#: Marks of answers in file names (fixed values).
ANSWERS = "(?i)参考答案|答案|解析|[-_ ]?solutions?|[-_ ]?answers?"
EXAMS = "select concat(source, '/exam-', cast(doc_id // 60 as string), case doc_id % 7 when 0 then '答案' when 1 then '-Solution' when 2 then '参考答案' else '' end, case when doc_id % 2 = 0 then '.pdf.md' else '.md' end) path from documents"


@register("join_sidecar_pair", f"""with f as ({EXAMS}), k as (select regexp_replace(regexp_replace(path, '\\.[A-Za-z.]+$', ''), '{ANSWERS}', '') stem, regexp_matches(path, '{ANSWERS}') is_answer, path from f),
 g as (select stem, min(path) filter (not is_answer) question, min(path) filter (is_answer) answer, count(*) - 2 extra from k group by 1) select * from g where question is not null and answer is not null""")
def join_sidecar_pair(spark, sf_dir):
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/exam-"), F.floor(k / 60).cast("string"), F.when(k % 7 == 0, "答案").when(k % 7 == 1, "-Solution").when(k % 7 == 2, "参考答案").otherwise(""), F.when(k % 2 == 0, ".pdf.md").otherwise(".md")).alias("path")
    )
    return C.pair_answers(files, ANSWERS)
