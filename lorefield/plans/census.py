"""Census family over orders x lineitem x part and over events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pairs, percent
from ..operators import census as C
from ..sources.tables import table
from .registry import register

PRES = "pres as (select l_orderkey stem, p_brand type_id, count(*) n from lineitem join part on l_partkey = p_partkey group by 1, 2)"
EV = "ev as (select concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) paper, event_type type_id, count(*) n from events group by 1, 2)"


def presence(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("stem"), F.col("p_brand").alias("type_id")).agg(F.count("*").alias("n"))


def event_presence(spark, sf_dir):
    paper = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string"))
    return table(spark, sf_dir, "events").groupBy(paper.alias("paper"), F.col("event_type").alias("type_id")).agg(F.count("*").alias("n"))


@register("agg_type_frequency", f"""with {PRES}, ann as (select count(distinct stem) c from pres),
     st as (select type_id, count(*) paper_count, cast(sum(n) as bigint) question_count from pres group by 1)
select cast(row_number() over (order by paper_count desc, question_count desc, type_id) as int) rank_no, type_id,
       paper_count, question_count, cast(paper_count as double) / c appearance_rate, cast(paper_count as double) / c >= 0.6 must_know
from st cross join ann""")
def agg_type_frequency(spark, sf_dir):
    return C.type_frequency(presence(spark, sf_dir), "stem", "type_id", "n")


@register("rank_types", f"""with {EV}, ann as (select count(distinct paper) c from ev),
     st as (select type_id, count(*) paper_count, cast(sum(n) as bigint) question_count from ev group by 1)
select cast(row_number() over (order by paper_count desc, question_count desc, type_id) as int) rank_no, type_id,
       paper_count, question_count, cast(paper_count as double) / c appearance_rate, cast(paper_count as double) / c >= 0.401 must_know
from st cross join ann""")
def rank_types(spark, sf_dir):
    return C.type_frequency(event_presence(spark, sf_dir), "paper", "type_id", "n", threshold=0.401)


@register("agg_cooccurrence", f"with {PRES} select a.type_id left_type, b.type_id right_type, count(*) papers from pres a join pres b on a.stem = b.stem and a.type_id < b.type_id group by 1, 2")
def agg_cooccurrence(spark, sf_dir):
    return C.cooccurrence(presence(spark, sf_dir), "stem", "type_id")


@register("join_cooccurrence", f"with {EV} select a.paper, a.type_id left_type, b.type_id right_type from ev a join ev b on a.paper = b.paper and a.type_id < b.type_id")
def join_cooccurrence(spark, sf_dir):
    by_paper = event_presence(spark, sf_dir).groupBy("paper").agg(F.sort_array(F.collect_set("type_id")).alias("types"))
    return by_paper.select("paper", F.explode(pairs(F.col("types"))).alias("p")).select("paper", F.col("p.left").alias("left_type"), F.col("p.right").alias("right_type"))


@register("fn_pairs", f"with {EV} select a.type_id left_type, b.type_id right_type, count(*) n from ev a join ev b on a.paper = b.paper and a.type_id < b.type_id group by 1, 2")
def fn_pairs(spark, sf_dir):
    by_paper = event_presence(spark, sf_dir).groupBy("paper").agg(F.sort_array(F.collect_set("type_id")).alias("types"))
    return by_paper.select(F.explode(pairs(F.col("types"))).alias("p")).groupBy(F.col("p.left").alias("left_type"), F.col("p.right").alias("right_type")).agg(F.count("*").alias("n"))


@register("agg_coverage", "select count(*) total, count(l.doc_id) annotated, cast(count(l.doc_id) as double) / count(*) coverage from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def agg_coverage(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labelled, "doc_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count("hit").alias("annotated")).select("total", "annotated", F.try_divide(F.col("annotated").cast("double"), "total").alias("coverage"))


@register("agg_format_freq", "select coalesce(cast(quality as string), 'unspecified') format, count(*) n from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def agg_format_freq(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unspecified")).alias("format")).agg(F.count("*").alias("n"))


@register("fn_map_get_default", "select event_id, coalesce(json_extract_string(props, '$.k'), 'none') k, coalesce(json_extract_string(props, '$.missing'), 'none') missing from events")
def fn_map_get_default(spark, sf_dir):
    fields = F.from_json("props", "map<string,string>")
    get = lambda k: F.when(F.map_contains_key(fields, F.lit(k)), fields[k]).otherwise(F.lit("none"))
    return table(spark, sf_dir, "events").select("event_id", get("k").alias("k"), get("missing").alias("missing"))


@register("topk_samples", f"""with {PRES}, r as (select *, row_number() over (partition by type_id order by n desc, stem) rn from pres)
select type_id, stem, n, cast(rn as int) rn from r where rn <= 3""")
def topk_samples(spark, sf_dir):
    order = W.partitionBy("type_id").orderBy(F.desc("n"), "stem")
    return presence(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("type_id", "stem", "n", "rn")


@register("topk_deep_dive", f"with {PRES} select stem, count(*) types from pres group by stem order by types desc, stem limit 10")
def topk_deep_dive(spark, sf_dir):
    return presence(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("types")).orderBy(F.desc("types"), "stem").limit(10)


@register("join_missing", "select o_orderkey from orders o where not exists (select 1 from lineitem l where l_orderkey = o_orderkey and l_returnflag = 'R')")
def join_missing(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_anti")


@register("join_known_types", """with k as (select p_partkey, p_brand from part where p_size > 25)
select l_orderkey, l_linenumber, case when exists (select 1 from k where p_partkey = l_partkey) then 'known' else 'unknown' end state from lineitem""")
def join_known_types(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")).distinct().withColumn("hit", F.lit(True))
    return line.join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("hit"), "known").otherwise("unknown").alias("state"))


@register("join_type_instances", f"with {PRES} select type_id, stem, cast(unnest(range(1, n + 1)) as int) question from pres")
def join_type_instances(spark, sf_dir):
    return presence(spark, sf_dir).select("type_id", "stem", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("question"))


EXAM_NAMES = ["试卷", "答案复习版", "试卷及答案"]


@register("agg_canonical_exam", """with s as (select doc_id // 3 grp, doc_id % 3 k, concat('papers/', cast(doc_id // 3 as string), '-', case doc_id % 3 when 0 then '试卷' when 1 then '答案复习版' else '试卷及答案' end, '.pdf.md') path from documents)
select cast(grp as string) grp, arg_min(path, case k when 0 then 0 when 2 then 1 else 3 end) problem_source, arg_min(path, case k when 2 then 0 when 1 then 1 else 4 end) answer_source, count(*) source_count,
 string_agg(case k when 0 then 'problem' when 1 then 'answer_review' else 'combined' end, ',' order by case k when 0 then 'problem' when 1 then 'answer_review' else 'combined' end) roles, false ambiguous from s group by grp""")
def agg_canonical_exam(spark, sf_dir):
    """Sources of one examination meet by the stem of their names without marks of their roles."""
    n = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, EXAM_NAMES)), (n % 3 + 1).cast("int"))
    path = F.concat(F.lit("papers/"), F.floor(n / 3).cast("string"), F.lit("-"), name, F.lit(".pdf.md"))
    return _canonical(table(spark, sf_dir, "documents").select(path.alias("path")))


def _canonical(files):
    stem = C.sidecar_stem(F.col("path"))
    docs = files.select(C.canonical_stem(stem).alias("grp"), "path", C.source_role(stem).alias("role"))
    rank = lambda order: F.array_position(F.array(*map(F.lit, order)), F.col("role"))
    return C.canonical_groups(docs, "grp", "path", rank(C.PROBLEM_ORDER), rank(C.ANSWER_ORDER), "role")


ANCHORED = ["2024-final", "2024-final答案复习版", "2025-final", "甲试卷", "甲试题"]


@register("agg_canonical_anchor", """with d as (select cast(doc_id // 5 as string) g, doc_id % 5 r from documents),
 f as (select g, case r when 0 then '2024-final' when 1 then '2024-final' when 2 then '2025-final' else '甲' end k, r, concat('p/', g, '-', case r when 0 then '2024-final' when 1 then '2024-final答案复习版' when 2 then '2025-final' when 3 then '甲试卷' else '甲试题' end, '.pdf.md') path from d)
select concat(g, '-', k) grp, arg_min(path, case r when 1 then 0 when 3 then 0 else 1 end) problem_source, arg_min(path, case r when 1 then 0 when 3 then 0 else 1 end) answer_source, count(*) source_count,
 case k when '2024-final' then 'answer_review,unknown' when '2025-final' then 'unknown' else 'problem' end roles, k = '甲' ambiguous from f group by g, k""")
def agg_canonical_anchor(spark, sf_dir):
    """For every five documents three sources that are two examinations, and one with two problem sheets."""
    n = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, ANCHORED)), (n % 5 + 1).cast("int"))
    return _canonical(table(spark, sf_dir, "documents").select(F.concat(F.lit("p/"), F.floor(n / 5).cast("string"), F.lit("-"), name, F.lit(".pdf.md")).alias("path")))


@register("batch_chunk", "with d as (select doc_id, row_number() over (partition by source order by doc_id) rn from documents) select doc_id, cast((rn - 1) // 6 as bigint) batch from d")
def batch_chunk(spark, sf_dir):
    at = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.floor((at - 1) / 6).alias("batch"))


@register("fn_percent", f"with {EV}, ann as (select count(distinct paper) c from ev), st as (select type_id, count(*) n from ev group by 1) select type_id, concat(cast(cast(round_even(100.0 * n / c, 0) as int) as string), '%') shown from st cross join ann")
def fn_percent(spark, sf_dir):
    stats = C.type_frequency(event_presence(spark, sf_dir), "paper", "type_id", "n")
    return stats.select("type_id", percent(F.col("appearance_rate")).alias("shown"))
