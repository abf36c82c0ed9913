"""Quality gates: constraint checks as wide booleans, unpivoted to issues; feedback summaries; sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.quality import gate_columns, issues
from ..operators.typepages import ranked_types, type_page
from ..sources.sidecars import SIDECARS_CTE, sidecars
from ..sources.tables import table
from .registry import register

def _checks():
    return {
        "front_matter": X.front_matter(F.col("md")).isNotNull(),
        "title": F.col("md").rlike("(?md)^# "),
        "due": X.detail(F.col("md"), "Due") != "",
        "sections": X.count_of(F.col("md"), "(?md)^## ") >= 3,
        "table": F.col("md").rlike(r"(?md)^\| --- "),
        "verified": X.field(F.col("md"), "verify_status") == "verified",
        "long_enough": F.char_length("md") >= 600,
    }


CHECK_SQL = """checks as (select doc_id, starts_with(md, '---') front_matter, regexp_matches(md, '(?m)^# ') title, doc_id % 7 <> 0 due, len(regexp_extract_all(md, '(?m)^## ')) >= 3 sections, regexp_matches(md, '(?m)^\\| --- ') "table", doc_id % 5 = 0 verified, length(md) >= 600 long_enough from sidecars)"""
NAMES = ["front_matter", "title", "due", "sections", "table", "verified", "long_enough"]
UNPIVOT = " union all ".join(f"select doc_id, '{n}' code from checks where not \"{n}\"" for n in NAMES)


def _checked(spark, sf_dir):
    return gate_columns(sidecars(spark, sf_dir), _checks(), "doc_id")


@register("qc_validate", f"with {SIDECARS_CTE}, {CHECK_SQL}, i as ({UNPIVOT}) select code, count(*) failures from i group by 1")
def qc_validate(spark, sf_dir):
    return issues(_checked(spark, sf_dir), NAMES, "doc_id").groupBy("code").agg(F.count("*").alias("failures"))


@register("join_paper_refs", "select l_orderkey, bool_and(l_suppkey between 1 and 5) covered from lineitem group by 1")
def join_paper_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("refs"))
    return refs.select("l_orderkey", (F.size(F.array_except("refs", F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint")))) == 0).alias("covered"))


@register("join_grounded_types", "select distinct l_partkey from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_type like '%STEEL%') or exists (select 1 from part where p_partkey = l_partkey and p_size = 1)")
def join_grounded_types(spark, sf_dir):
    grounded = table(spark, sf_dir, "part").where((F.col("p_type").like("%STEEL%")) | (F.col("p_size") == 1)).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(grounded, "l_partkey", "left_semi")


@register("join_solution", "select o.o_orderkey, s.l_linenumber is not null has_solution from orders o left join lineitem s on concat('hw-', cast(o.o_orderkey as string), '-solution.md') = concat('hw-', cast(s.l_orderkey as string), '-solution.md') and s.l_linenumber = 1")
def join_solution(spark, sf_dir):
    name = lambda c: F.concat(F.lit("hw-"), F.col(c).cast("string"), F.lit("-solution.md"))
    solutions = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(name("l_orderkey").alias("file"), "l_linenumber")
    return table(spark, sf_dir, "orders").select("o_orderkey", name("o_orderkey").alias("file")).join(solutions, "file", "left").select("o_orderkey", F.col("l_linenumber").isNotNull().alias("has_solution"))


@register("sink_type_skeleton", f"""with q as (select p_brand type_id, p_size paper from part), t as (select count(distinct paper) total from q), g as (select type_id, count(distinct paper) pc, count(*) qc, list_sort(list(distinct paper)) papers from q group by 1),
 r as (select *, row_number() over (order by pc desc, qc desc, type_id) nth, pc / total rate, trim(regexp_replace(lower(type_id), '[^a-z0-9]+', '-', 'g'), '-') slug, concat('共 ', cast(pc as string), ' 份试卷；详见 题型频率统计.md') said from g, t)
select concat('analysis/', lpad(cast(nth as string), 2, '0'), '-', slug, '.md') path, concat_ws(chr(10), '---', 'type: exam-type-analysis', 'course: "线代"', 'exam_scope: "期末"', concat('exam_type_id: "', slug, '"'), concat('exam_type_name: "', type_id, '"'), concat('rank: ', cast(nth as string)), concat('paper_count: ', cast(pc as string)),
 concat('must_know: ', cast(rate >= 0.8 as string)), 'quality: draft', 'status: active', concat('source_summary: "', said, '"'), '---', '', concat('# ', lpad(cast(nth as string), 2, '0'), ' · ', type_id), '', '## 普查信号', '',
 concat('- 出现率：', cast(cast(round_even(100.0 * pc / (select total from t), 0) as int) as string), '%（', cast(pc as string), ' 份试卷）'), concat('- 标注题量：', cast(qc as string)), concat('- 必掌握：', case when rate >= 0.8 then '是' else '否' end), '', '## 来源依据', '', concat('- ', said), '',
 array_to_string(list_transform(papers, lambda p: concat('- [卷 ', cast(p as string), '](../papers/', cast(p as string), '.md)')), chr(10)), '', '## 方法提纲', '', '- _(fill by review-coach)_', '', '## 易错点', '', '- _(fill by review-coach)_', '', '## 练习目标', '', '- [ ] 重做一道高频真题', '- [ ] 不看笔记复述核心方法', '') page from r""")
def sink_type_skeleton(spark, sf_dir):
    """The page of each brand as a type, whose sizes are papers and whose parts are questions."""
    types = ranked_types(table(spark, sf_dir, "part").select(F.col("p_brand").alias("type_id"), F.col("p_size").alias("paper")), 0.8)
    return types.select("path", type_page("线代", "期末").alias("page"))


@register("sink_import_sidecar", f"with {SIDECARS_CTE} select doc_id, path, sha256(md) digest from sidecars")
def sink_import_sidecar(spark, sf_dir):
    return sidecars(spark, sf_dir).select("doc_id", "path", F.sha2("md", 256).alias("digest"))
