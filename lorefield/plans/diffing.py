"""Difference and set family over subsets of ``documents`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffing as D
from ..operators.reconcile import Reconciler, page_print
from ..sources.shared import shared_root
from ..sources.tables import table
from ..streaming.increment import convert_new
from .registry import register

BEFORE = "b as (select doc_id, sha256(text) d from documents where doc_id % 10 <> 0)"
AFTER = "a as (select doc_id, sha256(case when doc_id % 7 = 0 then concat(text, '!') else text end) d from documents where doc_id % 10 <> 1)"


def _before(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("d"))


def _after(spark, sf_dir):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 1").select("doc_id", F.sha2(text, 256).alias("d"))


@register("join_snapshot_diff", f"with {BEFORE}, {AFTER} select coalesce(a.doc_id, b.doc_id) doc_id, case when b.d is null then 'added' when a.d is null then 'removed' when a.d <> b.d then 'modified' else 'unchanged' end change from a full join b on a.doc_id = b.doc_id")
def join_snapshot_diff(spark, sf_dir):
    return D.snapshot_diff(_before(spark, sf_dir), _after(spark, sf_dir), "doc_id", "d")


@register("join_baseline", f"with {BEFORE}, {AFTER} select case when b.d is null then 'new' when a.d is null then 'cleared' else 'unchanged' end state, count(*) n from (select distinct d from a) a full join (select distinct d from b) b on a.d = b.d group by 1")
def join_baseline(spark, sf_dir):
    b, a = _before(spark, sf_dir).select("d").distinct().withColumn("was", F.lit(1)), _after(spark, sf_dir).select("d").distinct().withColumn("now", F.lit(1))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "cleared").otherwise("unchanged")
    return b.join(a, "d", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register("set_intersect", f"with {BEFORE}, {AFTER} select d from a intersect select d from b")
def set_intersect(spark, sf_dir):
    return _after(spark, sf_dir).select("d").intersect(_before(spark, sf_dir).select("d"))


@register("set_except", f"with {BEFORE}, {AFTER} select d from a except select d from b")
def set_except(spark, sf_dir):
    return _after(spark, sf_dir).select("d").subtract(_before(spark, sf_dir).select("d"))


@register("set_union", f"with {BEFORE}, {AFTER} select d from a union select d from b")
def set_union(spark, sf_dir):
    return _after(spark, sf_dir).select("d").union(_before(spark, sf_dir).select("d")).distinct()


@register("set_symdiff_keys", f"with {BEFORE}, {AFTER} select coalesce(a.doc_id, b.doc_id) doc_id, a.d is not null in_after, b.d is not null in_before from a full join b on a.doc_id = b.doc_id")
def set_symdiff_keys(spark, sf_dir):
    b, a = _before(spark, sf_dir).withColumnRenamed("d", "was"), _after(spark, sf_dir).withColumnRenamed("d", "now")
    return b.join(a, "doc_id", "full_outer").select("doc_id", F.col("now").isNotNull().alias("in_after"), F.col("was").isNotNull().alias("in_before"))


@register("set_subset", "select l_orderkey, bool_and(l_returnflag in ('N', 'R')) subset from lineitem group by 1")
def set_subset(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return flags.select("l_orderkey", (F.size(F.array_except("f", F.array(F.lit("N"), F.lit("R")))) == 0).alias("subset"))


@register("set_dedup_ordered", "with o as (select l_orderkey, l_returnflag, min(l_linenumber) first_line from lineitem group by 1, 2) select l_orderkey, string_agg(l_returnflag, ',' order by first_line, l_returnflag) flags from o group by 1")
def set_dedup_ordered(spark, sf_dir):
    ordered = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return ordered.select("l_orderkey", F.array_join(F.array_distinct("x.l_returnflag"), ",").alias("flags"))


@register("inc_fingerprint_store", "select doc_id, substr(sha256(regexp_replace(concat('updated: 2026', chr(10), text), '(?m)^(updated|generated):.*\\n?', '', 'g')), 1, 16) fingerprint from documents")
def inc_fingerprint_store(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.fingerprint(F.concat(F.lit("updated: 2026\n"), "text")).alias("fingerprint"))


#: Pages of documents: two of a type, some made by a machine and some edited since; every fifth type has a page without one.
EXAM_PAGES = """select concat('p', cast(doc_id as string), '.md') path, case when doc_id % 10 = 7 then null else concat('t', cast(doc_id - doc_id % 2 as string)) end type_id,
 concat('rank: 0', chr(10), 'paper_count: 0', chr(10), text, case when doc_id % 3 = 0 then ' edited' else '' end) text, concat('rank: 0', chr(10), 'paper_count: 0', chr(10), text) made, doc_id from documents where doc_id % 6 <> 5"""
#: The ranking: types of even documents that are no multiples of 8, by number.
EXAM_RANKS = "select concat('t', cast(doc_id as string)) type_id, doc_id + 1 as rank, 1 + doc_id % 4 paper_count, concat(lpad(cast(doc_id + 1 as string), 8, '0'), '-t.md') path, concat('fresh ', cast(doc_id as string)) body from documents where doc_id % 2 = 0 and doc_id % 8 <> 0"


def exam_state(spark, sf_dir):
    """Pages, fingerprints and ranking of the documents."""
    docs = table(spark, sf_dir, "documents")
    pages, ranks = (spark.sql(q.replace("from documents", "from {docs}"), docs=docs) for q in (EXAM_PAGES, EXAM_RANKS))
    first = F.min_by("made", "doc_id")
    store = pages.where("type_id is not null").groupBy("type_id").agg(page_print(first).alias("fingerprint"))
    return pages.select("path", "type_id", "text"), store, ranks


@register("inc_reconcile", f"""with p as ({EXAM_PAGES}), w as ({EXAM_RANKS}), s as (select type_id, sha256(min_by(made, doc_id)) digest from p where type_id is not null group by 1),
 k as (select p.*, coalesce(sha256(p.text) = s.digest, false) is_made, w.path target, w.rank, w.paper_count, row_number() over (partition by p.type_id order by coalesce(sha256(p.text) = s.digest, false), p.path desc) nth from p left join s using (type_id) left join w using (type_id)),
 a as (select *, type_id is not null and nth = 1 and target is not null and not is_made migrates from k),
 fresh as (select * from w where type_id not in (select type_id from a where migrates))
select 'pages' as "table", target as name, sha256(replace(replace(text, concat('rank: 0', chr(10)), concat('rank: ', cast(rank as string), chr(10))), concat('paper_count: 0', chr(10)), concat('paper_count: ', cast(paper_count as string), chr(10)))) digest from a where migrates
union all select 'pages', path, sha256(body) from fresh union all select 'store', type_id, substr(sha256(body), 1, 16) from fresh union all select 'archive', path, sha256(text) from a where not migrates and not is_made""")
def inc_reconcile(spark, sf_dir):
    """Tables after a run that stopped before it had placed its pages and a second one that completed it."""
    pages, store, ranks = exam_state(spark, sf_dir)
    state = Reconciler(spark, shared_root(spark))
    state.seed(pages, store)

    def stop(phase: str) -> None:
        if phase == "archive":
            raise InterruptedError(phase)

    try:
        state.run(ranks, before=stop)
    except InterruptedError:
        after = state.run(ranks.where("false"))  # the plan that was written counts
    digest = F.sha2("text", 256).alias("digest")
    return (
        after["pages"].select(F.lit("pages").alias("table"), F.col("path").alias("name"), digest)
        .unionByName(after["store"].select(F.lit("store").alias("table"), F.col("type_id").alias("name"), F.col("fingerprint").alias("digest")))
        .unionByName(after["archive"].select(F.lit("archive").alias("table"), "name", digest))
    )


@register("inc_skip_existing", """with d as (select doc_id, text, case when doc_id % 3 = 0 then 'first' when doc_id % 3 = 1 then 'second' else 'third' end made_by from documents)
select doc_id, made_by, sha256(concat(made_by, ' ', text)) digest from d""")
def inc_skip_existing(spark, sf_dir):
    """A folder that grows by three drops, each with what was there before in new words; what exists is not converted again."""
    folder, docs = shared_root(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    for k, name in enumerate(("first", "second", "third")):
        drop = docs.where(F.col("doc_id") % 3 <= k).withColumn("made_by", F.lit(name))
        drop.write.parquet(f"{folder}/in/{name}")
        convert = lambda rows: rows.select("doc_id", "made_by", F.sha2(F.concat_ws(" ", "made_by", "text"), 256).alias("digest"))
        done = convert_new(spark, f"{folder}/in", "doc_id bigint, text string, made_by string", f"{folder}/out", f"{folder}/progress", "doc_id", "made_by", convert)
    return done.select("doc_id", "made_by", "digest")


@register("inc_stale_guard", "select doc_id, sha256(text) = sha256(case when doc_id % 7 = 0 then concat(text, '!') else text end) fresh from documents")
def inc_stale_guard(spark, sf_dir):
    joined = _before(spark, sf_dir).withColumnRenamed("d", "was")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("base"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    return docs.join(joined, "doc_id", "left").select("doc_id", (F.coalesce("was", "base") == F.col("now")).alias("fresh"))


@register("join_dirty_overlap", f"with {BEFORE}, {AFTER} select a.doc_id from a where exists (select 1 from b where b.doc_id = a.doc_id and b.d <> a.d)")
def join_dirty_overlap(spark, sf_dir):
    dirty = _before(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("d").alias("was"))
    after = _after(spark, sf_dir)
    return after.join(dirty, (after.doc_id == dirty.k) & (after.d != dirty.was), "left_semi").select("doc_id")


@register("join_skeleton_coverage", "select coalesce(l.doc_id, d.doc_id) doc_id, case when l.doc_id is null then 'missing' when d.doc_id is null then 'orphan' else 'ok' end state from (select doc_id from documents where doc_id % 9 <> 0) d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def join_skeleton_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select("doc_id").withColumn("page", F.lit(1))
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("type", F.lit(1))
    state = F.when(F.col("type").isNull(), "missing").when(F.col("page").isNull(), "orphan").otherwise("ok")
    return d.join(lab, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@register("cls_eol_only", "select doc_id, replace(replace(text, chr(10), concat(chr(13), chr(10))), concat(chr(13), chr(10)), chr(10)) = text eol_only from documents")
def cls_eol_only(spark, sf_dir):
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.replace(crlf, F.lit("\r\n"), F.lit("\n")) == F.col("text")).alias("eol_only"))
