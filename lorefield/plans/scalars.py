"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from ..operators import diffing as D
from ..sources.sidecars import SIDECARS_CTE, sidecars
from ..sources.tables import table
from .registry import register


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("fn_slugify_ascii", "select page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-') slug from pages")
def fn_slugify_ascii(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@register("fn_course_key", "select s_suppkey, trim(regexp_replace(lower(replace(s_name, '#', '_')), '[-_ ]+', ' ', 'g')) course_key from supplier")
def fn_course_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.trim(F.regexp_replace(F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))), "[-_ ]+", " ")).alias("course_key"))


@register("fn_stable_id", "select doc_id, concat('import-repair-', substr(sha1(text), 1, 10)) stable_id from documents")
def fn_stable_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.stable_id("import-repair-", F.col("text")).alias("stable_id"))


@register("fn_section_id", "select doc_id, substr(sha1(concat(cast(n_chars as string), ':', source)), 1, 8) section_id from documents")
def fn_section_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.sha1(F.concat(F.col("n_chars").cast("string"), F.lit(":"), "source")), 1, 8).alias("section_id"))


@register("fn_sha256", "select doc_id, sha256(text) digest, sha256(concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}')) object_digest from documents")
def fn_sha256(spark, sf_dir):
    canonical = F.to_json(F.struct("lang", "source"))  # keys in the order of their names
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(canonical, 256).alias("object_digest"))


@register("fn_fingerprint", "select page_id, substr(sha256(html), 1, 16) fingerprint from pages")
def fn_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.fingerprint(F.col("html")).alias("fingerprint"))


@register("fn_public_id", "select event_id, concat('fb-public-', strftime(ts, '%Y%m%d'), '-', substr(sha1(cast(event_id as string)), 1, 8)) public_id from events")
def fn_public_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("fb-public-"), F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.substring(F.sha1(F.col("event_id").cast("string")), 1, 8)).alias("public_id"))


@register("fn_feedback_id", "select event_id, concat('fb-', strftime(ts, '%Y-%m-%d'), '-', event_type) feedback_id from events")
def fn_feedback_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("fb-"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), X.slug(F.col("event_type"))).alias("feedback_id"))


@register("fn_yaml_string", "select doc_id, concat('\"', replace(replace(source, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), '\"') quoted from documents")
def fn_yaml_string(spark, sf_dir):
    escaped = F.replace(F.replace("source", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit('"'), escaped, F.lit('"')).alias("quoted"))


@register("fn_template", "select doc_id, concat('Hello ', source, ' / ', lang) page from documents")
def fn_template(spark, sf_dir):
    page = F.lit("Hello {{name}} / {{lang}}")
    for key, column in (("name", "source"), ("lang", "lang")):
        page = F.replace(page, F.lit("{{" + key + "}}"), F.col(column))
    return _docs(spark, sf_dir).select("doc_id", page.alias("page"))


@register("fn_first_nonempty", "select conv_id, turn, coalesce(nullif(trim(text), ''), nullif(role, ''), 'none') shown from conversations")
def fn_first_nonempty(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.nullif(F.btrim("text", F.lit(" ")), F.lit("")), F.nullif("role", F.lit("")), F.lit("none")).alias("shown"))


@register("fn_parse_csv", "select o_orderkey, array_to_string(list_filter(list_transform(string_split(concat(' a ,,', o_orderpriority, ', b'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') parts from orders")
def fn_parse_csv(spark, sf_dir):
    parts = F.filter(F.transform(F.split(F.concat(F.lit(" a ,,"), "o_orderpriority", F.lit(", b")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parts, "|").alias("parts"))


@register("fn_parse_scalar", "select event_id, coalesce(json_extract_string(props, '$.k'), props) v from events")
def fn_parse_scalar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "string"), "props").alias("v"))


@register("fn_decode_unicode_escape", "select doc_id, concat('é', source) decoded from documents")
def fn_decode_unicode_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", U.decode_escapes(F.concat(F.lit("\\u00e9"), "source")).alias("decoded"))


@register("fn_utc_stamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') stamp from events")
def fn_utc_stamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@register("src_env", "select doc_id, source token, lang mode from documents")
def src_env(spark, sf_dir):
    made = F.concat(F.lit("# x\nexport TOKEN='"), "source", F.lit("'\nMODE="), "lang", F.lit("\n"))
    pairs = F.map_from_arrays(F.regexp_extract_all(made, F.lit(r"(?md)^(?:export )?([A-Z_]+)=(.*)$"), F.lit(1)), F.transform(F.regexp_extract_all(made, F.lit(r"(?md)^(?:export )?([A-Z_]+)=(.*)$"), F.lit(2)), lambda v: F.regexp_replace(v, "^['\"](.*)['\"]$", "$1")))
    return _docs(spark, sf_dir).select("doc_id", pairs["TOKEN"].alias("token"), pairs["MODE"].alias("mode"))


@register("agg_risk_dedup", "select count(*) n from (select distinct source, lang from documents)")
def agg_risk_dedup(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.to_json(F.struct("lang", "source")).alias("j")).dropDuplicates(["j"]).agg(F.count("*").alias("n"))
