"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damage_conversations, repair_conversations, whole_conversations
from .dedup import exact_dedup
from .fingerprint import fingerprint_pairs, fingerprint_text, likeness
from .jaccard import jaccard_components
from .langid import LanguageModel, fit_language_model, label_languages
from .mixing import mix_sources
from .packing import pack_best_fit
from .sharding import hilbert_shards
from .tokens import encode_tree, token_budgets, write_prefix_tables
from .toxicity import fit_severity, grade_severity
from .warc import archive_round_trip
from .whitening import whiten_embeddings

#: The token that closes a document in packed sequences.
END_ID = 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = write_prefix_tables(_documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"), vocab.PATTERN)
    return token_budgets(tables, 512).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "cut_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_severity(docs, model).select("doc_id", "toxic", "grade", "severity", "p_toxic")


def held_out() -> F.Column:
    """Documents that language models do not learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def language_model(docs: DataFrame) -> LanguageModel:
    return fit_language_model(docs.where(~held_out()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labelled = label_languages(docs, language_model(docs))
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_tree(_documents(spark, sf_dir), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(_documents(spark, sf_dir), 40, numeric=["doc_id"], categorical=["lang", "source"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprint_pairs(_documents(spark, sf_dir))
    return prints.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("anchors")).alias("fingerprint"),
        fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(_documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"), vocab.PATTERN, END_ID, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damage_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return whole_conversations(repair_conversations(damaged, F.col("gone")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error"
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).drop("source")


QUERIES = (
    op1_jaccard_join,
    op2_token_counts,
    op3_toxicity,
    op4_language_id,
    op5_bpe_tree,
    op6_hilbert_shards,
    op7_syncmer_fingerprints,
    op8_best_fit_packing,
    op9_exact_dedup,
    op10_warc,
    op11_structure_repair,
    op12_whitening,
    op13_source_mix,
)

OP9_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm from documents),
     g as (select norm, min(doc_id) keep_id, count(*) group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(g.norm) text_sha256
from n join g on n.norm = g.norm
"""

OP10_SQL = """
with p as (select page_id, coalesce(html, '') body from pages),
     g as (select body, min(page_id) first_id from p where octet_length(encode(body)) >= 100 group by body)
select page_id, cast(octet_length(encode(p.body)) as bigint) payload_bytes, sha256(p.body) payload_digest,
       case when first_id < page_id then 'revisit' else 'response' end record_type,
       case when first_id < page_id then first_id end refers_to
from p left join g on p.body = g.body
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL, "op10_warc": OP10_SQL}
