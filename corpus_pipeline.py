"""The corpus pipeline: ``documents`` through five operators of ``lorefield.llm``.

Every stage works on all that the one before it kept, as written to Parquet and read
again.  The first four return the columns of ``documents``; the last the sequences.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers as vocab
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.llm.dedup import exact_dedup, normalised
from lorefield.llm.jaccard import jaccard_components
from lorefield.llm.langid import UNDETERMINED, label_languages
from lorefield.llm.packing import pack_best_fit
from lorefield.llm.queries import END_ID, language_model
from lorefield.llm.shared import shared_folder
from lorefield.llm.toxicity import fit_severity, grade_severity

#: Stages learn, cluster and pack, which SQL cannot express; tests hold each against a plain version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter.

    Repeated rows are judged alike; null ids and columns beside the text change nothing;
    an empty table gives an empty one, and where no row has a ``lang`` nothing is known
    and all rows go.
    """
    labelled = label_languages(docs, language_model(docs), spans=False, carry=tuple(docs.columns))
    return labelled.where(F.col("lang_pred") != UNDETERMINED).select("carried.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely than not of a grade over 0.

    Null and empty texts have no features and stay; repeated rows are judged alike;
    without labels nothing is dropped; an empty table gives an empty one.
    """
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_severity(docs, model, carry=tuple(docs.columns)).where(~F.col("toxic")).select("carried.*")


def _without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """``docs`` without the rows whose ``keys`` ``dropped`` holds, null keys alike; no column of ``docs`` can clash.

    ``dropped`` is written first: its size on disk decides whether it is broadcast.
    """
    path = shared_folder(docs.sparkSession, name)
    dropped.select(*(F.col(k).alias(f"dropped_{i}") for i, k in enumerate(keys))).distinct().write.parquet(path)
    held = docs.select(F.struct(*docs.columns).alias("kept"), *(key.alias(f"key_{i}") for i, key in enumerate(keys.values())))
    same = reduce(and_, (F.col(f"key_{i}").eqNullSafe(F.col(f"dropped_{i}")) for i in range(len(keys))))
    return held.join(docs.sparkSession.read.parquet(path), same, "left_anti").select("kept.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of equal texts; of repeated rows with that id, each.

    A null text counts as empty.  A null id stays only where all ids of its group are null.
    """
    dropped = exact_dedup(docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return _without(docs, dropped, {"doc_id": F.col("doc_id"), "sha": sha}, "copies")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of near copies, the documents of its least id.

    Texts without words are linked with nothing and stay, as does a null id of a
    component whose ids are all null.  Rows that share an id are told apart by their texts.
    """
    found = jaccard_components(docs, digest=True)
    dropped = found.where(F.col("n_shingles") > 0).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key")
    return _without(docs, dropped, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}, "near-copies")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens.

    A null or empty text is the end token alone; repeated rows are packed each for
    itself; an empty table gives no sequence.
    """
    packed = pack_best_fit(docs, vocab.path("byte_bpe_50k.json"), vocab.PATTERN, END_ID, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
