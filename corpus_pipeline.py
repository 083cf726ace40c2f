"""A corpus pipeline of five stages, each one operator over all that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; ``run`` writes each one as
Parquet to the session's shared folder and reads it back for the next. All but the last give the
columns of ``documents``. Rows without doc_id, repeated rows, null and empty texts, empty tables
and further columns pass through as each stage's operator defines them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, quality, sentencepiece_codec, simhash, suffix_dedup
from tidemark.llm.staging import keyed, release, staged

#: SQL cannot express fitted models, encoding or connected components; tests use brute force
ORACLE_SQL = None
MODEL = "piece_bpe_32k.model"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of this input's
    documents but for the fold that is held out of the query of its own."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id stays."""
    rows, key = keyed(docs, "doc_id", "text")
    groups = simhash.similar_groups(rows, doc_id=key)
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return rows.join(others, key, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier are cut out; a document may become empty.
    Bytes of a character that a cut goes through are left out; n_chars follows the text."""
    cut = suffix_dedup.dedup_spans(docs, kept_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_windows(docs, items).where("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count and the digests of ids and of what they decode to."""
    out = sentencepiece_codec.encode_documents(docs, public_tokenizers.path(MODEL), keep=["doc_id", "lang", "source"], ids=True)
    return out.drop("decoded")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
