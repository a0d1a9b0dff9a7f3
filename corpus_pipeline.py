"""A pipeline over documents: quality rules, near duplicates, shared passages, secrets, packing."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import chunks, jaccard_join, packing, quality_rules, secrets, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = chunks.numbered(docs)
    return chunks.restored(quality_rules.quality_rules(own, chunks.number_of(docs, "text"), tuple(own.columns)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id; of rows with equal ids the one with the least SHA-256 of the row as JSON. Rows without an id stay.

    Texts meet the ids that stay in one join; only rows of ids that repeat are compared. The tables by which the ids were
    found are deleted before the texts are moved.
    """
    own, i = chunks.numbered(docs), chunks.number_of(docs, "doc_id")

    def ids() -> DataFrame:
        classes = jaccard_join.jaccard_join(docs.select("doc_id", "text"))
        return classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias("rows"))

    first = chunks.written_by(spark, ids, "first-ids")
    once = first.where("rows = 1").select(i).hint("merge")  # at every size alike: as many ids as documents
    kept = own.join(once, i, "left_semi").unionByName(own.where(F.col(i).isNull()))
    again = first.where("rows > 1").select(i)
    if not again.isEmpty():
        whole = F.struct(*own.columns)
        one_each = own.join(again, i, "left_semi").groupBy(i).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
        kept = kept.unionByName(one_each.select("row.*"))
    return chunks.restored(kept.select(*own.columns), docs)


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return _with_length(substring_dedup.trimmed(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _with_length(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences."""
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("substring_dedup", passages), ("secrets", redact), ("packing", pack)]

#: SQL can't express the tokens and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = chunks.written_by(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
