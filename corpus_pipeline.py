"""A corpus cleaned and encoded in five stages, each an operator of the llm package over what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, containment, langid, lines, neardup
from spanloom.llm.common import materialise, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language stays undetermined: those without letters (null and empty ones among them), foreign ones, or those with
    evidence for several. Rows of equal id and text stay or go together; an empty table stays empty."""
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines but for their first document, and the documents of which they leave nothing, null and blank ones among
    them; n_chars, where there is such a column, follows. Repeated rows stay or go together; an empty table stays empty."""
    left = lines.drop_spread_lines(docs, counts=None).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least id; rows that share it stay together. Documents without words,
    null and empty texts among them, have no duplicates and stay; very long texts are compared whole; an empty table stays empty.

    The texts that the lines' removal left are compared first. A near copy that lost other lines than its original may no longer resemble
    it, so those that are left are compared once more by the texts in documents; rows whose id isn't there stay.
    """
    left = materialise(neardup.keep_one(docs))
    whole = table(spark, sf_dir, "documents").join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    copies = neardup.near_duplicates(whole.select("doc_id", "text")).where("not kept and doc_id <> component_id").select("doc_id").distinct()
    return left.join(materialise(copies), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, and those that share their id; null and empty texts hold none, very long ones are searched
    whole, repeated rows go together; an empty table, or no items, changes nothing."""
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each row, repeated ones too; a null text counts as empty, very long ones are encoded whole, an empty table gives an
    empty result."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("bpe", encode)]

#: Language identification has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
