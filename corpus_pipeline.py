"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of documents; a changed text has a new n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.line_dedup import dedup_lines
from newsloom.llm.ngram_join import drop_near_duplicates
from newsloom.llm.packing import pack_documents
from newsloom.llm.quality import drop_poor
from newsloom.llm.secrets_scan import find_secrets, redacted
from newsloom.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _rewritten(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """The documents whose texts `stage` rewrites, with a new n_chars where `changed` holds.

    Columns other than doc_id and text are renamed meanwhile, so that none clashes with those that the stage adds.
    """
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = stage(docs.select(*(F.col(c).alias(own.get(c, c)) for c in docs.columns)))
    size = F.when(F.expr(changed), F.length("text").cast("long")).otherwise(F.col(own["n_chars"]))
    return out.withColumn(own["n_chars"], size).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; those of which nothing is left go."""

    def stage(rows: DataFrame) -> DataFrame:
        return dedup_lines(rows, keep=tuple(rows.columns)).where(r"n_removed = 0 or text rlike '[^ \\t\\n\\x0B\\f\\r]'")

    return _rewritten(docs, stage, "n_removed > 0")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted."""

    def stage(rows: DataFrame) -> DataFrame:
        found = find_secrets(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=tuple(rows.columns))
        return found.withColumn("text", redacted(F.col("text"), F.col("spans")))

    return _rewritten(docs, stage, "size(spans) > 0")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL expresses none of the classifier, the joins or the packing within its limits; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
