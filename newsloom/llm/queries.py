"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import twins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    from newsloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that nearly repeat an earlier line of the corpus."""
    from newsloom.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    from newsloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding."""
    from newsloom.llm.ann import nearest_by_inner_product

    return nearest_by_inner_product(table(spark, sf_dir, "embeddings"))


def op5_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as AVI motion-JPEG and read back, as digests; feature: its shots as frames."""
    from newsloom.llm.avi_media import decode_avi, encode_avi

    back = decode_avi(encode_avi(table(spark, sf_dir, "documents")))
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_frame"].cast("string"), c["end_frame"].cast("string"))), ",")
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("clips:"), clips).alias("feature"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded under the multilingual byte-level vocabulary, as digests."""
    from newsloom.llm.byte_bpe import bpe_decode, bpe_encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and the token-efficiency test."""
    from newsloom.llm.secrets_scan import find_secrets, secret_digests

    found = find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secret_digests(found)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back along the verified chain of records."""
    from newsloom.llm.warc_archive import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens of the word vocabulary."""
    from newsloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 in 100 of their word 5-grams."""
    from newsloom.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as 16 codes of its parts, with its error and its label's."""
    from newsloom.llm.vector_codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids of the word vocabulary written to flat files in order of doc_id and read back by memory map."""
    from newsloom.llm.token_files import read_token_files, write_token_files
    from newsloom.shared import scratch_path

    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of the highest score for each benchmark item."""
    from newsloom.llm.lexical_search import search_documents

    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_ann": op4_ann,
    "op5_media_avi": op5_media_avi,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": twins.WARC,
    "op11_vector_codes": twins.vector_codes(),
    "op13_lexical_search": twins.lexical_search(),
}
