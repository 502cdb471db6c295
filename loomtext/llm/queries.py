"""Queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed, media, mixing, packing, pii, quality, simhash, substring, warc
from .common import bounded_batches, cut, read


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts go to Python workers, so batches are bounded."""
    bounded_batches(spark)
    return read(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), window=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), capacity=2048)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op6_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = cut(simhash.fingerprints(_documents(spark, sf_dir), shingle=3, words=1))
    # the bytes are little-endian: the digits are the reversed bytes
    digits = F.lower(F.concat(*(F.hex(F.substring("fp", i, 1)) for i in range(8, 0, -1))))
    return simhash.near_duplicates(fps).select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.protected_spans(_documents(spark, sf_dir)))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = chat.turns_of_table(read(spark, sf_dir, "conversations")).unionByName(chat.turns_of_table(extra))
    return chat.read_back(chat.format_turns(turns))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit_pages(pages, warc.rotten(pages))


_QUERIES = (
    op1_substring_dedup, op2_quality, op3_source_mix, op4_best_fit_packing, op5_embedding_dedup,
    op6_media_column, op7_simhash, op8_pii, op9_chat_format, op10_warc_audit,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": mixing.oracle(), "op10_warc_audit": warc.oracle()}
