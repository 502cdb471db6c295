"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``documents``. ``run`` writes each stage's
rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import mixing, packing, pii, quality, simhash
from loomtext.llm.common import bounded_batches, read, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of ``docs``."""
    bounded_batches(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    bounded_batches(spark)
    return simhash.distinct_documents(docs.select(*COLUMNS))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it."""
    bounded_batches(spark)
    return pii.sanitised_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row for each document and pass that takes any of it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048; text_hash tells the texts of a document's passes apart. Workers that ran the other stages too keep few words in mind."""
    bounded_batches(spark)
    return packing.pack_documents(docs, capacity=2048, text_hash=True, remember=100_000)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", sanitise),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]
#: Compression, fingerprints and tokens aren't SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
