"""JSON lines of labelled sentences, and result documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE = "text string, tokens array<string>, tags array<string>, `group` string"
SPLITS = ("train", "val", "test")


def read_sentences(spark: SparkSession, path: str, check_lengths: bool = True, schema: str = SENTENCE) -> DataFrame:
    """Labelled sentences; blank lines are skipped, bad JSON fails, and so do unequal numbers of tokens and tags when rows are read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not check_lengths:
        return rows
    bad = ~(F.size("tokens") == F.size("tags"))
    return rows.withColumn("tags", F.when(bad, F.raise_error(F.lit("tokens and tags differ in number"))).otherwise(F.col("tags")))


def write_sentences(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in a folder for each split where rows have one."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("split") if "split" in rows.columns else writer).json(path)


def write_splits(rows: DataFrame, folder: str) -> None:
    """``rows`` (split and the columns of a sentence) as ``folder``/train.jsonl and so on. Each is a folder of part files, which readers take like one file."""
    for name in SPLITS:
        rows.where(F.col("split") == name).select("text", "tokens", "tags", "group").write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}.jsonl")


def read_splits(spark: SparkSession, folder: str, check_lengths: bool = True) -> DataFrame:
    """The three splits of ``folder`` (files or folders of part files) as one table: sentence_id (by text, as the files have no ids), split and a sentence's columns."""
    rows = None
    for name in SPLITS:
        one = read_sentences(spark, f"{folder.rstrip('/')}/{name}.jsonl", check_lengths).withColumn("split", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select(F.xxhash64("text", "split").alias("sentence_id"), "text", "tokens", "tags", "group", "split")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one indented JSON document, in a folder of one part file."""
    report.coalesce(1).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """``document`` as one JSON file on any file system that Spark knows: folders made, two spaces of indent, no escapes, a line end at the end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write((json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode())
    out.close()
