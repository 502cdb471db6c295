"""Dedup by exact text, positional splits of shuffled groups, leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, text: str = "text", key: str = "sentence_id") -> DataFrame:
    """The row of the least key of each text. An aggregate finds it, so many copies of a text don't meet in a task."""
    first = rows.groupBy(text).agg(F.min(key).alias(key))
    return rows.join(first, [text, key], "left_semi").dropDuplicates([key])


def shuffled_place(seed: int, key: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def split(rows: DataFrame, by: str = "group", key: str = "sentence_id", seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """``rows`` with split: of each group in hash order the first round(n * train) train, then val, the rest test; halves round to even.

    Places come from ranges of the hash: each range's rows are counted, the
    counts of earlier ranges added to the places within a range. So no group,
    however large, is sorted in one task.
    """
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("train must be above 0, val 0 or more, and both leave some for the test split")
    marked = rows.withColumn("_h", shuffled_place(seed, key)).withColumn("_range", F.substring("_h", 1, 4))
    ranges = marked.groupBy(by, "_range").agg(F.count("*").alias("_m"))
    group = Window.partitionBy(by)
    ahead = F.coalesce(F.sum("_m").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), ahead.alias("_ahead"), F.sum("_m").over(group).alias("_n"))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_h", key))
    placed = marked.withColumn("_at", place).join(ranges, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    at, a, b = F.col("_at") + F.col("_ahead"), F.bround(F.col("_n") * F.lit(train), 0), F.bround(F.col("_n") * F.lit(val), 0)
    which = F.when(at <= a, "train").when(at <= a + b, "val").otherwise("test")
    return placed.withColumn("split", which).select(*rows.columns, "split")


def leakage(rows: DataFrame, text: str = "text") -> DataFrame:
    """Texts that lie in more than one split, or more than once: (text, splits, n)."""
    return rows.groupBy(text).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1 or n > 1")


def sizes(rows: DataFrame) -> DataFrame:
    """Sentences and tokens of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"))


def group_counts(rows: DataFrame, by: str = "group") -> DataFrame:
    return rows.groupBy("split", by).agg(F.count("*").alias("n"))
