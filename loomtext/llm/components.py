"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(e: DataFrame):
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _stars(e: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Each ``centre`` with its ``leaf`` and ``m``, the least of the centre and all its leaves.

    The minimum is a partial aggregate. The join back has a second key, so that
    both of its sides are dealt anew and adaptive execution may split the
    partition of a hub with many edges: no hub has to fit a task.
    """
    least = e.groupBy(centre).agg(F.min(leaf).alias("m")).withColumn("m", F.least("m", centre))
    hashed = lambda d: d.withColumn("k", F.xxhash64(centre))
    return hashed(e).join(hashed(least), [centre, "k"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` of every node that has an edge; the label is the least node of its component.

    Rows with a null end and loops are ignored; repeated edges count once. Node
    values may be of any type that Spark orders. Each round is a checkpoint, so
    the plan stays flat and a lost executor costs one round at most; rounds grow
    with the logarithm of the longest path. Only edge counts reach the driver.
    """
    there = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    e = cut(edges.where(there).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        large = _stars(both, "u", "v").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        small = _stars(large, "hi", "lo")
        e = cut(
            small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        )
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(e.select("lo", "lo").distinct())
