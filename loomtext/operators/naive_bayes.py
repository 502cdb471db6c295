"""Multinomial naive Bayes over sparse rows (row keys, column, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class MulticlassNaiveBayes:
    """Priors are shares of rows, not smoothed; likelihoods are smoothed by ``alpha``."""

    alpha: float = 1.0
    priors: DataFrame | None = None
    likelihoods: DataFrame | None = None

    def __post_init__(self):
        if self.alpha <= 0:
            raise ValueError("alpha must be above 0")

    def fit(self, features: DataFrame, targets: DataFrame, key: list[str], columns: DataFrame) -> MulticlassNaiveBayes:
        """``features``: key, column, value (not negative); ``targets``: key, category; ``columns``: all columns. Features of rows without a target don't count."""
        if features.where("value < 0").limit(1).count():
            raise ValueError("values must not be negative")
        known = columns.select("column").distinct()
        if features.join(known, "column", "left_anti").limit(1).count():
            raise ValueError("features have columns that aren't among the columns")
        classes = targets.groupBy("category").agg(F.count("*").alias("n"))
        total = Window.partitionBy(F.lit(0))
        self.priors = classes.select("category", F.log(F.col("n") / F.sum("n").over(total)).alias("log_prior"))
        sums = features.join(targets, key).groupBy("category", "column").agg(F.sum("value").alias("s"))
        # classes x columns: the model itself
        grid = classes.select("category").crossJoin(known)
        s = F.coalesce("s", F.lit(0.0)) + self.alpha
        rows = grid.join(sums, ["category", "column"], "left").select("category", "column", s.alias("s"))
        self.likelihoods = rows.select("category", "column", F.log(F.col("s") / F.sum("s").over(Window.partitionBy("category"))).alias("log_prob"))
        return self

    def joint_log(self, features: DataFrame, rows: DataFrame, key: list[str], most_classes: int = 10_000) -> DataFrame:
        """key, category, score (not normalised) of all ``rows``, also those without features. More than ``most_classes`` classes raise ValueError."""
        if self.priors is None or self.likelihoods is None:
            raise RuntimeError("fit first")
        priors = self.priors.limit(most_classes + 1).collect()
        if len(priors) > most_classes:
            raise ValueError(f"more than {most_classes} classes")
        part = features.join(self.likelihoods, "column").groupBy(*key, "category").agg(F.sum(F.col("value") * F.col("log_prob")).alias("s"))
        every = F.array(*(F.struct(F.lit(r["category"]).alias("category"), F.lit(r["log_prior"]).alias("log_prior")) for r in priors))
        scores = rows.select(*key, F.explode(every).alias("x")).select(*key, "x.category", "x.log_prior")
        return scores.join(part, [*key, "category"], "left").select(*key, "category", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))

    def predict(self, features: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
        """key and predicted: the best score; of equal ones the first class in order."""
        best = F.min_by("category", F.struct(-F.col("score"), F.col("category")))
        return self.joint_log(features, rows, key).groupBy(*key).agg(best.alias("predicted"))
