"""The whole training job: corpus, splits, features, cascade of two models, evaluation."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, metrics, splits
from ..operators.features import WindowFeatureBuilder
from ..operators.logistic import BinaryLogisticRegression, sparse_rows
from ..operators.naive_bayes import MulticlassNaiveBayes
from ..operators.tagging import base_category, cascade, flatten_targets
from ..sources.shared import cut

KEY = ["sentence_id", "token_idx"]


def labelled_corpus(spark: SparkSession, total: int = 1200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sentences with split, token rows with split, group, tag, category, is_pii)."""
    examples = splits.split(splits.keep_first(corpus.generate_examples(spark, total, seed)), seed=seed)
    examples = cut(examples)
    tokens = corpus.tagged_tokens(examples, strict=True).join(examples.select("sentence_id", "split", "group"), "sentence_id")
    tokens = tokens.withColumn("category", base_category("tag")).withColumn("is_pii", (F.col("category") != "O").cast("int"))
    return examples, cut(tokens)


def train_configuration(tokens: DataFrame, use_char_ngrams: bool, window_size: int = 2, max_iter: int = 600, learning_rate: float = 0.15) -> dict:
    """Fits the gate (logistic regression on TF-IDF) and the categories (naive Bayes on counts of PII tokens), predicts val and test."""
    began = time.time()
    builder = WindowFeatureBuilder(window_size=window_size, use_char_ngrams=use_char_ngrams)
    builder.fit(tokens.where("split = 'train'"))
    builder.vocabulary = cut(builder.vocabulary)
    n_columns = builder.vocabulary.count()
    counts = cut(builder.transform(tokens, "count"))
    weighted = counts.join(F.broadcast(builder.vocabulary.select("column", "idf")), "column").withColumn("value", F.col("value") * F.col("idf"))
    rows = sparse_rows(weighted, tokens.select(*KEY, "split", "is_pii"), KEY, "is_pii").join(tokens.select(*KEY, "split"), KEY)
    rows = cut(rows)
    gate = BinaryLogisticRegression(learning_rate=learning_rate, max_iter=max_iter).fit(rows.where("split = 'train'"), n_columns)
    pii = tokens.where("split = 'train' and is_pii = 1").select(*KEY, "category")
    bayes = MulticlassNaiveBayes().fit(counts, pii, KEY, builder.vocabulary)
    seconds = time.time() - began
    rest = tokens.where("split <> 'train'")
    said = gate.predict(rows.where("split <> 'train'")).select(*KEY, F.col("pred").alias("pred_pii"))
    kinds = bayes.predict(counts.join(rest.select(*KEY), KEY, "left_semi"), rest, KEY).withColumnRenamed("predicted", "pred_kind")
    predicted = cascade(rest.join(said, KEY).join(kinds, KEY), "pred_pii", "pred_kind")
    predicted = cut(predicted)
    return {"builder": builder, "counts": counts, "rows": rows, "gate": gate, "bayes": bayes, "predicted": predicted, "n_columns": n_columns, "training_seconds": seconds}


def tokens_of(sentences: DataFrame) -> DataFrame:
    """Token rows of sentences (sentence_id, tokens, tags, split, group), as training takes them."""
    rows = flatten_targets(sentences).join(sentences.select("sentence_id", "split", "group"), "sentence_id")
    return cut(rows.select(*KEY, "token", "tag", "category", "is_pii", "split", "group"))


def breakdown(predicted: DataFrame, split: str = "test") -> dict[str, DataFrame]:
    """Reports over all rows of a split and over each group."""
    return metrics.evaluate_bio(predicted.where(F.col("split") == split), by="group")


def library_comparison(spark: SparkSession, fitted: dict, tokens: DataFrame) -> DataFrame:
    """accuracy and f1 of both models and of Spark ML's on the same test rows, and their differences.

    The gate is scored by the f1 of PII; naive Bayes, on the rows that are PII,
    by the mean over categories. Spark ML's naive Bayes smooths priors too.
    """
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.linalg import Vectors, VectorUDT

    n = fitted["n_columns"]
    vector = F.udf(lambda columns, values: Vectors.sparse(n, columns, values), VectorUDT())
    rows = fitted["rows"].select(*KEY, "split", F.col("label").cast("double").alias("label"), vector("columns", "values").alias("features"))
    model = LogisticRegression(regParam=1e-6, maxIter=100, standardization=False).fit(rows.where("split = 'train'"))
    theirs = model.transform(rows.where("split = 'test'")).select(F.col("label").cast("int").alias("gold"), F.col("prediction").cast("int").alias("said"))
    ours = fitted["gate"].predict(fitted["rows"].where("split = 'test'")).select(F.col("label").alias("gold"), F.col("pred").alias("said"))

    pii = tokens.where("is_pii = 1").select(*KEY, "split", "category")
    names = [r["category"] for r in pii.where("split = 'train'").select("category").distinct().orderBy("category").collect()]
    known = F.array(*map(F.lit, names))
    counted = sparse_rows(fitted["counts"].join(pii.select(*KEY), KEY, "left_semi"), pii, KEY, "category").join(pii.select(*KEY, "split"), KEY)
    counted = cut(counted.select("split", F.col("label").alias("gold"), (F.array_position(known, F.col("label")) - 1).cast("double").alias("label"), vector("columns", "values").alias("features")))
    bayes = NaiveBayes(smoothing=1.0, modelType="multinomial").fit(counted.where("split = 'train'"))
    their_kinds = bayes.transform(counted.where("split = 'test'")).select("gold", F.element_at(known, F.col("prediction").cast("int") + 1).alias("said"))
    test = pii.where("split = 'test'")
    our_kinds = fitted["bayes"].predict(fitted["counts"].join(test.select(*KEY), KEY, "left_semi"), test, KEY).join(test, KEY).select(F.col("category").alias("gold"), F.col("predicted").alias("said"))

    def beside(name: str, ours: DataFrame, theirs: DataFrame, positive=None) -> DataFrame:
        a, b = (metrics.classification_scores(x, "gold", "said", positive=positive) for x in (ours, theirs))
        return a.select(F.lit(name).alias("model"), F.col("accuracy").alias("accuracy_own"), F.col("f1").alias("f1_own")).crossJoin(b.select(F.col("accuracy").alias("accuracy_library"), F.col("f1").alias("f1_library")))

    both = beside("logistic_regression_binary", ours, theirs, positive=1).union(beside("naive_bayes_category", our_kinds, their_kinds))
    return both.withColumn("accuracy_difference", F.abs(F.col("accuracy_own") - F.col("accuracy_library"))).withColumn("f1_difference", F.abs(F.col("f1_own") - F.col("f1_library")))
