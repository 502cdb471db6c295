"""Evaluation of predicted against gold tags or labels, from one confusion count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagging import base_category, extract_spans

_RATIO = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))


def shape_errors(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Tokens (sentence_id, token_idx) that only one side has."""
    both = predicted.select("sentence_id", "token_idx", F.lit(1).alias("p")).join(gold.select("sentence_id", "token_idx", F.lit(1).alias("g")), ["sentence_id", "token_idx"], "full")
    return both.where("p is null or g is null")


def counted(rows: DataFrame, gold: str, predicted: str, by: str | None = None) -> DataFrame:
    """(part, gold, predicted, n); parts are overall and, with ``by``, each of its values. Values are counted before they are repeated."""
    keys = [F.col(by).alias("g")] if by else []
    n = rows.groupBy(*keys, F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    parts = F.explode(F.array(F.lit("overall"), F.col("g").cast("string"))) if by else F.lit("overall")
    return n.select(parts.alias("part"), "gold", "predicted", "n").groupBy("part", "gold", "predicted").agg(F.sum("n").alias("n"))


def label_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, support for each part and observed label."""
    each = F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("label")
    rows = counts.select("part", "gold", "predicted", "n", each)
    right, said, real = ((F.col("gold") == F.col("label")) & (F.col("predicted") == F.col("label"))), F.col("predicted") == F.col("label"), F.col("gold") == F.col("label")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    s = rows.groupBy("part", "label").agg(total(right).alias("tp"), total(said).alias("said"), total(real).alias("support"))
    s = s.withColumn("precision", _RATIO(F.col("tp"), F.col("said"))).withColumn("recall", _RATIO(F.col("tp"), F.col("support")))
    return s.withColumn("f1", _RATIO(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("part", "label", "precision", "recall", "f1", "support")


def averages(counts: DataFrame) -> DataFrame:
    """Per part: means over observed labels, f1 weighted by support, accuracy. Overall has a row even where nothing was counted: zeros."""
    s = label_scores(counts).groupBy("part").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("macro_f1"), _RATIO(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    right = counts.groupBy("part").agg(_RATIO(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return _with_overall(counts).join(s.join(right, "part"), "part", "left").na.fill(0.0)


def _with_overall(counts: DataFrame) -> DataFrame:
    """The parts of ``counts``, overall always among them."""
    return counts.select("part").union(counts.sparkSession.range(1).select(F.lit("overall"))).distinct()


def in_order(report: DataFrame, *labels: str, outside: str = "last") -> DataFrame:
    """``report`` sorted: overall before the other parts, then each of ``labels`` by name with O at the ``outside`` end (first or last)."""
    edge = lambda c: (F.col(c) != "O") if outside == "first" else (F.col(c) == "O")
    keys = [x for c in labels for x in (edge(c), F.col(c))]
    parts = [F.col("part") != "overall", F.col("part")] if "part" in report.columns else []
    return report.orderBy(*parts, *keys)


def confusion(counts: DataFrame) -> DataFrame:
    """The dense matrix of each part as rows (part, gold, predicted, n), zeros kept; O always belongs to it."""
    labels = counts.select("part", F.explode(F.array(F.lit("O"), "gold", "predicted")).alias("l")).distinct()
    grid = labels.withColumnRenamed("l", "gold").join(labels.withColumnRenamed("l", "predicted"), "part")
    return grid.join(counts, ["part", "gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def span_scores(predicted: DataFrame, gold: DataFrame, by: str | None = None) -> DataFrame:
    """Exact-span precision, recall and f1 of two sets of spans (sentence_id, start, end, label); with ``by``, a column of both, also of each of its values."""
    keys = ["sentence_id", "start", "end", "label", *([by] if by else [])]
    side = lambda d, p, g: d.select(*keys, F.lit(p).alias("p"), F.lit(g).alias("g"))
    spans = side(predicted, 1, 0).union(side(gold, 0, 1)).groupBy(*keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    parts = F.explode(F.array(F.lit("overall"), F.col(by).cast("string"))) if by else F.lit("overall")
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("p") * F.col("g"), "correct"), (F.col("p"), "predicted"), (F.col("g"), "gold"))]
    s = spans.select(parts.alias("part"), "p", "g").groupBy("part").agg(*sums)
    s = _with_overall(s).join(s, "part", "left").na.fill(0)
    s = s.withColumn("precision", _RATIO(F.col("correct"), F.col("predicted"))).withColumn("recall", _RATIO(F.col("correct"), F.col("gold")))
    return s.withColumn("f1", _RATIO(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate_bio(rows: DataFrame, predicted: str = "predicted", gold: str = "tag", by: str | None = None) -> dict[str, DataFrame]:
    """All reports of token rows with two tag columns, overall and for each value of ``by``.

    tokens (averages of whole tags), labels, categories (without O), spans,
    confusion of categories. Labels are those that a part has itself; ``in_order``
    sorts a report. ``by`` must be the same for all tokens of a sentence.
    """
    tags = counted(rows, gold, predicted, by)
    cats = counted(rows.withColumn("gc", base_category(gold)).withColumn("pc", base_category(predicted)), "gc", "pc", by)
    keep = (by,) if by else ()
    return {
        "tokens": averages(tags),
        "labels": label_scores(tags),
        "categories": label_scores(cats).where("label <> 'O'"),
        "spans": span_scores(extract_spans(rows, predicted, keep), extract_spans(rows, gold, keep), by),
        "confusion": confusion(cats),
    }


def evaluate_sequences(predicted: DataFrame, gold: DataFrame, by: str | None = None, tag: str = "tag") -> dict[str, DataFrame]:
    """``evaluate_bio`` of two tables of token rows (sentence_id, token_idx, tag; ``by`` in gold). Raises ValueError if a token is in one of them alone."""
    if shape_errors(predicted, gold).limit(1).count():
        raise ValueError("predicted and gold differ in sentences or in their lengths")
    keys = ["sentence_id", "token_idx"]
    rows = gold.select(*keys, F.col(tag).alias("gold"), *([by] if by else [])).join(predicted.select(*keys, F.col(tag).alias("said")), keys)
    return evaluate_bio(rows, "said", "gold", by)


def classification_scores(rows: DataFrame, gold: str, predicted: str, positive=None) -> DataFrame:
    """accuracy, and f1 of the positive label or the mean over all labels."""
    counts = counted(rows.select(F.col(gold).cast("string").alias("g"), F.col(predicted).cast("string").alias("p")), "g", "p")
    s = label_scores(counts)
    picked = s if positive is None else s.where(F.col("label") == str(positive))
    f1 = picked.groupBy("part").agg(F.avg("f1").alias("f1"))
    return averages(counts).select("part", "accuracy").join(f1, "part", "left").select("accuracy", F.coalesce("f1", F.lit(0.0)).alias("f1"))


STRUCTURED = ("PHONE_NUMBER", "EMAIL", "ACCOUNT_NUMBER", "FINANCIAL_INFORMATION")


def ablation(first: DataFrame, second: DataFrame, labels: tuple[str, ...] = STRUCTURED) -> DataFrame:
    """Per label the f1 of two reports (part, label, f1; overall rows) and their difference, 0 where a report lacks it, and a row of means."""
    base = first.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    side = lambda d, n: d.where("part = 'overall'").select("label", F.col("f1").alias(n))
    rows = base.join(side(first, "f1_first"), "label", "left").join(side(second, "f1_second"), "label", "left").na.fill(0.0)
    mean = rows.agg(F.lit("macro mean").alias("label"), F.avg("f1_first").alias("f1_first"), F.avg("f1_second").alias("f1_second"))
    return rows.select("label", "f1_first", "f1_second").union(mean).withColumn("delta", F.col("f1_second") - F.col("f1_first"))
