"""BIO tags: categories, reconstruction, spans, validation. Rows are (sentence_id, token_idx, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order():
    return Window.partitionBy("sentence_id").orderBy("token_idx")


def base_category(tag) -> Column:
    """O for O; a tag without a dash itself; else what follows the first dash."""
    t = F.col(tag) if isinstance(tag, str) else tag
    return F.when(t == "O", "O").when(~t.contains("-"), t).otherwise(F.regexp_extract(t, "(?s)^[^-]*-(.*)$", 1))


def flatten_targets(sentences: DataFrame) -> DataFrame:
    """One row a token of (sentence_id, tokens, tags): token, tag, category, is_pii."""
    rows = sentences.select("sentence_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("token_idx", "x")).select("sentence_id", "token_idx", "x.tokens", "x.tags")
    rows = rows.withColumnsRenamed({"tokens": "token", "tags": "tag"}).withColumn("category", base_category("tag"))
    return rows.withColumn("is_pii", (F.col("category") != "O").cast("int"))


def unflatten(rows: DataFrame, value: str) -> DataFrame:
    """Token rows back to one array a sentence, in order."""
    got = F.array_sort(F.collect_list(F.struct("token_idx", F.col(value).alias("v"))))
    return rows.groupBy("sentence_id").agg(got.alias("x")).select("sentence_id", F.transform("x", lambda s: s["v"]).alias(value))


def categories_to_bio(rows: DataFrame, category: str = "category", outside: str = "O", out: str = "tag") -> DataFrame:
    """I- after the same category, B- otherwise; the outside label passes."""
    c = F.col(category)
    before = F.lag(c).over(_in_order())
    tag = F.when(c == outside, c).when(c.eqNullSafe(before), F.concat(F.lit("I-"), c)).otherwise(F.concat(F.lit("B-"), c))
    return rows.withColumn(out, tag)


def cascade(rows: DataFrame, gate: str, category: str) -> DataFrame:
    """The category where the gate is 1, else O, as BIO tags in ``predicted``."""
    return categories_to_bio(rows.withColumn("pred_category", F.when(F.col(gate) == 1, F.col(category)).otherwise("O")), "pred_category", out="predicted")


def extract_spans(rows: DataFrame, tag: str = "tag", keep: tuple[str, ...] = ()) -> DataFrame:
    """(sentence_id, start, end, label) of runs: a labelled token starts one unless it is I- of the label before it; ends are excluded. ``keep``: more columns of the sentence."""
    t = F.col(tag)
    label = F.when(t != "O", base_category(t))
    begins = label.isNotNull() & ~(t.startswith("I-") & label.eqNullSafe(F.lag("label").over(_in_order())))
    marked = rows.withColumn("label", label).withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(_in_order()))
    spans = marked.where("label is not null").groupBy("sentence_id", *keep, "island", "label").agg(F.min("token_idx").alias("start"), (F.max("token_idx") + 1).alias("end"))
    return spans.select("sentence_id", "start", "end", "label", *keep)


def bio_violations(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """(sentence_id, token_idx, error) of tags that break the grammar."""
    t = F.col(tag)
    label = F.when(t.contains("-"), base_category(t))
    before = F.lag(label).over(_in_order())
    error = F.when(t == "O", None).when(~t.contains("-"), "malformed tag").when(~t.startswith("B-") & ~t.startswith("I-"), "malformed prefix").when(t.startswith("I-") & ~label.eqNullSafe(before), "orphan")
    return rows.select("sentence_id", "token_idx", error.alias("error")).where("error is not null")


def align_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tags of tokens (sentence_id, token_idx, start, end) by entity spans (sentence_id, start, end, label) that overlap them; the first token of a span is B-.

    A token that overlaps two spans has a row for each; ``alignment_errors`` lists
    such tokens, and spans without a token, and ``aligned`` fails on either.
    """
    # own names: both tables may come from one, whose columns a join can't tell apart
    s = spans.select(F.col("sentence_id").alias("sid"), F.col("start").alias("s0"), F.col("end").alias("s1"), "label")
    rows = tokens.join(s, (F.col("sentence_id") == F.col("sid")) & (F.col("start") < F.col("s1")) & (F.col("end") > F.col("s0")), "left").drop("sid")
    nth = F.row_number().over(Window.partitionBy("sentence_id", "s0").orderBy("token_idx"))
    tag = F.when(F.col("label").isNull(), "O").otherwise(F.concat(F.when(nth == 1, "B-").otherwise("I-"), "label"))
    return rows.withColumn("tag", tag).drop("s0", "s1", "label")


def alignment_errors(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans that no token overlaps, and tokens that more than one span does: (sentence_id, error)."""
    t = tokens.select("sentence_id", "token_idx", F.col("start").alias("t0"), F.col("end").alias("t1"))
    s = spans.select(F.col("sentence_id").alias("sid"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    hit = (F.col("sentence_id") == F.col("sid")) & (F.col("t0") < F.col("s1")) & (F.col("t1") > F.col("s0"))
    lone = s.join(t, hit, "left_anti").select(F.col("sid").alias("sentence_id"), F.lit("entity without token").alias("error"))
    twice = t.join(s, hit).groupBy("sentence_id", "token_idx").count().where("count > 1").select("sentence_id", F.lit("overlapping entities").alias("error"))
    return lone.union(twice)


def aligned(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``align_spans``; raises ValueError if a span has no token or a token several spans."""
    if found := alignment_errors(tokens, spans).limit(1).collect():
        raise ValueError(f"{found[0]['error']} in sentence {found[0]['sentence_id']}")
    return align_spans(tokens, spans)


def sample(sentences: DataFrame, group: str, tag: str, key: str = "sentence_id") -> DataFrame:
    """The first sentence (group, tags, ...) of a group that has a tag; no row if there is none."""
    return sentences.where((F.col("group") == group) & F.array_contains("tags", tag)).orderBy(key).limit(1)
