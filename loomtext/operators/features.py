"""Context-window features of tokens: words, offsets, character n-grams, shapes; vocabulary and weights.

Tokens come as rows (sentence_id, token_idx, token), or as sentences (sentence_id,
tokens), which spares gathering them; a column ``low`` spares lowering them. Document frequency is counted by word:
features are named once for each different word of a batch, not for each token.
Rows of features are column numbers, made from whole sentences in Arrow
batches; nothing but the tokens is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ORTHOGRAPHIC, char_ngrams, orthographic, words


def _in_order():
    return Window.partitionBy("sentence_id").orderBy("token_idx")


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(sentence_id, tokens, low) of white-space tokens, ``low`` in lower case. The table is dealt out first: one file must not mean one task."""
    rows = docs.select(F.col(key).alias("sentence_id"), F.col(text).alias("text"))
    rows = rows.repartition(partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sentence_id")
    return rows.select("sentence_id", words("text").alias("tokens"), words(F.lower("text")).alias("low"))


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(sentence_id, token_idx, token) of white-space tokens."""
    return _rows(sentence_rows(docs, key, text, partitions))


def _rows(tokens: DataFrame) -> DataFrame:
    """Token rows of either form."""
    return tokens.select("sentence_id", F.posexplode("tokens").alias("token_idx", "token")) if "tokens" in tokens.columns else tokens


def _sentences(tokens: DataFrame) -> DataFrame:
    """(sentence_id, low) of either form, and the given numbers of the tokens, ``at``, if there are any."""
    if "tokens" in tokens.columns:
        return tokens.select("sentence_id", "low" if "low" in tokens.columns else F.transform("tokens", F.lower).alias("low"))
    rows = tokens.select("sentence_id", F.struct("token_idx", F.lower("token").alias("low")).alias("x"))
    return rows.groupBy("sentence_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("sentence_id", "x.low", F.col("x.token_idx").alias("at"))


def _coded(batches: Iterator[pa.RecordBatch], most: int = 1 << 18):
    """(rows, different words, codes, places from the start and from the end, sentences) of runs of sentences with about ``most`` tokens. A null's code is the number of words."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("low")).fill_null(0).to_numpy().astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + most, "right")))
            part, own = batch.slice(begin, end - begin), sizes[begin:end]
            begin = end
            coded = part.column("low").flatten().dictionary_encode()
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            yield part, coded.dictionary, codes, place, np.repeat(own, own) - 1 - place, np.repeat(np.arange(len(own)), own)


def _names(window: int, ngrams: tuple[int, int] | None):
    """An array of a token's feature names, repeats included."""
    low = F.lower("token")
    at = {o: low if o == 0 else F.lag(low, -o).over(_in_order()) for o in range(-window, window + 1)}
    out = []
    for o, t in at.items():
        out += [F.concat(F.lit("word="), t), F.concat(F.lit(f"offset={o:+d}:word="), t)]
    names = F.filter(F.array(*out), lambda x: x.isNotNull())
    return F.concat(names, char_ngrams("token", *ngrams)) if ngrams else names


def family(name="feature"):
    return F.when(F.col(name).startswith("char"), "char").when(F.col(name).startswith("ortho:"), "ortho").otherwise("word")


@dataclass
class WindowFeatureBuilder:
    """fit() learns the vocabulary, transform() gives (sentence_id, token_idx, column, feature, value)."""

    window_size: int = 2
    use_char_ngrams: bool = False
    char_ngram_range: tuple[int, int] = (3, 4)
    min_frequency: int = 2
    max_word_features: int = 2500
    max_char_features: int = 2500
    vocabulary: DataFrame | None = None

    def __post_init__(self):
        if self.window_size < 0:
            raise ValueError("window_size must be 0 or more")
        low, high = self.char_ngram_range
        if not 1 <= low <= high:
            raise ValueError("char_ngram_range must be rising and from 1 on")

    def names(self, tokens: DataFrame) -> DataFrame:
        ngrams = self.char_ngram_range if self.use_char_ngrams else None
        return _rows(tokens).select("sentence_id", "token_idx", "token", _names(self.window_size, ngrams).alias("names"))

    def _by_word(self, tokens: DataFrame) -> DataFrame:
        """(low, near, one column for each offset): rows whose window holds a lower-cased token, and those that have it at the offset.

        A token counts at offset o for the row o before it, if there is one, and within the window for
        those of the 2 * window_size + 1 rows around it that the same token before it doesn't reach.
        """
        w = self.window_size
        names = ["near", *(f"at{o:+d}" for o in range(-w, w + 1))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, known, codes, before, after, _ in _coded(batches):
                former = np.full(len(codes), 2 * w + 1)
                for k in range(2 * w, 0, -1):
                    former[k:][(codes[k:] == codes[:-k]) & (before[k:] >= k)] = k
                near = np.maximum(0, np.minimum(after, w) + 1 + np.minimum(np.minimum(before, w), former - w - 1))
                count = lambda x: pa.array(np.bincount(codes, x, len(known))[: len(known)].astype(np.int64))  # noqa: B023, E731
                at = [count(before >= o if o > 0 else after >= -o) for o in range(-w, w + 1)]
                yield pa.RecordBatch.from_arrays([known, count(near), *at], ["low", *names])

        rows = _sentences(tokens).select("low").mapInArrow(run, "low string, " + ", ".join(f"`{c}` bigint" for c in names))
        return rows.groupBy("low").agg(*(F.sum(f"`{c}`").alias(c) for c in names))

    def document_frequency(self, tokens: DataFrame) -> DataFrame:
        """(feature, df): tokens whose bag holds the feature."""
        by_word, w = self._by_word(tokens).where("low is not null"), self.window_size
        named = [("word=", "near"), *((f"offset={o:+d}:word=", f"at{o:+d}") for o in range(-w, w + 1))]
        each = F.array(*(F.struct(F.concat(F.lit(name), F.col("low")).alias("feature"), F.col(f"`{c}`").alias("df")) for name, c in named))
        df = by_word.select(F.explode(each).alias("x")).select("x.*").where("df > 0")
        if self.use_char_ngrams:
            grams = by_word.select(F.explode(F.array_distinct(char_ngrams("low", *self.char_ngram_range))).alias("feature"), F.col("`at+0`").alias("n"))
            df = df.unionByName(grams.groupBy("feature").agg(F.sum("n").alias("df")))
        return df

    def fit(self, tokens: DataFrame) -> WindowFeatureBuilder:
        """vocabulary: feature, column, family, df, idf. The most frequent of each family, ties by name; then the shapes."""
        n = tokens.agg(F.sum(F.array_size("tokens"))).first()[0] or 0 if "tokens" in tokens.columns else tokens.count()
        df = self.document_frequency(tokens).where(F.col("df") >= self.min_frequency).withColumn("family", family())
        # tasks keep their best rows only, so no family's tail travels
        best = lambda name, k: df.where(F.col("family") == name).orderBy(F.col("df").desc(), "feature").limit(k)
        # the driver gets max_word_features + max_char_features rows at most, once for all uses
        top = best("word", self.max_word_features).collect()
        if self.use_char_ngrams:
            top += best("char", self.max_char_features).collect()
        shapes = [(name, 0, "ortho") for name in ORTHOGRAPHIC]
        rows = tokens.sparkSession.createDataFrame([(*r, i) for i, r in enumerate([*top, *shapes])], "feature string, df bigint, family string, column int")
        idf = F.when(F.col("family") == "ortho", 1.0).otherwise(F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
        self.vocabulary = rows.select("feature", "column", "family", "df", idf.alias("idf"))
        return self

    def _words(self, tokens: DataFrame) -> DataFrame:
        """(sentence_id, token_idx, column, value) of words."""
        w, index, columns = self.window_size, {}, []
        for r in self.vocabulary.where("family = 'word'").select("feature", "column").collect():
            offset, word = re.fullmatch("(?s)(?:offset=([+-][0-9]+):)?word=(.*)", r["feature"]).groups()
            columns.append((index.setdefault(word, len(index)), 0 if offset is None else int(offset) + w + 1, r["column"]))
        table = np.full((len(index) + 1, 2 * w + 2), -1, np.int32)
        for row, slot, column in columns:
            table[row, slot] = column
        shared = tokens.sparkSession.sparkContext.broadcast((index, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, table = shared.value
            for part, known, codes, before, after, sentence in _coded(batches):
                own = table[np.array([index.get(x, -1) for x in known.to_pylist()] + [-1])][codes]

                def moved(slot: int, o: int) -> np.ndarray:
                    x, out = own[:, slot], np.full(len(own), -1, np.int32)  # noqa: B023
                    if o >= 0:
                        out[: max(0, len(x) - o)] = x[o:]
                        out[after < o] = -1  # noqa: B023
                    else:
                        out[-o:] = x[:o]
                        out[before < -o] = -1  # noqa: B023
                    return out

                found = []
                for o in range(-w, w + 1):
                    x = moved(o + w + 1, o)
                    rows = np.flatnonzero(x >= 0)
                    found.append((rows, x[rows], np.ones(len(rows))))
                near = [moved(0, o) for o in range(-w, w + 1)]
                for i, x in enumerate(near):
                    first = x >= 0
                    for y in near[:i]:
                        first &= x != y
                    rows = np.flatnonzero(first)
                    found.append((rows, x[rows], sum((y[rows] == x[rows]).astype(float) for y in near)))
                rows, column, value = map(np.concatenate, zip(*found, strict=True))
                at = part.column("at").flatten().take(pa.array(rows)) if "at" in part.schema.names else pa.array(before[rows].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("sentence_id").take(pa.array(sentence[rows])), at, pa.array(column), pa.array(value)], ["sentence_id", "token_idx", "column", "value"])

        kinds = dict(_rows(tokens).dtypes)
        return _sentences(tokens).mapInArrow(run, f"sentence_id {kinds['sentence_id']}, token_idx {kinds['token_idx']}, column int, value double")

    def transform(self, tokens: DataFrame, weighting: str = "count", shapes: bool = True) -> DataFrame:
        """(sentence_id, token_idx, column, feature, value); without ``shapes`` those of words and character n-grams only."""
        if self.vocabulary is None:
            raise RuntimeError("fit first")
        if weighting not in ("count", "tfidf"):
            raise ValueError("weighting is count or tfidf")
        # the vocabulary holds max_word_features + max_char_features + 6 rows at most
        key, known = ["sentence_id", "token_idx"], F.broadcast(self.vocabulary.select("feature", "column", "idf"))
        rows, tokens = self._words(tokens).join(known, "column"), _rows(tokens)
        if self.use_char_ngrams:
            grams = tokens.select(*key, char_ngrams("token", *self.char_ngram_range).alias("grams"))
            grams = grams.select(*key, "grams", F.explode(F.array_distinct("grams")).alias("feature")).join(known, "feature")
            value = F.size("grams") - F.size(F.array_remove("grams", F.col("feature")))
            rows = rows.unionByName(grams.select(*key, "feature", "column", "idf", value.cast("double").alias("value")))
        if shapes:
            x = tokens.select(*key, *orthographic("token"))
            x = x.select(*key, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in ORTHOGRAPHIC))).alias("x")).select(*key, "x.feature", "x.value")
            rows = rows.unionByName(x.where("value <> 0").join(known, "feature"))
        value = F.col("value") * F.col("idf") if weighting == "tfidf" else F.col("value")
        return rows.select(*key, "column", "feature", value.alias("value"))

    def fit_transform(self, tokens: DataFrame, weighting: str = "count", shapes: bool = True) -> DataFrame:
        return self.fit(tokens).transform(tokens, weighting, shapes)
