"""Quality by compression: zstandard dictionaries of good and bad text.

A text is compressed with a dictionary of good texts and with one of bad texts.
The difference of the two sizes, normalised by their sum, is all that a score
depends on: a logistic calibration, rising with it, makes it a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, table

THRESHOLD = 0.7
_LEVEL = 7


def held_out(doc_id="doc_id"):
    """Rows that nothing is learnt from: crc32 of the id's digits leaves 2 modulo 4. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the calibration: a score is the logistic of ``base`` + ``slope`` * difference."""

    good: bytes
    bad: bytes
    base: float
    slope: float

    def scorer(self):
        good, bad = (_compressor(d) for d in (self.good, self.bad))

        def score(texts: list[bytes]) -> np.ndarray:
            return _logistic(self.base + self.slope * _differences(texts, good, bad))

        return score


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of raw content: whole texts in turn, each as long as there is room for it."""
    out, room = [], size
    for t in texts:
        if len(t) < room:
            out.append(t)
            room -= len(t) + 1
    return b"\n".join(out)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:  # the least that the format takes
        return zstandard.ZstdCompressor(level=_LEVEL)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=data)


def _differences(texts: list[bytes], good, bad) -> np.ndarray:
    """How much smaller each text is with the good dictionary than with the bad one, as a share of both sizes."""
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        g, b = len(good.compress(t)), len(bad.compress(t))
        out[i] = (b - g) / (b + g)
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(d: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Base and slope of the logistic curve of ``y`` over ``d``, by Newton steps, halved until the loss falls. The slope is 0 at least."""
    centre, scale = d.mean(), max(d.std(), 1e-9)
    x = np.column_stack([np.ones(len(d)), (d - centre) / scale])

    def loss(w):
        z = np.clip(x @ w, -30, 30)
        return np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w

    w = np.zeros(2)
    for _ in range(60):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * w)
        now, k = loss(w), 1.0
        while k > 1e-4 and loss(w - k * step) > now:
            k /= 2
        w = w - k * step
        if np.abs(k * step).max() < 1e-9:
            break
    if w[1] < 0:
        return _base(y), 0.0
    return float(w[0] - w[1] * centre / scale), float(w[1] / scale)


def _base(y: np.ndarray) -> float:
    share = (y.sum() + 1) / (len(y) + 2)
    return math.log(share / (1 - share))


def train(docs: DataFrame, labels: DataFrame, dictionary_rows: int = 1500, calibration_rows: int = 4000, dictionary_bytes: int = 1 << 19, row_bytes: int = 1 << 13, check_bytes: int = 1 << 16) -> Model:
    """A model from a bounded sample of labelled rows.

    ``labels`` has doc_id and quality (0 or 1; others and nulls are left out).
    Of the rows that aren't held out, three quarters may serve for dictionaries
    and one quarter for calibration, by other bits of the same checksum. The
    sample is the first ``dictionary_rows`` of each class and the first
    ``calibration_rows`` in order of a hash of the id, without texts of over
    ``row_bytes`` and ``check_bytes`` bytes; of rows that share an id, the text
    that is first in order counts. So at most 2 * 1500 * 8 kB + 4000 * 64 kB reach
    the driver. Without rows of both classes the model gives every text the same
    score.
    """
    part = F.shiftright(F.crc32(F.col("doc_id").cast("string").cast("binary")), 8) % 4
    pool = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"), (part == 0).alias("check"), F.xxhash64("doc_id").alias("h")).distinct()
    first = lambda rows, n: rows.orderBy("h", "doc_id", "quality").limit(n)
    chosen = first(pool.where("check"), calibration_rows)
    for q in (0, 1):
        chosen = chosen.union(first(pool.where(~F.col("check") & (F.col("quality") == q)), dictionary_rows))
    # bounded by the parameters above, whatever the input: each sampled id has one text
    most = F.when(F.col("check"), check_bytes).otherwise(row_bytes)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= check_bytes).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= most)
    rows = rows.groupBy("h", "doc_id", "quality", "check").agg(F.min("text").alias("text"))
    sample = sorted((r["h"], r["doc_id"], r["quality"], r["check"], r["text"].encode()) for r in rows.collect())
    good, bad = (_dictionary([t for _, _, quality, check, t in sample if quality == q and not check], dictionary_bytes) for q in (1, 0))
    y = np.array([q for _, _, q, c, _ in sample if c], float)
    if len({*y}) < 2:
        return Model(good, bad, _base(y), 0.0)
    return Model(good, bad, *_calibrated(_differences([t for *_, c, t in sample if c], _compressor(good), _compressor(bad)), y))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, score (0 to 1) and predicted (1 from ``THRESHOLD`` on).

    Only the text counts, whole; a null is scored as an empty text. Null ids and
    repeated rows come back as given, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            s = score([t or b"" for t in b.column(len(names)).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*names, "score"])

    kinds = dict(rows.dtypes)
    out = rows.transform(map_in_arrow, run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", score double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
