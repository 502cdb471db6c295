"""Row-local operators over streams: they keep no state, so a stream frame needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, correct_spelling, redact, treebank


def cleaned_stream(stream: DataFrame, text: str = "text", spell: bool = False) -> DataFrame:
    """``stream`` with cleaned, redacted and tokens (spelling corrected if asked for)."""
    out = stream.withColumn("cleaned", clean(text)).withColumn("redacted", redact("cleaned"))
    tokens = treebank(F.col("redacted"))
    return out.withColumn("tokens", correct_spelling(tokens) if spell else tokens)
