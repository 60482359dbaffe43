"""Exact deduplication of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, text: str = "text", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The stream without texts that came before.

    With a time column state is kept for the delay only: a copy that comes later than that passes.
    Without one the state holds a digest of every text for good. Null texts all pass as one.
    """
    named = stream.withColumn("text_digest_", F.sha2(text, 256))
    if time is None:
        return named.dropDuplicates(["text_digest_"]).drop("text_digest_")
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_digest_"]).drop("text_digest_")
