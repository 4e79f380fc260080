"""The stateless survey score over a stream, with late copies dropped by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumora.operators import survey


def score_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Scores each row as the batch does without its duplicate terms."""
    return survey.score(stream, text_col, duplicates=False)


def first_seen(stream: DataFrame, time_col: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows whose keys didn't come within the delay before."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
