"""A stream of tagged elements, classified by a rule file and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import classify


def classify_stream(elements: DataFrame, source: str, tag_of) -> DataFrame:
    """As classify(): rules keep no state between rows, so a stream needs none either."""
    return classify(elements, source, tag_of)


def counts_by_window(features: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """(window, type, n), complete once the watermark has passed a window."""
    return features.withWatermark(time, late).groupBy(F.window(time, width), "type").agg(F.count(F.lit(1)).alias("n"))
