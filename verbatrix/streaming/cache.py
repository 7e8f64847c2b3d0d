"""Streaming form of the fetch cache: a pair of URL and limit is passed on once in five minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def distinct_requests(stream: DataFrame, time_col: str = "ts", lifetime: str = "5 minutes") -> DataFrame:
    """The requests (url, limit, time) of a stream without those that repeat within ``lifetime``.

    State is kept for as long as the watermark needs it; events that come later
    than ``lifetime`` are dropped.
    """
    rows = stream.withColumn("limit", t.normalize_limit(F.coalesce("limit", F.lit(0))))
    return rows.withWatermark(time_col, lifetime).dropDuplicatesWithinWatermark(["url", "limit"])
