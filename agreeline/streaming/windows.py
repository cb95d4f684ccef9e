"""The period counts of a stream: windowed, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, late: str, match: Column) -> DataFrame:
    """n and n_match of each window and group; rows later than ``late`` are left out. Works on a
    stream and, without the watermark's effect, on a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(match).alias("n_match"))
