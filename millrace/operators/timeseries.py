"""Time series: stepped range queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_query(points: DataFrame, start: Column, end: Column, step_s: int, lookback_s: int = 300, series: list[str] = (), ts: str = "ts", value: str = "value", tie: list[str] = ()) -> DataFrame:
    """(series, step_ts, value): at each step the newest point at most lookback_s old; steps without one are absent.

    A point is sent to the few steps that it can serve, ceil(lookback / step) of them at most, and each step takes its
    newest: an aggregation with map-side combine instead of a range join.
    """
    first, last, at = (F.unix_timestamp(c) for c in (start.cast("timestamp"), end.cast("timestamp"), F.col(ts).cast("timestamp")))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    low = F.ceil((micros - first * 1_000_000) / (step_s * 1_000_000))
    high = F.floor((micros - first * 1_000_000 + lookback_s * 1_000_000) / (step_s * 1_000_000))
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.floor((last - first) / step_s))
    near = points.where(F.col(value).isNotNull() & (at >= first - lookback_s - 1) & (at <= last)).where(low <= high)
    steps = near.select(*series, F.explode(F.sequence(low, high)).alias("_i"), micros.alias("_at"), F.col(value).alias("_v"), *tie)
    newest = steps.groupBy(*series, "_i").agg(F.max_by("_v", F.struct("_at", *tie)).alias("value"))
    return newest.select(*series, F.timestamp_seconds(first + F.col("_i") * step_s).alias("step_ts"), "value")
