"""Time windows and row-to-row state, as window functions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_range(ticks: DataFrame, width: str = "9 seconds", ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Minimum, maximum and range of bid and ask prices and the elapsed whole seconds, per tumbling window and symbol.
    Works on batches and on streams with a watermark on ts."""
    w = ticks.groupBy(F.window(ts, width).alias("w"), F.col(symbol).alias("symbol"))
    out = w.agg(
        F.min("bid_price").alias("min_bid_price"), F.max("bid_price").alias("max_bid_price"), F.min("ask_price").alias("min_ask_price"), F.max("ask_price").alias("max_ask_price"),
        F.min(ts).alias("_first"), F.max(ts).alias("_last"),
    )
    return out.select(
        F.col("w.start").alias("window_start"), "symbol",
        (F.col("max_bid_price") - F.col("min_bid_price")).alias("change_bid_price"), (F.col("max_ask_price") - F.col("min_ask_price")).alias("change_ask_price"),
        "min_bid_price", "max_bid_price", "min_ask_price", "max_ask_price",
        F.timestamp_diff("SECOND", F.col("_first"), F.col("_last")).alias("time_interval"),
    )


def login_audit(logs: DataFrame, width: str = "30 seconds", ts: str = "ts", action: str = "login") -> DataFrame:
    """Logins, distinct addresses and last login per user and tumbling window. A stream is counted in two steps, so that its state has a row of
    counts for each address of a window instead of a set for each window; windows come out in append mode, once the watermark has passed them."""
    rows = logs.where(F.col("action") == action)
    if logs.isStreaming:
        each = rows.groupBy(F.window(ts, width).alias("w"), "user_id", "source_ip").agg(F.count("*").alias("n"), F.max(ts).alias("last"))
        w = each.groupBy(F.window(F.window_time("w"), width).alias("w"), "user_id").agg(F.sum("n").alias("login_attempts"), F.count("source_ip").alias("distinct_ips"), F.max("last").cast("string").alias("time_since_last_login"))
    else:
        w = rows.groupBy(F.window(ts, width).alias("w"), "user_id").agg(F.count("*").alias("login_attempts"), F.count_distinct("source_ip").alias("distinct_ips"), F.max(ts).cast("string").alias("time_since_last_login"))
    return w.select(F.col("w.start").alias("window_start"), "user_id", "login_attempts", "distinct_ips", "time_since_last_login")


def suspicious_logins(logins: DataFrame, audit: DataFrame, key: str = "user_id") -> DataFrame:
    """Logins of users whose audit row has several addresses; logins may be a stream."""
    return logins.join(audit.where(F.col("distinct_ips") > 1), key, "inner")


def _slices(df: DataFrame, order: str, slices: int) -> Column:
    """The number of the slice of an order column that a row falls in: slices of about as many rows, between quantiles of the whole column; nulls are before all."""
    kind = dict(df.dtypes)[order]
    value = F.col(order).cast("timestamp").cast("double") if kind in ("timestamp", "date", "timestamp_ntz") else F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000).alias("c")).first()["c"] if slices > 1 else None
    place = F.lit(0)
    for i, c in enumerate(sorted(set(cuts or []))):
        place = F.when(value > c, i + 1).otherwise(place)
    return F.when(value.isNull(), -1).otherwise(place)


def consecutive_breach(df: DataFrame, key: str, ts: str | list[str], value: Column | str, limit: int, threshold: int, slices: int = 16) -> DataFrame:
    """Adds counter (breaches in a row up to this row) and fires (counter >= threshold). A breach is a truncated value below
    the limit; null and NaN are none.

    A key's rows are taken in slices of the first order column, so that a key with very many rows is several tasks'. Each slice
    counts on its own and is summed up as (rows, breaches at its end); in order, these tell how many breaches reach into the next slice, where the rows
    before the first one that is no breach add them. The order columns need one order for numbers and times; equal rows of it stay in one slice.
    """
    order = [ts] if isinstance(ts, str) else ts
    value = F.col(value) if isinstance(value, str) else value
    sliced = dict(df.dtypes)[order[0]] not in ("string", "boolean", "binary")
    breach = F.coalesce((value.cast("long") < limit) & ~F.isnan(value.cast("double")), F.lit(False))
    rows = df.withColumn("_b", breach).withColumn("_slice", _slices(df, order[0], slices) if sliced else F.lit(0))
    own = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The place of the last row that is no breach: what lies behind it is the run.
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))).withColumn("_stop", F.max(F.when(~F.col("_b"), F.col("_at")).otherwise(0)).over(own))
    ends = placed.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), "_at", "_stop").groupBy("_key", "_of").agg(F.max("_at").alias("_n"), F.max("_stop").alias("_last"))
    # Within a key: slices that are breaches throughout add up behind the last one that isn't.
    across = Window.partitionBy("_key").orderBy("_of")
    summed = ends.withColumn("_block", F.sum((F.col("_last") > 0).cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_n") - F.col("_last")).over(Window.partitionBy("_key", "_block").orderBy("_of").rowsBetween(Window.unboundedPreceding, 0))
    carried = summed.withColumn("_run", run).withColumn("_carry", F.coalesce(F.lag("_run").over(across), F.lit(0))).select("_key", "_of", "_carry")
    joined = placed.join(carried, placed[key].eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    counter = F.col("_at") - F.col("_stop") + F.when(F.col("_stop") == 0, F.col("_carry")).otherwise(0)
    return joined.withColumn("counter", counter.cast("long")).withColumn("fires", F.col("counter") >= threshold).select(*df.columns, "counter", "fires")


def detect_change(df: DataFrame, key: str, ts: str, members: str) -> DataFrame:
    """Adds change: 'first', 'same', 'changed' (as many members, but others) or 'resized'."""
    w = Window.partitionBy(key).orderBy(ts)
    now = F.array_sort(F.array_distinct(F.col(members)))
    before = F.lag(now).over(w)
    state = F.when(before.isNull(), "first").when(F.size(before) != F.size(now), "resized").when(before != now, "changed").otherwise("same")
    return df.withColumn("change", state)


def growth_flag(first: DataFrame, second: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Both counts of each key and whether they differ."""
    a, b = first.select(*keys, F.col(count).alias("count1")), second.select(*keys, F.col(count).alias("count2"))
    return a.join(b, keys).withColumn("growing", F.col("count1") != F.col("count2"))


def retain_latest(df: DataFrame, partition: str, n: int) -> DataFrame:
    """Rows of the newest n values of a partition column. The n values are few, so they are broadcast."""
    newest = df.select(partition).distinct().orderBy(F.desc(partition)).limit(n)
    return df.join(F.broadcast(newest), partition, "left_semi")


def chunk(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Adds the number of the chunk of n rows that each row of a key falls in."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / n))


def heartbeat_health(df: DataFrame, max_gap_ms: int, span_ms: int = 3_600_000) -> DataFrame:
    """Per source and target: number of beats, the largest gap, the last beat, and whether the gap stays within max_gap_ms.

    Gaps are taken within spans of time first and then between them, so that a pair with many beats isn't one task's.
    """
    pair = ["source", "target"]
    spans = df.withColumn("span", F.floor(F.col("ts") / span_ms))
    gaps = spans.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy(*pair, "span").orderBy("ts")))
    each = gaps.groupBy(*pair, "span").agg(F.count("*").alias("beats"), F.max("gap").alias("inside"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    between = each.withColumn("outside", F.col("first") - F.lag("last").over(Window.partitionBy(*pair).orderBy("span")))
    largest = F.coalesce(F.max(F.greatest("inside", "outside")), F.lit(0))
    out = between.groupBy(*pair).agg(F.sum("beats").alias("beats"), largest.alias("largest_gap"), F.max("last").alias("last_ts"))
    return out.withColumn("healthy", F.col("largest_gap") <= max_gap_ms)
