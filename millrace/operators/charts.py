"""Music charts: plays joined with songs, counted, and the best of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(plays: DataFrame, songs: DataFrame, key: str) -> DataFrame:
    """Plays with their song's columns; plays without a song have nulls."""
    return plays.join(songs, key, "left")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int = 5, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank. Spark keeps only n rows of a group in each task
    before the shuffle, so a large group stays small."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def song_counts(plays: DataFrame, songs: DataFrame, min_duration: int = 30_000) -> DataFrame:
    """(song_id, genre, name, plays) of plays that lasted long enough."""
    long = plays.where(F.col("duration") >= min_duration).groupBy("song_id").agg(F.count("*").alias("plays"))
    return long.join(songs.withColumnRenamed("id", "song_id"), "song_id", "inner").select("song_id", F.lower("genre").alias("genre"), "name", "plays")


def music_charts(plays: DataFrame, songs: DataFrame, n: int = 5, min_duration: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """(charts by genre, overall chart): most plays first, ties by song id."""
    counts = song_counts(plays, songs, min_duration)
    order = [F.desc("plays"), F.asc("song_id")]
    overall = counts.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top_n(counts, ["genre"], order, n), overall
