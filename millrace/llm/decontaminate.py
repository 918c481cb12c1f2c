"""Operator 6: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each window of an item is a set of (word, place) tokens. Tokens are ordered by how rare their word is
in the documents. Containment must be whole, so the prefix that two sets have to share is one token: the
rarest. Document words are joined with these tokens alone; a candidate must lie within the document
(length and positional bounds), and then its words are compared with the window's, one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared_files import stored

#: Windows that may be broadcast with their words; beyond that the words are shuffled.
BROADCAST_WINDOWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every byte that isn't part of a word, after lower-casing.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only); none for a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, at, window): all windows of size words; a shorter item that has words is one window."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", "at", F.slice("w", F.col("at") + 1, F.lit(size)).alias("window"))


def anchors(documents: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(word, j, item_id, window): for each window its word that is rarest in the documents, and the word's place
    in the window. A window with a word that no document has can't occur and is left out."""
    tokens = windows.select("item_id", "at", "window", F.posexplode("window").alias("j", "word"))
    vocabulary = tokens.select("word").distinct()
    spoken = documents.select(F.explode("w").alias("word"))
    counts = spoken.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarity = Window.partitionBy("item_id", "at").orderBy("n", "word", "j")
    whole = Window.partitionBy("item_id", "at")
    ranked = tokens.join(counts, "word", "left").withColumn("r", F.row_number().over(rarity)).withColumn("absent", F.max(F.col("n").isNull().cast("int")).over(whole))
    return ranked.where((F.col("r") == 1) & (F.col("absent") == 0)).select("word", "j", "item_id", "window").distinct()


def hits(documents: DataFrame, marks: DataFrame, small: bool) -> DataFrame:
    """(key, n_words, start, len, item_id, rows): every occurrence, and rows without an item, whose ``rows`` add up to the rows of the key."""
    inside = (F.col("pos") >= F.col("j")) & (F.col("pos") - F.col("j") + F.size("window") <= F.col("n_words"))
    same = F.slice("w", F.col("pos") - F.col("j") + 1, F.size("window")) == F.col("window")
    start = (F.col("pos") - F.col("j")).alias("start")
    length = F.size("window").alias("len")
    if small:
        spoken = documents.select("key", "n_words", "w", F.posexplode_outer("w").alias("pos", "word"))
        found = spoken.join(F.broadcast(marks.withColumnRenamed("word", "anchor")), (F.col("word") == F.col("anchor")) & inside & same, "left")
        # Each row is a key of its own here.
        return found.where(F.col("item_id").isNotNull() | F.coalesce(F.col("pos"), F.lit(0)).eqNullSafe(0)).select("key", "n_words", start, length, "item_id", F.lit(1).alias("rows"))
    spoken = documents.select("key", "n_words", F.posexplode("w").alias("pos", "word"))
    candidates = spoken.join(marks, "word").where(inside).select("key", "pos", "j", "window", "item_id").distinct()
    texts = documents.select("key", "w")
    found = candidates.join(texts, "key").where(same).select("key", start, length, "item_id")
    none = F.lit(None)
    headers = documents.select("key", "n_words", none.cast("int").alias("start"), none.cast("int").alias("len"), none.cast(marks.schema["item_id"].dataType).alias("item_id"), F.lit(1).alias("rows"))
    return headers.unionByName(found.withColumns({"n_words": none.cast("int"), "rows": F.lit(0)}))


def covered(spans: Column) -> Column:
    """Number of places that [start, start + len) spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        fresh = F.greatest(F.lit(0), end - F.greatest(x["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items array<string>, spans) for every row; text_hash is xxhash64 of the text.

    Null and empty texts have no words; null ids are kept; null item ids take no part; rows that repeat give
    a row each; an empty benchmark leaves every document clean. Other columns are not read.
    Documents are read twice: for the counts of the benchmark's words, and for the join.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = documents.select(F.col(id_col).alias("id"), text_hash.alias("h"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    windows = stored(item_windows(benchmark, size, item_col, item_text_col), "item-windows")
    small = windows.count() <= broadcast_windows
    marks = stored(anchors(docs, windows, small), "item-anchors")
    span = F.when(F.col("item_id").isNotNull(), F.struct("start", "len"))
    # Where the windows come to the documents, a row is told by its place in the scan; where words are shuffled, by id and text.
    place = F.monotonically_increasing_id() if small else F.lit(0).cast("long")
    keyed = docs.withColumn("key", F.struct("id", "h", place.alias("place"))).drop("id", "h")
    by_key = hits(keyed, marks, small).groupBy("key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(span).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.sum("rows").alias("rows"),
    )
    each = by_key if small else by_key.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("key.id").alias("doc_id"), F.col("key.h").alias("text_hash"), "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
