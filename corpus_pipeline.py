"""Corpus pipeline: documents -> toxicity -> near duplicates -> repeated passages -> benchmark passages -> token ids.

Each stage works on all rows that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontaminate, jaccard, substrings, toxicity
from millrace.llm.shared_files import stored

#: Bytes of an Arrow batch, unless the session sets them: operators work on slices of this size or less, and Spark's 64 MB are held
#: several times for each task, by the executor and by its worker.
ARROW_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def _by_text(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with _hash, semi- or anti-joined with (doc_id, text_hash); ids may be null."""
    named = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    return _hashed(docs).join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), how)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of (doc_id, text_hash) that are dropped. These are written first, so that Spark knows their size."""
    return _by_text(docs, stored(dropped.select("doc_id", "text_hash").distinct(), "dropped"), "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each row whose text the chain, trained on all labelled rows of these documents, rejects; the others pass through the same scan."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(docs, labels, ("low_quality", "toxic"))
    return toxicity.predict(docs, chain).where("toxic_pred = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one of the smallest id (null ids last), then the smallest text hash. Texts without words are in no class and stay."""
    _small_batches(spark)
    rows = stored(jaccard.near_duplicates(docs, width=5, percent=80).where("class is not null"), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = rows.groupBy("class").agg(first).select("class", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text"))
    out = _without(docs, rows.join(stored(kept, "kept"), "class").where(~same))
    # Rows of one id and text are told apart by nothing but their place; they are rare, so only they are sorted.
    twice = stored(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "equal-rows")
    if twice.limit(1).count() == 0:
        return out
    mine = _by_text(out, twice, "left_semi").dropDuplicates(["doc_id", "_hash"]).select(docs.columns)
    return _without(out, twice).unionByName(mine)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated 50-byte strings from the texts; a document of which nothing is left goes, an empty one stays, and a null text stays null."""
    _small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    marked = docs.withColumn("_null", F.col("text").isNull())
    cut = substrings.remove_repeats(marked, window=50, carry=[*others, "_null", "n_chars"], whole_characters=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    text = cut.where((F.col("n_bytes") == 0) | (removed < F.col("n_bytes"))).withColumn("text", F.when(~F.col("_null"), F.col("kept")))
    return text.withColumn("n_chars", F.when(F.col("_null"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each row in whose text a ten-word window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return _without(docs, found.where("n_hit > 0"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, with whether decoding the ids gives the text again."""
    _small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    source = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    coded = byte_bpe.encode(source, ranks, pattern, decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode_tokens),
]

#: The toxicity stage is a trained model, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
