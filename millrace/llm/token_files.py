"""Operator 7: token ids in Parquet list columns that can be read in part.

The files hold (doc_id, shard, local_start, n_tokens, ids), sorted by doc_id across and within files.
Ids are dictionary encoded (a vocabulary is far smaller than a column chunk) and fall back to plain
pages; lengths, offsets and ids of documents are delta encoded by the version-2 writer. Row groups
and pages have fixed sizes and Parquet writes a page index, so a reader that asks for a range of
doc_id, or for lengths alone, touches only those pages and columns.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.pieces import PieceTable, rows_of
from millrace.llm.shared_files import new_path, partitions_for
from millrace.llm.textarrays import IS_SPACE, ascii_lower

_TABLES: dict[str, PieceTable] = {}
SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"
#: Letter-only words that are encoded in one call.
JOINED_WORDS = 256
#: Letters below this one are composed and have a lower-case letter of their own, but for DOTTED.
LATIN_END, DOTTED = "\u0180", "\u0130"
#: Marks that may follow a word: a run of them is one more unit. The apostrophe is not one of them, nor what special strings are made of.
MARKS = ".,;:!?%$#&*"


class WordEncoder:
    """Ids by the tokenizers library, for vocabularies whose last token of a word has a suffix.

    White space is dropped and letters are lower-cased by these vocabularies, so a word of letters is
    one unit whatever stands around it: many are joined by blanks into one text, and the ids are cut
    after each token with the suffix. Words of Latin letters in lower case are their own normal form, so
    these texts skip the normaliser. Other pieces are encoded one by one.
    """

    def __init__(self, tokenizer_path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = Tokenizer.from_file(tokenizer_path)
        self.plain.no_truncation()
        self.plain.no_padding()
        with open(tokenizer_path, encoding="utf-8") as f:
            described = json.load(f)
        suffix = described["model"].get("end_of_word_suffix") or ""
        normal = json.dumps(described.get("normalizer") or {})
        self.joins = bool(suffix) and "Lowercase" in normal and "Replace" in normal
        if self.joins:
            self.plain.normalizer = Sequence([])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.joins:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def fold(self, raw: np.ndarray) -> np.ndarray:
        """Lower case and plain blanks, unless a special string may be there, which counts as it is written."""
        if not self.joins or ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any():
            return raw
        return np.where(IS_SPACE[raw], 0x20, ascii_lower(raw)).astype(np.uint8)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace").strip(" \t\n\x0b\x0c\r") for p in pieces]
        simple: list[int] = []
        single: list[int] = []
        units: list[int] = []
        for i, t in enumerate(texts):
            core = t.rstrip(MARKS)
            if self.joins and core.isalpha() and (core.isascii() or (max(core) < LATIN_END and DOTTED not in core)):
                simple.append(i)
                units.append(1 if len(core) == len(t) else 2)
            else:
                single.append(i)
        groups = [simple[at : at + JOINED_WORDS] for at in range(0, len(simple), JOINED_WORDS)]
        coded = self.plain.encode_batch_fast([" ".join([texts[i] for i in g]).lower() for g in groups], add_special_tokens=False)
        flat = [np.array(e.ids, np.int32) for e in coded]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum(np.array(units, np.int64)) - 1
        if len(ends) != sum(units) or (len(ends) and ends[-1] != len(ids)):
            # A word that the vocabulary treats otherwise: each piece on its own.
            simple, single, last, ends, ids = [], list(range(len(texts))), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        order = np.array(simple + single, np.int64)
        lengths = np.diff(ends[last], prepend=0)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in single], add_special_tokens=False)]
        lengths = np.concatenate([lengths, np.fromiter(map(len, rest), np.int64, len(rest))])
        both = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(rest), np.int32)])
        starts = np.cumsum(lengths) - lengths
        # Back to the order of the pieces.
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        counts = lengths[back]
        first = np.cumsum(counts) - counts
        where = np.arange(counts.sum()) + np.repeat(starts[back] - first, counts)
        return both[where], counts


def piece_table(tokenizer_path: str) -> PieceTable:
    """One memory for each Python worker."""
    if tokenizer_path not in _TABLES:
        encoder = WordEncoder(tokenizer_path)
        _TABLES[tokenizer_path] = PieceTable(encoder, encoder.fold)
    return _TABLES[tokenizer_path]


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encodes every text, adds end_id, and writes the files in ascending order of the id.

    One range shuffle of the texts; rows of equal ids are ordered by a hash of their text, so a
    repeated task writes the same file. Null texts are empty (the end id alone); null ids come first. An empty table gives files without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = piece_table(tokenizer_path), 0
        for batch in rows_of(batches, "text", 8 << 20):
            ids, offsets = table.text_ids(batch.column("text"))
            n = batch.num_rows
            full = np.insert(ids, offsets[1:], end_id)
            ends = offsets + np.arange(n + 1)
            lengths = np.diff(ends)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(full.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(start + ends[:-1]), pa.array(lengths), lists], ["doc_id", "shard", "local_start", "n_tokens", "ids"])
            start += int(ends[-1])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_tie"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    ordered = rows.repartitionByRange(partitions_for(df.sparkSession, size), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    coded = ordered.select("doc_id", F.spark_partition_id().alias("shard"), "text").mapInArrow(encode, SCHEMA)
    (
        coded.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Adds to the start within a file the ids of all files before it: start, in place of shard and local_start.
    There is one number for each file; they are read from the lengths alone."""
    sizes = rows.sparkSession.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("_size"))
    before = sizes.select("shard", (F.sum("_size").over(Window.orderBy("shard")) - F.col("_size")).alias("_before"))
    return rows.join(before, "shard").withColumn("start", F.col("local_start") + F.col("_before")).drop("_before", "shard", "local_start")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start) without reading any ids. start counts the ids of all earlier documents."""
    return with_starts(spark.read.schema(SCHEMA).parquet(path).select("doc_id", "shard", "local_start", "n_tokens"), path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents first..last; the range reaches the page index."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", "ids")


def crc32_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ids by the crc32 of their little-endian 32-bit values."""
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "ids"]
        names = [name for name in batch.schema.names if name != "ids"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def token_file_digests(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads (doc_id, start, n_tokens, ids_crc32) back from them."""
    spark = df.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(df, path, tokenizer_path, end_id, id_col, text_col)
    back = spark.read.schema(SCHEMA).parquet(path)
    digests = back.mapInArrow(crc32_of_ids, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return with_starts(digests, path).select("doc_id", "start", "n_tokens", "ids_crc32")
