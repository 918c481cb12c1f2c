"""Operator 12: lines that repeat across documents stay in the first of them.

Each line's key is hashed to 128 bits. The hashes are range-partitioned with document and position as further sort keys, so that a line which
very many documents hold is spread over several ranges, and each range is streamed once: a row whose document isn't the first of
its hash is dropped. Only the hash with which a range begins may have begun in the range before; its rows wait for
the first document that the ranges name at their ends, two rows for each range. What comes back is a compressed bitmap
for each document, not its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import rows_of
from millrace.llm.shared_files import Scratch, partitions_for, stored

#: Characters that are stripped from a line's ends.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that are split at a time, and of a row of a line in a shuffle.
SLICE, LINE_BYTES = 4 << 20, 56
#: A document: whether it has no id, the id, and for those without one the text's hash.
DOCUMENT = ["none", "id", "own"]
ROW = "kind int, none int, id long, own long, text_hash long, h1 long, h2 long, pos int, n int"
DECIDED, WAITING, BORDER = 0, 1, 2


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(none, id, own, text_hash, text, more): a document's identity beside its text."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    hashed = F.xxhash64(text)
    own = F.when(key.isNull(), hashed).otherwise(F.lit(0).cast("long"))
    return df.select(key.isNull().cast("int").alias("none"), F.coalesce(key, F.lit(0).cast("long")).alias("id"), own.alias("own"), hashed.alias("text_hash"), text.alias("text"), *more)


def survey(documents: DataFrame, least: int) -> DataFrame:
    """kind 0: a row for each document with its number of lines n. kind 1: a row for each line whose key has at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", SLICE):
            digests, places, counts, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                lines = text.split("\n")
                before = len(places)
                for i, line in enumerate(lines):
                    key = line.strip(SPACE)
                    if len(key) >= least:
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        places.append(i)
                counts.append(len(places) - before)
                sizes.append(len(lines))
            who = ["none", "id", "own", "text_hash"]
            zero = np.zeros(batch.num_rows, np.int64)
            yield _batch(zero, [batch.column(c) for c in who], zero, zero, zero, np.array(sizes))
            if places:
                rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield _batch(np.ones(len(h)), [batch.column(c).take(rows) for c in who], h[:, 0], h[:, 1], np.array(places), np.zeros(len(h)))

    def _batch(kind, who: list[pa.Array], h1, h2, pos, n) -> pa.RecordBatch:
        ints = lambda x: pa.array(np.asarray(x).astype(np.int32))
        return pa.RecordBatch.from_arrays([ints(kind), *who, pa.array(np.ascontiguousarray(h1)), pa.array(np.ascontiguousarray(h2)), ints(pos), ints(n)], ["kind", "none", "id", "own", "text_hash", "h1", "h2", "pos", "n"])

    return documents.select("none", "id", "own", "text_hash", "text").mapInArrow(run, ROW)


def _first_occurrences(lines: DataFrame) -> DataFrame:
    """Streams sorted lines. kind DECIDED: a line that goes. WAITING: a line of the hash with which this range begins. BORDER: the first
    document here of the range's first or last hash."""
    names = ["none", "id", "own", "text_hash", "h1", "h2", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash and document of the run that goes on
        opening = None  # hash with which the range begins
        for batch in batches:
            if batch.num_rows == 0:
                continue
            of = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            h, who = np.stack([of["h1"], of["h2"]], 1), np.stack([of[c].astype(np.int64) for c in DOCUMENT], 1)
            fresh = np.r_[True, (h[1:] != h[:-1]).any(1)]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
            first = who[start]
            if opening is None:
                opening = h[0].copy()
                yield made(BORDER, of, np.array([0]))
            elif (h[0] == last[0]).all():
                first[start == 0] = last[1]
            waiting = (h == opening).all(1)
            drop = (who != first).any(1) & ~waiting
            yield made(WAITING, of, np.flatnonzero(waiting))
            yield made(DECIDED, of, np.flatnonzero(drop))
            last = (h[-1].copy(), first[-1].copy())
        if last is not None:
            end = {"none": last[1][0], "id": last[1][1], "own": last[1][2], "text_hash": 0, "h1": last[0][0], "h2": last[0][1], "pos": 0}
            yield made(BORDER, {c: np.array([x]) for c, x in end.items()}, np.array([0]))

    def made(kind: int, of: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
        types = {"none": np.int32, "pos": np.int32}
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(of[c][rows].astype(types.get(c, np.int64))) for c in names)], ["kind", *names])

    return lines.select(*names).mapInArrow(run, "kind int, none int, id long, own long, text_hash long, h1 long, h2 long, pos int")


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Adds keep: the lines that stay as bits, first line lowest, deflated; null where all stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for n, words in zip(batch.column("n_lines").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if words is None:
                    packed.append(None)
                    continue
                bits = np.zeros((n + 63) // 64, np.uint64)
                for w in words:
                    bits[w["word"]] = w["bits"] & 0xFFFFFFFFFFFFFFFF
                packed.append(zlib.compress((~bits).tobytes()[: (n + 7) // 8]))
            columns = [*(batch.column(c) for c in batch.schema.names if c != "words"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != "words"), "keep"])

    return rows.mapInArrow(run, "none int, id long, text_hash long, n_lines long, n_dropped long, keep binary")


def stays(keep: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay, of a bitmap of keep_bitmaps."""
    return np.ones(n, bool) if keep is None else np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n].astype(bool)


def keep_bitmaps(df: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) for each distinct pair of id and text: keep has a bit for each line, see stays().

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line without white space at its ends, A-Z in lower
    case. Keys of at least ``least`` code points that several documents hold stay in the smallest doc_id alone, with all their lines there.
    Rows that repeat an id are one document. Rows without an id come after all others, each distinct text a document, in order of its hash.
    An empty table gives no rows. Other columns are not read. The result is written to the shared folder.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lines")
    try:
        surveyed = scratch.stored(survey(_keyed(df, id_col, text_col), least), "surveyed")
        lines = surveyed.where("kind = 1")
        parts = partitions_for(spark, lines.count() * LINE_BYTES)
        order = ["h1", "h2", *DOCUMENT, "text_hash", "pos"]
        streamed = scratch.stored(_first_occurrences(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)), "streamed")
        # At most two rows for each range.
        first = streamed.where(F.col("kind") == BORDER).groupBy("h1", "h2").agg(F.min(F.struct(*DOCUMENT)).alias("first"))
        waiting = streamed.where(F.col("kind") == WAITING).join(F.broadcast(first), ["h1", "h2"]).where(F.struct(*DOCUMENT) != F.col("first"))
        columns = ["none", "id", "text_hash", "pos"]
        gone = streamed.where(F.col("kind") == DECIDED).select(*columns).unionByName(waiting.select(*columns))
        words = gone.groupBy("none", "id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
        dropped = words.groupBy("none", "id", "text_hash").agg(F.collect_list(F.struct("word", "bits")).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
        each = surveyed.where("kind = 0").groupBy("none", "id", "text_hash").agg(F.max("n").cast("long").alias("n_lines"))
        both = each.join(dropped, ["none", "id", "text_hash"], "left").select("none", "id", "text_hash", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words")
        named = _bitmaps(both).select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), "text_hash", "n_lines", "n_dropped", "keep")
        return stored(named, "keep-bitmaps")
    finally:
        scratch.close()


def drop_lines(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_lines, n_dropped, kept) for every row of df: kept is its text without the lines that bitmaps drop."""
    if clash := {"doc_id", "n_lines", "n_dropped", "kept"} & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    held = df.select(F.struct(*carry).alias("_carried"), id_col, text_col) if carry else df
    left = _keyed(held, id_col, text_col, *(["_carried"] if carry else []))
    right = bitmaps.select(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_hash", "n_lines", "n_dropped", "keep")
    joined = left.join(right, ["none", "id", "text_hash"]).select("none", "id", "n_lines", "n_dropped", "keep", "text", *(["_carried"] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", SLICE):
            out = []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                if keep is not None:
                    lines = text.split("\n")
                    text = "\n".join([lines[i] for i in np.flatnonzero(stays(keep, len(lines))).tolist()])
                out.append(text)
            names = [c for c in batch.schema.names if c not in ("text", "keep")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "kept"])

    schema = joined.drop("text", "keep").schema.add("kept", "string")
    kept = joined.mapInArrow(run, schema)
    return kept.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), *(F.col(f"_carried.`{c}`").alias(c) for c in carry), "n_lines", "n_dropped", "kept")
