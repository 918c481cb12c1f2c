"""Operator 3: token counts of whole texts, without returning the tokens.

Arrow functions encode batches balanced by bytes and return lengths only; long texts are cut at safe
boundaries (see ``pieces``), so a call to the library grows with a document only where that has no such boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import MEMO_PIECE_BYTES, MEMO_PIECES, distinct_pieces, rows_of

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Number of tokens of pieces; remembers short ones."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        memo = self.memo
        missing = [p for p in pieces if p not in memo]
        fresh = {}
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            coded = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False)
            fresh.update(zip(part, map(len, coded), strict=True))
        found = np.fromiter((fresh[p] if p in fresh else memo[p] for p in pieces), np.int64, len(pieces))
        if len(memo) + len(fresh) > MEMO_PIECES:
            memo.clear()
        memo.update((p, n) for p, n in fresh.items() if len(p) <= MEMO_PIECE_BYTES)
        return found

    def text_lengths(self, column) -> np.ndarray:
        index, pieces, firsts = distinct_pieces(column)
        sums = np.zeros(len(index) + 1, np.int64)
        np.cumsum(self.lengths(pieces)[index] if len(index) else index, out=sums[1:])
        return np.diff(sums[firsts])


def counter(tokenizer_path: str) -> Counter:
    """One for each Python worker."""
    if tokenizer_path not in _COUNTERS:
        _COUNTERS[tokenizer_path] = Counter(tokenizer_path)
    return _COUNTERS[tokenizer_path]


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Nulls and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give a row
    each; other columns are not read, so clashing names don't matter; an empty table gives no rows.
    No shuffle: one pass over the two columns.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(c.text_lengths(batch.column("text")))], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
