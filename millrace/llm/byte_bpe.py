"""Operator 10: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over the vocabulary finds the
longest token at each position of a match of the split pattern. The encoder appends the longest token
that is compatible with the token before it and steps back to shorter ones where none is: two adjacent
tokens are compatible if merging their joined bytes gives them again, which is decided once for each pair and
remembered. The only sequence whose neighbours are all compatible is the one that the merges give, and
each position is visited a bounded number of times.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import PieceTable, rows_of
from millrace.llm.textarrays import give_back

_CODECS: dict[tuple[str, str], Codec] = {}
#: Compatible pairs that are remembered before the memory is emptied.
MEMO_PAIRS = 300_000


class Codec:
    def __init__(self, rank_path: str, pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        with open(rank_path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.token[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of each token: where the encoder steps back to.
        self.shorter = [self._proper_prefix(token) for token in self.token]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.table = PieceTable(self._encode_pieces)

    def _proper_prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            found = self.rank.get(token[:n])
            if found is not None:
                return found
        return -1

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gave this one; None for a single byte."""
        if token not in self.halves:
            whole, best = self.token[token], None
            for at in range(1, len(whole)):
                left, right = self.rank.get(whole[:at]), self.rank.get(whole[at:])
                if left is not None and right is not None and left < token and right < token and self._made_here(left, right, token):
                    best = (left, right)
                    break
            self.halves[token] = best
        return self.halves[token]

    def _made_here(self, left: int, right: int, token: int) -> bool:
        """Whether the seam of the two parts lasts until the merge that gives token."""
        a, b, limit = left, right, token
        while True:
            undo_left = a > b
            halves = self.split(a if undo_left else b)
            if halves is None:
                undo_left = not undo_left
                halves = self.split(a if undo_left else b)
                if halves is None:
                    return True
            if undo_left:
                limit, a = a, halves[1]
            else:
                limit, b = b + 1, halves[0]
            joined = self.rank.get(self.token[a] + self.token[b])
            if joined is not None and joined < limit:
                return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave exactly these two tokens of their joined bytes.

        Undoes the merges next to the seam, the last one first. If at some stage the two tokens at the
        seam have a merge of their own that comes before the one just undone, the seam would be gone.
        """
        key = left * len(self.token) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        limit = len(self.token)
        while True:
            joined = self.rank.get(self.token[left] + self.token[right])
            if joined is not None and joined < limit:
                return False
            undo_left = left > right
            halves = self.split(left if undo_left else right)
            if halves is None:
                undo_left = not undo_left
                halves = self.split(left if undo_left else right)
                if halves is None:
                    return True
            if undo_left:
                limit, left = left, halves[1]
            else:
                limit, right = right + 1, halves[0]

    def encode_match(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        token = self.token
        longest = [-1] * len(data)
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - len(token[rank])
            if longest[start] < 0 or len(token[rank]) > len(token[longest[start]]):
                longest[start] = rank
        dead = bytearray(len(data) + 1)
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < len(data):
            while candidate >= 0:
                end = at + len(token[candidate])
                if not dead[end] and (not out or self.compatible(out[-1], candidate)):
                    break
                candidate = self.shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < len(data) else -1
            else:
                dead[at] = 1
                candidate = out.pop()
                at -= len(token[candidate])
        return out

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        find, encode = self.pattern.findall, self.encode_match
        ids: list[int] = []
        ends = [0]
        for piece in pieces:
            for match in find(piece.decode("utf-8", "replace")):
                ids += encode(match.encode())
            ends.append(len(ids))
        return np.array(ids, np.int32), np.diff(ends)

    def forget(self) -> None:
        """Empties the memories of pieces and pairs: an idle worker keeps the vocabulary alone."""
        self.table.forget()
        self.pairs.clear()
        give_back()

    def token_bytes(self) -> pa.Array:
        """Bytes of every token, for decoding."""
        return pa.array(self.token, pa.large_binary())


def codec(rank_path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (rank_path, pattern) not in _CODECS:
        _CODECS[rank_path, pattern] = Codec(rank_path, pattern)
    return _CODECS[rank_path, pattern]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: str) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), values], [*names, name])


def _bytes_of(tokens: pa.Array, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The bytes of each list of ids; offsets: where the lists begin and end."""
    joined = tokens.take(ids)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    cuts = (ends[offsets] - ends[0]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts), joined.buffers()[2] if len(joined) else pa.py_buffer(b"")])


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """All columns but the text, and ids array<int>; with decoded_col also the bytes that decode() gives for these ids, in the
    same pass, so that no second set of workers holds the vocabulary.

    A null or empty text has no ids, an empty table gives no rows; repeated rows stay; an existing column named like ids_col or decoded_col is
    replaced. One pass without a shuffle, in slices of bounded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        tokens = own.token_bytes() if decoded_col else None
        try:
            for batch in rows_of(batches, text_col, 2 << 20):
                ids, offsets = own.table.text_ids(batch.column(text_col))
                values = pa.array(ids)
                out = _with_column(batch, ids_col, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), text_col)
                yield _with_column(out, decoded_col, _bytes_of(tokens, values, offsets), "") if decoded_col else out
        finally:
            own.forget()

    source = df.drop(*(c for c in (ids_col, decoded_col) if c))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text_col]
    return source.mapInArrow(run, ", ".join([*fields, f"`{ids_col}` array<int>", *([f"`{decoded_col}` binary"] if decoded_col else [])]))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns but the ids, and the decoded bytes; null ids decode to no bytes, an unknown id raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(rank_path, pattern).token_bytes()
        for batch in batches:
            lists = batch.column(ids_col)
            start, stop = (lists.offsets[0].as_py(), lists.offsets[-1].as_py()) if len(lists) else (0, 0)
            offsets = lists.offsets.to_numpy().astype(np.int64) - start
            yield _with_column(batch, bytes_col, _bytes_of(tokens, lists.values.slice(start, stop - start), offsets), ids_col)

    source = df.drop(bytes_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != ids_col]
    return source.mapInArrow(run, ", ".join([*fields, f"`{bytes_col}` binary"]))


def encode_decode_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and of the bytes that these decode to."""
    coded = encode(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rank_path, pattern, decoded_col="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
