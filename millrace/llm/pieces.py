"""Texts cut at safe boundaries, each distinct piece of a batch encoded once.

A boundary is safe where white space follows a character that is not white space, and where an
ideographic comma or full stop follows an ideograph: the pre-tokenisers
of the byte-level and of the word vocabularies always start a new match there, look no further back,
and their special strings hold neither. Encoding the pieces one by one therefore gives exactly
the tokens of the whole text, however long it is. A run without any such place is one piece, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.textarrays import IS_SPACE, byte_slices, give_back, text_bytes

#: Texts are handled in groups of about so many bytes.
BATCH_BYTES = 16 << 20
#: Pieces longer than this are not remembered; the memory is emptied at so many pieces.
MEMO_PIECE_BYTES = 64
MEMO_PIECES, MEMO_IDS = 500_000, 8_000_000
#: Ideographic comma and full stop, full-width comma, in UTF-8. Lead bytes E5 to E9 are those of ideographs alone.
PAUSES = ((0xE3, 0x80, 0x81), (0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x8C))


def piece_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of all pieces of all texts. Only ASCII white space after a character that is surely
    not white space counts: visible ASCII, or a sequence whose lead byte has no white space in its range."""
    n = len(raw)
    if n == 0:
        return np.zeros(1, np.int64)
    solid = (raw > 0x20) & (raw < 0x7F)
    lead2 = (raw >= 0xC3) & (raw <= 0xDF)
    lead3 = (raw >= 0xE4) & (raw <= 0xEE)
    solid[1:] |= lead2[:-1]
    solid[2:] |= lead3[:-2]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = IS_SPACE[raw[1:]] & solid[:-1]
    for a, b, c in PAUSES:
        at = np.flatnonzero((raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c))
        at = at[at >= 3]
        cut[at[(raw[at - 3] >= 0xE5) & (raw[at - 3] <= 0xE9)]] = True
    cut[offsets] = True
    cut[[0, n]] = True
    return np.flatnonzero(cut)


def distinct_pieces(column, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(index of each piece into the distinct ones, the distinct pieces, number of pieces before each text).
    fold maps the bytes to others that encode alike, so that more pieces are equal."""
    raw, offsets = text_bytes(column)
    cuts = piece_offsets(raw, offsets)
    if len(raw) == 0:
        return np.zeros(0, np.int64), [], np.zeros(len(offsets), np.int64)
    raw = raw if fold is None else fold(raw)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(cuts, offsets)


class PieceTable:
    """Token ids of pieces. ``encode`` gets a list of pieces and returns (all their ids, number of ids of each)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], fold: Callable[[np.ndarray], np.ndarray] | None = None):
        self.encode, self.fold = encode, fold
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece's ids are: a slot, between offsets[slot] and offsets[slot + 1] of ids."""
        if len(self.slots) > MEMO_PIECES or len(self.ids) > MEMO_IDS:
            self.forget()
        get = self.slots.get
        found = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        new_ids, new_counts = [self.ids], []
        for at in range(0, len(missing), 20_000):
            ids, counts = self.encode([pieces[i] for i in missing[at : at + 20_000]])
            new_ids.append(ids)
            new_counts.append(counts)
        if len(missing):
            first = len(self.offsets) - 1
            found[missing] = np.arange(first, first + len(missing))
            self.slots.update((pieces[i], first + n) for n, i in enumerate(missing.tolist()) if len(pieces[i]) <= MEMO_PIECE_BYTES)
            self.ids = np.concatenate(new_ids)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(new_counts))])
        return found

    def text_ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        index, pieces, firsts = distinct_pieces(column, self.fold)
        slots = self.places(pieces)[index] if pieces else index
        starts = self.offsets[slots]
        lengths = self.offsets[slots + 1] - starts if pieces else index
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        where = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends[:-1], lengths) if pieces else index
        return self.ids[where], ends[firsts]


def rows_of(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices balanced by the bytes of their texts."""
    for batch in batches:
        yield from byte_slices(batch, text_col, limit)
        del batch  # while the next one comes
    give_back()
