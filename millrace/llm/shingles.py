"""Sets of word shingles as sorted 64-bit hashes, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np

from millrace.llm.textarrays import BYTE_CODES, U64, ascii_lower, lengths_to_rows, mix, span_hashes, text_bytes, words

PLACES = [pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) | 1 for i in range(64)]


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct shingles, offsets of the texts); sorted within a text.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    raw, offsets = text_bytes(column)
    low = ascii_lower(raw)
    starts, ends, firsts = words(low, offsets)
    n = len(offsets) - 1
    if len(starts) == 0:
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    codes = span_hashes(BYTE_CODES[low], starts, ends)
    counts = np.diff(firsts)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    cuts = np.zeros(n + 1, np.int64)
    np.cumsum(made, out=cuts[1:])
    rows = lengths_to_rows(made)
    first = firsts[:-1][rows] + np.arange(cuts[-1]) - cuts[:-1][rows]
    sums = np.zeros(len(first), U64)
    taken = np.minimum(counts, width)[rows]
    padded = np.concatenate([codes, np.zeros(width, U64)])
    for i in range(width):
        sums += np.where(i < taken, padded[first + i], U64(0)) * U64(PLACES[i])
    hashes = mix(sums + taken.astype(U64) * U64(0xD6E8FEB86659FD93))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    kept = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return hashes[fresh], kept[cuts]


def digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(U64))
