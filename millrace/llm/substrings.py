"""Operator 9: removal of long repeated substrings with a run-length index.

Every window of 50 bytes holds an anchor: the 20-byte string of the smallest hash in it. Equal windows have
equal anchors, so only windows whose anchor occurs in several different texts can repeat; consecutive
windows with one anchor form a stretch of at most 80 bytes.

Texts are dealt into chunks of about 2 MB by a hash of id and text, in one shuffle that all passes share:

1. A chunk sends its anchors, sorted and packed by ranges of their hash; a range answers with a bit for each anchor that
   other texts hold too (live), and a bit for those with very many stretches (hot).
2. A chunk sends the stretches of its live anchors; equal ones of a chunk go out once, with the smallest id. They meet by
   anchor. Equal ones are one run there, which needs the smallest id only. Where an anchor has different stretches, these
   are put into a run-compressed Burrows-Wheeler index (see ``run_index``), and those that may repeat an earlier one are
   streamed against it. A window that matches a string of a smaller id is marked. Hot anchors are split: each window of
   their stretches is dealt by its own hash, so that only equal windows meet, which needs no index.
3. A chunk cuts the marked bytes.

Exact copies of a text are found by its hashes first, so that they don't add anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.run_index import RunIndex
from millrace.llm.shared_files import partitions_for
from millrace.llm.textarrays import BYTE_CODES, U64, give_back, mix, span_hashes, text_bytes

#: Bytes of an anchor; bytes of stretches that are indexed at a time; windows whose anchors are sought at a time.
ANCHOR, INDEX_BYTES, BLOCK = 20, 1_000_000, 1 << 20
#: Bytes of text in a chunk, with so many for each row; anchors in a range, at about one for 16 bytes.
CHUNK_BYTES, ROW_BYTES, RANGE_ANCHORS = 2 << 20, 64, 500_000
#: The key of rows with a null id: such rows count as the last document. They are dealt into so many chunks more.
LAST, SALTS = (1 << 63) - 1, 64
#: So many of 2**SPARE anchors are taken for another one, which only adds stretches to compare.
SPARE = 14
#: An anchor with more stretches than this in different texts is split by windows; windows of these that are compared at a time.
HOT, HOT_WINDOWS = 1024, 100_000
#: Texts of a chunk are numbered by so many bits.
TEXT_BITS = 24

SIDE = "chunk long, kind int, a long, b long, data binary"
STRETCHES = "anchor long, stretch binary, key long, ref long, start int"


def windowed_minima(raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of each window, hash of the ANCHOR (20) bytes from each position on)."""

    def at(offset: int, kind: str) -> np.ndarray:
        return np.ndarray((len(raw) - ANCHOR + 1,), kind, raw, offset, (1,))

    raw = np.ascontiguousarray(raw)
    hashes = at(0, "<u8") * U64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> U64(29)
    hashes += at(8, "<u8") * U64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> U64(32)
    hashes += at(16, "<u4") * U64(0x94D049BB133111EB)
    hashes *= U64(0xD6E8FEB86659FD93)
    low = U64((1 << 21) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
    reach, spread = 1, window - ANCHOR + 1
    while reach < spread:
        step = min(reach, spread - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return (least & low).astype(np.int64), hashes


def stretches(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, last window) of each stretch: consecutive windows with one anchor."""
    total = len(raw) - window + 1
    if total < 1:
        return (np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 2)
    # Windows that reach beyond their text start in its last window - 1 bytes.
    change = np.bincount(np.maximum(offsets[:-1], offsets[1:] - window + 1), minlength=len(raw) + 1) - np.bincount(offsets[1:], minlength=len(raw) + 1)
    inside = np.cumsum(change)[:total] == 0
    edges, places, found = [], [], []  # where the anchor changes, its place from there on (-1: none) and its hash
    before = -2
    for start in range(0, total, BLOCK):
        stop = min(total, start + BLOCK)
        where, hashes = windowed_minima(raw[start : stop + window - 1], window)
        place = np.where(inside[start:stop], where + start, -1)
        new = np.ones(stop - start, bool)
        new[1:] = place[1:] != place[:-1]
        new[0] = place[0] != before
        edge = np.flatnonzero(new)
        edges.append(edge + start)
        places.append(place[edge])
        found.append(hashes[where[edge]])
        before = int(place[-1])
    first, place, anchors = (np.concatenate(x) for x in (edges, places, found))
    last = np.append(first[1:], total) - 1
    kept = place >= 0
    first, last = first[kept], last[kept]
    return np.searchsorted(offsets, first, side="right") - 1, mix(anchors[kept]), first, last


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by their bytes, all lowest bytes first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data[1 : 1 + width * n], np.uint8).reshape(width, n).T
    return out.view("<u8")[:, 0].astype(np.int64), data[1 + width * n :]


def _numbered(first: np.ndarray) -> np.ndarray:
    """Number of the group that each row is in; first: where a group begins."""
    return np.cumsum(first) - 1


class _Chunk:
    """The different texts of a chunk that come first in their class of copies, in the order of key and hash."""

    def __init__(self, side: pa.Table, docs: pa.Table, window: int, bits: int):
        """window: 0 where no anchors are needed."""
        listed = {(a, b) for kind, a, b in zip(*(side.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True) if kind == 0}
        places: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(zip(docs.column("key").to_pylist(), docs.column("h").to_pylist(), strict=True)):
            if pair in listed:
                places.setdefault(pair, i)
        order = sorted(places)
        self.keys = np.array([k for k, _ in order], np.int64)
        self.raw, self.offsets = text_bytes(docs.column("text").take(pa.array([places[p] for p in order], pa.int64())))
        self.order = order
        if window:
            self.of, anchors, self.first, self.last = stretches(self.raw, self.offsets, window)
            anchors = (anchors >> U64(64 - bits)).astype(np.int64)
            by = np.lexsort((self.of, anchors))
            a, r = anchors[by], self.of[by]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            apart = np.ones(len(a), bool)
            apart[1:] = new[1:] | (r[1:] != r[:-1])
            group = _numbered(new)
            #: Different anchors in order, the number of their stretches, whether several texts hold them; each stretch's anchor.
            self.anchors = a[new]
            self.counts = np.bincount(group, minlength=len(self.anchors))
            self.several = np.bincount(group, weights=apart, minlength=len(self.anchors)) > 1
            self.anchor_of = np.empty(len(a), np.int64)
            self.anchor_of[by] = group

    def ranges(self, width: int) -> Iterator[tuple[int, slice]]:
        number = self.anchors // width
        edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(number[a]), slice(a, b)


def _tidy(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run for a group; then the worker, which may stay idle, gives its memory back. It has as many parameters as run has."""
    if run.__code__.co_argcount == 1:

        def one(table: pa.Table) -> pa.Table:
            out = run(table)
            give_back()
            return out

        return one

    def two(side: pa.Table, docs: pa.Table) -> pa.Table:
        out = run(side, docs)
        give_back()
        return out

    return two


def _characters(kept: bytes) -> str:
    """The kept bytes as UTF-8, without characters of which a part was removed."""
    return kept.decode("utf-8", "ignore")


def _chunk_of(docs: pa.Table) -> int:
    return docs.column("chunk")[0].as_py()


def _send_anchors(window: int, bits: int, width: int):
    """(range, chunk, data): the sorted anchors of a chunk in a range, as differences, with counts and flags."""

    def run(side: pa.Table, docs: pa.Table) -> pa.Table:
        ranges, blobs = [], []
        if docs.num_rows and side.num_rows:
            chunk = _Chunk(side, docs, window, bits)
            for number, part in chunk.ranges(width):
                steps = np.diff(chunk.anchors[part], prepend=number * width)
                extra = chunk.counts[part] * 2 + chunk.several[part] - 2
                blobs.append(_packed(len(steps).to_bytes(4, "little") + _planes(steps) + _planes(extra)))
                ranges.append(number)
        number = _chunk_of(docs) if docs.num_rows else 0
        return pa.table([pa.array(ranges, pa.int64()), pa.array([number] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], ["range", "chunk", "data"])

    return run


def _answer(hot: int):
    """For each packed list of anchors: a bit for those that are live, and one for those that are hot."""

    def run(table: pa.Table) -> pa.Table:
        anchors, counts, several, sizes = [], [], [], []
        for blob in table.column("data"):
            data = memoryview(_unpacked(blob.as_py()))
            n = int.from_bytes(data[:4], "little")
            steps, data = _from_planes(data[4:], n)
            extra, _ = _from_planes(data, n)
            anchors.append(np.cumsum(steps))
            counts.append(extra // 2 + 1)
            several.append(extra % 2)
            sizes.append(n)
        a, c, s = np.concatenate(anchors), np.concatenate(counts), np.concatenate(several)
        order = np.argsort(a, kind="stable")
        new = np.ones(len(a), bool)
        new[1:] = a[order[1:]] != a[order[:-1]]
        group = np.empty(len(a), np.int64)
        group[order] = _numbered(new)
        live = (np.bincount(group, weights=s + 1) > 1)[group]
        often = (np.bincount(group, weights=c) > hot)[group] & live
        out = []
        at = 0
        for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
            part = slice(at, at + n)
            at += n
            if live[part].any():
                out.append((chunk, _packed(np.packbits(live[part]).tobytes() + (np.packbits(often[part]).tobytes() if often[part].any() else b""))))
        number = table.column("range")[0].as_py()
        return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([number] * len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], ["chunk", "kind", "a", "b", "data"])

    return run


def _spans_table(anchor: np.ndarray, data: np.ndarray, sizes: np.ndarray, keys: np.ndarray, refs: np.ndarray, starts: np.ndarray) -> pa.Table:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    texts = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.table([pa.array(anchor.astype(np.int64)), texts, pa.array(keys), pa.array(refs), pa.array(starts.astype(np.int32))], ["anchor", "stretch", "key", "ref", "start"])


def _equal_before(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a string of a smaller key and of the same group equals each string, order of the strings). Strings of one hash are compared byte by byte."""
    order = np.lexsort((keys, hashes, groups))
    new = np.ones(len(at), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (groups[order[1:]] != groups[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
    heads = np.flatnonzero(new)
    head = np.empty(len(at), np.int64)
    head[order] = order[heads[_numbered(new)]]
    repeats = keys[head] < keys
    which = np.flatnonzero(repeats)
    spread = np.arange(int(sizes.max(initial=0)))
    for some in np.array_split(which, max(1, len(which) // 20_000)):
        if len(some):
            ahead = spread < sizes[some, None]
            end = len(raw) - 1
            repeats[some] = ((raw[np.minimum(at[some, None] + spread, end)] == raw[np.minimum(at[head[some], None] + spread, end)]) | ~ahead).all(1)
    return repeats, order


def _merged(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (text, start, end) that the spans cover together."""
    if not len(texts):
        return texts, starts, ends
    order = np.lexsort((starts, texts))
    t, s, e = texts[order], starts[order], ends[order]
    step = int(e.max()) + 1
    reach = np.maximum.accumulate(t * step + e)
    new = np.ones(len(t), bool)
    new[1:] = t[1:] * step + s[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(t)) - 1
    return t[heads], s[heads], reach[tails] - t[heads] * step


def _send_stretches(window: int, bits: int, width: int):
    """STRETCHES of live anchors. Starts below 0 (-1 - start) are those of hot anchors' windows, with the window's hash for
    the anchor, or of runs that are marked already, with four bytes of length for the stretch."""

    def run(side: pa.Table, docs: pa.Table) -> pa.Table:
        tables = [_spans_table(*(np.zeros(0, kind) for kind in (np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64)))]
        answers = side.filter(pc.equal(side.column("kind"), 1)) if side.num_rows else side
        if not docs.num_rows or not answers.num_rows:
            return tables[0]
        chunk = _Chunk(side, docs, window, bits)
        raw, offsets, of = chunk.raw, chunk.offsets, chunk.of
        live, often = np.zeros(len(chunk.anchors), bool), np.zeros(len(chunk.anchors), bool)
        where = dict(chunk.ranges(width))
        for number, blob in zip(answers.column("a").to_pylist(), answers.column("data").to_pylist(), strict=True):
            part = where[number]
            n = part.stop - part.start
            marks, size = np.frombuffer(_unpacked(blob), np.uint8), (n + 7) // 8
            live[part] = np.unpackbits(marks[:size], count=n)
            if len(marks) > size:
                often[part] = np.unpackbits(marks[size:], count=n)
        refs = (_chunk_of(docs) << TEXT_BITS) + np.arange(len(chunk.keys), dtype=np.int64)
        codes = BYTE_CODES[raw]
        marked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        plain = np.flatnonzero(live[chunk.anchor_of] & ~often[chunk.anchor_of])
        if len(plain):
            first, sizes, text = chunk.first[plain], chunk.last[plain] - chunk.first[plain] + window, of[plain]
            repeats, order = _equal_before(raw, first, sizes, span_hashes(codes, first, first + sizes), chunk.anchor_of[plain], chunk.keys[text])
            marked.append((text[repeats], first[repeats] - offsets[text[repeats]], (first + sizes)[repeats] - offsets[text[repeats]]))
            out = np.flatnonzero(~repeats)
            ends = np.cumsum(sizes[out])
            data = raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[out] - ends + sizes[out], sizes[out])]
            tables.append(_spans_table(chunk.anchors[chunk.anchor_of[plain[out]]], data, sizes[out], chunk.keys[text[out]], refs[text[out]], first[out] - offsets[text[out]]))
        hot = np.flatnonzero(often[chunk.anchor_of])
        sizes = chunk.last[hot] - chunk.first[hot] + 1
        for some in np.array_split(np.arange(len(hot)), max(1, -(-int(sizes.sum()) // HOT_WINDOWS))) if len(hot) else []:
            n = sizes[some]
            text = np.repeat(of[hot[some]], n)
            at = np.arange(n.sum()) + np.repeat(chunk.first[hot[some]] - np.cumsum(n) + n, n)
            if not len(at):
                continue
            low = int(at.min())
            hashes = span_hashes(codes[low : int(at.max()) + window], at - low, at - low + window)
            repeats, _ = _equal_before(raw, at, np.full(len(at), window), hashes, np.zeros(len(at), np.int64), chunk.keys[text])
            marked.append(_merged(text[repeats], (at - offsets[text])[repeats], (at - offsets[text])[repeats] + window))
            out = np.flatnonzero(~repeats)
            for w in np.array_split(out, max(1, len(out) // 20_000)):
                tables.append(_spans_table((hashes[w] >> U64(1)).astype(np.int64), raw[at[w, None] + np.arange(window)].ravel(), np.full(len(w), window), chunk.keys[text[w]], refs[text[w]], -1 - (at[w] - offsets[text[w]])))
        if marked:
            text, start, end = _merged(*(np.concatenate(x) for x in zip(*marked, strict=True)))
            tables.append(_spans_table((mix((refs[text] + start).astype(U64)) >> U64(1)).astype(np.int64), (end - start).astype("<i4").view(np.uint8), np.full(len(text), 4), chunk.keys[text], refs[text], -1 - start))
        return pa.concat_tables(tables)

    return run


class _Runs:
    """Different stretches of a task, until enough of them are there for an index."""

    def __init__(self, window: int):
        self.window = window
        self.parts: list[tuple[np.ndarray, ...]] = []  # bytes, sizes, anchors, keys of the stretches
        self.members: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # number of the stretch, ref, start
        self.count = self.bytes = 0

    def add(self, data: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, keys: np.ndarray) -> None:
        self.parts.append((data, sizes, anchors, keys))
        self.count += len(sizes)
        self.bytes += len(data)

    def marks(self, everything: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ref, start, length) of what repeats a smaller key's different stretch. All but the last anchor are done unless everything is."""
        none = (np.zeros(0, np.int64),) * 3
        if not self.parts:
            return none
        data, sizes, anchors, keys = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        number, refs, starts = (np.concatenate(x) for x in zip(*self.members, strict=True))
        stop = len(anchors) if everything else int(np.searchsorted(anchors, anchors[-1]))
        at = np.concatenate([[0], np.cumsum(sizes)])
        left = number >= stop
        self.parts, self.members = [(data[at[stop] :], sizes[stop:], anchors[stop:], keys[stop:])], [(number[left] - stop, refs[left], starts[left])]
        self.count, self.bytes = len(anchors) - stop, int(at[-1] - at[stop])
        number, refs, starts = number[~left], refs[~left], starts[~left]
        order = np.lexsort((keys[:stop], anchors[:stop]))
        same = anchors[order[1:]] == anchors[order[:-1]]
        if not same.any():
            return none

        def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            offsets = np.concatenate([[0], np.cumsum(sizes[which])])
            return data[np.arange(offsets[-1]) + np.repeat(at[which] - offsets[:-1], sizes[which])], offsets

        # All but the largest key of an anchor are indexed, all but the smallest are streamed.
        indexed, streamed = order[:-1][same], order[1:][same]
        indexed = indexed[np.argsort(keys[indexed], kind="stable")]
        index = RunIndex(*joined(indexed), keys[indexed], self.window)
        pattern, place, owner = index.owners_of_windows(*joined(streamed), self.window)
        smaller = owner < keys[streamed[pattern]]
        which, start, end = _merged_windows(pattern[smaller], place[smaller], self.window)
        # Every member of a stretch is marked alike.
        by = np.argsort(number, kind="stable")
        low, high = np.searchsorted(number[by], streamed[which]), np.searchsorted(number[by], streamed[which], side="right")
        n = high - low
        member = by[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
        return refs[member], starts[member] + np.repeat(start, n), np.repeat(end - start, n)


def _merged_windows(pattern: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _merged(pattern, place, place + window)


def _repeats(window: int):
    """SIDE rows of kind 2 (chunk, text, span) of bytes to remove, from STRETCHES sorted by anchor, stretch and key.
    A span is start * 2**32 + length."""

    def found(refs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        n = len(refs)
        columns = [pa.array(refs >> TEXT_BITS), pa.array(np.full(n, 2, np.int32)), pa.array(refs & ((1 << TEXT_BITS) - 1)), pa.array((starts.astype(np.int64) << 32) + sizes), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "kind", "a", "b", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(window)
        last: tuple | None = None  # (split, anchor, bytes, key) of the first string of the last run
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors, keys, refs, starts = (batch.column(c).to_numpy() for c in ("anchor", "key", "ref", "start"))
            raw, offsets = text_bytes(batch.column("stretch"))
            sizes = np.diff(offsets)
            split = starts < 0
            starts = np.where(split, -1 - starts, starts)
            done = split & (sizes < window)
            if done.any():
                lengths = raw[offsets[:-1][done, None] + np.arange(4)].copy().view("<i4")[:, 0]
                yield found(refs[done], starts[done], lengths.astype(np.int64))
            rest = np.flatnonzero(~done)
            if not len(rest):
                continue
            # Rows are in order of their bytes, so equal ones are neighbours; the longest is short.
            begin, size = offsets[:-1][rest], sizes[rest]
            new = np.ones(len(rest), bool)
            alike = (anchors[rest[1:]] == anchors[rest[:-1]]) & (size[1:] == size[:-1]) & (split[rest[1:]] == split[rest[:-1]])
            pairs = np.flatnonzero(alike)
            spread = np.arange(int(size.max()))
            for some in np.array_split(pairs, max(1, len(pairs) // 20_000)):
                ahead = spread < size[some, None]
                x, y = (np.minimum(begin[some + i, None] + spread, len(raw) - 1) for i in (0, 1))
                new[some + 1] = ((raw[x] != raw[y]) & ahead).any(1)
            first = rest[0]
            text = raw[begin[0] : begin[0] + size[0]].tobytes()
            carried = last is not None and last[:3] == (bool(split[first]), int(anchors[first]), text)
            if carried:
                new[0] = False
            heads = np.flatnonzero(new)
            group = _numbered(new)  # -1: goes on with the run of the batch before
            head_key = np.where(group >= 0, keys[rest[heads[np.maximum(group, 0)]]] if len(heads) else 0, last[3] if carried else 0)
            whole = head_key < keys[rest]
            if whole.any():
                yield found(refs[rest[whole]], starts[rest[whole]], size[whole])
            # Strings of unsplit anchors go on to an index, with all members of the smallest key.
            own = heads[~split[rest[heads]]]
            base = runs.count
            number = np.full(len(heads) + 1, -1, np.int64)
            number[np.flatnonzero(~split[rest[heads]])] = base + np.arange(len(own))
            number[-1] = base - 1 if carried and not last[0] else -1  # for group -1: the last one that was added
            member = np.flatnonzero(~whole & (number[group] >= 0))
            runs.members.append((number[group[member]], refs[rest[member]], starts[rest[member]]))
            total = size[own]
            ends = np.cumsum(total)
            runs.add(raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - ends + total, total)], total, anchors[rest[own]], keys[rest[own]])
            if len(heads):
                i = heads[-1]
                last = (bool(split[rest[i]]), int(anchors[rest[i]]), raw[begin[i] : begin[i] + size[i]].tobytes(), int(keys[rest[i]]))
            if runs.bytes >= INDEX_BYTES:
                yield found(*runs.marks(False))
        yield found(*runs.marks(True))

    return run


def _cut(window: int, carried: Sequence[str], whole_characters: bool):
    def run(side: pa.Table, docs: pa.Table) -> pa.Table:
        chunk = _Chunk(side, docs, 0, 0)
        number = {pair: i for i, pair in enumerate(chunk.order)}
        kinds = side.column("kind").to_numpy() if side.num_rows else np.zeros(0, np.int32)
        marks = kinds == 2
        texts = side.column("a").to_numpy(zero_copy_only=False)[marks] if marks.any() else np.zeros(0, np.int64)
        spans = side.column("b").to_numpy(zero_copy_only=False)[marks] if marks.any() else np.zeros(0, np.int64)
        texts, starts, ends = _merged(texts.astype(np.int64), spans.astype(np.int64) >> 32, (spans.astype(np.int64) >> 32) + (spans.astype(np.int64) & 0xFFFFFFFF))
        low, high = np.searchsorted(texts, np.arange(len(number))).tolist(), np.searchsorted(texts, np.arange(len(number)), side="right").tolist()
        starts, ends = starts.tolist(), ends.tolist()
        raw, offsets = text_bytes(docs.column("text"))
        whole = raw.tobytes()
        out_spans, kept = [], []
        for i, pair in enumerate(zip(docs.column("key").to_pylist(), docs.column("h").to_pylist(), strict=True)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            at = number.get(pair)
            if at is None:  # a copy of a smaller key's text
                runs = [(0, b - a)] if b - a >= window else []
            else:
                runs = list(zip(starts[low[at] : high[at]], ends[low[at] : high[at]], strict=True))
            out_spans.append([{"start": x, "end": y} for x, y in runs])
            edges = [0, *(x for span in runs for x in span), b - a]
            kept.append(b"".join(whole[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if runs else whole[a:b])
        left = pa.array([_characters(k) for k in kept], pa.string()) if whole_characters else pa.array(kept, pa.binary())
        columns = [docs.column("key"), docs.column("h"), pa.array(np.diff(offsets)), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), left, *(docs.column(c) for c in carried)]
        return pa.table(columns, ["key", "h", "n_bytes", "spans", "kept", *carried])

    return run


def chunked(df: DataFrame, chunks: int) -> DataFrame:
    """Adds the chunk of each (key, h); rows without an id are dealt by their place as well, as many may be equal."""
    salt = F.when(F.col("key") == LAST, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    return df.withColumn("chunk", F.pmod(F.xxhash64("key", "h", salt), F.lit(chunks)).cast("long"))


def _side_chunks(df: DataFrame, chunks: int) -> DataFrame:
    """The chunks that rows of a (key, h) may be in."""
    salts = F.when(F.col("key") == LAST, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return df.withColumn("salt", F.explode(salts)).withColumn("chunk", F.pmod(F.xxhash64("key", "h", "salt"), F.lit(chunks)).cast("long"))


def remove_repeats(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_bytes, spans array<struct<start,end>>, kept binary) for every row, and the columns of carry as
    they are; text_hash is xxhash64 of the text. With whole_characters, kept is a string, as with_text() makes it, in the same
    pass, so that no second set of workers is needed.

    A byte goes if a window over it also starts in a row of a smaller id. Null texts are empty; a null id
    counts as larger than all ids (2**63 - 1 is taken for it); rows that repeat an id never remove each
    other's bytes, and their texts are told apart by the 64 bits of text_hash; texts shorter than the window stay. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"carried{i}" for i in range(len(carry))]
    source = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), text.alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + ROW_BYTES), F.lit(0)).alias("n")).first()["n"]
    chunks, ranges = 1 + size // CHUNK_BYTES, 1 + size // (16 * RANGE_ANCHORS)
    bits = min(60, max(32, (size // 16 + 1).bit_length() + SPARE))
    width = -(-(1 << bits) // ranges)
    rows = source.withColumn("h", F.xxhash64("text"))
    texts = chunked(rows, chunks).groupBy("chunk")
    marked = rows.select("key", "h", F.xxhash64("text", F.lit(1)).alias("h2"), F.octet_length("text").alias("size"))
    firsts = _side_chunks(marked.groupBy("h", "h2", "size").agg(F.min("key").alias("key")), chunks)
    listed = firsts.select("chunk", F.lit(0).alias("kind"), F.col("key").alias("a"), F.col("h").alias("b"), F.lit(None).cast("binary").alias("data"))
    anchors = listed.groupBy("chunk").cogroup(texts).applyInArrow(_tidy(_send_anchors(window, bits, width)), "range long, chunk long, data binary")
    answers = anchors.groupBy("range").applyInArrow(_tidy(_answer(HOT)), SIDE)
    found = listed.unionByName(answers).groupBy("chunk").cogroup(texts).applyInArrow(_tidy(_send_stretches(window, bits, width)), STRETCHES)
    # Stretches hold up to five times the bytes of live text.
    parts = partitions_for(df.sparkSession, 5 * size)
    ordered = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "stretch", "key")
    marks = ordered.mapInArrow(_repeats(window), SIDE)
    out = StructType.fromDDL("key long, h long, n_bytes long, spans array<struct<start: long, end: long>>")
    out = out.add("kept", "string" if whole_characters else "binary")
    for name in names:
        out = out.add(name, source.schema[name].dataType, True)
    cut = listed.unionByName(marks).groupBy("chunk").cogroup(texts).applyInArrow(_tidy(_cut(window, names, whole_characters)), out)
    return cut.select(F.when(F.col("key") != LAST, F.col("key")).alias("doc_id"), F.col("h").alias("text_hash"), "n_bytes", "spans", "kept", *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)))


def with_text(cut: DataFrame) -> DataFrame:
    """Adds text: the kept bytes as UTF-8, without characters of which a part was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_characters(b) for b in batch.column("kept").to_pylist()]
            keep = [c for c in batch.schema.names if c != "kept"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "kept")
    return cut.mapInArrow(run, f"{fields}, text string")
