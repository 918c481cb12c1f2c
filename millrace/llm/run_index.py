"""A run-length compressed Burrows-Wheeler index over many short strings, and matching statistics against it.

The transform is kept as runs: symbol, first row, the row its first row maps to, and the text position at either
end (the sampled run ends). Matching statistics are streamed from the right: a pattern's symbol extends
the match in its row's run, or else the match goes on at the nearest run end with that symbol before or behind,
whichever shares more with the match so far. All patterns advance together.

What is kept after the build is the text, two bytes a symbol, four arrays over the runs, and one entry for each
different window; the arrays of the suffix sort go.
"""

from __future__ import annotations

import numpy as np

#: Symbols that are packed into the first sort key; symbols that are compared at a time.
FIRST, STEP = 7, 16


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key, from 1; the positions in ascending order of key and position)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, order


class RunIndex:
    """Index of the concatenated strings; equal suffixes are ordered by the position of their string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, window: int):
        """data, offsets: the strings' bytes; owners: a number for each string; window: the length of interest."""
        lengths = np.diff(offsets)
        count = len(lengths)
        n = len(data) + count
        starts = offsets[:-1] + np.arange(count)
        of = np.repeat(np.arange(count), lengths)
        self.text = np.zeros(n + STEP, np.uint16)
        self.text[np.arange(len(data)) + of] = data.astype(np.uint16) + 1
        self.size = n
        string = np.repeat(np.arange(count), lengths + 1)
        last = (starts + lengths)[string]  # each position's separator
        at = np.arange(n)
        keys = np.zeros(n, np.int64)
        for i in range(FIRST):
            keys = keys * 257 + np.where(at + i <= last, self.text[np.minimum(at + i, n - 1)], 0)
        ranks, order = _ranks(keys)
        depth, longest = FIRST, int(lengths.max(initial=0)) + 1
        below, kept = depth, ranks
        while depth < longest:
            behind = np.where(at + depth <= last, ranks[np.minimum(at + depth, n - 1)], 0)
            ranks, order = _ranks(ranks * (n + 1) + behind)
            depth *= 2
            if depth <= window:
                below, kept = depth, ranks
        # Rows whose suffixes share the first ``window`` symbols are neighbours; the smallest owner of each such group.
        head = kept[order]
        shift = window - below
        tail = np.where(at + shift <= last, kept[np.minimum(at + shift, n - 1)], 0)[order]
        new = np.ones(n, bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        self.group_starts = np.flatnonzero(new).astype(np.int32)
        self.group_owner = np.minimum.reduceat(owners[string[order]], self.group_starts)
        # The transform, as runs.
        symbols = self.text[order - 1]
        new[1:] = symbols[1:] != symbols[:-1]
        new[0] = True
        self.run_starts = np.flatnonzero(new)
        self.run_symbols = symbols[self.run_starts].astype(np.int64)
        run_lengths = np.diff(np.append(self.run_starts, n))
        self.last_row = self.run_starts + run_lengths - 1
        self.first_sample, self.last_sample = order[self.run_starts], order[self.last_row]
        by_symbol = np.argsort(self.run_symbols, kind="stable")
        before = np.cumsum(run_lengths[by_symbol]) - run_lengths[by_symbol]
        self.run_maps_to = np.empty(len(by_symbol), np.int64)
        self.run_maps_to[by_symbol] = before
        self.symbol_runs = self.run_symbols[by_symbol] * len(by_symbol) + by_symbol

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the text's suffixes at a and b, ``most`` at most."""
        total, on, spread = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(STEP)
        while len(on):
            x, y = (np.minimum(p[on] + total[on], self.size)[:, None] + spread for p in (a, b))
            alike = self.text[np.minimum(x, self.size)] == self.text[np.minimum(y, self.size)]
            whole = alike.all(1)
            total[on] += np.where(whole, STEP, alike.argmin(1))
            on = on[whole & (total[on] < most[on])]
        return np.minimum(total, most)

    def owners_of_windows(self, data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, place, owner) of every window of the patterns that occurs in the index, with the smallest owner
        of a string it occurs in."""
        lengths = np.diff(offsets)
        k, runs = len(lengths), len(self.run_starts)
        row, match, place = (np.zeros(k, np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > step)
            at = lengths[on] - 1 - step
            symbol = data[offsets[on] + at].astype(np.int64) + 1
            r, m, p = row[on], match[on], place[on]
            run = np.searchsorted(self.run_starts, r, side="right") - 1
            extends = self.run_symbols[run] == symbol
            r = np.where(extends, self.run_maps_to[run] + r - self.run_starts[run], 0)
            m2, p2 = np.where(extends, m + 1, 0), np.where(extends, p - 1, 0)
            # An empty match has no place yet: any row that starts with the symbol will do.
            lost = np.flatnonzero(~extends | (m == 0))
            if len(lost):
                c, old, most = symbol[lost], p[lost], m[lost]
                spot = np.searchsorted(self.symbol_runs, c * runs + run[lost])
                options = []
                for where, samples, rows in ((spot, self.first_sample, self.run_starts), (spot - 1, self.last_sample, self.last_row)):
                    inside = (where >= 0) & (where < runs)
                    key = self.symbol_runs[np.clip(where, 0, runs - 1)]
                    inside &= key // runs == c
                    which = key % runs
                    length = np.where(inside, self._common(old, samples[which], most), -1)
                    options.append((length, self.run_maps_to[which] + rows[which] - self.run_starts[which], samples[which] - 1))
                (l1, r1, p1), (l2, r2, p2b) = options
                first = l1 >= l2
                best = np.where(first, l1, l2)
                r[lost] = np.where(best < 0, 0, np.where(first, r1, r2))
                m2[lost] = best + 1
                p2[lost] = np.where(best < 0, 0, np.where(first, p1, p2b))
            row[on], match[on], place[on] = r, m2, p2
            hit = np.flatnonzero(m2 >= window)
            if len(hit):
                group = np.searchsorted(self.group_starts, r[hit], side="right") - 1
                found.append((on[hit], at[hit], self.group_owner[group]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))
