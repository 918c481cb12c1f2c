"""A cover tree over a block of vectors, for exact searches of inner products within windows.

Vectors get one more component that brings all of them to the length of the block's longest, so that a larger inner product with
any query is a smaller distance. Each level covers a node's points by balls of half its radius, as many as that takes; the radius that a
ball really has bounds the inner products of all that is in it. Points that no other point is near to stay in their node.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np

#: Points that a node holds without being divided.
LEAF = 16
#: Sums of products below this are exact as doubles.
EXACT = 2.0**53


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole doubles, or Python's integers where these might be inexact."""
    if x.size == 0 or np.abs(x).max() * scale < EXACT:
        return np.floor(x * scale)
    return np.array([math.floor(Fraction(c) * scale) for c in x.ravel().tolist()], object).reshape(x.shape)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, as longs or as Python's integers."""
    if rows.dtype != object and query.dtype != object and len(query):
        largest = np.abs(rows).max(initial=0.0) * np.abs(query).max() * len(query)
        if largest < EXACT:
            return np.rint(rows @ query).astype(np.int64)
        rows = np.array([[int(c) for c in r] for r in rows.tolist()], object).reshape(rows.shape)
    out = np.empty(len(rows), object)
    query = [int(c) for c in query.tolist()]
    for i, r in enumerate(rows.tolist()):
        out[i] = sum(int(a) * b for a, b in zip(r, query, strict=True))
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, nodes, radii). A node: its centre, the range of its own points and the range of its children, in that order."""
    n = len(vectors)
    points = vectors.astype(np.float64)
    squares = (points**2).sum(1)
    if not np.isfinite(squares).all() or not n:
        return np.arange(n), np.array([[0, 0, n, 1, 1]], np.int64), np.array([np.inf])
    augmented = np.column_stack([points, np.sqrt(np.maximum(squares.max() - squares, 0))])

    def from_centre(c: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((augmented[rows] - augmented[c]) ** 2).sum(1))

    everything = np.arange(n)
    root = int(((augmented - augmented.mean(0)) ** 2).sum(1).argmin())
    distance = from_centre(root, everything)
    level = [(root, float(distance.max(initial=0.0)), everything, distance)]
    order, nodes, radii = [], [], []
    made, at = 1, 0
    while level:
        following = []
        for centre, radius, rows, distance in level:
            own, children = rows, []
            if len(rows) > LEAF and radius > 0:
                own, rest, c, d = [], rows, centre, distance
                while len(rest):
                    near = d <= radius / 2
                    near[rest == c] = True
                    ball = rest[near]
                    if len(ball) == 1:
                        own.append(ball)
                    else:
                        children.append((c, float(d[near].max()), ball, d[near]))
                    rest = rest[~near]
                    if len(rest):
                        c = int(rest[0])
                        d = from_centre(c, rest)
                own = np.concatenate(own) if own else np.zeros(0, np.int64)
            order.append(own)
            nodes.append([centre, at, at + len(own), made, made + len(children)])
            radii.append(radius)
            at += len(own)
            made += len(children)
            following += children
        level = following
    order = np.concatenate(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    nodes = np.array(nodes, np.int64)
    nodes[:, 0] = place[nodes[:, 0]]
    return order, nodes, np.array(radii)


class CoverTree:
    """vectors and ids in the order of build()."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.ids, self.vectors, self.nodes, self.radii = ids, vectors, nodes, radii
        self.square = float((vectors.astype(np.float64) ** 2).sum(1).max(initial=0.0))

    def bounds(self, query: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(most, least) inner products within each of some nodes."""
        at = np.asarray(products(self.vectors[self.nodes[first:last, 0]], query), np.float64)
        radius = self.radii[first:last]
        length = float((query.astype(np.float64) ** 2).sum())
        slack = 1e-9 * (length + self.square) + 1e-6
        if not np.isfinite(slack) or not np.isfinite(radius).all():
            return np.full(len(at), np.inf), np.full(len(at), -np.inf)
        both = length + self.square
        distance = np.sqrt(np.maximum(both - 2 * at, 0))
        most = np.minimum((both - np.maximum(distance - radius, 0) ** 2) / 2, at + math.sqrt(length) * radius)
        least = np.maximum((both - (distance + radius) ** 2) / 2, at - math.sqrt(length) * radius)
        return most + slack, least - slack

    def search(self, query: np.ndarray, own: int, windows: list[tuple], k: int) -> list[list[tuple[int, int]]]:
        """For each window (lowest, highest) of inner products the k largest within it as (product, id), ties by the smaller id, but never of the id
        ``own``. None as an end is no bound. Nodes are taken by the largest product that they may hold."""
        found: list[list[tuple]] = [[] for _ in windows]
        need = [-math.inf if lo is None else lo for lo, _ in windows]
        top = [math.inf if hi is None else hi for _, hi in windows]
        most, least = self.bounds(query, 0, 1)
        heap = [(-most[0], 0)] if any(most[0] >= n and least[0] <= t for n, t in zip(need, top, strict=True)) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < min(need):
                break
            _, a, b, first, last = self.nodes[node].tolist()
            if b > a:
                scores, ids = products(self.vectors[a:b], query), self.ids[a:b]
                for w in range(len(windows)):
                    fit = np.flatnonzero((scores >= need[w]) & (scores <= top[w]) & (ids != own))
                    if len(fit) > 4 * k and scores.dtype != object:
                        cut = np.partition(scores[fit], len(fit) - k)[len(fit) - k]
                        fit = fit[scores[fit] >= cut]
                    if len(fit):
                        found[w] = heapq.nsmallest(k, [*found[w], *((-int(s), int(i)) for s, i in zip(scores[fit], ids[fit], strict=True))])
                        if len(found[w]) == k:
                            need[w] = max(need[w], -found[w][-1][0])
            if last > first:
                most, least = self.bounds(query, first, last)
                useful = np.zeros(last - first, bool)
                for n, t in zip(need, top, strict=True):
                    useful |= (most >= n) & (least <= t)
                for i in np.flatnonzero(useful).tolist():
                    heapq.heappush(heap, (-most[i], first + i))
        return [[(-s, i) for s, i in f] for f in found]
