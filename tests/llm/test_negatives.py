"""Cover trees and hard negatives against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import cover_tree, hard_negatives, queries


def clustered(rng, n, dim=8):
    centres = rng.normal(size=(5, dim))
    out = np.where(rng.random((n, 1)) < 0.6, centres[rng.integers(0, 5, n)] + 0.02 * rng.normal(size=(n, dim)), rng.normal(size=(n, dim)))
    return out * rng.choice([1.0, 1.0, 3.0, 0.2], (n, 1))


def test_tree_against_all_products():
    """Every window's best, and radii that cover what is below them; clusters that no window reaches aren't verified."""
    rng = np.random.default_rng(4)
    x = clustered(rng, 900)
    x[10:40] = x[10]
    v, ids = cover_tree.whole(x, 256), rng.permutation(5000)[:900].astype(np.int64)
    order, nodes, radii = cover_tree.build(v)
    assert sorted(order.tolist()) == list(range(900))
    tree = cover_tree.CoverTree(ids[order], v[order], nodes, radii)
    seen = 0
    for q, own in zip(cover_tree.whole(clustered(rng, 40), 256), ids[:40].tolist(), strict=True):
        scores = [int(s) for s in v @ q]
        top = max(scores)
        windows = [(None, None), (math.ceil(0.8 * top), top), (0, 10), (top + 1, None)]
        for (lo, hi), found in zip(windows, tree.search(q, own, windows, 5), strict=True):
            fit = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != own and (lo is None or s >= lo) and (hi is None or s <= hi))
            assert found == [(-s, i) for s, i in fit[:5]]
        most, least = tree.bounds(q, 0, len(nodes))
        for (centre, a, b, *_), m, l in zip(nodes.tolist(), most, least, strict=True):
            inside = v[order][a:b] @ q
            assert (inside <= m).all() and (inside >= l).all()
        seen += int((most >= top).sum())
    assert seen < 0.5 * 40 * len(nodes)


def expected(rows, positives=5, negatives=5):
    """rows: (id, label, vector); anchors are ids divisible by 10."""
    ok = [(i, lab, [math.floor(Fraction(float(c)) * 256) for c in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    out = []
    for anchor, label, v in {(i, lab, tuple(v)) for i, lab, v in ok if i % 10 == 0}:
        scored = sorted((-dot(v, w), i, lab == label) for i, lab, w in ok if i != anchor and len(w) == len(v))
        for ps, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
            out += [(anchor, pid, r, nid, clip(-ps), clip(-ns)) for r, (ns, nid, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, block string, rank int")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in hard_negatives.hard_negatives(df, "vec_id % 10 = 0").collect())


@pytest.mark.parametrize("blocks", [(4096, 512), (20, 3)])
def test_negatives_against_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TREE_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    rng, pick = np.random.default_rng(6), random.Random(6)
    rows = [(i, pick.choice([0, 0, 0, 1, 2]), [float(c) for c in v]) for i, v in enumerate(clustered(rng, 260))]
    rows += [(400 + i, i % 3, rows[30][2]) for i in range(12)]  # ties
    rows += [(500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.5]), (502, 2, [1.0, 2.25]), (503, 2, [1.0, None]), (504, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (505, 1, None), (506, 1, []), (507, 1, [math.nan, 1.0]), (508, 1, [math.inf, 1.0])]
    rows += [(20, 0, rows[20][2]), (20, 0, rows[20][2]), (20, 1, rows[21][2]), (510, 3, [-1.0, -1.0]), (511, 3, [0.0, 0.0])]
    assert got(spark, rows) == expected(rows)


def test_scores_beyond_a_long(spark):
    big = 3e18
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 2.0]), (2, 1, [big / 2, 2.0]), (3, 2, [0.9 * big, 0.0]), (4, 2, [0.9 * big, 1e300]), (5, 2, [0.45 * big, 5.0]), (6, 1, [1.0, 1.0]), (7, 2, [0.9, 0.9]), (10, 2, [-big, 4.0])]
    assert got(spark, rows) == expected(rows)
    for s in (2**70, -(2**70), 5):
        assert hard_negatives.exact(0 if abs(s) > 9 else s, hard_negatives._in_order(s) if abs(s) > 9 else None) == s


def test_empty_table(spark):
    assert got(spark, []) == []


def test_query_rows(spark):
    assert queries.op11_hard_negatives(spark, "/root/testdata/sf0.01").count() > 20
