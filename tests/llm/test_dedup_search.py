"""Jaccard join, top-k, decontamination and substring removal against brute force."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, substrings, topk
from millrace.llm.run_index import RunIndex
from millrace.llm.textarrays import text_bytes

SCHEMA = "doc_id long, text string, token string, id string, digest int, n int"


def frame(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    passage = prose(rng, 40)
    out = []
    for i in range(60):
        words = prose(rng, rng.choice([0, 1, 3, 5, 30, 80, 120])).split(" ")
        out.append((i, " ".join(words)))
        if i % 3 == 0 and len(words) > 20:
            for _ in range(3):
                near = list(words)
                for _ in range(rng.randint(0, 4)):
                    near[rng.randrange(len(near))] = "zz"
                out.append((100 + len(out), " ".join(near)))
        if i % 5 == 0:
            out.append((300 + i, f"{prose(rng, 10)} {passage} {prose(rng, 3)}"))
    base = prose(rng, 60)
    out += [(500 + i, base) for i in range(30)] + [(600 + i, f"{base} tail{i}") for i in range(30)]
    out += [(700, None), (701, ""), (702, " \n"), (703, "\x0b\x1c"), (704, "aaaa " * 400), (705, "aaaa " * 400 + "b"), (706, "x" * 5000), (706, "x" * 5000), (None, base), (None, None)]
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """The smallest id of each row's component; ids of one text are in one component, rows without an id too."""
    sets = {t or "": shingles(t) for _, t in texts}
    parent = {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, t in texts:
        if i is not None and sets[t or ""]:
            least[root(t)] = min(i, least.get(root(t), i))
    return collections.Counter((i, len(sets[t or ""]), least.get(root(t)) if sets[t or ""] else i) for i, t in texts)


def test_components(spark, texts):
    odd = texts + [(None, "only rows without an id say these few words"), (None, "only rows without an id say these few words"), (None, prose(random.Random(8), 30))]
    out = jaccard.near_duplicates(frame(spark, odd)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == components(odd)
    classes = collections.defaultdict(set)
    for r in out:
        if r["class"] is not None:
            classes[r["class"]].add(r.component_id)
    assert all(len(ids) == 1 for ids in classes.values())
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("open_texts")} == set()


def test_link_through_a_row_without_id(spark):
    words = [f"w{i}" for i in range(120)]
    a, b, c = (" ".join(words[i : i + 100]) for i in (0, 8, 16))
    assert 100 * len(shingles(a) & shingles(c)) < 80 * len(shingles(a) | shingles(c))
    out = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, [(5, a), (None, b), (7, c)])).collect()}
    assert out == {5: 5, None: 5, 7: 5}


@pytest.mark.parametrize("few", [0, 3, 16, 1000])
def test_template_texts_and_few_rounds(spark, monkeypatch, few):
    """Texts that share three quarters of their words, beside real copies, with no pivot rounds: all pairs of open buckets,
    of the first order where they have ``few`` rows at most, of the second where they have more."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "FIRST_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "SECOND_ROUNDS", 0)
    rng = random.Random(15)
    template = prose(rng, 60)
    texts = [(i, f"{template} {prose(rng, 20)}") for i in range(25)]
    texts += [(100 + i, f"{texts[i][1]} {prose(rng, i)}") for i in range(12)]
    out = jaccard.near_duplicates(frame(spark, texts)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == components(texts)


def test_pairs_of_buckets_are_in_proportion_to_their_rows(spark):
    few = lambda sizes: jaccard._few(spark.createDataFrame(list(enumerate(sizes)), "token long, rows long"))
    assert few([2] * 50 + [24, 30]) == 30  # a bucket somewhat larger than most asks for no second order
    assert few([30] * 50) == jaccard.FEW  # all would make 14.5 pairs a row
    assert few([2] * 5000 + [20, jaccard.FULL + 1]) == 20 and few([]) == jaccard.FEW


def test_prefixes_agree_under_every_order():
    rng = random.Random(16)
    for _ in range(40):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 60))}
        b = set(list(a)[: rng.randint(1, len(a))]) | {rng.getrandbits(64) for _ in range(rng.randint(0, 6))}
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        hashes, offsets = np.concatenate(sets), np.array([0, len(a), len(a) + len(b)])
        if 100 * len(a & b) >= 80 * len(a | b):
            for seed in jaccard.ORDERS:
                x, y = jaccard._heads(hashes, offsets, 80, seed).to_pylist()
                assert set(x) & set(y)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert jaccard.near_duplicates(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def removed(texts, window=50):
    first = {}
    for i, t in texts:
        key = float("inf") if i is None else i
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in texts:
        key = float("inf") if i is None else i
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < key:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return collections.Counter(out)


def test_repeats(spark, texts):
    got = substrings.remove_repeats(frame(spark, texts)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == removed(texts)
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_in_small_indices(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "INDEX_BYTES", 500)
    got = substrings.remove_repeats(frame(spark, texts)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == removed(texts)


def test_repeats_in_many_rows_without_id(spark):
    rng = random.Random(11)
    shared = prose(rng, 40)
    texts = [(1, shared), (2, f"start {shared}")]
    for key in (None, 7):
        texts += [(key, prose(rng, 40) + (f" {shared}" if i % 3 == 0 else "")) for i in range(900)]
    got = substrings.remove_repeats(frame(spark, texts)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == removed(texts)


def test_hot_anchors_are_split(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 4)
    rng = random.Random(12)
    passage = prose(rng, 40)
    shared = texts + [(None if i % 9 == 0 else 1000 + i // 2, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(120)]
    got = substrings.remove_repeats(frame(spark, shared)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == removed(shared)


def test_split_windows_are_dealt_by_their_own_hash():
    rng = random.Random(13)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(30)]
    n = len(texts)
    docs = pa.table([pa.array([3] * n), pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["chunk", "key", "h", "text"])
    side = pa.table([pa.array([3] * n), pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array(range(n)), pa.nulls(n, pa.binary())], ["chunk", "kind", "a", "b", "data"])
    sent = substrings._send_anchors(50, 40, 1 << 36)(side, docs)
    answers = [substrings._answer(4)(sent.slice(i, 1)) for i in range(sent.num_rows)]
    found = substrings._send_stretches(50, 40, 1 << 36)(pa.concat_tables([side, *answers]), docs).to_pylist()
    assert any(r["start"] < 0 and len(r["stretch"]) == 50 for r in found)
    assert any(r["start"] < 0 and len(r["stretch"]) == 4 for r in found)
    unsplit = collections.Counter(r["anchor"] for r in found if r["start"] >= 0)
    assert max(unsplit.values(), default=0) <= 4


def test_stretches_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(14)
    raw, offsets = text_bytes(pa.array([prose(rng, n) for n in (0, 3, 400, 9, 9, 0, 30)]))
    whole = [x.tolist() for x in substrings.stretches(raw, offsets, 50)]
    assert len(whole[0]) > 20
    for block in (1, 7, 64):
        monkeypatch.setattr(substrings, "BLOCK", block)
        assert [x.tolist() for x in substrings.stretches(raw, offsets, 50)] == whole


def test_removed_text_is_valid(spark):
    a = "é" * 60
    out = substrings.with_text(substrings.remove_repeats(frame(spark, [(1, a), (2, f"x{a}zñ"), (3, f"x{a}ñ")]))).orderBy("doc_id").collect()
    # The first byte of ñ is also that of é, so it goes with the repeated ones, and the rest of the character with it.
    assert [r.text for r in out] == [a, "xzñ", ""]


def test_run_index_matches_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
        patterns = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(9)]
        join = lambda parts: (np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        index = RunIndex(*join(strings), np.arange(12) * 10, 9)
        got = sorted(zip(*map(list, index.owners_of_windows(*join(patterns), 9)), strict=True))
        want = [(p, k, min(10 * s for s in range(12) if pattern[k : k + 9] in strings[s])) for p, pattern in enumerate(patterns) for k in range(len(pattern) - 8) if any(pattern[k : k + 9] in s for s in strings)]
        assert got == sorted(want)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination(spark, limit):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 12, 10, 4, 1, 0))] + [(6, None), (None, "a b")]
    docs = []
    for i in range(40):
        body = prose(rng, 50).split(" ")
        item = (items[rng.randrange(6)][1] or "").split(" ")
        cut = rng.randint(0, max(0, len(item) - 10))
        docs.append((i, ", ".join(body[:20] + item[cut : cut + rng.choice([9, 10, 12, 30])] + body[20:]).upper().replace("É", "é")))
    docs += [(50, None), (None, items[0][1]), (None, None), (51, ""), (52, items[0][1]), (52, items[0][1]), (53, items[2][1][:-1])]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = word(t)
        if i is not None and w:
            windows[i] = {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    expected = collections.Counter()
    for i, t in docs:
        w, hit, found = word(t), set(), set()
        for item, wins in windows.items():
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(item))
        expected[i, len(w), len(hit), len(found), ",".join(sorted(found))] += 1
    out = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in out.collect()) == expected


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 1, 3])).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(300, None), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (306, [0.0] * 6), (308, [-1.0] * 6), (310, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.topk(df, F.col("vec_id") % 10 == 0, k=5).collect())
    usable = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, u in usable:
        if q % 10 == 0:
            scores = sorted((-int(u @ v), i) for i, v in usable if i != q and len(v) == len(u))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_topk_of_long_vectors(spark, monkeypatch):
    """Components of any finite size, repeated ids, empty vectors, and columns with the names that the operator uses inside."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(17)
    sizes = [0.01, 1.0, 2.0**20, 2.0**30, 2.0**41, 2.0**60, 1e300, 1.7e308]
    rows = [(i // 2 * 2 if i > 30 else i, [rng.uniform(-1, 1) * rng.choice(sizes) for _ in range(3)]) for i in range(50)]
    rows += [(50, [2.0**41, 0.0, 0.0]), (51, [1.0, 0.0, 0.0]), (52, []), (53, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "b", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, block string, x int, score double")
    got = [tuple(r) for r in topk.topk(df, F.col("vec_id") % 5 == 0, k=4).collect()]
    usable = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v and all(map(math.isfinite, v))]
    best = collections.defaultdict(list)
    for q, u in usable:
        if q % 5 == 0:
            best[q] += [(-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in usable if i != q]
    limit = 2**63 - 1
    want = [(q, r, i, max(-limit, min(limit, -s))) for q, hits in best.items() for r, (s, i) in enumerate(sorted(hits)[:4], 1)]
    assert sorted(got) == sorted(want)


def test_digest_of_kept_bytes(spark):
    from millrace.llm.queries import op9_suffix_dedup

    rows = op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_removed for r in rows) > 0
    assert all(r.kept_sha256 != hashlib.sha256(b"").hexdigest() or r.n_removed == r.n_bytes for r in rows)
