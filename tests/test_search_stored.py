"""Top rows by blocks and the dictionary by deletions, against the plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(4000):
        own = [rng.choice(words) for _ in range(rng.randint(3, 40))] + ["common"] * rng.choice([0, 1, 1, 2])
        own += ["rare"] * 3 * (900 <= i < 912) + ["medium"] * (i % 50 == 0)
        texts.append((i, " ".join(own), "f", 1.0))
    texts += [(5000, None, "f", 1.0), (5001, "", "f", 1.0), (None, "common rare", "f", 1.0)]
    df = spark.createDataFrame(texts, "id long, text string, field string, best double")
    index = search.build_index(df, "id", ["text"])
    return index, search.store_index(index, str(tmp_path_factory.mktemp("text") / "index"))


def listed(hits):
    return [(r["id"], round(r["score"], 9)) for r in hits.collect()]


@pytest.mark.parametrize("text", ["rare common", "common", "medium w1 common", "nothing here", "rare nothing", "w5 w6 w7 w8", ""])
@pytest.mark.parametrize("size", [1, 10])
def test_top_equals_the_full_ranking(stored, text, size):
    index, kept = stored
    assert listed(search.match_top(kept, "text", text, size)) == listed(search.match(index, "text", text, size))


def test_blocks_that_cannot_reach_are_skipped(stored):
    _, kept = stored
    blocks, _, _ = search.top_ranges(kept, "text", "rare common", 10)
    both = kept.blocks.where(F.col("term").isin("rare", "common"))
    assert blocks.count() <= 4 < both.count() / 5
    # A frequent word is in blocks of bounded size, whichever task wrote them.
    assert both.agg(F.max(F.size("held"))).first()[0] <= 1 << search.RANGE_BITS
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "range" in plan.split("PushedFilters")[1]


def test_many_open_ranges_by_a_join(stored, monkeypatch):
    index, kept = stored
    monkeypatch.setattr(search, "NAMED_RANGES", 1)
    assert listed(search.match_top(kept, "text", "w1 w2 w3", 10)) == listed(search.match(index, "text", "w1 w2 w3", 10))


def edits(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_deletions_find_all_within_the_edits(spark):
    """Every pair of words within one or two edits, swaps too, shares a deletion of its beginnings."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 11))) for _ in range(120)]
    for w in words[:60]:
        x = list(w)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(x) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                x.insert(at, rng.choice("abcé"))
            elif x and kind == 1:
                x.pop(min(at, len(x) - 1))
            elif len(x) > at + 1:
                x[at], x[at + 1] = x[at + 1], x[at]
        words.append("".join(x))
    words = sorted(set(words))
    made = {}
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", search.deletions("w", 1).alias("one"), search.deletions("w", 2).alias("two")).collect():
        made[r["w"]] = (set(r["one"]), set(r["two"]))
    near = 0
    for a in words:
        for b in words:
            d = edits(a, b)
            if d <= 2:
                near += a != b
                assert made[a][1] & made[b][1]
                assert d > 1 or made[a][0] & made[b][1]
    assert near > 100


def test_stored_dictionary_is_read_at_deletions(stored):
    index, kept = stored
    for text in ("commom madium common", "rar", "w1x2 xyzzy"):
        assert sorted(map(tuple, search.suggest(kept, "text", text).collect())) == sorted(map(tuple, search.suggest(index, "text", text).collect()))
    plan = search._near(kept, "text", [(0, "commom", 2)])._jdf.queryExecution().executedPlan().toString()
    assert "In(deleted" in plan.split("PushedFilters")[1] and "/terms" not in plan
    for text in ("commno w1", "medum rar", "w12 w"):
        assert sorted(map(tuple, search.match_bool_prefix(kept, "text", text, 2).collect())) == sorted(map(tuple, search.match_bool_prefix(index, "text", text, 2).collect()))


def test_postings_come_back_and_no_word_is_shuffled(spark, tmp_path, monkeypatch):
    """Positions, lengths and two fields from blocks of few documents; texts are shuffled to be dealt, words aren't."""
    monkeypatch.setattr(search, "WORDS", 6)
    df = spark.createDataFrame([(i, "b a b c" if i % 3 else "a", None if i % 5 else f"b x{i}") for i in range(200)] + [(900, " ", "")], "id int, one string, two string")
    index = search.build_index(df, "id", ["one", "two"])
    written = []
    real = type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *by: written.append(real(self, *by)) or written[-1])
    kept = search.store_index(index, str(tmp_path / "two"))
    plan = next(d for d in written if "best" in d.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(id") == 1 == plan.count("Exchange ") and plan.index("MapInArrow") < plan.index("Exchange ")
    for column in ("postings", "lengths"):
        want = getattr(index, column)
        assert sorted(map(tuple, getattr(kept, column).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert kept.blocks.agg(F.max(F.size("held"))).first()[0] > 1
    assert {(r["term"], r["freq"]) for r in search.dictionary(kept, "one").collect()} == {("a", 200), ("b", 133), ("c", 133)}
    assert search.match_phrase(kept, "one", "b c").count() == 133 and search.prefix(kept, "two", "x1").count() == 22
    empty = search.store_index(search.build_index(df.where("id = 900"), "id", ["one"]), str(tmp_path / "none"))
    assert search.match(empty, "one", "a").count() == 0 == search.match_top(empty, "one", "a").count()
