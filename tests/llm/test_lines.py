"""Lines that repeat across documents, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def expected(rows):
    """(doc_id, n_lines, n_dropped, kept text) of every row; rows without an id are documents by their text, after all others."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    who = lambda i, t: (1, 0, t or "") if i is None else (0, i, "")
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(who(i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == who(i, t)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, rows, parts=None, **more):
    df = spark.createDataFrame([(i, t, "a", 1, b"x") for i, t in rows], "doc_id long, text string, none string, id int, keep binary")
    df = df.repartition(parts) if parts else df
    kept = line_dedup.drop_lines(df, line_dedup.keep_bitmaps(df, **more))
    return sorted([tuple(r) for r in kept.select("doc_id", "n_lines", "n_dropped", "kept").collect()], key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    pool = ["short", "A Line That Repeats", " a line that repeats\t", "ÄÖÜ äöü straße ö", "exactly 10", "only nine", "İstanbul line of text", ""]
    pool += [f"line number {i} of the pool" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {j}" for j in range(rng.randint(0, 90)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "A line that repeats\r\n" * 70), (203, "A line that repeats\r\n" * 70), (203, "another text\nexactly 10"), (-5, "exactly 10\nmore of this document")]
    rows += [(None, "exactly 10\nno id here at all")] if seed == 3 else []
    rows += [(None, None), (None, None), (300 + seed, "\n".join(f"very long {i % 5000}" for i in range(12_000))), (301 + seed, "\n".join(f"very long {i % 7000}" for i in range(9_000)))]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_against_plain_python(spark, parts):
    rows = corpus()
    assert got(spark, rows, parts) == expected(rows)


def test_one_line_in_every_document(spark):
    """A third of all lines are one; the ranges split it, and each range but the first waits for the border."""
    rng = random.Random(8)
    rows = [(i, "\n".join(["the line of all documents"] * rng.randint(1, 3) + [f"own {i} {j} ......" for j in range(3)])) for i in rng.sample(range(5000), 1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(spark, rows, 5) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_text_beyond_a_slice(spark, monkeypatch):
    rows = [(2, "\n".join(f"line {i:09d}" for i in range(300_000))), (1, "\n".join(f"line {i:09d}" for i in range(0, 300_000, 3)))]
    assert sum(len(t) for _, t in rows) > line_dedup.SLICE
    assert got(spark, rows) == expected(rows)


def test_empty_table_and_bitmaps(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "first of the lines\nb"), (2, "x\nFirst of the lines \ny")], "doc_id long, text string")
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(df).collect()}
    assert maps[1]["keep"] is None and line_dedup.stays(maps[2]["keep"], 3).tolist() == [True, False, True]
    carried = line_dedup.drop_lines(df.withColumn("source", F.lit("s")), line_dedup.keep_bitmaps(df), carry=("source",))
    assert {tuple(r) for r in carried.select("doc_id", "source", "kept").collect()} == {(1, "s", "first of the lines\nb"), (2, "s", "x\ny")}
    with pytest.raises(ValueError):
        line_dedup.drop_lines(df.withColumn("kept", F.lit(1)), line_dedup.keep_bitmaps(df), carry=("kept",))


def test_query_hash_is_of_the_kept_text(spark):
    from millrace.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    theirs = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in expected(rows))
    assert sorted(tuple(r) for r in queries.op12_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == theirs
