"""What the pipeline's tasks and their Python workers hold."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import pieces, substrings

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def python_steps(df) -> list[int]:
    """How many steps in Python follow each other without a shuffle or a table between, for each such row of steps."""
    runs = [0]
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if re.search(r"MapInArrow|GroupsInArrow", line):
            runs[-1] += 1
        elif re.search(r"Exchange|Scan", line):
            runs.append(0)
    return runs


def test_cut_texts_need_one_worker_for_a_task(spark, docs):
    assert max(python_steps(substrings.with_text(substrings.remove_repeats(docs)))) == 2
    out = corpus_pipeline.cut_repeated_passages(spark, docs, SMALL)
    assert max(python_steps(out)) == 1
    cut = substrings.with_text(substrings.remove_repeats(docs).where((F.col("n_bytes") == 0) | (F.octet_length("kept") > 0)))
    want = cut.select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    got = out.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    assert got.to_pylist() == want.to_pylist()


def test_whole_characters_are_those_of_with_text(spark):
    a = "é" * 60
    rows = spark.createDataFrame([(1, a), (2, f"x{a}zñ"), (3, f"x{a}ñ"), (4, a), (5, None)], "doc_id long, text string")
    plain = substrings.with_text(substrings.remove_repeats(rows)).orderBy("doc_id").collect()
    once = substrings.remove_repeats(rows, whole_characters=True).orderBy("doc_id").collect()
    assert [r.kept for r in once] == [r.text for r in plain] == [a, "xzñ", "", "", ""]


def test_pipeline_asks_for_small_batches(spark, docs, monkeypatch):
    before = spark.conf.get(KEY, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "benchmark_decontamination":  # no Python there
                continue
            spark.conf.unset(KEY)
            stage(spark, docs, SMALL)
            assert int(spark.conf.get(KEY).rstrip("b")) == corpus_pipeline.ARROW_BYTES, name
        spark.conf.set(KEY, "1m")
        corpus_pipeline.encode_tokens(spark, docs, SMALL)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc alone")
def test_an_idle_worker_gives_its_heap_back():
    """Arrays of 100 kB come from the heap, where one at the end keeps all that was freed before it."""
    held = [np.ones(100_000, np.uint8) for _ in range(2000)]
    last = np.ones(100_000, np.uint8)
    del held
    full = resident()
    assert list(pieces.rows_of(iter([pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])]), "text"))
    assert full - resident() > 100_000_000 and len(last)
