"""Nearest neighbours by blocks in a shuffle, and the stored index."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import vector

DIM = 8


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], "s", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, salt string, block int")


def asked(df):
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def brute(vectors, queries, k, metric):
    out = {}
    for q, x in queries.items():
        if metric == "l2":
            d = ((vectors - x) ** 2).sum(1)
        elif metric == "dot":
            d = -(vectors @ x)
        else:
            d = 1 - vectors @ x / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(x))
        order = sorted(range(len(vectors)), key=lambda i: (d[i], i))[:k]
        out[q] = [(i, round(float(d[i]), 9)) for i in order]
    return out


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9)))
    return out


def clustered(rng, n, clusters=40):
    centres = rng.normal(size=(clusters, DIM)) * 10
    return centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, DIM))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_in_a_grid_without_the_driver(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, DIM))
    df = frame(spark, vectors).repartition(3)
    monkeypatch.setattr(vector, "BLOCK", 60)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector, "TASK_BYTES", 500)
    monkeypatch.setattr(vector, "FAN_IN", 3)
    for name in ("collect", "toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda self, name=name: (_ for _ in ()).throw(AssertionError(name)), raising=False)
    hits = vector.knn(df, asked(df.where("vec_id % 7 = 0")), 6, metric)
    monkeypatch.undo()
    assert lists(hits) == brute(vectors, {i: vectors[i] for i in range(0, 700, 7)}, 6, metric)


def test_knn_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, []), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {q: [i for i, _ in v] for q, v in lists(vector.knn(df, asked(df), 2)).items()} == {1: [1, 2], 2: [1, 2], 3: [3], 6: [6, 1]}
    assert vector.knn(df.where("false"), asked(df), 2).count() == 0 == vector.knn(df, asked(df.where("false")), 2).count()


def _index(centroids):
    rows = sorted(centroids.select("cell", "centroid", "radius").collect())
    return np.array([r["cell"] for r in rows]), np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_stored_index_reads_a_quarter(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([clustered(rng, 2400), clustered(rng, 1, 1) + 0.5 * rng.normal(size=(1600, DIM))])
    df = frame(spark, vectors)
    indexed, centroids = vector.store_ivf(*vector.ivf_build(df, 24, metric=metric), str(tmp_path / "index"))
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) < 1000  # the large cluster was divided
    queries = {i: vectors[i] for i in range(0, 4000, 40)}
    q = asked(df.where("vec_id % 40 = 0"))
    want = brute(vectors, queries, 5, metric)
    near = lists(vector.ivf_search(indexed, centroids, q, 5, 2, metric))
    found = sum(len({i for i, _ in near.get(k, [])} & {i for i, _ in v}) for k, v in want.items())
    assert found >= 0.9 * 5 * len(want)
    # Two cells hold fewer than a quarter of all rows, whichever query probes them, and a stored index reads no other folder.
    assert sum(sorted(sizes.values())[-2:]) < 0.25 * 4000
    probed = vector._routed(vector._source(q, "query_id", "query"), (*_index(centroids),), 2, metric, False).groupBy("id").agg(F.collect_set("cell").alias("cells")).collect()
    assert len(probed) == 100 and np.mean([sum(sizes[c] for c in r["cells"]) for r in probed]) < 0.15 * 4000
    plan = indexed.where(F.col("cell").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert lists(vector.ivf_search(indexed, centroids, q, 5, 1, metric, exact=True)) == want


def test_a_step_depends_on_neither_ties_nor_cells(spark, monkeypatch):
    """Rows that are all at one distance, a block's pairs of which don't fit in one step, and queries that go to every cell."""
    rows, queries = np.zeros((300, DIM)), np.ones((40, DIM))
    largest = []
    real = vector._pairs
    monkeypatch.setattr(vector, "STEP", 800)
    monkeypatch.setattr(vector, "_pairs", lambda metric, a, b: largest.append(a.size) or real(metric, a, b))
    q, i, d = vector._nearest("l2", queries, rows, np.arange(1000, 1300), 5)
    assert max(largest) <= vector.STEP and len(q) == 40 * 300
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == {(a, b) for a in range(40) for b in range(1000, 1300)} and set(d.tolist()) == {float(DIM)}
    routed = []
    index = (np.arange(60), np.arange(60.0)[:, None] * np.ones(DIM), np.full(60, 1.0))
    fake = pa.RecordBatch.from_pylist([{"id": k, "v": [float(k)] * DIM} for k in range(50)])

    class Asked:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            routed.extend(run(iter([fake])))

    vector._routed(Asked(), index, 45, "l2", False)
    assert max(b.num_rows for b in routed) * DIM <= vector.STEP
    found = [(r["id"], r["cell"]) for b in routed for r in b.to_pylist()]
    assert len(found) == len(set(found)) == 50 * 45 and all(abs(c - k) < 45 for k, c in found)
