"""Operator 11: hard negatives by cover trees over norm-augmented candidates.

Candidates of one label are dealt by the nearest of a few pivots, the top of the tree, and packed into blocks, each with a cover tree of
its own (cover_tree.py). Anchors are packed into blocks too. A first search, in the trees of an anchor's own label, gives its positives; their
scores make windows, and a second search takes the largest scores of each window in the trees of all other labels. Which blocks
meet is decided by their descriptions alone; vectors are fetched for these pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.cover_tree import CoverTree, build, whole
from millrace.llm.shared_files import Scratch, partitions_for, stored
from millrace.llm.topk import COMPONENT_BYTES, _in_order

#: Candidates and anchors in a block; rows from which pivots are taken, and their number.
TREE_BLOCK, ANCHOR_BLOCK = 4096, 512
SAMPLE, PIVOTS = 2048, 32
LONG = np.iinfo(np.int64).max
#: beyond: the score as text, where a long doesn't hold it.
HIT = "a_block long, at int, p_score long, p_beyond string, id long, score long, beyond string"


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    fit = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(fit & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x"), F.size(x).alias("dim"))


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """A few rows of each dimension, far from each other, from a bounded sample chosen by hash. They shape the blocks, not the result."""
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE).select("dim", "x").toArrow()
    out = {}
    for dim in set(some["dim"].to_pylist()):
        points = np.array([x for d, x in zip(some["dim"].to_pylist(), some["x"].to_pylist(), strict=True) if d == dim], np.float64)
        points = points[np.abs(points).max(1) < 1e100]
        if not len(points):
            continue
        picked = [0]
        gap = ((points - points[0]) ** 2).sum(1)
        while len(picked) < PIVOTS and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[picked[-1]]) ** 2).sum(1))
        out[dim] = points[picked]
    return out


def _dealt(rows: DataFrame, shared) -> DataFrame:
    """Adds pivot, the number of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            column = batch.column("x")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    with np.errstate(all="ignore"):
                        x = values[offsets[at][:, None] + np.arange(dim)]
                        gaps = (pivots[dim] ** 2).sum(1) - 2 * x @ pivots[dim].T
                        near[at] = np.nan_to_num(gaps, nan=0.0).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "pivot"])

    return rows.mapInArrow(run, "vec_id long, label string, x array<double>, dim int, pivot int")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[dict]:
    """Columns of up to size consecutive rows that agree in the keys."""
    held: dict | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is not None and (len(held["vec_id"]) == size or any(held[k][0] != row[k] for k in keys)):
                yield held
                held = None
            held = held or {c: [] for c in row}
            for c, v in row.items():
                held[c].append(v)
    if held is not None:
        yield held


def _trees(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """A cover tree for each block of one label and dimension."""

    schema = pa.schema([("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "matrix", "nodes", "radii"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, g in enumerate(_groups(batches, ["label", "dim"], TREE_BLOCK)):
            ids, x = np.array(g["vec_id"], np.int64), np.array(g["x"], np.float64)
            v = whole(x, scale)
            order, nodes, radii = build(v)
            row = {"block": (g["part"][0] << 24) | made, "label": g["label"][0], "dim": g["dim"][0], "ids": ids[order].tobytes(), "matrix": x[order].tobytes(), "nodes": nodes.tobytes(), "radii": radii.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    order = ["label", "dim", "pivot", "vec_id"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().cast("long").alias("part"), "label", "dim", "vec_id", "x").mapInArrow(run, "block long, label string, dim int, ids binary, matrix binary, nodes binary, radii binary")


def _anchor_blocks(anchors: DataFrame, parts: int) -> DataFrame:
    schema = pa.schema([("a_block", pa.int64()), ("a_dim", pa.int32()), ("a_ids", pa.binary()), ("a_labels", pa.list_(pa.string())), ("a_matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, g in enumerate(_groups(batches, ["dim"], ANCHOR_BLOCK)):
            row = {"a_block": (g["part"][0] << 24) | made, "a_dim": g["dim"][0], "a_ids": np.array(g["vec_id"], np.int64).tobytes(), "a_labels": g["label"], "a_matrix": np.array(g["x"], np.float64).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    order = ["dim", "label", "vec_id"]
    ranged = anchors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().cast("long").alias("part"), "label", "dim", "vec_id", "x").mapInArrow(run, "a_block long, a_dim int, a_ids binary, a_labels array<string>, a_matrix binary")


def exact(score: int, beyond: str | None) -> int:
    """The score that a hit's two columns stand for."""
    if beyond is None:
        return score
    digits = beyond[7:] if beyond[0] == "p" else beyond[7:].translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))
    return int(digits, 16) if beyond[0] == "p" else -int(digits, 16)


def _windows(listed: list | None, n: int, percent: int) -> list[list[tuple]]:
    """(key, lowest, highest) for each of n anchors: of its positives' scores, or one without bounds where none are listed."""
    if listed is None:
        return [[((None, None), None, None)] for _ in range(n)]
    out: list[list[tuple]] = [[] for _ in range(n)]
    for w in listed:
        p = exact(w["score"], w["beyond"])
        lowest = -(-percent * p // 100)
        if lowest <= p:
            out[w["at"]].append(((w["score"], w["beyond"]), lowest, p))
    return out


def _search(pairs: DataFrame, k: int, scale: int, percent: int, same_label: bool) -> DataFrame:
    """Hits of anchors in the tree of each pair: of their own label, or of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tree = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["block"] != block:
                    vectors = whole(np.frombuffer(row["matrix"], np.float64).reshape(-1, row["dim"]), scale)
                    tree = CoverTree(np.frombuffer(row["ids"], np.int64), vectors, np.frombuffer(row["nodes"], np.int64).reshape(-1, 5), np.frombuffer(row["radii"], np.float64))
                    block = row["block"]
                ids = np.frombuffer(row["a_ids"], np.int64).tolist()
                anchors = whole(np.frombuffer(row["a_matrix"], np.float64).reshape(-1, row["dim"]), scale)
                hits = []
                for i, windows in enumerate(_windows(row["windows"], len(ids), percent)):
                    if windows and (row["a_labels"][i] == row["label"]) == same_label:
                        found = tree.search(anchors[i], ids[i], [w[1:] for w in windows], k)
                        hits += [(row["a_block"], i, *key, v, max(-LONG, min(LONG, s)), _in_order(s) if abs(s) >= LONG else None) for (key, _, _), f in zip(windows, found, strict=True) for s, v in f]
                if hits:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], ["a_block", "at", "p_score", "p_beyond", "id", "score", "beyond"])

    return pairs.select("block", "label", "dim", "ids", "matrix", "nodes", "radii", "a_block", "a_ids", "a_labels", "a_matrix", "windows").mapInArrow(run, HIT)


def _ids(asked: DataFrame) -> DataFrame:
    """(a_block, at, anchor_id) of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("a_block").to_pylist(), batch.column("a_ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["a_block", "at", "anchor_id"])

    return asked.select("a_block", "a_ids").mapInArrow(run, "a_block long, at int, anchor_id long")


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a_block", "at", "p_score", "p_beyond").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x); larger ones come first, ties by the smaller id. An anchor's positives are the first rows
    of its label but for those of its own id; a positive's negatives are the first rows of other labels whose score is at most the positive's and at
    least percent of it, so a positive below zero has none. Rows without id, label or vector, with an empty vector or with a null or
    non-finite component take no part; vectors meet those of their own dimension. Rows that repeat an id are candidates each; of equal anchor rows one counts, and
    different ones of one id are anchors each. A score that a long can't hold is compared as it is and shown as the nearest long. An empty table
    gives no rows. Other columns are not read. The result is written to the shared folder.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = _usable(df, id_col, vector_col, label_col)
    anchors = _usable(df.where(is_anchor), id_col, vector_col, label_col).dropDuplicates(["vec_id", "label", "x"])
    shared = None
    try:
        size = rows.agg(F.coalesce(F.sum("dim"), F.lit(0)).alias("n")).first()["n"] * COMPONENT_BYTES
        parts = partitions_for(spark, size)
        shared = spark.sparkContext.broadcast(pivots_of(rows))
        trees = scratch.stored(_trees(_dealt(rows, shared), parts, scale), "trees")
        asked = scratch.stored(_anchor_blocks(anchors, parts), "anchors")
        places = trees.select("block", "label", "dim")
        salt = F.pmod(F.xxhash64("block"), F.lit(parts))

        def met(pairs: DataFrame, with_windows: DataFrame) -> DataFrame:
            return scratch.stored(pairs.select("block", "a_block"), "pairs").join(with_windows, "a_block").join(trees, "block")

        described = asked.select("a_block", "a_dim", F.explode(F.array_distinct("a_labels")).alias("a_label"))
        own = described.join(places, (F.col("a_dim") == F.col("dim")) & (F.col("a_label") == F.col("label")))
        found = _search(met(own, asked.withColumn("windows", F.lit(None).cast("array<struct<at:int,score:bigint,beyond:string>>"))), positives, scale, percent, True)
        best = scratch.stored(_first(found, positives).select("a_block", "at", "id", "score", "beyond"), "positives")
        windows = best.where("score >= 0").groupBy("a_block").agg(F.array_sort(F.collect_set(F.struct("at", "score", "beyond"))).alias("windows"))
        bounded = scratch.stored(asked.join(windows, "a_block"), "bounded-anchors")
        spread = bounded.select("a_block", "a_dim", F.array_distinct("a_labels").alias("labels"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("salt"))
        far = places.select("block", "label", "dim", salt.alias("of"))
        # A block of one label alone has nothing to look for in a tree of that label.
        others = spread.join(far, (F.col("a_dim") == F.col("dim")) & (F.col("salt") == F.col("of"))).where(F.col("labels") != F.array("label"))
        hits = _first(_search(met(others, bounded), negatives, scale, percent, False), negatives)
        named = best.join(_ids(asked), ["a_block", "at"])
        same = (hits["a_block"] == named["a_block"]) & (hits["at"] == named["at"]) & (hits["p_score"] == named["score"]) & hits["p_beyond"].eqNullSafe(named["beyond"])
        out = named.join(hits, same).select("anchor_id", named["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), hits["id"].alias("negative_id"), named["score"].alias("positive_score"), hits["score"].alias("negative_score"))
        return stored(out, "mined")
    finally:
        if shared is not None:
            shared.unpersist()
        scratch.close()
