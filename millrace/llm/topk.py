"""Operator 2: exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length into buckets, longest first, and packed into blocks; a block
never spans more than its share of rows, so one common length can't fill a task. Queries are packed
into blocks too and meet each vector block once. A first pass over the bucket of the longest vectors
gives every query a lower bound of its k-th score. In each block that bound becomes a local cosine
threshold, bound / (query length * longest vector of the block). A threshold over 1 skips the block; one
near 1 prunes by coordinates (a vector that close to the query has each large coordinate within a known
interval); a low one prunes by length alone. What is left is verified with exact integer products.
Pairs of blocks in which no query can reach a vector are dropped before the blocks themselves are sent.

Vectors so long that a product might not fit 64 bits (WIDE) take a way of their own, with Python's integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared_files import Scratch, partitions_for, stored

#: Vectors and queries in a block.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
#: Coordinates that are compared, and the local threshold from which comparing them pays.
FOCUS, COORDINATE_FROM = 3, 0.7
BLOCK_SCHEMA = "block long, ids binary, matrix binary, dim int, longest double"
#: beyond: order of scores that 64 bits don't hold.
HIT_SCHEMA = "query_id long, vec_id long, score long, beyond string"
#: Squared length from which products of two vectors may leave 64 bits.
WIDE = float(1 << 61)
#: Bytes of a component in a block.
COMPONENT_BYTES = 8


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x, v array<long>, norm2 double): components x as double and v = floor(scale * x), which is right where norm2 is below WIDE.
    Vectors that are null, empty, or hold null or non-finite components take no part; so do null ids."""
    x = F.col(vector_col).cast("array<double>")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def pack(rows: DataFrame, size: int, components: str = "v") -> DataFrame:
    """Blocks of at most size vectors of one dimension, in the order of the rows of each partition. components: v as integers, or x as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = held.pop(dim)
            made += 1
            part = np.frombuffer(np.concatenate(ids).tobytes(), np.int64)
            number = (partition << 24) | made
            matrix = np.concatenate(vectors)
            longest = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(1).max()))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.tobytes()]), pa.array([matrix.tobytes()]), pa.array([dim], pa.int32()), pa.array([longest])], ["block", "ids", "matrix", "dim", "longest"])

        partition = 0
        for batch in batches:
            partition = batch.column("part")[0].as_py() if batch.num_rows else partition
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column(components)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                rows_of_dim = np.flatnonzero(dims == dim)
                matrix = values[(offsets[rows_of_dim][:, None] + np.arange(dim)[None, :])]
                for at in range(0, len(rows_of_dim), size):
                    mine = held.setdefault(int(dim), ([], []))
                    mine[0].append(ids[rows_of_dim[at : at + size]])
                    mine[1].append(matrix[at : at + size])
                    if sum(map(len, mine[0])) >= size:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return rows.select(F.spark_partition_id().alias("part"), "vec_id", components).mapInArrow(run, BLOCK_SCHEMA)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vector_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[list, list, list]:
    """Hits of a query block in a vector block whose score reaches the query's bound, k at most for each."""
    out_q, out_v, out_s = [], [], []
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    query_lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    vectors, vector_ids, lengths = vectors[order], vector_ids[order], lengths[order]
    # Products are exact in float64 below 2**53; beyond that integers are multiplied.
    exact_float = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1]) < 2.0**53
    left = vectors.astype(np.float64) if exact_float else vectors
    right = queries.astype(np.float64) if exact_float else queries
    unit = vectors / np.maximum(lengths, 1e-300)[:, None]
    longest = lengths[0] if len(lengths) else 0.0
    slack = 1e-9
    for i in range(len(queries)):
        need, size = float(bound[i]), query_lengths[i]
        local = need / (size * longest) if need > 0 and size * longest > 0 else -1.0
        if need > 0 and (size == 0 or longest == 0 or local > 1 + slack):
            continue
        if need > 0:
            # Length pruning: |v| >= need / |q|; the block is sorted by length.
            upto = int(np.searchsorted(-lengths, -(need / size) * (1 - slack), side="right"))
        else:
            upto = len(lengths)
        rows = slice(0, upto)
        if local >= COORDINATE_FROM and upto:
            q = right[i] / size
            keep = np.ones(upto, bool)
            t = min(1.0, local)
            for c in np.argsort(-np.abs(q))[:FOCUS]:
                spread = np.sqrt(max(0.0, (1 - q[c] ** 2) * (1 - t * t)))
                if q[c] >= -t:
                    keep &= unit[:upto, c] >= q[c] * t - spread - 1e-7
                if q[c] <= t:
                    keep &= unit[:upto, c] <= q[c] * t + spread + 1e-7
            rows = np.flatnonzero(keep)
        scores = left[rows] @ right[i]
        scores = np.rint(scores).astype(np.int64) if exact_float else scores.astype(np.int64)
        ids = vector_ids[rows]
        fit = (scores >= bound[i]) & (ids != query_ids[i])
        scores, ids = scores[fit], ids[fit]
        if len(scores) > k:
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        out_q.append(np.full(len(ids), query_ids[i]))
        out_v.append(ids)
        out_s.append(scores)
    return out_q, out_v, out_s


def _search(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_matrix"], np.int64).reshape(-1, dim)
                bound = np.frombuffer(row["bounds"], np.int64) if row["bounds"] is not None else np.full(len(query_ids), np.iinfo(np.int64).min)
                q, v, s = best(queries, query_ids, np.frombuffer(row["matrix"], np.int64).reshape(-1, dim), np.frombuffer(row["ids"], np.int64), bound, k)
                if q:
                    found = [pa.array(np.concatenate(x).astype(np.int64)) for x in (q, v, s)]
                    yield pa.RecordBatch.from_arrays([*found, pa.nulls(len(found[0]), pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return pairs.select("ids", "matrix", "dim", "q_ids", "q_matrix", "bounds").mapInArrow(run, HIT_SCHEMA)


def _in_order(score: int) -> str:
    """Text that sorts as the whole numbers do."""
    digits = f"{abs(score):x}"
    text = f"{len(digits):06x}{digits}"
    return f"p{text}" if score >= 0 else "n" + text.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


def _search_exactly(pairs: DataFrame, k: int, scale: int) -> DataFrame:
    """Hits of blocks of doubles, by Python's integers. Scores that a long can't hold come as the nearest long, with their order in ``beyond``."""
    most = np.iinfo(np.int64).max

    def whole(data: bytes, dim: int) -> np.ndarray:
        return np.array([math.floor(Fraction(x) * scale) for x in np.frombuffer(data, np.float64).tolist()], object).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64).tolist()
                scores = whole(row["q_matrix"], row["dim"]) @ whole(row["matrix"], row["dim"]).T
                hits = []
                for query, line in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), scores.tolist(), strict=True):
                    top = heapq.nsmallest(k, ((-s, i) for s, i in zip(line, ids, strict=True) if i != query))
                    hits += [(query, i, max(-most, min(most, -s)), _in_order(-s) if abs(s) >= most else None) for s, i in top]
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score", "beyond"), h, strict=True)) for h in hits], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())]))

    return pairs.select("ids", "matrix", "dim", "q_ids", "q_matrix").mapInArrow(run, HIT_SCHEMA)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _as_queries(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dim").alias("q_dim"))


def _meetings(queries: DataFrame, vectors: DataFrame, parts: int, extra: list[str], scratch: Scratch) -> DataFrame:
    """One copy of each query block for each vector block of its dimension that it may reach. Which blocks meet is decided by their numbers, dimensions and
    lengths alone and written; then the blocks are fetched for these pairs, so that no copy of a matrix is made, or sent to all tasks, before."""
    places = vectors.select("dim", "block", "longest", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("salt"))
    known = [c for c in ("q_block", "q_dim", "least") if c in queries.columns]
    spread = queries.select(*known, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("salt"))
    near = (F.col("q_dim") == F.col("dim")) & (spread["salt"] == places["salt"])
    if "least" in known:
        near = near & (F.col("least") <= F.col("longest") * (1 + 1e-9))
    pairs = scratch.stored(spread.join(places, near).select("q_block", "block"), "pairs")
    return pairs.join(queries.select("q_block", "q_ids", "q_matrix", *extra), "q_block").join(vectors, "block")


def topk(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each row of is_query with all other rows.

    Ties go to the smaller vec_id; fewer candidates give fewer rows; vectors meet only vectors of their
    own dimension; rows that repeat an id are candidates each, but never of a query of that id, and a
    query id that repeats gets the best of its rows. Any finite component counts; a score that a long can't hold is ranked
    as it is and shown as the nearest long. An empty table gives no rows. Each query block
    meets each vector block once, so the work is (queries / block) * (vectors / block) products.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    try:
        both = quantised(df, id_col, vector_col, scale)
        flags = quantised(df.where(is_query), id_col, vector_col, scale).dropDuplicates(["vec_id", "x"])
        sizes = both.agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).alias("n"), F.coalesce(F.max((F.col("norm2") >= WIDE).cast("int")), F.lit(0)).alias("wide")).first()
        parts = partitions_for(spark, sizes["n"] * COMPONENT_BYTES)
        base, asked = both.where(F.col("norm2") < WIDE), flags.where(F.col("norm2") < WIDE)
        vectors = scratch.stored(pack(base.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"), VECTOR_BLOCK), "vectors")
        queries = scratch.stored(_as_queries(pack(asked, QUERY_BLOCK)), "queries")
        # The block of the longest vectors of each dimension gives the first bounds.
        first = vectors.groupBy("dim").agg(F.min("block").alias("block"))
        head = vectors.join(first, ["dim", "block"])
        near = queries.join(head, F.col("q_dim") == F.col("dim"))
        bounds = _top(_search(near.withColumn("bounds", F.lit(None).cast("binary")), k), k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
        bounds = bounds.where(F.col("n") >= k).select("query_id", "bound")
        bounded = scratch.stored(_with_bounds(queries, bounds), "bounded-queries")
        hits = _search(_meetings(bounded, vectors, parts, ["bounds"], scratch), k)
        if sizes["wide"]:
            far, near = both.where(F.col("norm2") >= WIDE), flags.where(F.col("norm2") >= WIDE)
            packed = lambda rows, size, name: scratch.stored(pack(rows, size, "x"), name)
            wide = _meetings(_as_queries(packed(near, QUERY_BLOCK, "wide-queries")), packed(both, QUERY_BLOCK, "all-vectors"), parts, [], scratch)
            narrow = _meetings(_as_queries(packed(asked, QUERY_BLOCK, "narrow-queries")), packed(far, QUERY_BLOCK, "wide-vectors"), parts, [], scratch)
            hits = hits.unionByName(_search_exactly(wide.unionByName(narrow), k, scale))
        return stored(_top(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
    finally:
        scratch.close()


def _with_bounds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds to each query block the bounds of its queries, in their order, and the least length that a vector needs for any of them."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["q_ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["q_block"])), pa.array(np.arange(len(ids), dtype=np.int64)), pa.array(ids)], ["q_block", "at", "query_id"])

    lowest = np.iinfo(np.int64).min
    members = queries.select("q_block", "q_ids").mapInArrow(ids_of, "q_block long, at long, query_id long")
    listed = members.join(bounds, "query_id", "left").groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(int(lowest))).alias("bound")))), lambda x: x["bound"]).alias("bound_list"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, least = [], []
            for bound, matrix, dim in zip(*(batch.column(c).to_pylist() for c in ("bound_list", "q_matrix", "q_dim")), strict=True):
                need = np.asarray(bound, np.int64)
                lists.append(need.tobytes())
                length = np.sqrt((np.frombuffer(matrix, np.int64).reshape(-1, dim).astype(np.float64) ** 2).sum(1))
                ratio = np.where(need > 0, need / np.maximum(length, 1e-300), -1.0)
                least.append(float(ratio.min(initial=np.inf)))
            keep = [n for n in batch.schema.names if n != "bound_list"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in keep), pa.array(lists, pa.binary()), pa.array(least)], [*keep, "bounds", "least"])

    joined = queries.join(listed, "q_block").select("q_block", "q_ids", "q_matrix", "q_dim", "bound_list")
    return joined.mapInArrow(packed, "q_block long, q_ids binary, q_matrix binary, q_dim int, bounds binary, least double")
