"""Vector search: exact nearest neighbours by blocks, and a partitioned index with an exact way.

Queries and rows are packed into blocks, which meet in shuffles: nothing of the queries passes through the driver. The partitioned index
keeps its centroids, a bounded number, on the driver and in every task.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries of a block; they meet in one matrix product.
BLOCK, QUERY_BLOCK = 2048, 512
#: Bytes of vectors that a task should get.
TASK_BYTES = 64 << 20
#: Distances of a step, and components of the vectors that it compares or hands on, so that a task's memory depends on neither cells nor ties.
STEP = 1 << 18
#: Partial results are merged in groups of so many salts first.
FAN_IN = 64
HITS = "query_id long, id long, distance double"
METRICS = ("l2", "cosine", "dot")


def _tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; then the worker, which may stay idle, gives its memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def _at_a_time(width: int) -> int:
    """How many rows of so many numbers make a step."""
    return max(1, STEP // max(1, width))


def _pairs(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of paired rows: 'l2' (squared), 'cosine' (1 - cosine; 1 for a vector without length) or 'dot' (the negated product: smaller is nearer)."""
    if metric == "l2":
        return ((queries - rows) ** 2).sum(1)
    products = (queries * rows).sum(1)
    if metric == "dot":
        return -products
    lengths = np.sqrt((queries**2).sum(1) * (rows**2).sum(1))
    return 1 - np.where(lengths > 0, products / np.where(lengths > 0, lengths, 1), 0)


def _all(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of all queries and rows by one matrix product, right but for rounding."""
    products = queries @ rows.T
    if metric == "dot":
        return -products
    a, b = (queries**2).sum(1)[:, None], (rows**2).sum(1)[None, :]
    if metric == "l2":
        return a + b - 2 * products
    lengths = np.sqrt(a * b)
    return 1 - np.where(lengths > 0, products / np.where(lengths > 0, lengths, 1), 0)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of so many components, those vectors)."""
    lists = column.cast(pa.large_list(pa.float64()))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    which = np.flatnonzero(np.asarray(lists.is_valid()) & (np.diff(offsets) == dim))
    return which, values[offsets[which][:, None] + np.arange(dim)]


def _nearest(metric: str, queries: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, exact distance) of at least the k nearest rows of each query, in steps."""
    step = _at_a_time(len(rows))
    parts = [_near_some(metric, queries[at : at + step], rows, k) for at in range(0, len(queries), step)]
    q = np.concatenate([p[0] + at * step for at, p in enumerate(parts)])
    return q, row_ids[np.concatenate([p[1] for p in parts])], np.concatenate([p[2] for p in parts])


def _near_some(metric: str, queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, exact distance). Rows at the distance of the k-th may be very many."""
    rough = _all(metric, queries, rows)
    scale = 1e-9 * (1 + np.abs(rough).max(initial=0))
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < rough.shape[1] else np.full((len(queries), 1), np.inf)
    q, r = np.nonzero((rough <= cut + scale) & np.isfinite(rough))
    step = _at_a_time(rows.shape[1])
    exact = [_pairs(metric, queries[q[at : at + step]], rows[r[at : at + step]]) for at in range(0, len(q), step)]
    return q, r, np.concatenate([np.zeros(0), *exact])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _source(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    rows = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more)


def _packed(rows: DataFrame, size: int, cells: bool = False) -> DataFrame:
    """(block, dim, cell, ids, matrix): blocks of at most size vectors of one dimension and, of rows that are sorted by it, one cell."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made, part, cell = 0, 0, None

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = held.pop(dim)
            made += 1
            return pa.RecordBatch.from_pylist([{"block": (part << 32) | made, "dim": dim, "cell": cell, "ids": np.concatenate(ids).tobytes(), "matrix": np.concatenate(vectors).tobytes()}], schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column("part")[0].as_py()
            of = batch.column("cell").to_numpy(zero_copy_only=False) if cells else np.zeros(batch.num_rows, np.int32)
            for a, b in _runs(of):
                if cells and int(of[a]) != cell:
                    yield from [block(d) for d in list(held)]
                    cell = int(of[a])
                some = batch.slice(a, b - a)
                sizes = some.column("v").value_lengths().to_numpy()
                for dim in np.unique(sizes).tolist():
                    which, vectors = _vectors(some.column("v"), dim)
                    ids = some.column("id").to_numpy()[which]
                    at = 0
                    while at < len(ids):
                        mine = held.setdefault(dim, [[], []])
                        to = at + size - sum(map(len, mine[0]))
                        mine[0].append(ids[at:to])
                        mine[1].append(vectors[at:to])
                        if to <= len(ids):
                            yield block(dim)
                        at = to
        yield from [block(d) for d in list(held)]

    chosen = rows.select(F.spark_partition_id().cast("long").alias("part"), "id", "v", *(["cell"] if cells else []))
    return chosen.mapInArrow(_tidy(run), "block long, dim int, cell int, ids binary, matrix binary")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    ends = np.flatnonzero(np.r_[values[1:] != values[:-1], True]) + 1
    return list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))


def _compared(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """Hits of pairs of blocks: k for each query of a run of pairs with the same query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, salt, ids, best = None, 0, None, []

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, i, d = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((i, d, q))
            q, i, d = q[order], i[order], d[order]
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
            return q[place < k], i[place < k], d[place < k]

        def hits() -> pa.RecordBatch:
            q, i, d = kept()
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(d), pa.array(np.full(len(q), salt, np.int32))], ["query_id", "id", "distance", "salt"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["q_block"] != now:
                    if best:
                        yield hits()
                    now, salt, best = row["q_block"], row["salt"], []
                    ids = np.frombuffer(row["q_ids"], np.int64)
                    queries = np.frombuffer(row["q_matrix"], np.float64).reshape(len(ids), -1)
                rows = np.frombuffer(row["matrix"], np.float64).reshape(-1, queries.shape[1])
                best.append(_nearest(metric, queries, rows, np.frombuffer(row["ids"], np.int64), k))
                if sum(len(b[0]) for b in best) > 8 * k * len(ids):
                    best = [kept()]
        if best:
            yield hits()

    return pairs.select("q_block", "q_ids", "q_matrix", "ids", "matrix", "salt").mapInArrow(_tidy(run), "query_id long, id long, distance double, salt int")


def _as_queries(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("cell").alias("q_cell"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))


def _grid(spark: SparkSession, rows: int, queries: int, size: int) -> tuple[int, int]:
    """(salts of the rows, groups of the queries): rows go to each group, queries to each salt, so that both move about as much."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    groups = max(1, min(tasks, round(math.sqrt(tasks * queries / max(1, rows)))))
    return max(1, -(-tasks // groups)), groups


def _merged(hits: DataFrame, k: int, salts: int) -> DataFrame:
    """Partial results are merged in groups of salts before all of a query's meet."""
    if salts > FAN_IN:
        part = Window.partitionBy("query_id", F.floor(F.col("salt") / FAN_IN)).orderBy("distance", "id")
        hits = hits.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return _ranked(hits.select("query_id", "id", "distance"), k)


def knn(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows that pass the filter; ties by id.

    queries: query_id, query, any number. Blocks of queries and of rows meet in a grid of tasks: each pair in one matrix product, and a task keeps k rows for
    each query, whose distances are computed again row by row. Null and empty vectors and null ids take no part; vectors meet those of their own dimension.
    Rows of queries that share an id are one query. An empty table gives no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = df.sparkSession
    source = _source(df if where is None else df.where(where), id_col, vector_col)
    asked = _source(queries, "query_id", "query")
    n, m = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("size")).first() for x in (source, asked))
    salts, groups = _grid(spark, n["n"], m["n"], 8 * n["size"])
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = _packed(source, BLOCK).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("group", every(groups))
    left = _as_queries(_packed(asked, QUERY_BLOCK)).withColumn("q_group", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int")).withColumn("q_salt", every(salts))
    near = (F.col("q_dim") == F.col("dim")) & (F.col("q_salt") == F.col("salt")) & (F.col("q_group") == F.col("group"))
    return _merged(_compared(left.join(right.hint("merge"), near), k, metric), k, salts)


def _unit(vectors: np.ndarray, metric: str) -> np.ndarray:
    """The vectors as the index compares them: of length one for the cosine."""
    if metric != "cosine":
        return vectors
    lengths = np.sqrt((vectors**2).sum(1))[:, None]
    return vectors / np.where(lengths > 0, lengths, 1)


def _centred(points: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """count centres of a bounded sample: far points first, then moved to the means of what is nearest to them."""
    picked = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(picked) < count and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[picked[-1]]) ** 2).sum(1))
    centres = points[picked]
    for _ in range(rounds):
        near = _all("l2", points, centres).argmin(1)
        centres = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _assigned(df: DataFrame, centres: np.ndarray, metric: str, vector_col: str) -> DataFrame:
    """df with cell, the nearest centre, and gap, the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*df.schema, *T.StructType.fromDDL("cell int, gap double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            step = min(BLOCK, _at_a_time(max(centres.shape)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                which, found = _vectors(part.column(vector_col), centres.shape[1])
                if len(which) < part.num_rows:
                    raise ValueError(f"vectors of an index of {centres.shape[1]} components need as many")
                found = _unit(found, metric)
                cell = _all("l2", found, centres).argmin(1)
                gap = np.sqrt(_pairs("l2", found, centres[cell]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], [*part.schema.names, "cell", "gap"])

    return df.mapInArrow(_tidy(run), schema)


def ivf_build(df: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, sample_rows: int = 50_000, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """(rows with their cell and its gap, centroids with the radius of their cell).

    K-means is fitted on at most about sample_rows rows; every row gets a cell. Cells that would hold more than twice the mean are divided by centres of
    their own, taken from a sample of at most sample_rows of their rows. metric 'cosine' compares directions. Rows without id or vector aren't in the index;
    all vectors need one dimension.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    n = rows.count()
    some = (rows if n <= sample_rows else rows.sample(sample_rows / n, seed)).select(F.col(vector_col).cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    features = F.transform("v", lambda x: x / F.when(length > 0, length).otherwise(1.0)) if metric == "cosine" else F.col("v")
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(some.select(array_to_vector(features).alias("features")))
    centres = np.array(model.clusterCenters(), np.float64)
    sizes = {r["cell"]: r["n"] for r in _assigned(rows.select(vector_col), centres, metric, vector_col).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    large = {c: m for c, m in sizes.items() if m > 2 * n / max(1, len(sizes)) and m > BLOCK // 8}
    if large:
        total = sum(large.values())
        inside = _assigned(rows.select(vector_col), centres, metric, vector_col).where(F.col("cell").isin(*large)).select("cell", F.col(vector_col).cast("array<double>").alias("v"))
        found = (inside if total <= sample_rows else inside.sample(sample_rows / total, seed)).toArrow()
        of, vectors = found["cell"].to_numpy(), _unit(_vectors(found["v"].combine_chunks(), centres.shape[1])[1], metric)
        parts = [_centred(vectors[of == c], -(-m * len(sizes) // n)) for c, m in sorted(large.items()) if (of == c).any()]
        centres = np.concatenate([np.delete(centres, sorted(c for c in large if (of == c).any()), axis=0), *parts])
    indexed = _assigned(rows, centres, metric, vector_col)
    centroids = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    radius = indexed.groupBy("cell").agg(F.max("gap").alias("radius"))
    return indexed, centroids.join(radius, "cell")


def store_ivf(indexed: DataFrame, centroids: DataFrame, path: str, rows_per_file: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Writes an index in a folder for each cell, so that a search reads the folders of the cells that it probes, and opens it."""
    # Spark splits a cell with very many rows and puts small ones together.
    indexed.hint("rebalance", "cell").write.option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{path}/rows")
    stored = indexed.sparkSession.read.parquet(f"{path}/rows")
    radius = stored.groupBy("cell").agg(F.max("gap").alias("radius"))
    centroids.select("cell", "centroid").join(radius, "cell").write.parquet(f"{path}/centroids")
    return open_ivf(indexed.sparkSession, path)


def open_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The index that store_ivf wrote."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids")


def _routed(asked: DataFrame, index: tuple, nprobe: int, metric: str, bounds: bool) -> DataFrame:
    """(id, v, cell): each query for each cell that it probes; with bounds, for each other cell that may hold a row within its bound."""
    shared = asked.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres, radius = shared.value
        for batch in batches:
            step = min(256, _at_a_time(len(centres)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                which, found = _vectors(part.column("v"), centres.shape[1])
                if len(which) < part.num_rows:
                    raise ValueError(f"queries of an index of {centres.shape[1]} components need as many")
                gap = _all(metric if metric == "dot" else "l2", _unit(found, metric), centres)
                probed = gap.argsort(1, kind="stable").argsort(1, kind="stable") < nprobe
                if bounds:
                    bound = part.column("bound").to_numpy(zero_copy_only=False)[:, None]
                    probed = ~probed & (np.sqrt(np.maximum(gap, 0)) - radius[None, :] <= bound * (1 + 1e-9) + 1e-9)
                q, c = np.nonzero(probed)
                some = _at_a_time(centres.shape[1])
                for a in range(0, len(q), some):
                    take = pa.array(q[a : a + some])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(cells[c[a : a + some]].astype(np.int32))], ["id", "v", "cell"])

    return asked.select("id", "v", *(["bound"] if bounds else [])).mapInArrow(_tidy(run), "id long, v array<double>, cell int")


def _in_cells(indexed: DataFrame, routed: DataFrame, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    """Hits of routed queries in their cells. The cells that any query probes, a bounded number, are named in the filter, so that a stored index reads their folders alone."""
    wanted = [r["cell"] for r in routed.select("cell").distinct().collect()]
    rows = _source(indexed.where(F.col("cell").isin(wanted)), id_col, vector_col, "cell")
    by_cell = lambda x, size: _packed(x.repartition("cell").sortWithinPartitions("cell"), size, True)
    right = _packed(rows.sortWithinPartitions("cell"), BLOCK, True)
    left = _as_queries(by_cell(routed, QUERY_BLOCK)).withColumn("salt", F.col("q_cell"))
    return _compared(left.join(right.hint("merge"), (F.col("q_cell") == F.col("cell")) & (F.col("q_dim") == F.col("dim"))), k, metric)


def ivf_search(indexed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest within the nprobe cells whose centroids are nearest to the query.

    exact (l2, and cosine on an index of that metric): then also those within all cells that the first result doesn't rule out. No row of a cell is nearer than
    the centroid's distance less the cell's radius, so the result is that of a full scan. The centroids, a row for each cell, come to the driver; queries go
    to their cells by a join.
    """
    if exact and metric == "dot":
        raise ValueError("exact search needs the l2 or the cosine metric")
    small = centroids.select("cell", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius")).orderBy("cell").toArrow()
    index = (small["cell"].to_numpy(), np.array(small["centroid"].to_pylist(), np.float64), small["radius"].to_numpy())
    asked = _source(queries, "query_id", "query")
    hits = _in_cells(indexed, _routed(asked, index, nprobe, metric, False), k, metric, id_col, vector_col).select("query_id", "id", "distance")
    if exact:
        first = _ranked(hits, k).groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n"))
        # A cosine distance d is a distance of sqrt(2 d) between directions.
        reach = F.sqrt(F.greatest(F.col("d"), F.lit(0.0)) * (2 if metric == "cosine" else 1))
        bounded = asked.join(first.select("query_id", F.when(F.col("n") >= k, reach).alias("bound")), asked["id"] == F.col("query_id"), "left")
        bounded = bounded.select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        hits = hits.unionByName(_in_cells(indexed, _routed(bounded, index, nprobe, metric, True), k, metric, id_col, vector_col).select("query_id", "id", "distance"))
    return _ranked(hits, k)
