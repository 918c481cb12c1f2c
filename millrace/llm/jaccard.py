"""Operator 1: near-duplicate classes by an n-gram Jaccard join with several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token in their prefixes under every order
of all tokens, at places that leave room for the overlap they need. The first order puts shingles that repeat in
the corpus last and the others by hash; texts that share a prefix token of it meet in a bucket. Smaller buckets
are compared pair by pair, as many as make a bounded number of pairs for each row. Of what larger buckets leave open,
the second order takes the shingles by how rare they are among the texts still open. The open texts' prefixes
under further, independent orders are written once; a candidate pair goes on only if it shares a prefix token
under each of them. Only then are the two texts fetched and their sets compared.

Equal texts are one node, whatever their ids. A bucket isn't expanded into pairs at once:
each node is first compared with one pivot of the bucket, and what links becomes one component.
Only buckets that still hold several components go on, and in the last step every pair of nodes of different
components is compared, so no link that matters for the components is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.pieces import rows_of
from millrace.llm.shared_files import Scratch, partitions_for, stored
from millrace.llm.shingles import shingle_sets
from millrace.llm.textarrays import U64, mix

#: Shingles whose frequency the first order knows: the most frequent ones, a proven bound of what is broadcast.
FREQUENT = 1 << 20
#: Seeds of the further orders.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Rounds with pivots under the first and the second order, before all remaining pairs.
FIRST_ROUNDS, SECOND_ROUNDS = 1, 3
#: Buckets of the first order with so many rows at most are compared pair by pair, so that only texts of larger ones
#: shuffle all their shingles for the second order; larger ones too, up to FULL rows, as long as all pairs are PAIRS for each
#: row of the buckets at most.
FEW, FULL, PAIRS = 16, 32, 8
#: Shingles that a task counts at a time; bytes of text whose shingles it makes at a time.
CHUNK, SLICE = 1_000_000, 1 << 19
#: Tokens meet by so many bits of their hash; a clash only adds candidates. The mark is above them.
TOKEN_BITS, APART = U64((1 << 48) - 1), U64(1 << 62)
#: In the second order, frequent shingles come after all others.
BEHIND = 1 << 40


def _at_least(n, percent: int):
    """Smallest whole number of at least percent / 100 of n."""
    return -(-n * percent // 100)


def survey(documents: DataFrame, width: int) -> DataFrame:
    """kind 0: (h, n) shingles that occur in n different texts, n >= 2, of one chunk of a partition.
    kind 1: (node h, set size n, id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def repeated() -> pa.RecordBatch:
            nonlocal size
            both = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
            held.clear()
            seen.clear()
            size = 0
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            n = np.diff(np.r_[starts, len(both)])
            keep = n >= 2
            return rows(0, pa.array(both[starts[keep]].view(np.int64)), n[keep], pa.nulls(int(keep.sum()), pa.int64()))

        def rows(kind: int, h: pa.Array, n: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), h, pa.array(n.astype(np.int64)), ids], ["kind", "h", "n", "id"])

        for batch in rows_of(batches, "text", SLICE):
            hashes, offsets = shingle_sets(batch.column("text"), width)
            yield rows(1, batch.column("node"), np.diff(offsets), batch.column("id"))
            for i, node in enumerate(batch.column("node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    held.append(hashes[offsets[i] : offsets[i + 1]])
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield repeated()
        yield repeated()

    return stored(documents.select("id", "node", "text").mapInArrow(run, "kind int, h long, n long, id long"), "shingle-survey")


def frequent(surveyed: DataFrame, scratch: Scratch, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent shingles, ``most`` at most. The counts cover all documents;
    they leave out what a chunk holds once, which no order needs to be exact."""
    counted = scratch.stored(surveyed.where("kind = 0").groupBy("h").agg(F.sum("n").alias("n")), "shingle-counts")
    sizes = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["m"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    top = counted.where(F.col("n") >= least).select("h", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    hashes = top.column("h").to_numpy().view(U64)
    order = np.argsort(hashes)
    return hashes[order], top.column("n").to_numpy()[order]


class _Known:
    """Counts of the frequent shingles, with a sieve of 2**23 places before the search."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray]):
        self.hot, self.counts = known
        self.sieve = np.zeros(1 << 23, bool)
        self.sieve[(self.hot >> U64(41)).astype(np.int64)] = True

    def often(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each shingle; 0 where it isn't frequent."""
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.sieve[(hashes >> U64(41)).astype(np.int64)])
        if len(self.hot) and len(near):
            at = np.minimum(np.searchsorted(self.hot, hashes[near]), len(self.hot) - 1)
            out[near] = np.where(self.hot[at] == hashes[near], self.counts[at], 0)
        return out


def prefixes(documents: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(token, pos, node, n, rare): the prefix tokens of each set under the first order, and their places in it.
    rare: how many of the set's tokens the order takes as rare. shared: broadcast frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        seen: set[int] = set()
        for batch in rows_of(batches, "text", SLICE):
            fresh = []  # copies of a text have its tokens
            for i, node in enumerate(batch.column("node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            hashes, offsets = shingle_sets(batch.column("text"), width)
            n = np.diff(offsets)
            often = known.often(hashes)
            long = np.where(n > 0, n - _at_least(n, percent) + 1, 0)
            common = np.zeros(len(hashes) + 1, np.int64)
            np.cumsum(often > 0, out=common[1:])
            rare = n - (common[offsets[1:]] - common[offsets[:-1]])
            picked = []
            for i in np.flatnonzero(n).tolist():
                a, b, p = int(offsets[i]), int(offsets[i + 1]), int(long[i])
                if common[a + p] > common[a]:
                    picked.append(a + np.argsort(often[a:b], kind="stable")[:p])
                else:
                    picked.append(np.arange(a, a + p))
            rows = np.repeat(np.arange(len(n)), long)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(long) - long, long)
            tokens = hashes[np.concatenate(picked)] & TOKEN_BITS if picked else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(place.astype(np.int32)), batch.column("node").take(pa.array(rows)), pa.array(n[rows].astype(np.int32)), pa.array(rare[rows].astype(np.int32))],
                ["token", "pos", "node", "n", "rare"],
            )

    return documents.select("node", "text").mapInArrow(run, "token long, pos int, node long, n int, rare int")


def _fits(n_a, n_b, pos_a, pos_b, percent: int):
    """Whether the sizes allow the threshold, and the token's places leave room for the overlap that it needs."""
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    room = F.least(n_a - pos_a, n_b - pos_b)
    return (small * 100 >= large * percent) & (room * (100 + percent) >= (n_a + n_b) * percent)


def _pivot_pairs(buckets: DataFrame, order, percent: int, scratch: Scratch) -> DataFrame:
    """Pivots are an aggregation, which combines before the shuffle; written, so that Spark can split a large bucket in the join."""
    pivots = scratch.stored(buckets.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "comp"), order).alias("p")), "pivots")
    fit = (F.col("p.comp") != F.col("comp")) & _fits(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"), percent)
    return buckets.join(pivots, "token").where(fit).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _all_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket whose sizes fit; each row meets only rows of its own and the next size band."""
    columns = ("node", "n", "pos", "comp")
    left = buckets.select("token", F.explode(F.array(_band("n", percent), _band("n", percent) + 1)).alias("band"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = buckets.select("token", _band("n", percent).alias("band"), *(F.col(c).alias(f"{c}_b") for c in columns))
    # Within a band each pair once; a row of the band below meets the band above.
    once = (_band("n_a", percent) < F.col("band")) | (F.col("node_a") < F.col("node_b"))
    fit = once & (F.col("comp_a") != F.col("comp_b")) & _fits(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b"), percent)
    return left.join(right, ["token", "band"]).where(fit).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _band(n: str, percent: int):
    """Sizes that fit each other are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int") if percent < 100 else F.col(n)


def _open_buckets(buckets: DataFrame, percent: int) -> DataFrame:
    """Rows that share their bucket with a row of another component and of a size that may fit."""
    rows = buckets.withColumn("band", _band("n", percent))
    spans = rows.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    around = spans.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    several = around.groupBy("token", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token", "band")
    return rows.join(several, ["token", "band"], "left_semi").drop("band")


def _heads(hashes: np.ndarray, offsets: np.ndarray, percent: int, seed: int) -> pa.Array:
    """The prefix tokens of each set under the order of a seed, by 32 bits of their hash."""
    keys = mix(hashes ^ U64(seed))
    picked, ends = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        p = b - a - _at_least(b - a, percent) + 1 if b > a else 0
        picked.append(np.partition(keys[a:b], p - 1)[:p] if p < b - a else keys[a:b])
        ends.append(ends[-1] + len(picked[-1]))
    tokens = np.concatenate(picked) if picked else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((tokens >> U64(8)).astype(np.uint32).view(np.int32)))


def _open_texts(documents: DataFrame, nodes: DataFrame, width: int, percent: int, parts: int, scratch: Scratch) -> DataFrame:
    """(node, head0, head1, .., text) of the open nodes: a table in buckets by node with the prefixes under the
    further orders, so that later joins on node move only the other side."""
    spark = documents.sparkSession
    name, heads = f"open_texts_{uuid.uuid4().hex}", [f"head{i}" for i in range(len(ORDERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", SLICE):
            hashes, offsets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(_heads(hashes, offsets, percent, seed) for seed in ORDERS), batch.column("text")], ["node", *heads, "text"])

    once = documents.select("node", "text").groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")
    rows = once.select("node", "text").mapInArrow(run, f"node long, {', '.join(f'{h} array<int>' for h in heads)}, text string")
    if parts != int(spark.conf.get("spark.sql.shuffle.partitions")):  # else the rows of a task are in few buckets already
        rows = rows.repartition(parts, "node")
    scratch.tables.append(name)
    rows.write.option("compression", "zstd").bucketBy(parts, "node").sortBy("node").option("path", scratch.new_path("open-texts")).saveAsTable(name)
    return spark.table(name)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under every further order and whose sets reach the threshold."""
    heads = [c for c in texts.columns if c.startswith("head")]
    left = texts.select(F.col("node").alias("a"), *(F.col(h).alias(f"{h}_a") for h in heads))
    right = texts.select(F.col("node").alias("b"), *(F.col(h).alias(f"{h}_b") for h in heads))
    agree = F.lit(True)
    for h in heads:
        agree = agree & F.arrays_overlap(f"{h}_a", f"{h}_b")
    candidates = pairs.join(left, "a").join(right, "b").where(agree).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text_a", SLICE):
            for part in rows_of([batch], "text_b", 2 * SLICE):
                x, x_at = shingle_sets(part.column("text_a"), width)
                y, y_at = shingle_sets(part.column("text_b"), width)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    s, t = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    if len(s) == 0 or len(t) == 0:
                        continue
                    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                    both = int((s[at] == t).sum())
                    keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    text = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    return candidates.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _second_order(open_nodes: DataFrame, texts: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(token, node, n, pos, rare, comp): prefixes of the open texts with the tokens in order of how many open texts hold them;
    frequent shingles come last, by their count in all documents, so that they needn't meet to be counted.
    Tokens of one text come first and can't be shared, so they only take up places. open_nodes: (node, n, comp); what all tokens
    of a text have in common is joined to the few that stay, as every shingle of the open texts is shuffled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in rows_of(batches, "text", SLICE):
            hashes, offsets = shingle_sets(batch.column("text"), width)
            n = np.diff(offsets)
            rows = np.repeat(np.arange(len(n)), n)
            take = pa.array(rows)
            often = known.often(hashes)
            tokens = hashes & TOKEN_BITS
            # A frequent shingle's rows go wherever the text's other hash takes them.
            nodes = batch.column("node").to_numpy().view(U64)[rows]
            meet = np.where(often > 0, (mix(tokens ^ nodes) >> U64(32)) | APART, tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(meet.view(np.int64)), pa.array(np.where(often > 0, tokens, U64(0)).view(np.int64)), batch.column("node").take(take), pa.array(often.astype(np.int32))],
                ["meet", "hot", "node", "often"],
            )

    tokens = texts.join(open_nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "meet long, hot long, node long, often int")
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("meet"))).where("df > 1 or often > 0")
    placed = counted.withColumn("df", F.when(F.col("often") > 0, F.col("often") + F.lit(BEHIND)).otherwise(F.col("df")))
    placed = placed.withColumn("token", F.when(F.col("often") > 0, F.col("hot")).otherwise(F.col("meet"))).select("node", "token", "df").join(open_nodes, "node")
    own = Window.partitionBy("node")
    placed = placed.withColumn("alone", F.col("n") - F.count("*").over(own)).withColumn("pos", F.col("alone") + F.row_number().over(own.orderBy("df", "token")) - 1)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    rows = placed.where(F.col("pos") < prefix)
    return rows.select("token", "node", "n", F.col("pos").cast("int").alias("pos"), F.col("alone").cast("int").alias("rare"), "comp")


def _few(sizes: DataFrame) -> int:
    """Rows of the largest buckets that are compared pair by pair: smaller buckets come first, and the pairs of all of them are in proportion to
    the rows of all buckets, however the buckets' sizes grow with the table. sizes: (token, rows); a row for each power of two comes to the driver."""
    m = F.col("rows")
    steps = sizes.groupBy(F.ceil(F.log2("rows")).alias("step")).agg(F.sum("rows").alias("all"), F.sum(m * (m - 1) / 2).alias("pairs"), F.max("rows").alias("most")).orderBy("step").collect()
    allowed, pairs, few = PAIRS * sum(r["all"] for r in steps), 0, FEW
    for r in steps:
        pairs += r["pairs"]
        if r["most"] > FULL or pairs > allowed:
            break
        few = max(few, r["most"])
    return few


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, class) for every row. class: a number that exactly the rows of one
    component share; component_id: its smallest id; text_hash: xxhash64 of the text.

    Texts that are null, empty or without words have no shingles: their component is their own id, their class null.
    Rows with a null id take part in links; a component that has no id at all has a null component_id.
    Rows that repeat an id get the component of their own text. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    documents = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    surveyed = survey(documents, width)
    sets = surveyed.where("kind = 1").select("id", F.col("h").alias("node"), "n")
    with Scratch(df.sparkSession, "near-duplicates") as scratch:
        classes = _classes(documents, surveyed, sets, width, percent, scratch)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return sets.join(classes, "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("node").alias("text_hash"), "class")


def _classes(documents: DataFrame, surveyed: DataFrame, sets: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, class, component_id) of every text with shingles. sets: (id, node, n) of every document."""
    spark = documents.sparkSession
    # Prefixes are a fifth of the shingles, in rows of about 48 bytes.
    size = surveyed.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = partitions_for(spark, size * 48 * (100 - percent) // 100)
    shared = spark.sparkContext.broadcast(frequent(surveyed, scratch))
    # Most tokens belong to one text; they go before anything is sorted. Both uses read all columns under the same filter, and the
    # join is an inner one (tokens are unique on its right), so that Spark shuffles the rows once.
    rows = prefixes(documents, width, percent, shared).where("token is not null").repartition(parts, "token")
    seen = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.col("pos") + F.col("n") + F.col("rare")).alias("all"))
    met = seen.where("lo <> hi and all > 0").select("token")
    nodes = scratch.stored(rows.join(met.hint("shuffle_hash"), "token").dropDuplicates(["token", "node"]), "shared-tokens")
    buckets = scratch.stored(_open_buckets(nodes.withColumn("comp", F.col("node")), percent), "buckets")
    texts = _open_texts(documents, buckets.select("node").distinct(), width, percent, parts, scratch)
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("comp"))  # rows from Python, if none, would start other workers

    def linked(buckets: DataFrame, pairs: DataFrame) -> DataFrame:
        """Compares the pairs and renames the components that they join, in the labels and in the buckets that stay open."""
        nonlocal labels
        links = scratch.stored(verified(pairs, texts, width, percent), "near-links")
        if _empty(links):
            return buckets
        of = buckets.select("node", "comp").distinct()
        between = links.join(of.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        merged = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).withColumnRenamed("node", "comp")
        if _empty(labels):
            labels = merged.select(F.col("comp").alias("node"), F.col("label").alias("comp"))
        else:
            moved = labels.join(merged, "comp", "left").select("node", F.coalesce("label", "comp").alias("comp"))
            new = merged.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("label").alias("comp"))
            labels = scratch.stored(moved.unionByName(new), "component-labels")
        renamed = buckets.join(merged, "comp", "left").select("token", "node", "n", "pos", "rare", F.coalesce("label", "comp").alias("comp"))
        return scratch.stored(_open_buckets(renamed, percent), "buckets")

    for step in range(FIRST_ROUNDS):
        if _empty(buckets):
            break
        # First the text with the least of its own in the bucket, which most others are near to; then any.
        order = F.struct("rare", "node") if step == 0 else F.struct(F.xxhash64("node", F.lit(step)))
        buckets = linked(buckets, _pivot_pairs(buckets, order, percent, scratch))
    if not _empty(buckets):
        sizes = scratch.stored(buckets.groupBy("token").agg(F.count("*").alias("rows")), "bucket-sizes")
        few = sizes.where(F.col("rows") <= _few(sizes)).select("token")
        buckets = linked(buckets, _all_pairs(buckets.join(few, "token", "left_semi"), percent))
        buckets = scratch.stored(_open_buckets(buckets.join(few, "token", "left_anti"), percent), "large-buckets")
    if not _empty(buckets):
        rarest = scratch.stored(_second_order(scratch.stored(buckets.select("node", "n", "comp").distinct(), "open-nodes"), texts, width, percent, shared), "rarest-tokens")
        buckets = scratch.stored(_open_buckets(rarest, percent), "open-buckets")
    for step in range(SECOND_ROUNDS):
        if _empty(buckets):
            break
        order = F.struct("rare", "node") if step == 0 else F.struct(F.xxhash64("node", F.lit(-step)))
        buckets = linked(buckets, _pivot_pairs(buckets, order, percent, scratch))
    if not _empty(buckets):
        linked(buckets, _all_pairs(buckets, percent))
    # Each side of these joins is a written table, so that Spark can split a class or a text with very many rows.
    least = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    labelled = scratch.stored(least.join(labels, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("class")), "labelled-texts")
    smallest = scratch.stored(labelled.groupBy("class").agg(F.min("least").alias("component_id")), "component-ids")
    shared.unpersist()
    return stored(labelled.join(smallest, "class").select("node", "class", "component_id"), "classes")
