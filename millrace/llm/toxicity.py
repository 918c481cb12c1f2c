"""Operator 5: toxicity categories by a classifier chain.

The categories of a label table are predicted one after another by linear models. A later model gets the earlier
categories' probabilities beside the text's features; in training these probabilities come from models that didn't see
the row (out of fold), so a later model learns how far the earlier ones can be trusted.
Features are counts of indicative words and word beginnings. Each model chooses its own by their log-odds in
the rows it is trained on, so that an out-of-fold model knows nothing of the rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.pieces import rows_of
from millrace.llm.samples import stratified
from millrace.llm.shared_files import Scratch
from millrace.llm.textarrays import U64, ascii_lower, lengths_to_rows, runs, span_hashes, text_bytes, BYTE_CODES

#: Word beginnings of so many bytes are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Rows of each value of the last category that the fit takes at most, features of a model, and folds.
SAMPLE_ROWS, FEATURES, FOLDS = 3000, 256, 3
#: Rows of a category that must hold a feature.
LEAST = 3

IS_WORD = np.zeros(256, bool)
IS_WORD[97:123] = IS_WORD[128:] = IS_WORD[48:58] = True


def features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, text) of each word and word beginning of the texts; number of texts. Kinds don't share hashes:
    the length is part of a hash, and a beginning is only taken from a longer word."""
    raw, offsets = text_bytes(column)
    low = ascii_lower(raw)
    starts, ends, firsts = runs(IS_WORD[low], offsets)
    rows = lengths_to_rows(np.diff(firsts))
    codes = BYTE_CODES[low]
    hashes, of = [span_hashes(codes, starts, ends)], [rows]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        hashes.append(span_hashes(codes, starts[long], starts[long] + n) ^ U64(0xA5A5 + n))
        of.append(rows[long])
    return np.concatenate(hashes), np.concatenate(of), len(offsets) - 1


@dataclass
class FeatureIndex:
    """Sorted hashes, with a 2**16-bit sieve before the search."""

    hashes: np.ndarray

    def __post_init__(self):
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes >> U64(48)).astype(np.int64)] = True

    def cells(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, place in the index, count) of the features that are there, and the number of texts."""
        found, rows, n = features(column)
        near = np.flatnonzero(self.sieve[(found >> U64(48)).astype(np.int64)])
        found, rows = found[near], rows[near]
        at = np.minimum(np.searchsorted(self.hashes, found), max(0, len(self.hashes) - 1))
        hit = self.hashes[at] == found if len(self.hashes) else np.zeros(0, bool)
        cell, count = np.unique(rows[hit] * max(1, len(self.hashes)) + at[hit], return_counts=True)
        return cell // max(1, len(self.hashes)), cell % max(1, len(self.hashes)), count, n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def linear_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, steps: int = 200) -> np.ndarray:
    """Logistic regression with an intercept (last weight), accelerated full-batch gradient steps. weight: of each row."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    y = y.astype(np.float32)
    weight = (weight / max(weight.mean(), 1e-12)).astype(np.float32) if len(x) else np.zeros(0, np.float32)
    w, ahead, v = (np.full(x.shape[1], start, np.float32) for start in (0, 0, 1))
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    rate = np.float32(1 / (0.25 * np.linalg.norm(np.sqrt(weight) * (x @ v)) ** 2 / max(1, len(x)) + penalty))
    for i in range(steps):
        g = x.T @ (weight * (sigmoid(x @ ahead) - y)) / np.float32(max(1, len(x))) + np.float32(penalty) * ahead
        new = ahead - rate * g
        ahead = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Link:
    """A category's model: places of its features in the index, and weights of these, the earlier probabilities and the intercept."""

    places: np.ndarray
    weights: np.ndarray


@dataclass
class Chain:
    categories: list[str]
    index: FeatureIndex
    links: list[Link]

    def probabilities(self, column) -> np.ndarray:
        """A column for each category. Texts without words have probability 0."""
        rows, places, counts, n = self.index.cells(column)
        x = np.zeros((n, len(self.index.hashes)), np.float32)
        x[rows, places] = np.log1p(counts)
        earlier = np.zeros((n, 0))
        for link in self.links:
            earlier = np.column_stack([earlier, linear(np.column_stack([x[:, link.places], earlier]), link.weights)])
        raw, offsets = text_bytes(column)
        words = np.concatenate([[0], np.cumsum(IS_WORD[ascii_lower(raw)])])
        return np.where((words[offsets[1:]] > words[offsets[:-1]])[:, None], earlier, 0.0)


def train(categories: list[str], index: FeatureIndex, chosen: dict[tuple[int, int], np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Chain:
    """chosen: places of the features of (category, fold left out, or -1). y: a column for each category, nan where a row isn't
    labelled. weight: of each row, so that the probabilities are those of the table that was sampled."""
    links, earlier = [], np.zeros((len(x), 0))
    for c in range(len(categories)):
        known = ~np.isnan(y[:, c])

        def link(rows: np.ndarray, places: np.ndarray, c: int = c) -> Link:
            return Link(places, linear_fit(np.column_stack([x[rows][:, places], earlier[rows]]), y[rows, c], weight[rows]))

        outside = np.zeros(len(x))
        for f in range(FOLDS):
            model, away = link(known & (fold != f), chosen[c, f]), fold == f
            outside[away] = linear(np.column_stack([x[away][:, model.places], earlier[away]]), model.weights)
        links.append(link(known, chosen[c, -1]))
        earlier = np.column_stack([earlier, outside])
    return Chain(categories, index, links)


def fit(documents: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """Trains on at most about 2 * SAMPLE_ROWS labelled documents (a documented bound), whole texts.

    categories: 0 / 1 columns of labels, in the order of the chain; the last one decides, and rows of which it is null aren't taken.
    An id with several label rows has a category if one of them says so; of an id with several texts, one is taken.
    None where either value of the last category has no text.
    """
    scratch = Scratch(documents.sparkSession, "toxicity")
    last, marks = categories[-1], [f"y{c}" for c in range(len(categories))]
    marked = labels.where(F.col(last).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(c).cast("int").alias(y) for c, y in zip(categories, marks, strict=True)))
    share = {r[0]: r["n"] for r in marked.groupBy(marks[-1]).agg(F.count("*").alias("n")).collect()}
    sample = stratified(marked, marks[-1], "id", SAMPLE_ROWS)
    # The sample's size is bounded, so it may be broadcast. One row for each id bounds what the driver gets.
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(sample), "id").groupBy("id", *marks).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = scratch.stored(one.withColumn("fold", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(29)), F.lit(FOLDS)).cast("int")), "toxicity-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 4 << 20):
            found, of, n = features(batch.column("text"))
            cell = np.unique(np.rec.fromarrays([found, batch.column("fold").to_numpy()[of], of], names="h,f,r"))
            new = np.ones(len(cell), bool)
            new[1:] = (cell["h"][1:] != cell["h"][:-1]) | (cell["f"][1:] != cell["f"][:-1])
            group, size = np.cumsum(new) - 1, int(new.sum())
            columns = [pa.array(cell["h"][new].view(np.int64)), pa.array(cell["f"][new].astype(np.int32))]
            for y in marks:
                value = batch.column(y).to_numpy(zero_copy_only=False).astype(np.float64)[cell["r"]]
                columns += [pa.array(np.bincount(group, weights=value == k, minlength=size).astype(np.int64)) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "fold", *names])

    names = [f"{side}{c}" for c in range(len(categories)) for side in ("pos", "neg")]
    sizes = {(r["fold"], c, k): r[f"n{c}{k}"] for r in rows.groupBy("fold").agg(*(F.count(F.when(F.col(y) == k, 1)).alias(f"n{c}{k}") for c, y in enumerate(marks) for k in (0, 1))).collect() for c in range(len(marks)) for k in (0, 1)}
    total = lambda c, k, away: sum(n for (f, d, v), n in sizes.items() if (d, v) == (c, k) and f != away)
    if not total(len(marks) - 1, 0, -1) or not total(len(marks) - 1, 1, -1):
        scratch.close()
        return None
    inside = lambda name, away: F.sum(F.when(F.col("fold") != away, F.col(name)).otherwise(0))
    models = [(c, away) for c in range(len(categories)) for away in range(-1, FOLDS)]
    held = rows.mapInArrow(present, "h long, fold int, " + ", ".join(f"{n} long" for n in names)).groupBy("h")
    table = scratch.stored(held.agg(*(inside(f"{side}{c}", away).alias(f"{side}{c}_{away + 1}") for c, away in models for side in ("pos", "neg"))), "toxicity-features")
    best = None
    for c, away in models:
        pos, neg = F.col(f"pos{c}_{away + 1}"), F.col(f"neg{c}_{away + 1}")
        odds = F.log((pos + 0.5) / (total(c, 1, away) + 1)) - F.log((neg + 0.5) / (total(c, 0, away) + 1))
        top = table.where(pos >= LEAST).select(F.lit(c).alias("c"), F.lit(away).alias("away"), "h", (odds * F.sqrt(pos)).alias("weight")).orderBy(F.desc("weight"), "h").limit(FEATURES)
        best = top if best is None else best.unionByName(top)
    found = best.toArrow()
    hashes = found["h"].to_numpy().view(U64)
    index = FeatureIndex(np.unique(hashes))
    chosen = {(c, away): np.sort(np.searchsorted(index.hashes, hashes[(found["c"].to_numpy() == c) & (found["away"].to_numpy() == away)])) for c, away in models}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 4 << 20):
            of, places, counts, n = index.cells(batch.column("text"))
            ends = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "fold", *marks)), *lists], ["id", "fold", *marks, "places", "counts"])

    kind = rows.schema["id"].dataType.simpleString()
    data = rows.mapInArrow(vectors, f"id {kind}, fold int, {', '.join(f'{y} int' for y in marks)}, places array<int>, counts array<int>").orderBy("id").toArrow()
    scratch.close()
    x = np.zeros((data.num_rows, len(index.hashes)), np.float32)
    for i, (places, counts) in enumerate(zip(data["places"].to_pylist(), data["counts"].to_pylist(), strict=True)):
        x[i, places] = np.log1p(counts)
    y = np.column_stack([data[m].to_numpy().astype(np.float64) for m in marks])
    # A value is sampled with probability SAMPLE_ROWS / share, or always.
    weight = np.where(y[:, -1] == 1, max(1.0, share[1] / SAMPLE_ROWS), max(1.0, share[0] / SAMPLE_ROWS))
    return train(list(categories), index, chosen, x, y, weight, data["fold"].to_numpy())


def predict(df: DataFrame, chain: Chain | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of df, with p_<category> for each category and <last category>_pred, for every row. They replace columns of the same name.

    Null and empty texts, and texts without words, have probability 0 and are never toxic; without a chain (nothing was
    learned) the result is toxic_pred 0 alone. Repeated rows give a row each. One pass, no shuffle.
    """
    if chain is None:
        return df.withColumn("toxic_pred", F.lit(0))
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names, verdict = [f"p_{c}" for c in chain.categories], f"{chain.categories[-1]}_pred"
    # Inside, columns are numbered, so that no name can clash.
    text, inner = f"c{df.columns.index(text_col)}", [f"c{i}" for i in range(len(df.columns))]
    numbered = df.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text, 2 << 20):
            p = shared.value.probabilities(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(len(names)))], [*inner, *names])

    schema = StructType([*numbered.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    scored = numbered.mapInArrow(run, schema)
    kept = [F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True) if c not in (*names, verdict)]
    return scored.select(*kept, *names, (F.col(names[-1]) >= threshold).cast("int").alias(verdict))
