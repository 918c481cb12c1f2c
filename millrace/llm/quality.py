"""Operator 8: text quality from random-indexing word vectors and a small network.

Every word and word shape has a fixed sparse random index vector; the vector of a frequent one is the
sum of the words' index vectors around its occurrences in all documents, labelled or not. Frequent are
words and shapes in at least the square root of the number of documents, and with at least a VOCABULARY-th of all
the (word, document) pairs there are: shares add up to 1, so the vocabulary never has more than VOCABULARY entries. A document is pooled to the mean of
its vectors, with the length of its mean index vector (near 1 where one word is repeated, near 0 in prose)
and a few ratios. A two-layer network scores it; its probabilities are calibrated by one temperature,
which is chosen on rows that the network wasn't trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import rows_of
from millrace.llm.samples import stratified
from millrace.llm.shared_files import Scratch
from millrace.llm.textarrays import BYTE_CODES, U64, ascii_lower, lengths_to_rows, mix, span_hashes, text_bytes, words

#: Rows of each label that the network takes at most; dimensions; non-zeros of an index vector; words on each side.
SAMPLE_ROWS, DIM, NON_ZERO, SIDE = 3000, 48, 4, 2
#: Bound of the vocabulary, by the share of all pairs that its entries have at least.
VOCABULARY = 1 << 17
#: Counts of texts by words that are held at a time.
HISTOGRAM = 1 << 20
HIDDEN, EPOCHS = 32, 400

#: Character classes of word shapes: lower case and other letters, upper case, digits, and every other byte for itself.
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[97:123] = 97
CLASSES[65:91] = 65
CLASSES[48:58] = 48
CLASSES[128:] = 97


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word in lower case, hash of its shape, text of each word, bytes of each word)."""
    raw, offsets = text_bytes(column)
    starts, ends, firsts = words(raw, offsets)
    rows = lengths_to_rows(np.diff(firsts))
    if len(starts) == 0:
        return np.zeros(0, U64), np.zeros(0, U64), rows, np.zeros(0, np.int64)
    plain = span_hashes(BYTE_CODES[ascii_lower(raw)], starts, ends)
    kinds = CLASSES[raw]
    upper = np.zeros(len(raw), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    upper[:-1] |= upper[1:] & (raw[:-1] == 0xC3)
    kinds = np.where(upper, 65, kinds)
    # A shape is the sequence of classes without repeats.
    fresh = np.ones(len(raw), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[starts] = True
    kept = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    shape = span_hashes(BYTE_CODES[kinds[fresh]], kept[starts], kept[ends]) ^ U64(0x5AFE)
    return plain, shape, rows, ends - starts


def index_parts(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of each non-zero of the index vectors."""
    for i in range(NON_ZERO):
        h = mix(hashes + U64(i + 1))
        yield (h % U64(DIM)).astype(np.int64), np.where(h >> U64(63), 1.0, -1.0)


@dataclass
class Vectors:
    """Sorted hashes of the vocabulary, and a vector for each."""

    hashes: np.ndarray
    table: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary; its size where a word isn't in it."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def pooled(self, column) -> np.ndarray:
        plain, shape, rows, sizes = tokens(column)
        n, v = len(column), len(self.hashes) + 1
        count = np.bincount(rows, minlength=n).astype(np.float64)
        out = np.zeros((n, self.table.shape[1] + 6))
        some = np.maximum(count, 1)
        step = int(np.clip(HISTOGRAM // v, 16, 512))
        for at in range(0, n, step):  # a histogram of some texts over the words in them at a time
            m = min(n, at + step) - at
            a, b = np.searchsorted(rows, [at, at + m])
            places = np.concatenate([self.places(plain[a:b]), self.places(shape[a:b])])
            known = places < v - 1
            there = np.zeros(v, bool)
            there[places[known]] = True
            held = np.flatnonzero(there)
            short = np.cumsum(there) - 1
            hist = np.bincount((np.tile(rows[a:b], 2)[known] - at) * len(held) + short[places[known]], minlength=m * len(held))
            out[at : at + m, : self.table.shape[1]] = hist.reshape(m, len(held)) @ self.table[held] / some[at : at + m, None]
        mean = np.zeros(n * DIM)
        for place, sign in index_parts(plain):
            mean += np.bincount(rows * DIM + place, weights=sign, minlength=n * DIM)
        extra = out[:, self.table.shape[1] :]
        extra[:, 0] = np.linalg.norm(mean.reshape(n, DIM), axis=1) / some / np.sqrt(NON_ZERO)
        same = np.zeros(len(plain), bool)
        same[1:] = (plain[1:] == plain[:-1]) & (rows[1:] == rows[:-1])
        extra[:, 1] = np.bincount(rows, weights=same, minlength=n) / some
        extra[:, 2] = np.bincount(rows, weights=sizes, minlength=n) / some
        extra[:, 3] = np.log1p(count)
        extra[:, 4] = count == 0
        extra[:, 5] = np.linalg.norm(out[:, : self.table.shape[1]], axis=1)
        return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
        """Adam on all rows but every fifth; these choose the temperature. weight: of each row, so that the
        probabilities are those of the table that was sampled."""
        rng = np.random.default_rng(8)
        aside = np.arange(len(x)) % 5 == 0
        mean, scale = x.mean(0), x.std(0) + 1e-6
        layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        z, t, g = ((x - mean) / scale)[~aside], y[~aside, None], (weight / weight.mean())[~aside, None]
        first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(z @ layers[0] + layers[1])
            error = g * (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - t) / len(z)
            back = error @ layers[2].T * (1 - hidden**2)
            for i, grad in enumerate((z.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] = layers[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, scale, layers, 1.0)
        if aside.any():
            logit, truth, mass = net.logits(x[aside]), y[aside], weight[aside]

            def loss(temperature: float) -> float:
                p = np.clip(1 / (1 + np.exp(-np.clip(logit / temperature, -40, 40))), 1e-9, 1 - 1e-9)
                return float(-(mass * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).sum())

            net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Vocabulary and word vectors are statistics of all documents. The network is trained on at most about
    2 * SAMPLE_ROWS labelled rows (a documented bound), whole texts. None where no label of either kind has a text. labels: one row for each id that may be learned from."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    share = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        return None
    sample = stratified(marked, "y", "id", SAMPLE_ROWS)
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample's size is bounded, so it may be broadcast. One row for each id bounds what the driver gets.
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with Scratch(documents.sparkSession, "quality") as scratch:
        return _fitted(documents, texts, one, share, scratch)


def _fitted(documents: DataFrame, texts: DataFrame, one: DataFrame, share: dict[int, int], scratch: Scratch) -> Model | None:
    """fit() of (id, text) of all documents and the sampled (id, y, text); share: labelled rows of each label."""
    rows = scratch.stored(one, "quality-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 2 << 20):
            plain, shape, of, _ = tokens(batch.column("text"))
            for hashes in (plain, shape):
                order = np.lexsort((of, hashes))
                h, r = hashes[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                found, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = scratch.stored(texts.select("text").mapInArrow(seen, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    pairs = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.where(F.col("n") >= max(2, math.isqrt(documents.count()), -(-pairs // VOCABULARY))).select("h").toArrow()
    if not top.num_rows:
        return None
    vocabulary = Vectors(np.sort(top["h"].to_numpy().view(U64)), np.zeros((top.num_rows, DIM)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(vocabulary.hashes)
        sums = np.zeros((v + 1) * DIM, np.int64)
        for batch in rows_of(batches, "text", 2 << 20):
            plain, shape, of, _ = tokens(batch.column("text"))
            mine = [vocabulary.places(plain) * DIM, vocabulary.places(shape) * DIM]
            parts = list(index_parts(plain))
            for step in (s for s in range(-SIDE, SIDE + 1) if s):
                here = slice(max(0, -step), len(of) - max(0, step))
                there = slice(max(0, step), len(of) - max(0, -step))
                if len(of) <= abs(step):
                    continue
                together = of[here] == of[there]
                targets = [word[here][together] for word in mine]
                for place, sign in parts:
                    place, sign = place[there][together], sign[there][together]
                    for word in targets:
                        sums += np.bincount(word + place, weights=sign, minlength=(v + 1) * DIM).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "x"])

    cells = texts.select("text").mapInArrow(contexts, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros((len(vocabulary.hashes) + 1) * DIM)
    flat[cells["at"].to_numpy()] = cells["x"].to_numpy()  # Arrow, as rows of Python objects would fill the driver
    context = flat.reshape(-1, DIM)[:-1]
    # A word's own index vector is part of its vector, so that words with like contexts stay apart.
    own = np.zeros((len(vocabulary.hashes), DIM))
    for place, sign in index_parts(vocabulary.hashes):
        own[np.arange(len(own)), place] += sign
    context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    vocabulary.table = np.hstack([context, own / np.sqrt(NON_ZERO)])

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([r.tobytes() for r in vocabulary.pooled(batch.column("text"))], pa.binary())], ["id", "y", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    data = rows.mapInArrow(pooled, f"id {kind}, y int, x binary").orderBy("id", "x").toPandas()
    if data.empty:
        return None
    x = np.stack([np.frombuffer(b) for b in data["x"]])
    y = data["y"].to_numpy(np.float64)
    if y.min() == y.max():
        return None
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, share[1] / taken[1], share[0] / taken[0])
    order = np.random.default_rng(5).permutation(len(x))
    return Model(vocabulary, Network.train(x[order], y[order], weight[order]))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) for every row; a null is an empty text, and empty texts are scored too.
    Without a model every score is 0.5. Repeated rows give a row each. One pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return source.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows_of(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(m.network.score(m.vectors.pooled(batch.column("text"))))], ["id", "score"])

    scored = source.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
