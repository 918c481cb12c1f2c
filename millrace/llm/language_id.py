"""Operator 4: language identification by bit-sliced Bloom filters over byte n-grams.

Every language has a Bloom filter of its most frequent n-grams. The filters are bit-sliced: one table holds, at each slot,
a bit for every language, so that the AND of an n-gram's slots gives at once all languages that may
contain it. A text's popcount for each language, less the hits that the filter's fill makes expect by
chance, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.pieces import rows_of
from millrace.llm.samples import stratified
from millrace.llm.textarrays import U64, ascii_lower, mix, text_bytes

#: Sizes of n-grams in bytes; slots of the table; slots of an n-gram.
SIZES, SLOTS, PROBES = (3, 5), 1 << 20, 2


def grams(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all n-grams that lie within a text, the text of each). Upper-case ASCII counts as lower case."""
    low = ascii_lower(raw)
    n = len(low) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    codes = np.zeros(n, U64)
    for i in range(size):
        codes |= low[i : i + n].astype(U64) << U64(8 * i)
    codes |= U64(size) << U64(56)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = rows[:n] == rows[size - 1 :]
    return codes[inside], rows[:n][inside]


def slots(codes: np.ndarray) -> list[np.ndarray]:
    mixed = mix(codes)
    width = SLOTS.bit_length() - 1
    return [((mixed >> U64(width * i)) & U64(SLOTS - 1)).astype(np.int32) for i in range(PROBES)]


@dataclass
class LanguageModel:
    languages: list[str]
    #: One table of 8 languages each.
    tables: list[np.ndarray]
    #: Chance that an n-gram which is not in a language's filter seems to be.
    false_rate: np.ndarray

    @staticmethod
    def build(languages: list[str], members: dict[str, np.ndarray]) -> LanguageModel:
        tables = [np.zeros(SLOTS, np.uint8) for _ in range(0, max(1, len(languages)), 8)]
        for i, language in enumerate(languages):
            for at in slots(members[language]):
                tables[i // 8][at] |= np.uint8(1 << (i % 8))
        fill = np.array([np.mean((tables[i // 8] >> (i % 8)) & 1) for i in range(len(languages))])
        return LanguageModel(languages, tables, fill**PROBES)

    def popcounts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(hits of each text in each language, n-grams of each text)."""
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        hits = np.zeros((n, 8 * len(self.tables)))
        total = np.zeros(n)
        bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
        for size in SIZES:
            codes, rows = grams(raw, offsets, size)
            total += np.bincount(rows, minlength=n)
            places = slots(codes)
            for t, table in enumerate(self.tables):
                mask = table[places[0]]
                for at in places[1:]:
                    mask &= table[at]
                found = np.bincount(rows.astype(np.int64) * 256 + mask, minlength=n * 256).reshape(n, 256)
                hits[:, 8 * t : 8 * t + 8] += found @ bits
        return hits[:, : len(self.languages)], total

    def decide(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, its share of the corrected popcounts)."""
        hits, total = self.popcounts(column)
        true = np.maximum(0.0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate))
        # The contrast between languages sharpens with the evidence.
        rate = true / np.maximum(total, 1)[:, None]
        best = rate.argmax(1)
        sums = true.sum(1)
        share = np.where(sums > 0, true[np.arange(len(best)), best] / np.maximum(sums, 1e-12), 1.0 / len(self.languages))
        return best, np.clip(share, 0.0, 1.0)


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 1500, grams_per_language: int = 4000) -> LanguageModel | None:
    """Filters from at most about per_language texts of each language (a documented bound), whole texts.
    None if no row has a language and a text."""
    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 8 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            which, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
            for size in SIZES:
                codes, of = grams(raw, offsets, size)
                for i, name in enumerate(names):
                    found, n = np.unique(codes[which[of] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "size", "gram", "n"])

    sample = stratified(usable, "lang", "id", per_language)
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= grams_per_language).select("lang", "gram").toPandas()
    if top.empty:
        return None
    members = {lang: part["gram"].to_numpy().view(U64) for lang, part in top.groupby("lang")}
    return LanguageModel.build(sorted(members), members)


def predict(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; `und` with score 0 where the text is null or has no letter, or
    where nothing was learned. Repeated rows and rows with a null id give a row each; an empty table gives no rows. One pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return source.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], object)
        for batch in rows_of(batches, "text", 4 << 20):
            best, score = shared.value.decide(batch.column("text"))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            best = np.where(lettered, best, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(np.where(lettered, score, 0.0))], ["id", "lang_pred", "score"])

    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
