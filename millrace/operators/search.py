"""Full-text search on data frames: postings, BM25, phrases, spelling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Parameters of the ranking function.
K1, B = 1.2, 0.75
#: Documents of a range are 2 to this power; ranges that give the first bound, and ranges that a filter names.
RANGE_BITS, FIRST_RANGES, NAMED_RANGES = 7, 16, 1024
#: Words whose blocks are made at a time, and words of the documents that a task should get: their blocks are sorted in its memory.
WORDS, TASK_WORDS = 1_000_000, 4_000_000
#: Edits that the stored dictionary is made for, and the letters at a word's beginning that it looks at.
EDITS, BEGINNING = 2, 7
#: Word characters of the analyser: letters, numbers and marks.
NOT_WORD = "[^\\p{L}\\p{N}\\p{M}_]+"


def analyse(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


@dataclass
class Index:
    """documents: id and fields. analysed: (id, field, terms), the words of each field in order. postings: (id, field, term, pos).
    lengths: (id, field, length). Where the index is stored, else None: terms (field, term, freq), statistics (field, n, avg_len), blocks
    (field, term, range, n, best, id, tf, length, start, pos, held), a term's postings in n documents of a range with the largest share of a score among
    them (lists by document, where start is the place of its first position in pos; held has the first three together), and deletions
    (field, deleted, term, freq), the dictionary by what is left of its words' beginnings. The stored postings are those of the blocks, one by one."""

    documents: DataFrame
    id: str
    analysed: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame | None = None
    statistics: DataFrame | None = None
    blocks: DataFrame | None = None
    deletions: DataFrame | None = None

    def field(self, name: str) -> DataFrame:
        return self.postings.where(F.col("field") == name)

    def held(self, name: str) -> DataFrame:
        """(term, id) of a field, once for each word of a document."""
        if self.blocks is None:
            return self.field(name).select("term", "id").distinct()
        return self.blocks.where(F.col("field") == name).select("term", F.explode("id").alias("id"))


def build_index(df: DataFrame, id: str, fields: list[str]) -> Index:
    """An index that is evaluated as it is used; store_index writes it."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), analyse(F.col(f)).alias("terms")) for f in fields)))
    analysed = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), each.alias("x")).select("id", "x.field", "x.terms")
    postings = analysed.select("id", "field", F.posexplode("terms").alias("pos", "term"))
    return Index(df, id, analysed, postings, analysed.where(F.size("terms") > 0).select("id", "field", F.size("terms").alias("length")))


def store_index(index: Index, path: str) -> Index:
    """Writes the index and opens it: postings in blocks by term and range of documents, sorted by these in each file, so that a query reads the pages of its own
    words and a frequent word is many tasks'; lengths; the dictionary, by term and by deletions; statistics.

    Documents are dealt by their ids; a range is up to 2 ** RANGE_BITS neighbours. A file is the index of the documents of one task, so their texts are shuffled
    and no words are."""
    spark = index.documents.sparkSession
    write = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    write(index.documents, "documents")
    write(index.lengths, "lengths")
    sums = spark.read.parquet(f"{path}/lengths").groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("avg_len"), F.sum("length").alias("words"))
    stats = sums.collect()  # a row for each field
    write(spark.createDataFrame([(r["field"], r["n"], r["avg_len"]) for r in stats], "field string, n long, avg_len double"), "statistics")
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(r["words"] for r in stats) // TASK_WORDS))
    # From the documents as written; not yet analysed, as Spark reads the rows twice to deal them by ranges.
    fields = sorted(r["field"] for r in stats)
    texts = spark.read.parquet(f"{path}/documents").select(index.id, *(f for f in fields if f != index.id)).where(F.col(index.id).isNotNull())
    dealt = texts.repartitionByRange(parts, index.id).sortWithinPartitions(index.id)
    # The word comes first, as Spark sorts by a prefix of the first column.
    write(_blocks(dealt, index.id, {r["field"]: r["avg_len"] for r in stats}).sortWithinPartitions("term", "field", "range"), "blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("term", "field").agg(F.sum("n").alias("freq"))
    write(terms.sortWithinPartitions("term", "field"), "terms")
    left = spark.read.parquet(f"{path}/terms").select("field", F.explode(deletions("term", EDITS)).alias("deleted"), "term", "freq")
    write(left.repartition("deleted", "field").sortWithinPartitions("deleted", "field", "term"), "deletions")
    return open_index(spark, path, index.id)


def _blocks(documents: DataFrame, id: str, avg_len: dict[str, float]) -> DataFrame:
    """(field, term, range, n, best, id, tf, length, start, pos) of the documents that a task has. avg_len names the fields."""
    kind = documents.schema[id].dataType.simpleString()
    schema = f"field string, term string, range long, n int, best double, id array<{kind}>, tf array<int>, length array<int>, start array<int>, pos array<int>"
    if not avg_len:
        return documents.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for field in batch.column("field").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("field"), field))
                ends = np.cumsum(own.column("terms").value_lengths().to_numpy())
                at = 0
                while at < own.num_rows:
                    # Whole documents, as many as have WORDS words, but one at least.
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                    yield _block_rows(field, own.slice(at, to - at), first, avg_len[field])
                    first += -(-(to - at) // (1 << RANGE_BITS))
                    at = to
        pa.default_memory_pool().release_unused()

    analysed = build_index(documents, id, list(avg_len)).analysed
    return analysed.where(F.size("terms") > 0).select("id", "field", "terms").mapInArrow(run, schema)


def _block_rows(field: str, documents: pa.RecordBatch, first: int, avg_len: float) -> pa.RecordBatch:
    """The blocks of some documents, whose ranges are numbered from first."""
    words = documents.column("terms").flatten().dictionary_encode()
    length = documents.column("terms").value_lengths().to_numpy()
    own = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")  # words of one term stay in order of document and position
    code, own, place = code[order], own[order], place[order]
    at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])])
    tf, code, own = np.diff(np.r_[at, len(code)]), code[at], own[at]
    part = own >> RANGE_BITS
    block = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
    n = np.diff(np.r_[block, len(code)])
    share = tf / (tf + K1 * (1 - B + B * length[own] / avg_len))
    ends = pa.array(np.r_[block, len(code)].astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))
    ids = documents.column("id")
    columns = {
        "field": pa.array([field]).take(pa.array(np.zeros(len(n), np.int32))),
        "term": words.dictionary.take(pa.array(code[block])),
        "range": pa.array(first + part[block].astype(np.int64)),
        "n": pa.array(n.astype(np.int32)),
        "best": pa.array(np.maximum.reduceat(share, block)),
        "id": pa.ListArray.from_arrays(ends, ids.take(pa.array(own))),
        "tf": lists(tf),
        "length": lists(length[own]),
        "start": lists(at - np.repeat(at[block], n)),
        "pos": pa.ListArray.from_arrays(pa.array(np.r_[at[block], len(place)].astype(np.int32)), pa.array(place.astype(np.int32))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def open_index(spark: SparkSession, path: str, id: str) -> Index:
    """An index that store_index wrote."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    blocks = read("blocks")
    each = blocks.select("field", "term", "range", F.explode(F.arrays_zip("id", "length", "tf", "start")).alias("x"), "pos")
    postings = each.select("x.id", "range", "x.length", F.explode(F.slice("pos", F.col("x.start") + 1, F.col("x.tf"))).alias("pos"), "term", "field")
    analysed = postings.groupBy("id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    blocks = blocks.withColumn("held", F.arrays_zip("id", "tf", "length"))
    return Index(read("documents"), id, analysed, postings, read("lengths"), read("terms"), read("statistics"), blocks, read("deletions"))


def _idf(n: float, df: int) -> Column:
    return F.log(1 + (F.lit(float(n)) - F.lit(df) + 0.5) / (F.lit(df) + 0.5))


def deletions(word: str | Column, edits: int) -> Column:
    """What is left of a word's first BEGINNING letters after up to ``edits`` deletions. Two words within so many edits, a swap of neighbours being one, share
    one of these: letters that an edit touches, or that an insertion shifts beyond the beginning, are as many as the edits at most."""
    return _left(F.substring(F.col(word) if isinstance(word, str) else word, 1, BEGINNING), F.lit(edits))


@F.pandas_udf(ArrayType(StringType()))
def _left(start: pd.Series, edits: pd.Series) -> pd.Series:
    def left(text: str, most: int) -> list[str]:
        out = last = {text}
        for _ in range(most):
            last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
            out = out | last
        return list(out)

    return pd.Series([None if t is None else left(t, m) for t, m in zip(start, edits, strict=True)])


def words_of(text: str) -> list[str]:
    """The words of a query, as analyse() has those of a document."""
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}\p{M}_]+", text.lower()) if w]


def term(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose field is exactly the value."""
    return df.where(F.col(field) == value)


def prefix(index: Index, field: str, start: str) -> DataFrame:
    """Documents with a word of the field that starts so."""
    hits = index.held(field).where(F.col("term").startswith(start.lower())).select("id").distinct()
    return index.documents.join(hits.withColumnRenamed("id", index.id), index.id, "left_semi")


def _counted(index: Index, field: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """((id, length, tf of each word), one row of n, avg_len and the df of each word)."""
    names = [f"tf{i}" for i in range(len(wanted))]
    if index.terms is not None:
        held = index.blocks.where((F.col("field") == field) & F.col("term").isin(*wanted)).select("term", F.explode("held").alias("h")).select("term", "h.*")
        rows = held.groupBy("id").agg(F.max("length").alias("length"), *(F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(t) for w, t in zip(wanted, names, strict=True)))
        known = index.terms.where((F.col("field") == field) & F.col("term").isin(*wanted))
        dfs = known.agg(*(F.coalesce(F.sum(F.when(F.col("term") == w, F.col("freq"))), F.lit(0)).alias(f"df{i}") for i, w in enumerate(wanted)))
        return rows, dfs.crossJoin(index.statistics.where(F.col("field") == field).select("n", "avg_len"))
    # The words are counted within each document's list: no explosion and no shuffle.
    texts = index.analysed.where((F.col("field") == field) & (F.size("terms") > 0))
    rows = texts.select("id", F.size("terms").alias("length"), *(_occurrences(w).alias(n) for w, n in zip(wanted, names, strict=True)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg_len"), *(F.count(F.when(F.col(t) > 0, 1)).alias(f"df{i}") for i, t in enumerate(names)))
    return rows.where(F.greatest(*names, F.lit(0)) > 0) if names else rows.where(F.lit(False)), stats


def _occurrences(word: str) -> Column:
    return F.size(F.filter("terms", lambda t: t == F.lit(word)))


def scores(index: Index, field: str, terms: list[str], filtered: DataFrame | None = None) -> DataFrame:
    """(id, score) by BM25 of documents with any of the terms. Statistics are of the whole field; a
    filter narrows the hits alone."""
    wanted = sorted(set(terms))
    rows, stats = _counted(index, field, wanted)
    if filtered is not None:
        rows = rows.join(filtered.select(F.col(index.id).alias("id")), "id", "left_semi")
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_len")))
    # The statistics are one row.
    return rows.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def ranked(hits: DataFrame, size: int | None = 10) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), "id")
    return ordered.limit(size) if size else hits


def match(index: Index, field: str, text: str, size: int | None = 10) -> DataFrame:
    """(id, score) of the best documents with any word of the text."""
    return ranked(scores(index, field, words_of(text)), size)


def _weights(index: Index, field: str, wanted: list[str]) -> tuple[dict[str, tuple[float, int]], float]:
    """({word: (n, df)} of the words that the index has, average length); one row for each word of the query comes to the driver."""
    stats = index.statistics.where(F.col("field") == field).select("n", "avg_len").first()
    found = index.terms.where((F.col("field") == field) & F.col("term").isin(*wanted)).select("term", "freq").collect()
    return {r["term"]: (stats["n"], r["freq"]) for r in found}, stats["avg_len"] if stats else 0.0


def _scored(blocks: DataFrame, weights: dict, avg_len: float) -> DataFrame:
    """(id, score) of the documents in some blocks. Words are added in their order, so that scores are those of scores()."""
    each = blocks.select("term", F.explode("held").alias("h")).select("term", "h.*").withColumn("avg_len", F.lit(avg_len))
    own = each.groupBy("id").agg(*(F.sum(F.when(F.col("term") == w, _idf(*weights[w]) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_len"))))).alias(f"s{i}") for i, w in enumerate(sorted(weights))))
    score = F.lit(0.0)
    for i in range(len(weights)):
        score = score + F.coalesce(f"s{i}", F.lit(0.0))
    return own.select("id", score.alias("score"))


def top_ranges(index: Index, field: str, text: str, size: int) -> tuple[DataFrame, dict, float]:
    """(blocks that may hold one of the ``size`` best documents, weights of the words, average length).

    A range's bound is the sum of the best shares of the words in it. The ranges with the highest bounds are scored first; ranges whose bound is
    below the score of their document number ``size`` hold none of the best.
    """
    weights, avg_len = _weights(index, field, sorted(set(words_of(text))))
    blocks = index.blocks.where((F.col("field") == field) & F.col("term").isin(*weights))
    if not weights:
        return blocks, weights, avg_len
    weight = F.lit(0.0)
    for w, (n, df) in weights.items():
        weight = F.when(F.col("term") == w, _idf(n, df)).otherwise(weight)
    bounds = blocks.select("range", (weight * F.col("best")).alias("most")).groupBy("range").agg(F.sum("most").alias("most"))
    first = [r["range"] for r in bounds.orderBy(F.desc("most"), "range").limit(FIRST_RANGES + size).collect()]
    known = _scored(blocks.where(F.col("range").isin(*first)), weights, avg_len).orderBy(F.desc("score")).limit(size).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
    if known["n"] < size:
        return blocks, weights, avg_len
    open_ranges = bounds.where(F.col("most") * (1 + 1e-12) >= F.lit(known["least"])).select("range")
    named = [r["range"] for r in open_ranges.limit(NAMED_RANGES + 1).collect()]
    if len(named) <= NAMED_RANGES:
        return blocks.where(F.col("range").isin(*named)), weights, avg_len
    return blocks.join(open_ranges, "range", "left_semi"), weights, avg_len


def match_top(index: Index, field: str, text: str, size: int = 10) -> DataFrame:
    """(id, score): match() from a stored index, without the blocks that can't hold one of the best."""
    blocks, weights, avg_len = top_ranges(index, field, text, size)
    if not weights:
        return index.lengths.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    return ranked(_scored(blocks, weights, avg_len), size)


def _shifted(positions: str, place: int) -> Column:
    return F.transform(positions, lambda p: p - place)


def _placed(positions: str, places: list[int], low: Column, slop: int) -> Column:
    """How many places of a word, in order, get a position of their own between low and low + slop from where they stand. The spans have one
    length, so the first free position goes to the first open place."""
    wanted = F.array(*(F.lit(j) for j in places))
    fits = lambda n, p: (n < len(places)) & (p - F.get(wanted, n)).between(low, low + slop)
    return F.aggregate(positions, F.lit(0), lambda n, p: n + F.when(fits(n, p), 1).otherwise(0))


def match_phrase(index: Index, field: str, text: str, slop: int = 0) -> DataFrame:
    """Ids of documents that hold the words within slop moves: the spread of (position - place in the phrase).
    A word that the phrase repeats has to be there as often.

    The positions of a phrase's words in one document are combined there; candidates are documents with all words.
    """
    words = words_of(text)
    if not words:
        return index.postings.select("id").where(F.lit(False))
    places = {w: [i for i, x in enumerate(words) if x == w] for w in dict.fromkeys(words)}
    own = index.field(field).where(F.col("term").isin(*places))
    lists = own.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("term") == w, F.col("pos")))).alias(f"p{i}") for i, w in enumerate(places)))
    some = lists
    for i, at in enumerate(places.values()):
        some = some.where(F.size(f"p{i}") >= len(at))
    # For each shifted position as the lower end: every place needs a position of its own within slop above it.
    ends = F.flatten(F.array(*(_shifted(f"p{i}", j) for i, at in enumerate(places.values()) for j in at)))

    def holds(low: Column) -> Column:
        ok = F.lit(True)
        for i, at in enumerate(places.values()):
            ok = ok & (_placed(f"p{i}", at, low, slop) == len(at))
        return ok

    return some.where(F.exists(ends, holds)).select("id")


def multi_match(index: Index, fields: list[str], text: str, size: int | None = 10) -> DataFrame:
    """(id, score): a document's best field counts."""
    parts = [scores(index, f, words_of(text)) for f in fields]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("id").agg(F.max("score").alias("score")), size)


def search_with_facet(index: Index, fields: list[str], text: str, facet_col: str, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(best hits, facet over all hits)."""
    from millrace.operators.reports import facet

    hits = multi_match(index, fields, text, None)
    rows = index.documents.join(hits.select(F.col("id").alias(index.id)), index.id, "left_semi")
    return ranked(hits, size), facet(rows, facet_col, size)


def bool_query(index: Index, field: str, text: str, where: Column, size: int | None = 10) -> DataFrame:
    """(id, score) of documents that match and pass the filter, which doesn't score."""
    return ranked(scores(index, field, words_of(text), index.documents.where(where)), size)


def get(df: DataFrame, id_col: str, value) -> DataFrame:
    """The document of an id, or nothing."""
    return df.where(F.col(id_col) == value)


def dictionary(index: Index, field: str) -> DataFrame:
    """(term, freq): the number of documents with each word."""
    if index.terms is not None:
        return index.terms.where(F.col("field") == field).select("term", "freq")
    terms = index.analysed.where(F.col("field") == field).select(F.explode(F.array_distinct("terms")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("freq"))


def _near(index: Index, field: str, words: list[tuple[int, str, int]]) -> DataFrame:
    """(clause, word, most, term, freq) of terms that share a deletion with a word within its edits: a superset of those within the edits.
    words: clause, word, edits. A stored index is read at these deletions; else the dictionary's are made. Words of the query are few, and so are their deletions."""
    spark = index.documents.sparkSession
    edits = max((m for _, _, m in words), default=0)
    asked = spark.createDataFrame(words, "clause int, word string, most int")
    each = [asked.where(F.col("most") == m).select("*", F.explode(deletions("word", m)).alias("deleted")) for m in sorted({m for _, _, m in words})]
    left = each[0] if each else asked.withColumn("deleted", F.col("word"))
    for more in each[1:]:
        left = left.unionByName(more)
    if index.deletions is not None and edits <= EDITS:
        held = index.deletions.where(F.col("field") == field)
        held = held.where(F.col("deleted").isin([r["deleted"] for r in left.select("deleted").distinct().collect()]))
    else:
        held = dictionary(index, field).select(F.explode(deletions("term", edits)).alias("deleted"), "term", "freq")
    return held.join(F.broadcast(left), "deleted").select("clause", "word", "most", "term", "freq").distinct()


def suggest(index: Index, field: str, text: str, max_edits: int = 2, size: int = 5, min_length: int = 4) -> DataFrame:
    """(word, suggestion, distance, freq, rank) for words that the dictionary lacks: terms with the same first letter within the edits.
    Terms are found by the deletions that they share with a word; only these are measured."""
    words = [w for w in dict.fromkeys(words_of(text)) if len(w) >= min_length]
    near = _near(index, field, [(i, w, max_edits) for i, w in enumerate(words)])
    # A word that the dictionary has shares itself.
    known = Window.partitionBy("clause")
    unknown = near.withColumn("_has", F.max((F.col("word") == F.col("term")).cast("int")).over(known)).where("_has = 0 and substring(term, 1, 1) = substring(word, 1, 1)")
    scored = unknown.withColumn("distance", F.levenshtein("word", "term", max_edits)).where((F.col("distance") >= 0) & (F.length("term") >= min_length))
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("word", F.col("term").alias("suggestion"), "distance", "freq", "rank")


def allowed_edits(word: str) -> int:
    """0 for up to 2 letters, 1 for up to 5, else 2."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def _edits(word: str, term: str, most: int) -> int:
    """Edits (a swap of neighbours is one), or most + 1 beyond."""
    if abs(len(term) - len(word)) > most:
        return most + 1
    before, last = None, list(range(len(term) + 1))
    for i, a in enumerate(word, 1):
        row = [i]
        for j, b in enumerate(term, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
            if before is not None and j > 1 and a == term[j - 2] and word[i - 2] == b:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return min(last[-1], most + 1)


@F.pandas_udf(IntegerType())
def transposition_distance(word: pd.Series, term: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([_edits(w, t, m) for w, t, m in zip(word, term, most, strict=True)])


def match_bool_prefix(index: Index, field: str, text: str, minimum: int = 2, expansions: int = 50) -> DataFrame:
    """(id, matched): documents that match at least ``minimum`` of the words, all fuzzily but the last, which is a prefix.

    Fuzzy words and the prefix expand to at most ``expansions`` dictionary terms, nearest and most frequent first. Only terms that share a
    deletion with a word are measured; a swap of neighbours is one edit.
    """
    words = words_of(text)
    if not words:
        return index.postings.select("id", F.lit(0).cast("long").alias("matched")).where(F.lit(False))
    near = _near(index, field, [(i, w, allowed_edits(w)) for i, w in enumerate(words[:-1])])
    fuzzy = near.withColumn("d", transposition_distance("word", "term", "most")).where(F.col("d") <= F.col("most")).select("clause", "term", "freq", "d")
    begun = dictionary(index, field).where(F.col("term").startswith(words[-1])).select(F.lit(len(words) - 1).alias("clause"), "term", "freq", F.lit(0).alias("d"))
    measured = fuzzy.unionByName(begun)
    order = Window.partitionBy("clause").orderBy("d", F.desc("freq"), "term")
    expanded = measured.withColumn("r", F.row_number().over(order)).where(F.col("r") <= expansions).select("clause", "term")
    # At most expansions terms for each word of the query.
    hits = index.held(field).join(F.broadcast(expanded), "term")
    counted = hits.groupBy("id").agg(F.count_distinct("clause").alias("matched"))
    return counted.where(F.col("matched") >= min(minimum, len(words)))
