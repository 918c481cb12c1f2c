"""Queries on text and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import search, vector
from millrace.plans.registry import ORACLE_SQL, new_folder, query, table


def docs_index(spark, sf_dir) -> search.Index:
    return search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", "lang"), "doc_id", ["text"])


def parts_index(spark, sf_dir) -> search.Index:
    return search.build_index(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"])


def bm25(words: str, tokens: str, n: str = "") -> str:
    """SQL of sc(id, score) for tokens (id, term) of a field; n ends the names of its parts."""
    return f"""tok{n} AS ({tokens}), len{n} AS (SELECT id, count(*) AS l FROM tok{n} GROUP BY id), st{n} AS (SELECT count(*) AS n, avg(l) AS al FROM len{n}),
    tf{n} AS (SELECT id, term, count(*) AS tf FROM tok{n} WHERE term IN ({words}) GROUP BY 1, 2), df{n} AS (SELECT term, count(*) AS df FROM tf{n} GROUP BY 1),
    sc{n} AS (SELECT t.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))) AS score
        FROM tf{n} t JOIN df{n} USING (term) JOIN len{n} x ON x.id = t.id, st{n} GROUP BY t.id)"""


DOC_TOKENS = r"SELECT id, term FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^\pL\pN\pM_]+')) AS term FROM documents) WHERE term <> ''"
NAME_TOKENS = r"SELECT id, term FROM (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[^\pL\pN\pM_]+')) AS term FROM part) WHERE term <> ''"


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def search_term(spark, sf_dir):
    return search.term(table(spark, sf_dir, "documents"), "source", "src3").select("doc_id")


@query(f"SELECT DISTINCT id AS p_partkey FROM ({NAME_TOKENS}) WHERE starts_with(term, 'wid')")
def search_prefix(spark, sf_dir):
    return search.prefix(parts_index(spark, sf_dir), "p_name", "wid").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950 AND 1000")
def search_range(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_retailprice").between(950, 1000)).select("p_partkey")


@query(f"WITH {bm25("'thatea', 'ering', 'with'", DOC_TOKENS)} SELECT id, round(score, 6) AS score FROM sc")
def search_match(spark, sf_dir):
    return rounded(search.match(docs_index(spark, sf_dir), "text", "Thatea ering with", None))


@query(f"WITH {bm25("'red', 'widget'", NAME_TOKENS)} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 10")
def search_match_top(spark, sf_dir):
    return rounded(search.match(parts_index(spark, sf_dir), "p_name", "red widget", 10))


@query(r"""WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\pL\pN\pM_]+') IF x <> ''] AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM t)
    SELECT DISTINCT a.doc_id AS id FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'the' AND abs((b.pos - 1) - a.pos) <= 2""")
def search_phrase_slop(spark, sf_dir):
    return search.match_phrase(docs_index(spark, sf_dir), "text", "of the", 2)


@query(f"""WITH {bm25("'red', 'economy'", NAME_TOKENS)}, {bm25("'red', 'economy'", "SELECT p_partkey AS id, lower(p_type) AS term FROM part", "2")}
    SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM sc2) GROUP BY id""")
def multi_match(spark, sf_dir):
    return rounded(search.multi_match(parts_index(spark, sf_dir), ["p_name", "p_type"], "red economy", None))


@query(f"WITH h AS (SELECT DISTINCT id FROM ({NAME_TOKENS}) WHERE term IN ('red', 'bolt')) SELECT p_brand, count(*) AS count FROM part JOIN h ON p_partkey = id GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 10")
def search_facet(spark, sf_dir):
    return search.search_with_facet(parts_index(spark, sf_dir), ["p_name"], "red bolt", "p_brand")[1]


@query(f"WITH {bm25("'red', 'bolt'", NAME_TOKENS)} SELECT id, round(score, 6) AS score FROM sc JOIN part ON p_partkey = id WHERE p_retailprice BETWEEN 900 AND 1000")
def bool_query(spark, sf_dir):
    return rounded(search.bool_query(parts_index(spark, sf_dir), "p_name", "red bolt", F.col("p_retailprice").between(900, 1000), None))


@query(f"""WITH d AS (SELECT term, count(DISTINCT id) AS freq FROM ({NAME_TOKENS}) GROUP BY 1), w AS (SELECT unnest(['widgit', 'gizno', 'small']) AS word),
    c AS (SELECT word, term AS suggestion, levenshtein(word, term) AS distance, freq FROM w, d WHERE word NOT IN (SELECT term FROM d) AND word[1] = term[1] AND len(term) >= 4 AND levenshtein(word, term) <= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, suggestion) AS rank FROM c)
    SELECT word, suggestion, CAST(distance AS INTEGER) AS distance, freq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def suggest(spark, sf_dir):
    return search.suggest(parts_index(spark, sf_dir), "p_name", "widgit gizno small")


@query(f"""WITH t AS (SELECT DISTINCT id, term FROM ({NAME_TOKENS})) SELECT id, count(DISTINCT clause) AS matched FROM (
    SELECT id, 0 AS clause FROM t WHERE damerau_levenshtein(term, 'smlal') <= 1 UNION ALL SELECT id, 1 FROM t WHERE starts_with(term, 'wid')) GROUP BY id HAVING count(DISTINCT clause) >= 2""")
def bool_prefix_fuzzy(spark, sf_dir):
    return search.match_bool_prefix(parts_index(spark, sf_dir), "p_name", "smlal wid", 2)


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def get_document(spark, sf_dir):
    return search.get(table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "text")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents) SELECT doc_id, round(CAST('0x' || s[1:2] AS INTEGER) / 127.5 - 1, 4) AS v0, round(CAST('0x' || s[63:64] AS INTEGER) / 127.5 - 1, 4) AS v31,
    round(CAST('0x' || s[7:8] AS INTEGER) / 127.5 - 1, 4) AS v99, 128 AS dim FROM h""")
def hash_vector(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", scalars.hash_vector("text").alias("v"))
    at = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 4)
    return v.select("doc_id", at(0).alias("v0"), at(31).alias("v31"), at(99).alias("v99"), F.size("v").alias("dim"))


def queries_of(spark, sf_dir) -> DataFrame:
    """Every row whose id is divisible by 20, against all rows."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def knn_sql(distance: str, where: str = "true") -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {distance} AS d FROM e q, e c WHERE q.vec_id % 20 = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p) SELECT query_id, id, round(d, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def nearest(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


@query(knn_sql("list_distance(q.v, c.v) * list_distance(q.v, c.v)"))
def knn_l2(spark, sf_dir):
    return nearest(vector.knn(table(spark, sf_dir, "embeddings"), queries_of(spark, sf_dir), 10))


@query(knn_sql("list_distance(q.v, c.v) * list_distance(q.v, c.v)", "c.label = 3"))
def knn_filtered(spark, sf_dir):
    return nearest(vector.knn(table(spark, sf_dir, "embeddings"), queries_of(spark, sf_dir), 10, where="label = 3"))


@query(knn_sql("1 - list_cosine_similarity(q.v, c.v)"))
def knn_cosine(spark, sf_dir):
    return nearest(vector.knn(table(spark, sf_dir, "embeddings"), queries_of(spark, sf_dir), 10, "cosine"))


@query(knn_sql("-list_dot_product(q.v, c.v)"))
def knn_dot(spark, sf_dir):
    return nearest(vector.knn(table(spark, sf_dir, "embeddings"), queries_of(spark, sf_dir), 10, "dot"))


def cells_of(n: int) -> tuple[int, int]:
    """(cells, probes) of an index of n rows: cells grow with the root of the rows. Three quarters are probed: these vectors hardly form clusters."""
    cells = max(4, round(n**0.5 / 2))
    return cells, -(-cells * 3 // 4)


@query(knn_sql("list_distance(q.v, c.v) * list_distance(q.v, c.v)"))
def ivf_search(spark, sf_dir):
    """The index, with the cells that the first probes don't rule out: the result of a full scan."""
    e = table(spark, sf_dir, "embeddings")
    cells, probes = cells_of(e.count())
    return nearest(vector.ivf_search(*vector.ivf_build(e, cells), queries_of(spark, sf_dir), 10, probes, exact=True))


@query(f"""WITH ex AS ({knn_sql("list_distance(q.v, c.v) * list_distance(q.v, c.v)")}) SELECT count(*) AS wanted, true AS enough FROM ex""")
def ivf_recall(spark, sf_dir):
    """Of the exact neighbours, nine tenths at least are in the probed cells alone."""
    e, q = table(spark, sf_dir, "embeddings"), queries_of(spark, sf_dir)
    cells, probes = cells_of(e.count())
    near = vector.ivf_search(*vector.ivf_build(e, cells), q, 10, probes).select("query_id", "id", F.lit(1).alias("found"))
    both = vector.knn(e, q, 10).join(near, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@query(knn_sql("1 - list_cosine_similarity(q.v, c.v)"))
def ivf_stored(spark, sf_dir):
    """The same by the cosine from an index that was written, with a folder for each cell."""
    e = table(spark, sf_dir, "embeddings")
    cells, probes = cells_of(e.count())
    stored = vector.store_ivf(*vector.ivf_build(e, cells, metric="cosine"), new_folder(spark, "vectors"))
    return nearest(vector.ivf_search(*stored, queries_of(spark, sf_dir), 10, probes, "cosine", exact=True))


@query(f"WITH {bm25("'thatea', 'ering', 'with'", DOC_TOKENS)} SELECT id, round(score, 6) AS score FROM sc")
def search_stored(spark, sf_dir):
    """The same words as search_match, from an index that was written."""
    path = new_folder(spark, "text-index")
    search.store_index(docs_index(spark, sf_dir), path)
    return rounded(search.match(search.open_index(spark, path, "doc_id"), "text", "Thatea ering with", None))


@query(f"WITH {bm25("'thatea', 'ering', 'with'", DOC_TOKENS)} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 10")
def search_top_stored(spark, sf_dir):
    """The ten best by blocks: those whose bound is below the tenth score aren't read."""
    index = search.store_index(docs_index(spark, sf_dir), new_folder(spark, "text-index"))
    return rounded(search.match_top(index, "text", "Thatea ering with", 10))


@query(ORACLE_SQL["suggest"])
def suggest_stored(spark, sf_dir):
    """From a stored dictionary, read at the deletions of the words."""
    return search.suggest(search.store_index(parts_index(spark, sf_dir), new_folder(spark, "parts-index")), "p_name", "widgit gizno small")


@query(ORACLE_SQL["bool_prefix_fuzzy"])
def bool_prefix_stored(spark, sf_dir):
    return search.match_bool_prefix(search.store_index(parts_index(spark, sf_dir), new_folder(spark, "parts-index")), "p_name", "smlal wid", 2)


@query("SELECT doc_id, text, true AS hidden FROM documents")
def aes_roundtrip(spark, sf_dir):
    key = b"0123456789abcdef"
    sealed = table(spark, sf_dir, "documents").select("doc_id", "text", scalars.aes_encrypt_col("text", key).alias("sealed"))
    return sealed.select("doc_id", scalars.aes_decrypt_col("sealed", key).alias("text"), (F.col("sealed") != F.col("text")).alias("hidden"))
