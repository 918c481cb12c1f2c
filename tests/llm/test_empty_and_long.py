"""Empty tables, and texts beyond the slices in which they are handled."""

import random

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, language_id, token_counts, token_files

JSON, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_empty_tables(spark, nothing):
    assert token_counts.token_counts(nothing, JSON, limit=10).count() == 0
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode_decode_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_files.token_file_digests(nothing, WORDS, end_id=2).count() == 0
    learned = spark.createDataFrame([(i, "the and of with " * 5 if i % 2 else "der und die mit " * 5, "en" if i % 2 else "de") for i in range(60)], nothing.schema)
    model = language_id.fit(learned, "doc_id", "text", "lang")
    assert language_id.predict(nothing, model).count() == 0
    assert language_id.predict(learned.withColumn("doc_id", F.lit(None).cast("long")), model).where("doc_id is null").count() == 60


def test_a_text_of_several_slices(spark):
    """Beyond 16 MB of one document between short ones: counted, encoded and decoded whole."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(3_200_000))
    assert len(long.encode()) > 16 << 20
    df = spark.createDataFrame([(1, "short one"), (2, long), (3, None), (4, "last")], "doc_id long, text string").repartition(2)
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, JSON, limit=1024).collect()}
    library = tokenizers.Tokenizer.from_file(JSON)
    cuts = [long[i : i + 2_000_000] for i in range(0, len(long), 2_000_000)]
    assert counts[2][0] == len(long.encode()) and counts[3] == (0, 0)
    # Cut by hand before a space, each part is encoded alike; the others say by how much the total can differ at most.
    total = sum(len(library.encode(c, add_special_tokens=False).ids) for c in cuts)
    assert abs(counts[2][1] - total) <= 4 * len(cuts)
    coded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded_col="decoded")
    out = {r["doc_id"]: r for r in coded.select("doc_id", F.size("ids").alias("n"), F.sha2("decoded", 256).alias("sha")).collect()}
    want = {r["doc_id"]: r["sha"] for r in df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).collect()}
    assert {i: r["sha"] for i, r in out.items()} == want and out[2]["n"] == counts[2][1]
