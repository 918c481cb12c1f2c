"""Tokenisers against their libraries; classifiers by held-out accuracy."""

import base64
import collections
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, language_id, quality, queries, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = list("abcdeinort  \n\t'sLTé中ñß.,!$#0123 ́　\u0085\x1c😀İΣ")
    out = [None, "", "  ", "a" * 5000, "ab" * 3000, "the " * 3000, "<|endoftext|>", "x<|endoftext|>  <|STARTOFTEXT|><|startoftext|> y", " \n\n  hello   world  ", "I'M it's They'LL"]
    out += ["中文分句。" * 2000, "汉字，汉字。\u3000汉，a。b，é。中", "。。中，，中。", "ݘ。࿿。䷀。"]
    out += ["".join(rng.choice("中文汉字。，、a ！") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("thaeinorsdl") for _ in range(rng.randint(5, 40))) for _ in range(500)]
    return [(i, t) for i, t in enumerate(out)] + [(3, "again"), (None, "no id")]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in texts], "doc_id long, text string, n_tokens int, ids string")


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, texts), path).collect()}
    for i, text in texts:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i, len((text or "").encode())] == (n, n > 1024)


def test_byte_bpe(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs(spark, texts).drop("ids").withColumn("copy", F.col("text")), path, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded.withColumn("kept", F.col("ids")), path, public_tokenizers.PATTERN).collect()
    assert len(back) == len(texts)
    for r in back:
        assert r.kept == enc.encode_ordinary(r.copy or "")
        assert bytes(r.decoded) == (r.copy or "").encode()
    both = byte_bpe.encode(docs(spark, texts).withColumn("decoded", F.lit(1)), path, public_tokenizers.PATTERN, decoded_col="decoded").collect()
    assert collections.Counter((tuple(r.ids), bytes(r.decoded)) for r in both) == collections.Counter((tuple(r.kept), bytes(r.decoded)) for r in back)


def test_token_files(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    unique = [(i, x) for i, x in texts if i is not None and x != "again"]
    got = {r.doc_id: tuple(r)[1:] for r in token_files.token_file_digests(docs(spark, unique), path, 2).collect()}
    start = 0
    for i, text in sorted(unique):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_ids(spark):
    """Null ids come first; rows of one id stand in the order of their text's hash; clashing names aren't read."""
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = [(5, "some words"), (5, "other words here"), (None, "no id"), (None, None), (2, ""), (5, "some words")]
    got = sorted(tuple(r) for r in token_files.token_file_digests(docs(spark, rows), path, 2).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    tie = {r.text: r.h for r in docs(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_file_format(spark, tmp_path):
    """Dictionary pages of ids, delta encoded lengths, row groups within their size, and a page index."""
    out = str(tmp_path / "ids")
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet").coalesce(1), out, public_tokenizers.path("word_bpe_49k.json"), 2, row_group_bytes=256 << 10, page_bytes=16 << 10)
    groups = 0
    for name in (n for n in os.listdir(out) if n.endswith(".parquet")):
        meta = pq.ParquetFile(f"{out}/{name}").metadata
        for g in range(meta.num_row_groups):
            groups += 1
            columns = {c.path_in_schema: c for c in (meta.row_group(g).column(i) for i in range(meta.num_columns))}
            ids = columns["ids.list.element"]
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "local_start"))
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert meta.row_group(g).total_byte_size < 4 << 20
    assert groups > 4


def test_words_that_the_shortcut_gets_wrong(monkeypatch):
    """Where words and their ends don't agree, every piece is encoded on its own."""
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = [b"plain", b" words", b" and", b" more..", b" x1"]
    right = encoder(pieces)
    encoder.ends[encoder.tokenizer.encode("words", add_special_tokens=False).ids[-1]] = False
    wrong = encoder(pieces)
    assert right[0].tolist() == wrong[0].tolist() and right[1].tolist() == wrong[1].tolist()


def test_token_files_read_in_part(spark, tmp_path):
    path, out = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "ids")
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), out, path, 2)
    part = token_files.read_tokens(spark, out, 10, 12)
    assert sorted(r.doc_id for r in part.collect()) == [10, 11, 12]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in part._jdf.queryExecution().toString()
    meta = token_files.read_metadata(spark, out)
    assert meta.agg(F.max("start")).first()[0] < meta.agg(F.sum("n_tokens")).first()[0]
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:80]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    small = "/root/testdata/sf0.001"
    assert rows(queries.QUERIES[name](spark, small).toArrow()) == rows(connect(small).execute(queries.ORACLE_SQL[name]).to_arrow_table())


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op4_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.count() > 200
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_against_plain_python(spark):
    """Popcounts and decision of each text, n-gram by n-gram."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    model = language_id.fit(d, "doc_id", "text", "lang")
    bits = language_id.SLOTS.bit_length() - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * factor) % 2**64
        return x ^ (x >> 33)

    def plain(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        hits, total = [0] * len(model.languages), 0
        for size in language_id.SIZES:
            for i in range(len(raw) - size + 1):
                h = mixed(int.from_bytes(raw[i : i + size], "little") | size << 56)
                total += 1
                for n in range(len(hits)):
                    hits[n] += all(model.tables[n // 8][(h >> (bits * p)) % language_id.SLOTS] >> (n % 8) & 1 for p in range(language_id.PROBES))
        true = [max(0.0, (x - total * f) / (1 - f)) for x, f in zip(hits, model.false_rate, strict=True)]
        best = max(range(len(true)), key=lambda n: (true[n], -n))
        return model.languages[best], true[best] / sum(true)

    few = d.limit(12)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(few, model).collect()}
    for r in few.collect():
        lang, score = plain(r.text)
        assert out[r.doc_id][0] == lang and abs(out[r.doc_id][1] - score) < 1e-9


def test_language_ignores_clashing_names(spark):
    d = spark.createDataFrame([(1, "the cat and the hat", "en", 1.0, "x"), (2, "der Hund und die Katze", "de", 2.0, "y")], "doc_id long, text string, lang string, score double, lang_pred string")
    out = language_id.predict(d, language_id.fit(d, "doc_id", "text", "lang"))
    assert out.columns == ["doc_id", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"en", "de"}


def test_language_cases(spark):
    d = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None), (5, "the", None), (None, "und die", "de")], "doc_id long, text string, lang string")
    out = [tuple(r) for r in language_id.predict(d, language_id.fit(d, "doc_id", "text", "lang")).collect()]
    assert [(i, p) for i, p, _ in out] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "en"), (None, "de")]
    assert all(0 <= s <= 1 for _, _, s in out)
    assert {r.lang_pred for r in language_id.predict(d, language_id.fit(d.where("false"), "doc_id", "text", "lang")).collect()} == {"und"}


def test_nine_languages(spark):
    words = ["alfa", "bravo", "carlo", "delta", "echos", "foxes", "golfs", "hotel", "india"]
    d = spark.createDataFrame([(i, f"{w} " * 20, w) for i, w in enumerate(words)], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred for r in d.join(language_id.predict(d, language_id.fit(d, "doc_id", "text", "lang")), "doc_id").collect())


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels.where(queries.remainder(5) == 0), "doc_id")
    got = {(r.toxic, r.toxic_pred): r.n for r in out.groupBy("toxic", "toxic_pred").agg(F.count("*").alias("n")).collect()}
    assert got.get((0, 1), 0) <= 0.01 * got[0, 0]
    assert got[1, 1] >= 0.85 * (got[1, 1] + got.get((1, 0), 0))
    assert d.count() == queries.op5_toxicity(spark, "/root/testdata/sf0.001").count() * 50


def test_toxicity_beyond_the_sample(spark, monkeypatch):
    """Words that two thirds of the toxic and a tenth of the eight times as many clean texts hold stand for no more than their share."""
    rng = random.Random(6)
    toxic = [rng.random() < 1 / 9 for _ in range(2700)]
    d = spark.createDataFrame([(i, f"common {'grudge' if rng.random() < (0.67 if y else 0.1) else 'plain'}") for i, y in enumerate(toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    whole = toxicity.predict(d, toxicity.fit(d, labels, ("toxic",))).agg(F.avg("p_toxic")).first()[0]
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    sampled = toxicity.predict(d, toxicity.fit(d, labels, ("toxic",))).agg(F.avg("p_toxic")).first()[0]
    assert abs(whole - 1 / 9) < 0.02
    assert abs(sampled - 1 / 9) < 0.04


def test_toxicity_chain_against_plain_python(spark):
    """Probabilities of every text from the chain's weights, computed word by word; odd rows; names that clash with the operator's own."""
    rng = random.Random(7)
    words = ["good", "fine", "nasty", "nastiest", "vile", "sloppy", "prose"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)), "p", 1) for i in range(300)]
    rows += [(300, None, "p", 1), (301, "", "p", 1), (302, " ... ", "p", 1), (303, "Vile " * 3_000, "p", 1), (303, "vile nasty", "p", 1), (None, "vile nastier", "p", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, c0 int")
    labels = spark.createDataFrame([(i, int("sloppy" in t), int("vile" in t)) for i, t, _, _ in rows[:300]], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(d, labels)
    assert chain.categories == ["low_quality", "toxic"] and len(chain.links[1].weights) == len(chain.links[1].places) + 2
    places = {int(h): i for i, h in enumerate(chain.index.hashes)}

    def plain(text):
        counts = collections.Counter()
        for word in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower()):
            hashes, _, _ = toxicity.features(pa.array([word]))
            counts.update(places[int(h)] for h in hashes if int(h) in places)
        p = []
        for link in chain.links:
            x = [math.log1p(counts[i]) for i in link.places] + p + [1.0]
            p.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, link.weights.tolist(), strict=True)))))
        return p if re.search("[a-z0-9]", (text or "").lower()) else [0.0, 0.0]

    out = toxicity.predict(d, chain)
    assert out.columns == ["doc_id", "text", "c0", "p_low_quality", "p_toxic", "toxic_pred"]
    for r in out.collect():
        assert np.allclose([r.p_low_quality, r.p_toxic], plain(r.text), atol=1e-4)
        assert r.toxic_pred == int(r.p_toxic >= 0.5)
    right = out.where("doc_id < 300").join(labels, "doc_id").agg(F.avg((F.col("toxic") == F.col("toxic_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_features_left_out_of_a_fold(spark):
    """A word that only rows of one fold hold is no feature of the model that leaves this fold out."""
    d = spark.createDataFrame([(i, f"{'awful' if i % 2 else 'kind'} word{i % 7}") for i in range(200)], "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    folds = {r.doc_id: r.f for r in d.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    seen = []
    real = toxicity.train
    toxicity.train = lambda categories, index, chosen, *rest: seen.append((index, chosen)) or real(categories, index, chosen, *rest)
    try:
        marked = d.rdd.map(lambda r: (r.doc_id, r.text + (" secret" if folds[r.doc_id] == 1 and r.doc_id % 2 else ""))).toDF("doc_id long, text string")
        toxicity.fit(marked, labels, ("toxic",))
    finally:
        toxicity.train = real
    index, chosen = seen[0]
    secret = int(np.searchsorted(index.hashes, toxicity.features(pa.array(["secret"]))[0][0]))
    assert [secret in chosen[0, away].tolist() for away in (-1, 0, 1, 2)] == [True, True, False, True]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op8_quality(spark, SF).where("held_out").join(labels, "doc_id")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_models_without_labels_or_texts(spark, module):
    d = spark.createDataFrame([(1, None), (2, ""), (2, " "), (None, "text"), (5, "word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, low_quality int")
    assert module.fit(d, none) is None
    assert module.predict(d, None).count() == 5
    both = spark.createDataFrame([(i, "bad ugly words" if i % 2 else "a fine text of prose") for i in range(40)], "doc_id long, text string")
    labels = both.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(None).cast("int").alias("low_quality"))
    out = module.predict(d.unionByName(both), module.fit(both, labels))
    assert out.count() == 45
    assert module.predict(d.where("false"), module.fit(both, labels)).count() == 0


def test_quality_scores_against_plain_python(spark):
    """Pooling and network of each text, word by word; odd rows and clashing names."""
    rows = [(i, "bad ugly words words" if i % 2 else f"A fine text of prose, No {i % 7}", 1.0, "n") for i in range(60)]
    rows += [(100, None, 1.0, "n"), (101, "", 1.0, "n"), (102, "word " * 30_000, 1.0, "n"), (None, "no id", 1.0, "n"), (5, "bad again", 1.0, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = d.where("doc_id < 60 and doc_id is not null").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    model = quality.fit(d, labels)
    v, net = model.vectors, model.network
    place = {int(h): i for i, h in enumerate(v.hashes)}

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        pooled, mean, same, before = np.zeros(v.table.shape[1]), np.zeros(quality.DIM), 0, None
        for word in words:
            own, shape, _, _ = quality.tokens(pa.array([word]))
            for h in (int(own[0]), int(shape[0])):
                if h in place:
                    pooled += v.table[place[h]]
            for at, sign in quality.index_parts(own):
                mean[at[0]] += sign[0]
            same += before == int(own[0])
            before = int(own[0])
        n = max(1, len(words))
        pooled /= n
        extra = [np.linalg.norm(mean) / n / 2, same / n, sum(len(w.encode()) for w in words) / n, math.log1p(len(words)), float(not words), np.linalg.norm(pooled)]
        x = (np.concatenate([pooled, extra]) - net.mean) / net.scale
        w1, b1, w2, b2 = net.layers
        return 1 / (1 + math.exp(-float((np.tanh(x @ w1 + b1) @ w2 + b2)[0]) / net.temperature))

    out = quality.predict(d, model)
    assert out.columns == ["doc_id", "score", "predicted"]
    got = collections.Counter((r.doc_id, round(r.score, 6), r.predicted) for r in out.collect())
    want = collections.Counter((i, round(plain(t), 6), int(plain(t) >= 0.3)) for i, t, _, _ in rows)
    assert got == want


def test_quality_words_of_unlabelled_documents(spark):
    labelled = [(i, "bad ugly words" if i % 2 else "a fine text of prose") for i in range(40)]
    others = [(100 + i, f"green zebra eats {'tall' if i % 2 else 'wet'} grass") for i in range(40)]
    d = spark.createDataFrame(labelled + others, "doc_id long, text string")
    labels = d.where("doc_id < 40").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    vectors = quality.fit(d, labels).vectors
    for word, around in (("zebra", {"green": 40, "eats": 40, "tall": 20, "wet": 20}), ("ugly", {"bad": 20, "words": 20})):
        hashes = quality.tokens(pa.array([" ".join([word, *around])]))[0]
        want = np.zeros(quality.DIM)
        for place, sign in quality.index_parts(hashes[1:]):
            np.add.at(want, place, sign * list(around.values()))
        at = vectors.places(hashes[:1])[0]
        assert at < len(vectors.hashes)
        assert np.allclose(vectors.table[at, : quality.DIM], want / np.linalg.norm(want))


def test_quality_vocabulary_is_bounded(spark, monkeypatch):
    """Two words and two shapes are in all documents; twelve more words are in more than the square root of their number."""
    d = spark.createDataFrame([(i, f"alpha beta x{i % 10} y{i % 7} z{i % 5}") for i in range(60)], "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    whole = quality.fit(d, labels).vectors.hashes
    monkeypatch.setattr(quality, "VOCABULARY", 10)
    few = quality.fit(d, labels).vectors.hashes
    assert len(few) == 4 and len(whole) == 16 and set(few.tolist()) < set(whole.tolist())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("not round_trip").count() == 0
    assert 0 < out.count() < 200
    first = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        again = stage(spark, first, "/root/testdata/sf0.001")
        assert again.columns == first.columns
        assert again.count() <= first.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_odd_rows(spark):
    import corpus_pipeline

    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a clean short text", "en", "s", 18), (3, "a clean short text", "en", "s", 18), (None, "no id here at all", "en", "s", 17)], ODD)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        # Of two equal rows, one stays.
        assert docs.count() == (5 if name == "toxicity" else 4)


def test_pipeline_decides_by_row(spark, tmp_path):
    """Rows that share an id, or have none, stand or fall with their own text."""
    import corpus_pipeline

    rng = random.Random(19)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item, base = prose(14), prose(80)
    dirty = f"{prose(20)} {item} {prose(5)}"
    rows = [(1, dirty), (1, prose(30)), (None, dirty), (None, prose(30)), (2, base), (2, f"{base} more"), (2, prose(40)), (None, base), (None, f"{base} words"), (7, base), (7, base), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ODD)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert texts(clean) == sorted((str(i), t or "") for i, t in rows if t != dirty)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    # dirty: the row with the id. base, with "more" and "words": one of the two rows of the smallest id.
    lone = [(i, t) for i, t in rows if t != dirty and not (t or "").startswith(base)]
    got = texts(single)
    group = [x for x in got if x[1].startswith(base)]
    assert len(group) == 1 and group[0][0] == "2"
    assert sorted(x for x in got if x not in group) == sorted([("1", dirty), *((str(i), t or "") for i, t in lone)])


def test_pipeline_drops_toxic_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)
    words = ["calm", "tree", "river", "stone", "light", "paper", "music"]
    text = lambda bad: " ".join([*(rng.choice(words) for _ in range(15)), *(["vilest", "scoundrel"] if bad else [])])
    rows = [(i, text(i % 4 == 0)) for i in range(240)] + [(None, text(True)), (None, text(False)), (5, text(True)), (4, text(False)), (900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], ODD)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(i), t or "") for i, t in rows if "vilest" not in (t or ""))
