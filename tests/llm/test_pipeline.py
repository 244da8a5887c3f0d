"""The pipeline's stages on a small corpus, each on what its predecessor kept."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sentences(rng, n):
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "pu", "ro", "sa", "ti"]) for _ in range(rng.randint(1, 4)))
    return "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    passage = sentences(rng, 6).replace("\n", " ")
    rows = [(i, sentences(rng, 6), "en", f"s{i % 3}") for i in range(60)]
    rows += [(60 + i, rows[i][1] + "\nOne more.", "en", "s0") for i in range(5)]
    rows += [(70 + i, sentences(rng, 5) + "\n" + passage + "\n" + sentences(rng, 5), "en", "s1") for i in range(4)]
    rows += [(80 + i, "\n".join(w.upper() + "!! " + w.upper() + "!!" for w in sentences(rng, 1).split()), "en", "s2") for i in range(30)]
    folder = str(tmp_path_factory.mktemp("tables"))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1])) for r in rows], kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 80), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    import tiktoken

    from trackweave.llm.byte_bpe import read_ranks

    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        seen.append(docs.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    ids = [sorted(r.doc_id for r in stage) for stage in seen]
    assert ids[0] == [r[0] for r in rows if r[0] < 80]
    assert ids[1] == [i for i in ids[0] if not 60 <= i < 65]
    assert ids[2] == ids[1]
    cut = {r.doc_id: r for r in seen[2]}
    assert all(cut[i].text == rows[i][1] and cut[i].n_chars == len(rows[i][1]) for i in range(60))
    assert all(len(cut[i].text) < len(dict((r[0], r[1]) for r in rows)[i]) and cut[i].n_chars == len(cut[i].text) for i in range(70, 74))
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in set(ids[3])) <= 2
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.CODE_FILE)), special_tokens={})
    assert ids[4] == ids[3]
    assert all(r.ids == model.encode_ordinary(cut[r.doc_id].text) and r.n_tokens == len(r.ids) for r in seen[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == ids[4]


def test_last_stage_decodes_its_ids(spark):
    import hashlib

    texts = ["a b c", "", None, "naïve 日本語\n\n x"]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.token_ids(spark, docs, "").collect()}
    assert found == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_stages_on_an_empty_table(spark, corpus):
    folder, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_tell_rows_apart_by_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (4, b), (4, a), (4, b), (6, b), (None, a), (None, a), (7, None), (7, None), (8, " "), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], KIND).withColumn("extra", F.lit("mark")).withColumnRenamed("extra", "H")
    found = sorted(((r.doc_id or -1, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert found == sorted([(1, a), (4, b), (-1, a), (-1, a), (7, ""), (8, " "), (9, "")])


def test_stages_take_odd_rows(spark, corpus):
    folder, _ = corpus
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "word " * 30_000, "en", "s", 150_000), (2, "Same text here.", "en", "s", 15), (2, "Same text here.", "en", "s", 15), (3, "a\u00a0b 日本語 " * 50, None, "s", None)]
    docs = spark.createDataFrame(rows, KIND).withColumn("SIZE", F.lit(1)).withColumn("ids", F.lit("x"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() <= 2 * len(rows) and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)


CLASHING = ("score", "predicted", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "_copies", "_copy", "_chosen", "_mark", "_size", "_number", "taken", "size", "target", "h", "a.b", "_kept_0", "Rank")


@pytest.mark.parametrize("k", range(4))
def test_other_columns_keep_their_values(spark, k):
    """A stage gives back every column of documents, whatever its name, with the row's own values; and n_chars may be missing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").drop("n_chars")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHING])
    out = corpus_pipeline.STAGES[k][1](spark, wide, "/root/testdata/sf0.001")
    assert out.columns == wide.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)
