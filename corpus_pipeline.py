"""The corpus pipeline: documents to token ids, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents, with the values they had but for what the stage is to change: other columns, whatever their names, are set aside
under names of their own while a stage works. Empty tables give empty ones. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm import byte_bpe, jaccard_join, line_crf, mixing, suffix_dedup
from trackweave.llm.common import WORD, cut, fresh, small_batches, table
from trackweave.session import ship

CODE_FILE = "byte_bpe_multi_50k.tiktoken"


#: The columns that stages work with.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """The stage with all columns but COLUMNS under other names while it works, so that none clashes with what it adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"_kept_{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[docs[f"`{c}`"].alias(names[c]) for c in docs.columns]), sf_dir)
        return out.select(*[out[names[c]].alias(c) for c in docs.columns])

    return run


@apart
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good. It is fitted on labelled documents of this table.

    Null and empty texts are judged as texts without lines are. Equal texts are judged alike, so repeated rows stay or go together; a score of 0.5 stays. Ids decide nothing but the sample.
    """
    ship(spark)
    small_batches(spark)
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    judged = line_crf.classify(docs, field)
    return judged.where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at 0.8 or more: that of the smallest id.

    Documents without words are in no group and stay, as do those without an id. Rows that repeat an id with another text
    are documents of their own; rows repeated as a whole stay once.
    """
    ship(spark)
    small_batches(spark)
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rest = docs.where(~alone)
    found = jaccard_join.jaccard_rows(rest).where("is_first")
    chosen = found.groupBy("doc_id", "h").agg(F.min("mark").alias("_mark")).select(F.col("doc_id").alias("_chosen"), "_mark")
    first = rest.join(chosen, (F.col("doc_id") == F.col("_chosen")) & (F.xxhash64("text") == F.col("_mark")), "left_semi").dropDuplicates(["doc_id", "text"])
    wordless = docs.where(alone)
    return first.unionByName(wordless.where("doc_id is not null").dropDuplicates(["doc_id", "text"])).unionByName(wordless.where("doc_id is null"))


@apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover; those left without a word go.

    Null and short texts stay as they are. Of rows that repeat a long text all lose it. ``n_chars``, where there is such a column, follows the text.
    """
    ship(spark)
    small_batches(spark)
    done = suffix_dedup.remove_repeats(docs, kept_as="text")
    done = done.withColumn("text", F.col("kept_text")).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


@apart
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole: not at all, once, or twice.

    A null source is a source of its own. Texts without words, null ones too, have nothing to take and go. Rows that repeat an id, a source and a size take the shares of these rows in any order.
    """
    taken = mixing.mix(docs).select("doc_id", "source", "size", "taken")
    size, number = fresh(docs, "_size", "_number")
    keys = ["doc_id", "source", size]
    left = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    left = left.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(size)))
    right = taken.withColumnRenamed("size", size).withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy("taken")))
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in (*keys, number)], "taken")
    same = [left[c].eqNullSafe(right[f"r_{c}"]) for c in (*keys, number)]
    copies = F.when(F.col(size) > 0, F.floor(F.col("taken") / F.col(size) + 0.5)).otherwise(0).cast("int")
    joined = left.join(right, same).withColumn("_copies", copies).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[left[c] for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded_sha256: whole texts as ids of the rank file, and the digest of the bytes that the ids decode to.

    Null and empty texts have no ids. Every row has a row, repeated ones too; other columns are left out.
    """
    ship(spark)
    small_batches(spark)
    path, pattern = public_tokenizers.path(CODE_FILE), public_tokenizers.PATTERN
    coded = byte_bpe.code_documents(docs.select("doc_id", "source", "text"), path, pattern)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: The first stage is fitted, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k + 1}")
    return docs
