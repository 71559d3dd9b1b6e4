"""A training corpus from raw documents: rules, quality resampling, one of each group of near copies, no benchmark text, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe_transducer, common, decontaminate, jaccard_join, quality_rules, resampling
from trendloom.session import SETTINGS, cut, work_folder


def _prepare(spark: SparkSession) -> None:
    for key, value in (SETTINGS | common.SETTINGS).items():
        spark.conf.set(key, value)


def _carried(docs: DataFrame, *beside: Column) -> DataFrame:
    """The documents, each in one column ``doc``, and the columns that a stage works on: no name of a document can be taken."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *beside)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are.

    Null and empty texts have no words and go, as do texts that any rule rejects; equal rows stay or go together, so there
    are no ties. Texts are taken whole however long. All columns keep their names and values, whatever they are called. An
    empty table gives an empty one.
    """
    _prepare(spark)
    return quality_rules.judged(_carried(docs, F.col("text"))).where("kept").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the share that stays is that of good text among the labelled ones.

    Null and empty texts weigh nothing and are drawn by chance alone; equal rows stay or go together, as do ties at the border.
    Whole texts are weighed. All columns keep their names and values; an empty table gives an empty one.
    """
    _prepare(spark)
    ratios, share = resampling.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = cut(resampling.weighed(_carried(docs, F.col("doc_id"), F.col("text")), ratios).drop("doc_id", "text"))
    return resampling.resampled(scored, share).where("kept").select("doc.*")


def _without(docs: DataFrame, others: DataFrame) -> DataFrame:
    """``docs`` without the rows of the (doc_id, text_key) of ``others``; a null doc_id equals a null one.

    A bitmap of the hashes of ``others`` (16 bits for each, 16 MB at most) goes to all tasks first: rows that it rules out stay
    without a shuffle of their text, and only the few others are joined.
    """
    gone = cut(others.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    size = 1 << min(27, max(15, (16 * gone.count()).bit_length()))

    def slot(doc_id: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id, key), F.lit(size)) + 1

    own = slot(F.col("gone_id"), F.col("gone_key"))
    bitmap = gone.groupBy(F.bitmap_bucket_number(own).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("bits"))
    marked = _carried(docs, F.col("doc_id").alias("id"), common.text_key().alias("key"))
    at = slot(F.col("id"), F.col("key"))
    marked = marked.withColumns({"within": F.bitmap_bucket_number(at), "at": F.bitmap_bit_position(at)})
    marked = marked.join(F.broadcast(bitmap), F.col("within") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("bits IS NOT NULL") & ((F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")) % 2) == 1), F.lit(False))
    marked = marked.select("doc", "id", "key", maybe.alias("maybe"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & F.col("key").eqNullSafe(F.col("gone_key"))
    doubtful = marked.where("maybe").join(gone, same, "left_anti")
    return marked.where("NOT maybe").unionByName(doubtful).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, once.

    Texts without words are near copies of nothing and stay. Of a group without any doc_id one row stays. Where several rows
    of a group bear its smallest doc_id, the one with the smallest digest of its text stays, and of equal rows one. Whole texts
    are compared. All columns keep their names and values; an empty table gives an empty one.
    """
    _prepare(spark)
    classes = cut(jaccard_join.near_duplicates(docs.select("doc_id", "text")).where("n_shingles > 0"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    winners = classes.where(first).groupBy("component", "component_id").agg(F.min("text_key").alias("best_key"), F.count(F.lit(1)).alias("n"))
    named = classes.drop("component_id").join(winners, "component")
    kept = _without(docs, named.where(~first | (F.col("text_key") != F.col("best_key"))))
    repeated = cut(winners.where("n > 1").select(F.col("component_id").alias("twice_id"), F.col("best_key").alias("twice_key")))
    if repeated.isEmpty():
        return kept
    keyed = _carried(kept, F.col("doc_id").alias("id"), common.text_key().alias("key"))
    again = F.col("id").eqNullSafe(F.col("twice_id")) & F.col("key").eqNullSafe(F.col("twice_key"))
    once = keyed.join(repeated, again, "left_semi").dropDuplicates(["id", "key"])
    return keyed.join(repeated, again, "left_anti").unionByName(once).select("doc.*")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item.

    Null and empty texts stay; equal rows stay or go together, so there are no ties. Whole texts are searched. All columns keep
    their names and values; an empty table gives an empty one.
    """
    _prepare(spark)
    found = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document; ids are little-endian 32-bit integers.

    A null text is empty: no ids. The digest of the decoded text equals that of the text, which the round trip shows. Every row
    is coded by itself and whole, so equal rows give equal results and there are no ties. Other columns are left out; an empty
    table gives an empty one.
    """
    _prepare(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_transducer.round_trip(F.col("text"), path, pattern, with_ids=True)
    return docs.select("doc_id", both.alias("both")).select("doc_id", "both.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("token_ids", token_ids),
]

# Fitted ratios, hashed sets and token ids are not expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
