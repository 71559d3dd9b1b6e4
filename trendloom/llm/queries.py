"""Registered queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe_transducer, collocations, common, decontaminate, jaccard_join, language, periodic_runs, quality_rules, resampling, sharding, token_files, toxicity, warc, wrapper
from trendloom.session import SETTINGS, cut, work_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    for key, value in (SETTINGS | common.SETTINGS).items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_texts(_table(spark, folder, "pages"))


def op2_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return warc.archived(pages, work_folder(spark))


def op4_subword_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("text_key")


def op5_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    """40 shards by the law of equal row counts."""
    found = sharding.sharded(_table(spark, folder, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = work_folder(spark)
    manifest = token_files.write_sequences(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), files)
    return token_files.read_documents(manifest, files)


def op7_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = bpe_transducer.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, folder, "documents")).drop("text_key", "component")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents")).select(*quality_rules.RESULT)


def op10_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, log_ratio, kept) of every document."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ratios, share = resampling.fit(docs, _table(spark, folder, "labels"))
    scored = cut(resampling.weighed(docs, ratios).drop("text"))
    return resampling.resampled(scored, share).select("doc_id", "log_ratio", "kept")


def op11_hat_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.top_phrases(_table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, folder, "documents"))


def op13_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_wrapper_induction, op2_warc_transactions, op3_winnowing, op4_subword_toxicity, op5_feistel_shards, op6_token_files, op7_bpe_transducer, op8_jaccard_join, op9_quality_rules, op10_resampling, op11_hat_collocations, op12_periodic_runs, op13_language_spans)
}

ORACLES = {
    "op2_warc_transactions": warc.ORACLE,
    "op3_winnowing": decontaminate.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_quality_rules": quality_rules.oracle(),
    "op11_hat_collocations": collocations.ORACLE,
}
