"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import drop_from, gram_hashes, row_numbers, word_hashes, words
from trendloom.session import cut

LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 18
GRAMS_A_BUCKET = 32  # n-grams of the target in a bucket, at most, up to MOST_BUCKETS
SAMPLE = 10_000  # labelled rows, good and bad together, that the target model and the share of good text are fitted on
WEIGHT_GRAMS = 400  # a text weighs as one of at most so many n-grams, else length alone would decide
SEED = 17


def _gram_buckets(texts: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    """For each text the buckets of its words and word pairs."""
    hashes, borders = word_hashes(texts)
    n = np.uint64(buckets)
    one = (gram_hashes(hashes, 1) % n).astype(np.int64)
    two = (gram_hashes(hashes, 2) % n).astype(np.int64)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def labelled_sample(labels: DataFrame, size: int = SAMPLE, label: str = "quality") -> DataFrame:
    """At most ``size`` labelled rows (doc_id, good), the same ones wherever they are stored; a doc_id counts once.

    A doc_id labelled both ways counts as bad.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = rows.groupBy("doc_id").agg(F.min((F.col(label) == 1).cast("int")).alias("good"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(size)


def width(grams: int) -> int:
    """Buckets for a target of so many n-grams: a power of two. The target tells buckets apart only as far as it fills them."""
    return min(max(LEAST_BUCKETS, 1 << (-(-grams // GRAMS_A_BUCKET) - 1).bit_length()), MOST_BUCKETS) if grams else LEAST_BUCKETS


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams in all texts, and in those whose ``good`` is 1. Each task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = drop_from(batch, "good").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for flag, grams in zip(good, _gram_buckets(drop_from(batch, "text"), buckets), strict=True):
                seen = np.bincount(grams, minlength=buckets) if len(grams) > buckets else None
                if seen is not None:
                    raw += seen
                    target += seen * flag
                else:
                    np.add.at(raw, grams, 1)
                    if flag:
                        np.add.at(target, grams, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw[used], "target": target[used]})

    parts = docs.select("text", "good").mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None, size: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(log ratio per bucket, share of good text): the raw model counts all texts, the target model the good ones of the sample.

    There are as many buckets as the measured n-grams of the target call for (``width``), unless a number is given. Only the
    counts of the buckets reach the driver. Without good labelled text all ratios are 0 and the share is 1.
    """
    sample = cut(labelled_sample(labels, size))
    n_words = F.when(F.col("good") == 1, F.size(words(F.col("text")))).otherwise(0).cast("long")
    grams = F.sum(F.greatest(2 * n_words - 1, F.lit(0)))
    good, grams = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").agg(F.avg("good"), F.coalesce(grams, F.lit(0))).first()
    buckets = buckets or width(grams)
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")  # at most ``size`` rows of two numbers
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in bucket_counts(marked, buckets).toLocalIterator():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(buckets), 1.0
    smooth = lambda x: (x + 1.0) / (x.sum() + buckets)
    return np.log(smooth(target)) - np.log(smooth(raw)), float(good)


def log_ratio(text: Column, ratios: np.ndarray, weight_grams: int | None = WEIGHT_GRAMS) -> Column:
    """Mean log ratio of a text's n-grams, times their count up to ``weight_grams``; 0 for a text without words.

    The mean is over all n-grams of the text, however long. With ``weight_grams`` of None it is the plain sum, the log of the
    ratio of the two models.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for grams in _gram_buckets(texts, len(ratios)):
            out.append(float(ratios[grams].mean()) * min(len(grams), weight_grams or len(grams)) if len(grams) else 0.0)
        return pa.array(out, pa.float64())

    return score(text)


def gumbel(*identity: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the identity of a row alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*identity, F.lit(seed)), 11)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, weight_grams: int | None = WEIGHT_GRAMS) -> DataFrame:
    """``docs`` with ``log_ratio`` and ``sample_key`` (log ratio plus noise); columns of those names are replaced."""
    scored = docs.withColumn("log_ratio", log_ratio(F.col("text"), ratios, weight_grams))
    return scored.withColumn("sample_key", F.col("log_ratio") + gumbel(F.col("doc_id"), F.col("text"), seed=seed))


def cut_key(scored: DataFrame, share: float) -> float | None:
    """The k-th largest ``sample_key``, where k is ``share`` of the rows, rounded up; None for an empty table."""
    placed, total = row_numbers(scored.select("sample_key"), -F.col("sample_key"))
    k = int(np.ceil(share * total))
    row = placed.where(F.col("row_number") == max(k, 1) - 1).first()
    return row["sample_key"] if row else None


def resampled(scored: DataFrame, share: float) -> DataFrame:
    """``scored`` with ``kept``: whether the row is among the share of the rows with the largest keys (Gumbel top-k).

    This draws rows without replacement by the ratio of the two models. ``scored`` is read twice, so hand in a written table.
    Null and empty texts have a ratio of 0 and only noise. Equal rows have equal keys and stay or go together, which may keep
    more than the share. An empty table gives an empty one.
    """
    least = cut_key(scored, share)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least if least is not None else 0.0))
