"""Counts, ranges, timelines and cluster recomputation.

Every aggregate here has a map-side partial form, so that a key with a third of all rows reaches its
reducer as one partial row per input task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.schema import ERROR_RATE, ERROR_RATE_AFTER

SKETCH_BITS = 12


def count_by(df: DataFrame, *keys: str, name: str = "num_items") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def day_counts(items: DataFrame, *keys: str, col: str = "content_published_date") -> DataFrame:
    """Items per published day; items without a date form their own group."""
    return count_by(items.withColumn("day", F.date_trunc("day", col).cast("timestamp_ntz")), *keys, "day")


def day_sketches(items: DataFrame, *keys: str, value: str = "content_item_id", col: str = "content_published_date", bits: int = SKETCH_BITS) -> DataFrame:
    """(keys, day, num_items, sketch): per day a mergeable sketch of the distinct values, some 4 KB each at 12 bits.

    A sketch with ``bits`` has a standard error of about 0.83 / sqrt(2^bits), 1.3 % at 12 bits. Items without a date are left out.
    """
    days = items.where(F.col(col).isNotNull()).withColumn("day", F.date_trunc("day", col).cast("timestamp_ntz"))
    return days.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("num_items"), F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def distinct_between(sketches: DataFrame, *keys: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(keys, num_items, num_distinct) over a range of days, both included, from ``day_sketches`` alone: no item is read again.

    ``num_distinct`` is an estimate; ``count_distinct`` over the items is exact.
    """
    picked = sketches
    for bound, test in ((start, F.col("day").__ge__), (end, F.col("day").__le__)):
        picked = picked if bound is None else picked.where(test(bound))
    merged = picked.groupBy(*keys).agg(F.sum("num_items").alias("num_items"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "num_items", F.hll_sketch_estimate("sketch").alias("num_distinct"))


def timeline(df: DataFrame, *keys: str, unit: str = "day", col: str = "content_published_date") -> DataFrame:
    """Rows per (time bin, key) as observed; null times and null keys are left out."""
    seen = df.where(F.col(col).isNotNull())
    for key in keys:
        seen = seen.where(F.col(key).isNotNull())
    return count_by(seen.withColumn(unit, F.date_trunc(unit, col).cast("timestamp_ntz")), *keys, unit)


def filled_histogram(df: DataFrame, *keys: str, unit: str = "hour", col: str = "content_published_date") -> DataFrame:
    """Rows per time bin with empty bins as 0 between the first and last bin of each key.

    The bins are built from the counted rows, one per observed bin, not from the input.
    """
    counted = timeline(df, *keys, unit=unit, col=col)
    bounds = counted.groupBy(*keys).agg(F.min(unit).alias("first_bin"), F.max(unit).alias("last_bin"))
    bins = bounds.select(
        *keys, F.explode(F.sequence("first_bin", "last_bin", F.expr(f"INTERVAL 1 {unit}"))).alias(unit)
    )
    return bins.join(counted, [*keys, unit], "left").fillna(0, ["num_items"])


def value_range(df: DataFrame, col: str, *keys: str, default: Column | None = None, prefix: str = "") -> DataFrame:
    """Smallest and largest value; ``default`` stands in when there is none."""
    low, high = F.min(col), F.max(col)
    if default is not None:
        low, high = F.coalesce(low, default), F.coalesce(high, default)
    out = [low.alias(f"min_{prefix or col}"), high.alias(f"max_{prefix or col}")]
    return df.groupBy(*keys).agg(*out)


def time_range(items: DataFrame, col: str = "content_published_date", *keys: str) -> DataFrame:
    """First and last time; now when there is none."""
    now = F.to_timestamp_ntz(F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return value_range(items, col, *keys, default=now)


def cluster_sizes_range(clusters: DataFrame, *keys: str) -> DataFrame:
    return value_range(clusters, "num_items", *keys, default=F.lit(0).cast("bigint"))


def published_range(items: DataFrame) -> DataFrame:
    """First and last published date per cluster."""
    return items.where(F.col("content_cluster_id").isNotNull()).groupBy("content_cluster_id").agg(
        F.min("content_published_date").alias("min_pub_date"),
        F.max("content_published_date").alias("max_pub_date"),
    )


def recompute_clusters(items: DataFrame) -> DataFrame:
    """Size, unique texts, exemplar (oldest item) and date range of each cluster, from its items.

    A cluster has one workspace. A null text counts as one value. Texts are reduced to digests before
    anything is sorted or shuffled (``text`` reads the digest twice, which keeps Spark from moving the
    hash into the aggregate); the one distinct count splits a hot cluster over its texts before the
    counts meet.
    """
    members = items.where(F.col("content_cluster_id").isNotNull()).select(
        "workspace_id", "content_cluster_id", "raw_created_at", "content_item_id", "content_published_date",
        F.sha2("content", 256).alias("digest"),
    )
    text = F.when(F.col("digest").isNull(), F.lit("null")).otherwise(F.col("digest"))
    age = F.struct("raw_created_at", "content_item_id")
    return members.groupBy("workspace_id", "content_cluster_id").agg(
        F.count(F.lit(1)).alias("num_items"),
        F.count_distinct(text).alias("num_items_unique"),
        F.min(age)["content_item_id"].alias("exemplar_item_id"),
        F.min("content_published_date").alias("min_pub_date"),
        F.max("content_published_date").alias("max_pub_date"),
    )


def items_added(assign_events: DataFrame) -> DataFrame:
    """Items ever added to each cluster; deletions do not lower it."""
    adds = assign_events.where(F.col("kind") == "add")
    return count_by(adds, "content_cluster_id", name="num_items_added")


def run_metrics(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts of loaded, failed and blank rows by run keys."""
    failed = F.col("current_state") == "failed"
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(failed).alias("errors"),
        F.count_if(~failed).alias("loaded"),
    )


def error_gate(outcomes: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Per key: error count, rate, and whether the run has to stop: by the rate, and by ``most`` errors if that is given."""
    counted = run_metrics(outcomes, *keys)
    rate = F.col("errors") / F.col("items")
    stop = (F.col("items") > ERROR_RATE_AFTER) & (rate >= ERROR_RATE)
    if most is not None:
        stop = stop | (F.col("errors") >= most)
    return counted.select(*keys, "items", "errors", rate.alias("error_rate"), stop.alias("must_stop"))


class ErrorRateExceeded(RuntimeError):
    """Too many items of a stage failed."""


def check_gate(outcomes: DataFrame, *keys: str, most: int | None = None) -> None:
    """Raise when the gate of any key says stop; one row reaches the driver."""
    bad = error_gate(outcomes, *keys, most=most).where("must_stop").limit(1).collect()
    if bad:
        raise ErrorRateExceeded(str(bad[0].asDict()))
