"""Distinct values and date sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.values import date_id


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values; null is a value."""
    return df.select(*cols).distinct()


def union_sets(*sets: DataFrame) -> DataFrame:
    joined = sets[0]
    for other in sets[1:]:
        joined = joined.unionByName(other)
    return joined.distinct()


def days_between(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included, as date_id, for each row of dates."""
    days = F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("day")
    return bounds.select(days).select(date_id(F.col("day")).alias("date_id"))


def backfill_dates(spark: SparkSession, start_id: int, end_id: int) -> DataFrame:
    """The date_ids of a backfill, both ends included."""
    bounds = spark.range(1).select(
        F.to_date(F.lit(str(start_id)), "yyyyMMdd").alias("start"),
        F.to_date(F.lit(str(end_id)), "yyyyMMdd").alias("end"),
    )
    return days_between(bounds, "start", "end")
