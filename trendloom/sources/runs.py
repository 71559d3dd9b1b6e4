"""Run states: one row per batch of a load, in a folder of its own, so that a repeated batch replaces its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import path_exists

COUNTS = ["items", "inserted", "replaced", "ignored", "failed", "dispatched"]
RUN = "state STRING, bad_lines BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTS) + ", removed BIGINT"


def record(counts: DataFrame, bad: DataFrame, folder: str) -> None:
    """Writes the run row of a batch from its outcome counts by date and its malformed lines.

    ``dispatched`` items go on into a workflow, ``removed`` ones were in the table and gave way. A run whose lines were all
    malformed has failed, as has one without lines.
    """
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
    lost = bad.agg(F.count(F.lit(1)).alias("bad_lines"))
    row = sums.crossJoin(F.broadcast(lost))  # one row each
    state = F.when(F.col("items") == 0, "failed").otherwise("completed")
    row = row.select(state.alias("state"), "bad_lines", *COUNTS, F.col("replaced").alias("removed"))
    row.coalesce(1).write.mode("overwrite").json(folder)


def record_empty(spark: SparkSession, folder: str) -> None:
    """The run row of a job that found nothing to load."""
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("bad_lines", *COUNTS, "removed")]
    spark.range(1).select(F.lit("failed").alias("state"), *zeros).coalesce(1).write.mode("overwrite").json(folder)


def read(spark: SparkSession, root: str) -> DataFrame:
    """All run rows with the name of their batch."""
    if not path_exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], f"{RUN}, batch STRING")
    return spark.read.schema(f"{RUN}, batch STRING").json(f"{root}/runs")


def batches(spark: SparkSession, root: str) -> set[str]:
    """Names of the batches recorded so far: one a run, a few thousand in the life of a table."""
    return {r["batch"] for r in read(spark, root).select("batch").distinct().collect()}
