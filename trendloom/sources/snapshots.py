"""Table snapshots: write new folders, then record them in one commit row.

A commit holds the whole table, or the rows that came in and the ids that went out since the last
commit, so that a small load does not rewrite a large table. Data is complete before its commit row
exists and no path is ever overwritten: a lost job leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import path_exists

COMMITS = "version BIGINT, is_whole BOOLEAN, row_folder STRING, gone_folder STRING, batch_id STRING"


def commits(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).json(f"{root}/commits")


def has_batch(spark: SparkSession, root: str, batch_id: str) -> bool:
    return bool(commits(spark, root).where(F.col("batch_id") == batch_id).take(1))


def _commit(spark, root, rows, gone, is_whole, partition_by, batch_id) -> int:
    last = commits(spark, root).agg(F.max("version")).first()[0]
    if batch_id is not None and has_batch(spark, root, batch_id):
        return last
    version = 0 if last is None else last + 1
    name = f"{version}-{uuid.uuid4().hex}"
    writer = rows.withColumn("_version", F.lit(version).cast("bigint")).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/rows/{name}")
    if gone is not None:
        gone.withColumn("_gone_at", F.lit(version).cast("bigint")).write.parquet(f"{root}/gone/{name}")
    row = (version, is_whole, f"rows/{name}", None if gone is None else f"gone/{name}", batch_id)
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").json(f"{root}/commits")
    return version


def commit_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None, batch_id: str | None = None) -> int:
    """Write ``df`` as the new content of the table; a batch that is already in is skipped."""
    return _commit(df.sparkSession, root, df, None, True, partition_by, batch_id)


def commit_changes(
    rows: DataFrame, root: str, gone: DataFrame | None = None, partition_by: list[str] | None = None,
    batch_id: str | None = None,
) -> int:
    """Add ``rows`` and take out the earlier rows whose key is in ``gone``; a repeated batch is skipped."""
    return _commit(rows.sparkSession, root, rows, gone, False, partition_by, batch_id)


def read_snapshot(spark: SparkSession, root: str, schema: str | None = None, key: str = "content_item_id") -> DataFrame:
    """The table as of the last commit; an empty one of ``schema`` before the first."""
    log = commits(spark, root)
    start = log.where("is_whole").agg(F.max("version")).first()[0]
    used = log if start is None else log.where(F.col("version") >= start)
    parts = used.orderBy("version").collect()
    if not parts:
        if schema is None:
            raise FileNotFoundError(f"no snapshot in {root}")
        return spark.createDataFrame([], schema)
    rows = _read_all(spark, [f"{root}/{p['row_folder']}" for p in parts], schema and f"{schema}, _version BIGINT")
    gone = [f"{root}/{p['gone_folder']}" for p in parts if p["gone_folder"]]
    if gone:
        left = _read_all(spark, gone, None).groupBy(F.col(key).alias("_key")).agg(F.max("_gone_at").alias("_gone_at"))
        rows = rows.join(left, (F.col(key) == F.col("_key")) & (F.col("_version") < F.col("_gone_at")), "left_anti")
    return rows.drop("_version")


def _read_all(spark: SparkSession, folders: list[str], schema: str | None) -> DataFrame:
    frames = [(spark.read.schema(schema) if schema else spark.read).parquet(f) for f in folders]
    out = frames[0]
    for one in frames[1:]:
        out = out.unionByName(one)
    return out


def compact(spark: SparkSession, root: str, partition_by: list[str] | None = None, key: str = "content_item_id") -> int:
    """One whole snapshot in place of many changes."""
    return commit_snapshot(read_snapshot(spark, root, key=key), root, partition_by)
