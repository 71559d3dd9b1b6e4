"""The raw store: JSON lines, or Parquet once compacted, in date/workspace/source partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.schema import RAW_ITEM

PARTITION = ["date_id", "workspace_id", "source_id"]
LINES = "value STRING, date_id INT, workspace_id STRING, source_id STRING"


def append_raw(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append raw items; every write adds new files. JSON lines are gzipped.

    Rows are rebalanced by partition first: few files per folder, and a hot folder in several.
    """
    missing = [c for c in [*PARTITION, "content_id", "content"] if c not in df.columns]
    if missing:
        raise ValueError(f"not raw items, missing {missing}")
    options = {"compression": "gzip", "ignoreNullFields": "false"} if fmt == "json" else {}
    even = df.hint("rebalance", *[F.col(c) for c in PARTITION])
    even.write.mode("append").partitionBy(*PARTITION).format(fmt).options(**options).save(path)


def _pick(df: DataFrame, date_ids, workspace_id, source_id) -> DataFrame:
    if date_ids is not None:
        df = df.where(F.col("date_id").isin(list(date_ids)))
    if workspace_id is not None:
        df = df.where(F.col("workspace_id") == workspace_id)
    if source_id is not None:
        df = df.where(F.col("source_id") == source_id)
    return df


def read_raw(spark: SparkSession, path: str, date_ids=None, workspace_id=None, source_id=None, strict: bool = False) -> DataFrame:
    """Raw items of matching partitions; the payload stays text.

    ``strict`` fails on a malformed line. Otherwise such lines stay as rows with ``_corrupt_record``;
    see ``good_rows`` and ``quarantine``.
    """
    return parse_lines(_pick(spark.read.schema(LINES).text(path), date_ids, workspace_id, source_id), strict)


def parse_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines of the store (``LINES``), from a table or a stream, as raw items."""
    body = ", ".join(f for f in RAW_ITEM.split(", ") if f.split(" ")[0] not in PARTITION)
    options = {"mode": "FAILFAST"} if strict else {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json("value", body if strict else f"{body}, _corrupt_record STRING", options)
    return lines.select(parsed.alias("r"), *PARTITION).select("r.*", *PARTITION)


def good_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def quarantine(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNotNull()).select(*PARTITION, "_corrupt_record")


def read_compacted(spark: SparkSession, path: str, date_ids=None, workspace_id=None, source_id=None) -> DataFrame:
    return _pick(spark.read.parquet(path), date_ids, workspace_id, source_id)


def compact(spark: SparkSession, source: str, target: str, date_ids=None) -> None:
    """Gzipped JSON, which cannot be split, to Parquet in the same partitions."""
    raw = good_rows(read_raw(spark, source, date_ids))
    even = raw.hint("rebalance", *[F.col(c) for c in PARTITION])
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(target)


def delete_partition(spark: SparkSession, path: str, date_id: int, workspace_id: str, source_id: str) -> bool:
    """Remove one partition folder; true if it was there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(
        f"{path}/date_id={date_id}/workspace_id={workspace_id}/source_id={source_id}"
    )
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def external_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A schema-on-read table over the raw store, with its partitions found from the folders."""
    columns = ", ".join(c for c in RAW_ITEM.split(", ") if c.split(" ")[0] not in PARTITION)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, date_id INT, workspace_id STRING, source_id STRING) "
        f"USING json PARTITIONED BY (date_id, workspace_id, source_id) LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)
