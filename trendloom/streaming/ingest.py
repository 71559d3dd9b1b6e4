"""Raw store to item table, as a stream of files or as a backfill of dates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.operators import extract, maintenance, setops
from trendloom.operators.joins import ITEM_KEY
from trendloom.session import cut, settle_batch
from trendloom.sources import raw_store, runs, snapshots

ITEMS = (
    "run_id STRING, workspace_id STRING, source_id STRING, query_id STRING, date_id INT, raw_created_at TIMESTAMP_NTZ, "
    "raw_content_id STRING, raw_content STRING, content_item_id BIGINT, content_published_date TIMESTAMP_NTZ, "
    "content_published_url STRING, content STRING, content_language_code STRING, source_field STRING, "
    "failed_reason STRING, current_state STRING"
)


def load_items(raw: DataFrame, root: str, extractor: Callable[[DataFrame], DataFrame], batch_id: str | None = None, force: bool = False) -> DataFrame:
    """Extract raw items and upsert them into the item table at ``root``; gives outcome counts per date.

    Only keys and states of the stored table are read; new rows and the ids of replaced ones are
    committed as changes.
    """
    spark = raw.sparkSession
    items = extract.ingest_status(extractor(raw))
    incoming = items.withColumn("arrival", F.unix_micros(F.col("raw_created_at").cast("timestamp")))
    stored = snapshots.read_snapshot(spark, root, ITEMS).select(*ITEM_KEY, "content_item_id", "current_state")
    decided = cut(maintenance.split_incoming(stored, incoming, force))
    taken = decided.where(F.col("outcome") != "ignored")
    gone = decided.where(F.col("outcome") == "replaced").select(F.col("existing_content_item_id").alias("content_item_id"))
    columns = [c.split(" ")[0] for c in ITEMS.split(", ")]
    snapshots.commit_changes(taken.select(*columns), root, gone, batch_id=batch_id)
    return decided.groupBy("date_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.count_if(F.col("outcome") == "replaced").alias("replaced"),
        F.count_if(F.col("outcome") == "ignored").alias("ignored"),
        F.count_if(F.col("current_state") == "failed").alias("failed"),
        F.count_if((F.col("outcome") != "ignored") & (F.col("current_state") != "failed")).alias("dispatched"),
    )


def raw_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New raw store files as a stream of raw items; the payload stays text, and a malformed line is a row with ``_corrupt_record``."""
    lines = spark.readStream.schema(raw_store.LINES).option("maxFilesPerTrigger", max_files).text(path)
    return raw_store.parse_lines(lines)


def ingest_stream(
    spark: SparkSession, path: str, root: str, checkpoint: str, extractor: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """All raw files not seen yet into the item table, then stop (the daily job).

    A batch that is replayed after a failure finds its id in the commit log and changes nothing. Malformed lines of a batch are
    kept in ``root``/quarantine/batch=n, and its figures in ``root``/runs/batch=n; both are written anew when it is repeated.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        raw = settle_batch(df, spark)
        bad = cut(raw_store.quarantine(raw))
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")
        counts = load_items(raw_store.good_rows(raw), root, extractor, batch_id=f"{checkpoint}#{batch_id}")
        runs.record(counts, bad, f"{root}/runs/batch={batch_id}")

    return (
        raw_stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_run(spark: SparkSession, path: str, root: str, checkpoint: str, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One daily job to its end: the run rows of its batches. A job that found no line at all leaves one row, as failed."""
    before = runs.batches(spark, root)
    ingest_stream(spark, path, root, checkpoint, extractor).awaitTermination()
    new = sorted(runs.batches(spark, root) - before)
    if not new:
        new = [f"empty-{uuid.uuid4().hex}"]
        runs.record_empty(spark, f"{root}/runs/batch={new[0]}")
    return runs.read(spark, root).where(F.col("batch").isin(new))


def dedup_within(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Bounded stream dedup: first row per natural key within the delay."""
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(ITEM_KEY).drop("event_time")


def backfill(
    spark: SparkSession, path: str, root: str, extractor: Callable[[DataFrame], DataFrame], start_id: int, end_id: int,
) -> DataFrame:
    """Load every date from start to end in one pruned scan; gives one status row per date.

    Malformed lines do not stop the other dates; a date with some is reported as ``error``, one without
    any file as ``missing``.
    """
    dates = setops.backfill_dates(spark, start_id, end_id)
    wanted = [r["date_id"] for r in dates.collect()]
    raw = raw_store.read_raw(spark, path, wanted)
    broken = raw.groupBy("date_id").agg(
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_lines"), F.count("run_id").alias("raw_items")
    )
    loaded = load_items(raw_store.good_rows(raw), root, extractor)
    report = dates.join(broken, "date_id", "left").join(loaded.drop("dispatched"), "date_id", "left")
    status = F.when(F.col("raw_items").isNull(), "missing").when(F.col("bad_lines") > 0, "error").otherwise("completed")
    return report.withColumn("status", status).fillna(0)
