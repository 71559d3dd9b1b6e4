"""Model answers and new vectors as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.operators import clusters, pivot_index, similarity
from trendloom.operators.keywords import KEYWORD_COLUMNS, attach_keywords
from trendloom.operators.sizes import add_sizes, cluster_sizes
from trendloom.session import cut, settle_batch
from trendloom.sources import landed, snapshots

VECTORS = "content_item_id BIGINT, workspace_id STRING, vector ARRAY<FLOAT>, content_cluster_id BIGINT"


def callback_stream(
    spark: SparkSession, path: str, items: DataFrame, keyword_root: str, event_path: str, refused_path: str, checkpoint: str,
) -> StreamingQuery:
    """Landed callbacks to keyword rows and state events. Errors change nothing; sets for unknown items
    or of another workspace are kept apart, and so are lines that are not JSON (``keyword_root``/quarantine)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        good, broken = landed.split_messages(settle_batch(df, spark))
        broken.write.mode("overwrite").parquet(f"{keyword_root}/quarantine/batch={batch_id}")
        sets = cut(landed.callback_keyword_sets(landed.callback_rows(good)))
        rows, refused = attach_keywords(sets, items)
        snapshots.commit_changes(rows.select(*KEYWORD_COLUMNS), keyword_root, batch_id=f"{checkpoint}#{batch_id}")
        refused.write.mode("overwrite").json(f"{refused_path}/batch={batch_id}")
        owned = sets.join(items.select("content_item_id", "workspace_id"), ["content_item_id", "workspace_id"], "left_semi")
        events = owned.select("content_item_id", F.col("target_state").alias("to_state"))
        events.write.mode("overwrite").parquet(f"{event_path}/batch={batch_id}")

    lines = spark.readStream.text(path).select(F.col("value").alias("message"))
    return (
        lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def add_vectors(batch: DataFrame, root: str, threshold: float, batch_id: str) -> DataFrame:
    """Clusters for a batch of new vectors, from similar ones in the index at ``root`` and from each other.

    Only the cells that the batch can meet are read, and of the clusters only the buckets of those found. Copies inside the
    batch come as one edge each.
    """
    spark = batch.sparkSession
    fresh = cut(batch.select("content_item_id", "workspace_id", "vector").where("vector IS NOT NULL"))
    queries = similarity.representatives(fresh, F.col("vector"), "vector").withColumnRenamed("content_item_id", "query_id")
    old = pivot_index.find_stored(queries, root, threshold, columns=["content_cluster_id"], but=batch_id)
    stars = similarity.copies(fresh, F.col("vector")).where("rep_id <> content_item_id").select(
        "workspace_id", F.col("rep_id").alias("src_id"), F.col("content_item_id").alias("dst_id"), F.lit(2.0).alias("score")
    )
    edges = similarity.similar_vectors(fresh, threshold).unionByName(stars)
    members = fresh.select("workspace_id", "content_item_id", F.lit(None).cast("bigint").alias("content_cluster_id"))
    sizes = None
    if old is not None:
        old = cut(old)
        edges = edges.unionByName(old.select("workspace_id", "src_id", "dst_id", "score"))
        members = members.unionByName(old.select("workspace_id", F.col("dst_id").alias("content_item_id"), "content_cluster_id").distinct())
        sizes = cluster_sizes(spark, root, members, batch_id)
    placed = clusters.assign_clusters(members, edges, stored_sizes=sizes)
    return fresh.join(placed.select("content_item_id", "content_cluster_id"), "content_item_id")


def store_vectors(placed: DataFrame, root: str, batch_id: str) -> None:
    """Adds a clustered batch to the index and to the sizes; repeating a batch changes nothing."""
    pivot_index.extend_index(placed, root, batch_id, ["content_cluster_id"])
    add_sizes(placed, root, batch_id)


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """All clustered vectors of the index at ``root``."""
    found = pivot_index.read_index(spark, root)
    return spark.createDataFrame([], VECTORS) if found is None else found.select("content_item_id", "workspace_id", "vector", "content_cluster_id")


def cluster_stream(vectors: DataFrame, root: str, threshold: float, checkpoint: str) -> StreamingQuery:
    """New vectors into the clustered vector index at ``root``, micro-batch by micro-batch.

    Batches are named by the checkpoint's last folder and their number; one that is repeated after a failure does not see its
    own earlier rows and writes the same ones again.
    """
    spark = vectors.sparkSession
    name = "".join(c if c.isalnum() else "-" for c in checkpoint.rstrip("/").rsplit("/", 1)[-1])

    def batch(df: DataFrame, batch_id: int) -> None:
        tag = f"{name}-{batch_id}"
        placed = cut(add_vectors(settle_batch(df, spark), root, threshold, tag))
        store_vectors(placed, root, tag)

    return (
        vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
