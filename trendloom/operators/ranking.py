"""Winners per key, ordering, paging and sampling.

Winners are ``min``/``max`` of a struct, which combine map-side. Only where every row of a key needs
its neighbours is a window used, and ``per_key`` splits keys that are too large for one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.joins import ITEM_KEY
from trendloom.session import cut

LARGE_KEY = 5_000_000


def latest_state(events: DataFrame) -> DataFrame:
    """Newest state of each item by (event_ts, event_id)."""
    newest = F.max(F.struct("event_ts", "event_id", "to_state"))
    return events.groupBy("content_item_id").agg(newest.alias("e")).select(
        "content_item_id",
        F.col("e.to_state").alias("current_state"),
        F.col("e.event_ts").alias("event_ts"),
    )


def exemplars(items: DataFrame) -> DataFrame:
    """Oldest item of each cluster, the smaller id on a tie."""
    oldest = F.min(F.struct("raw_created_at", "content_item_id"))["content_item_id"]
    members = items.where(F.col("content_cluster_id").isNotNull())
    return members.groupBy("content_cluster_id").agg(oldest.alias("exemplar_item_id"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair seen from both of its items."""
    return pairs.select("src_id", "dst_id", "score").unionByName(
        pairs.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "score")
    )


def best_candidates(edges: DataFrame, item_sizes: DataFrame) -> DataFrame:
    """Best neighbour of each item by score, then cluster size, then id.

    ``edges`` are directed (src_id, dst_id, score); ``item_sizes`` has (content_item_id, cluster_size).
    """
    sized = edges.join(item_sizes.withColumnRenamed("content_item_id", "dst_id"), "dst_id")
    best = F.max(F.struct("score", "cluster_size", "dst_id"))
    return sized.groupBy("src_id").agg(best.alias("b")).select(
        "src_id",
        F.col("b.dst_id").alias("dst_id"),
        F.col("b.score").alias("score"),
        F.col("b.cluster_size").alias("cluster_size"),
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark trims each key to k rows before the shuffle (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def dedup_winner(incoming: DataFrame, force: bool = False) -> DataFrame:
    """One row per natural key: the first good row, or the last row of all with ``force``.

    ``incoming`` carries ``arrival`` (order of arrival) and ``current_state``.
    """
    columns = incoming.columns
    bad = F.coalesce(F.col("current_state") == "failed", F.lit(False))
    rest = F.struct(*[c for c in columns if c not in (*ITEM_KEY, "arrival")]).alias("rest")
    tie = F.xxhash64(*[c for c in columns if c not in (*ITEM_KEY, "arrival")])
    if force:
        winner = F.max_by(F.struct("arrival", rest), F.struct("arrival", tie))
    else:
        winner = F.min_by(
            F.struct("arrival", rest),
            F.struct(bad, F.when(bad, -F.col("arrival")).otherwise(F.col("arrival")), tie),
        )
    picked = incoming.groupBy(*ITEM_KEY).agg(winner.alias("w"))
    return picked.select(*ITEM_KEY, "w.arrival", "w.rest.*").select(*columns)


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest key: one number to the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def per_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    whole: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], DataFrame],
    large_key: int = LARGE_KEY,
) -> DataFrame:
    """Use ``whole`` while every key fits a task, else ``split`` on key segments.

    The split form gets a column ``segment``: rows are range-partitioned by key and order, so a hot
    key is spread over many even segments that follow each other. The segments are written to the
    checkpoint folder, so that a lost executor cannot change them.
    """
    if largest_key(df, keys) <= large_key:
        return whole(df)
    ranged = df.repartitionByRange(*keys, *order).withColumn("segment", F.spark_partition_id())
    return split(cut(ranged))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, large_key: int = LARGE_KEY
) -> DataFrame:
    """Value of the row before, per key."""

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))

    def split(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys, "segment").agg(F.max(F.struct(*order, F.col(column).alias("last"))).alias("l"))
        by_segment = Window.partitionBy(*keys).orderBy("segment")
        before = last.select(*keys, "segment", F.lag("l.last").over(by_segment).alias("before"))
        inner = Window.partitionBy(*keys, "segment").orderBy(*order)
        lagged = rows.withColumn(name, F.lag(column).over(inner))
        first = F.row_number().over(inner) == 1
        joined = lagged.withColumn("first_row", first).join(before, [*keys, "segment"])
        value = F.when(F.col("first_row"), F.col("before")).otherwise(F.col(name))
        return joined.withColumn(name, value).drop("segment", "before", "first_row")

    return per_key(df, keys, order, whole, split, large_key)


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, large_key: int = LARGE_KEY
) -> DataFrame:
    """Sum of ``value`` up to and with each row, per key."""
    upto = (Window.unboundedPreceding, Window.currentRow)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))

    def split(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*keys, "segment").agg(F.sum(value).alias("part"))
        earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        offset = sums.select(*keys, "segment", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("offset"))
        inner = Window.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(*upto)
        running = rows.withColumn(name, F.sum(value).over(inner)).join(offset, [*keys, "segment"])
        return running.withColumn(name, F.col(name) + F.col("offset")).drop("segment", "offset")

    return per_key(df, keys, order, whole, split, large_key)


def number_attempts(run_events: DataFrame, large_key: int = LARGE_KEY) -> DataFrame:
    """Attempts of each run: every ``running`` event opens one, ``run_id:n``; it ends with the next
    completed or failed event, and stays open without one."""
    starts = F.when(F.col("to_state") == "running", 1).otherwise(0)
    numbered = with_running_sum(run_events, ["run_id"], ["event_ts", "event_id"], starts, "attempt_num", large_key)
    running = F.col("to_state") == "running"
    ended = F.col("to_state").isin("completed", "failed")
    return (
        numbered.where(F.col("attempt_num") > 0)
        .groupBy("run_id", "attempt_num")
        .agg(
            F.min(F.when(running, F.col("event_ts"))).alias("attempt_start"),
            F.min(F.when(ended, F.col("event_ts"))).alias("attempt_end"),
            F.max(F.struct("event_ts", "event_id", "to_state"))["to_state"].alias("current_state"),
        )
        .withColumn("attempt_id", F.concat_ws(":", "run_id", F.col("attempt_num").cast("string")))
    )


def transition_durations(events: DataFrame, large_key: int = LARGE_KEY) -> DataFrame:
    """Microseconds between an event of an item and the one before."""
    order = ["event_ts", "event_id"]
    lagged = with_previous(events, ["content_item_id"], order, "event_ts", "previous_ts", large_key)
    micros = F.expr("timestampdiff(MICROSECOND, previous_ts, event_ts)")
    return lagged.select("event_id", "content_item_id", "to_state", "event_ts", "previous_ts", micros.alias("micros"))


def page(df: DataFrame, key: str, after=None, n: int | None = 10000) -> DataFrame:
    """Keyset page in key order."""
    rest = df if after is None else df.where(F.col(key) > after)
    rest = rest.orderBy(key)
    return rest if n is None else rest.limit(n)


def top_priority(clusters: DataFrame, n: int = 1000) -> DataFrame:
    """Clusters to look at again, highest priority first."""
    wanted = clusters.where(F.col("priority_score") > 0.0)
    return wanted.orderBy(F.desc("priority_score"), "content_cluster_id").limit(n)


def recent_runs(process_state: DataFrame, n: int | None = None) -> DataFrame:
    """Runs by date and start, newest first; open values lead."""
    ordered = process_state.orderBy(
        F.desc_nulls_first("date_id"), F.desc_nulls_first("attempt_start"), F.asc("run_id"), F.asc("attempt_num")
    )
    return ordered if n is None else ordered.limit(n)


def sample_percent(df: DataFrame, percent: float, seed: int = 42, by: str | None = None) -> DataFrame:
    """Repeatable sample; with ``by`` it does not depend on the file layout."""
    if by is None:
        return df.sample(percent / 100, seed=seed)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10000
    return df.where(slot < percent * 100)


def random_pick(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows in random order."""
    return df.orderBy(F.rand(seed)).limit(n)
