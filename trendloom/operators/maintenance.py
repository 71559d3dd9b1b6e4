"""Upsert, delete, expire and erase. Each gives new tables; none changes a table in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators.aggregates import recompute_clusters
from trendloom.operators.joins import match_existing
from trendloom.operators.ranking import dedup_winner

Tables = dict[str, DataFrame]


def insert_absent(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose natural key is not stored yet, one winner of each key."""
    return match_existing(dedup_winner(incoming), items, [], "left_anti").select(*incoming.columns)


def split_incoming(items: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """Incoming winners per key with their ``outcome``: inserted, replaced or ignored.

    A stored item that failed, or any stored item with ``force``, is replaced.
    """
    winners = dedup_winner(incoming, force)
    matched = match_existing(winners, items, ["content_item_id", "current_state"])
    stored = F.col("existing_content_item_id").isNotNull()
    replaceable = F.lit(True) if force else F.coalesce(F.col("existing_current_state") == "failed", F.lit(True))
    outcome = F.when(~stored, "inserted").when(replaceable, "replaced").otherwise("ignored")
    return matched.withColumn("outcome", outcome).drop("existing_current_state")


def upsert_items(items: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """The item table after an idempotent load. ``items`` carries ``current_state``."""
    decided = split_incoming(items, incoming, force).where(F.col("outcome") != "ignored")
    replaced = decided.where(F.col("outcome") == "replaced").select(F.col("existing_content_item_id").alias("content_item_id"))
    kept = items.join(replaced, "content_item_id", "left_anti").select(*items.columns)
    return kept.unionByName(decided.select(*items.columns))


def delete_items(tables: Tables, ids: DataFrame) -> Tables:
    """Tables without the given items, their states, keywords and vectors; touched clusters are
    recounted and get a new exemplar, and vanish when empty."""
    gone = ids.select("content_item_id")
    items = tables["items"]
    deleted = items.join(gone, "content_item_id", "left_semi")
    out = dict(tables)
    out["items"] = items.join(gone, "content_item_id", "left_anti").select(*items.columns)
    for name in ("keywords", "vectors"):
        if name in tables:
            out[name] = tables[name].join(gone, "content_item_id", "left_anti").select(*tables[name].columns)
    if "states" in tables:
        state_ids = deleted.select(F.col("content_item_state_id").alias("state_id"))
        out["states"] = tables["states"].join(state_ids, "state_id", "left_anti")
    if "clusters" in tables:
        out["clusters"] = _recount(tables["clusters"], out["items"], deleted)
    return out


def _recount(clusters: DataFrame, items_left: DataFrame, deleted: DataFrame) -> DataFrame:
    """Recount only clusters that lost items; the others are passed on as they are."""
    touched = deleted.where(F.col("content_cluster_id").isNotNull()).select("content_cluster_id").distinct()
    same = clusters.join(touched, "content_cluster_id", "left_anti").select(*clusters.columns)
    fresh = recompute_clusters(items_left.join(touched, "content_cluster_id", "left_semi"))
    fresh = fresh.select(*[c for c in fresh.columns if c in clusters.columns])
    kept_columns = [c for c in clusters.columns if c not in fresh.columns or c == "content_cluster_id"]
    return same.unionByName(fresh.join(clusters.select(*kept_columns), "content_cluster_id").select(*clusters.columns))


def expired_ids(items: DataFrame, earliest: Column) -> DataFrame:
    """Items published before ``earliest``; items without a date never expire."""
    return items.where(F.col("content_published_date") < earliest).select("content_item_id")


def expire(tables: Tables, config: DataFrame, window_end: Column, force: bool = False) -> Tables:
    """Delete items older than the life span of their workspace.

    ``config`` has (workspace_id, live_days); without live_days nothing expires. ``force`` uses
    ``window_end`` itself as the limit.
    """
    items = tables["items"]
    if force:
        return delete_items(tables, expired_ids(items, window_end))
    limited = items.join(config.select("workspace_id", "live_days"), "workspace_id")
    earliest = F.expr("timestampadd(DAY, -live_days, window_end)")
    old = expired_ids(limited.withColumn("window_end", window_end), earliest)
    return delete_items(tables, old)


def erase_workspace(tables: Tables, workspace_id: str, source_id: str, keep_keywords: bool = False) -> Tables:
    """Tables without the items and states of (workspace, source) and without any cluster of the workspace.

    Items of other sources of the workspace lose their link to the clusters. ``keep_keywords`` leaves
    the keywords of erased items in place.
    """
    items = tables["items"]
    mine = (F.col("workspace_id") == workspace_id) & (F.col("source_id") == source_id)
    erased = items.where(mine).select("content_item_id", "content_item_state_id")
    out = dict(tables)
    link = F.when(F.col("workspace_id") == workspace_id, F.lit(None)).otherwise(F.col("content_cluster_id"))
    out["items"] = items.where(~mine).withColumn("content_cluster_id", link)
    state_ids = erased.select(F.col("content_item_state_id").alias("state_id"))
    out["states"] = tables["states"].join(state_ids, "state_id", "left_anti")
    out["clusters"] = tables["clusters"].where(F.col("workspace_id") != workspace_id)
    if not keep_keywords:
        out["keywords"] = tables["keywords"].join(erased, "content_item_id", "left_anti").select(*tables["keywords"].columns)
    return out
