"""Joins between the item, state, keyword, cluster and configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_state(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items with their state row; items without one vanish."""
    return items.join(states.withColumnRenamed("state_id", "content_item_state_id"), "content_item_state_id")


def with_items(keywords: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Keyword rows with columns of their item."""
    own = [c for c in keywords.columns if c not in columns]
    return keywords.select(*own).join(items.select("content_item_id", *columns), "content_item_id")


def having_keyword(items: DataFrame, keywords: DataFrame, texts=None) -> DataFrame:
    """Items that carry at least one of the keyword texts; no item twice."""
    wanted = keywords if not texts else keywords.where(F.col("keyword_text").isin(list(texts)))
    return items.join(wanted.select("content_item_id"), "content_item_id", "left_semi")


def clusters_having_keyword(items: DataFrame, keywords: DataFrame, texts=None) -> DataFrame:
    """Ids of clusters with an item that carries one of the keyword texts."""
    found = having_keyword(items, keywords, texts).where(F.col("content_cluster_id").isNotNull())
    return found.select("workspace_id", "content_cluster_id").distinct()


def with_exemplar(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with text and url of their exemplar; clusters without one vanish."""
    exemplar = items.select(
        F.col("content_item_id").alias("exemplar_item_id"),
        F.col("content").alias("exemplar_content"),
        F.col("content_published_url").alias("exemplar_published_url"),
    )
    return clusters.join(exemplar, "exemplar_item_id")


def with_cluster_size(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items with the size of their cluster, 0 when they have none."""
    sizes = clusters.select("content_cluster_id", F.col("num_items").alias("cluster_size"))
    return items.join(sizes, "content_cluster_id", "left").fillna(0, ["cluster_size"])


def drop_orphan_states(states: DataFrame, items: DataFrame) -> DataFrame:
    """States that belong to an item."""
    owned = items.select(F.col("content_item_state_id").alias("state_id"))
    return states.join(owned, "state_id", "left_semi")


def states_of(states: DataFrame, items: DataFrame, workspace_id: str, source_id: str) -> DataFrame:
    """States of the items of one workspace and source."""
    owned = items.where((F.col("workspace_id") == workspace_id) & (F.col("source_id") == source_id))
    return drop_orphan_states(states, owned)


ITEM_KEY = ["workspace_id", "raw_content_id", "source_field"]


def match_existing(incoming: DataFrame, items: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Join on the natural item key, where a null source_field equals a null one."""
    right = items.select(
        *[F.col(c).alias(f"existing_{c}") for c in ITEM_KEY],
        *[F.col(c).alias(f"existing_{c}") for c in columns if c not in ITEM_KEY],
    )
    same = [F.col(c).eqNullSafe(F.col(f"existing_{c}")) for c in ITEM_KEY]
    joined = incoming.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"existing_{c}" for c in ITEM_KEY])


def check_transitions(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Mark each (from_state, to_state) by the state graph, which is a handful of rows."""
    graph = F.broadcast(transitions.select("from_state", "to_state", F.lit(True).alias("is_valid")))
    return events.join(graph, ["from_state", "to_state"], "left").fillna(False, ["is_valid"])


def with_config(df: DataFrame, config: DataFrame) -> DataFrame:
    """Attach workspace configuration (workflow, threshold, life span)."""
    return df.join(config, "workspace_id", "left")


def authorised_workspaces(config: DataFrame, session_slugs: DataFrame, env: str = "live") -> DataFrame:
    """Workspaces open to each session: by team slug, public ones, and dev ones in a dev setting.

    ``config`` has (workspace_id, slugs), ``session_slugs`` has (session_id, slug).
    """
    mapping = config.select("workspace_id", F.explode("slugs").alias("slug"))
    open_slugs = ["public"] + (["dev_public"] if env in ("local", "dev") else [])
    sessions = session_slugs.select("session_id").distinct()
    always = sessions.withColumn("slug", F.explode(F.array(*[F.lit(s) for s in open_slugs])))
    wanted = session_slugs.select("session_id", "slug").unionByName(always)
    return wanted.join(mapping, "slug").select("session_id", "workspace_id").distinct()
