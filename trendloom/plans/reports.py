"""Reports over the item, cluster, keyword and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.aggregates import published_range
from trendloom.operators.filters import (
    active_between, in_list, in_workspace, keep_listed, language_is, published_between, size_between, text_match,
)
from trendloom.operators.joins import having_keyword, with_exemplar, with_state
from trendloom.operators.ranking import sample_percent as sample_rows


def content_rows(
    items: DataFrame, states: DataFrame, keywords: DataFrame | None = None, workspace_id=None,
    published_start=None, published_end=None, closed: str = "both", cluster_ids=None, language_code=None,
    query_ids=None, keyword_texts=None, match=None, match_mode: str = "literal", sample_percent=None,
    max_limit: int | None = None,
) -> DataFrame:
    """Items with their state; the first ``max_limit`` in id order, or all of them, unsorted.

    Filters run before the joins and reach the scan.
    """
    base = items if sample_percent is None else sample_rows(items, sample_percent, by="content_item_id")
    base = base.where(in_workspace(workspace_id) & published_between(published_start, published_end, closed))
    base = base.where(language_is(*([language_code] if language_code else [])) & text_match(match, match_mode))
    base = keep_listed(keep_listed(base, "content_cluster_id", cluster_ids), "query_id", query_ids)
    if keyword_texts:
        base = having_keyword(base, keywords, keyword_texts)
    state = states.select("state_id", "current_state", "completed_timestamp")
    rows = with_state(base, state)
    return rows if max_limit is None else rows.orderBy("content_item_id").limit(max_limit)


def cluster_rows(
    clusters: DataFrame, items: DataFrame, workspace_id=None, cluster_ids=None, min_cluster_size=None,
    max_cluster_size=None, min_pub_date=None, max_pub_date=None, oldest_since=None, sample_percent=None,
    max_limit: int | None = None,
) -> DataFrame:
    """Clusters with exemplar text, url and first and last published date; the first ``max_limit`` in id
    order, or all of them, unsorted."""
    base = clusters if sample_percent is None else sample_rows(clusters, sample_percent, by="content_cluster_id")
    base = base.where(in_workspace(workspace_id) & in_list("content_cluster_id", cluster_ids))
    base = base.where(size_between(min_cluster_size, max_cluster_size)).drop("min_pub_date", "max_pub_date")
    ranges = published_range(items.where(in_workspace(workspace_id)))
    ranges = ranges.where(active_between(min_pub_date, max_pub_date, oldest_since))
    rows = with_exemplar(base.join(ranges, "content_cluster_id"), items)
    return rows if max_limit is None else rows.orderBy("content_cluster_id").limit(max_limit)


def top_clusters(clusters: DataFrame, items: DataFrame, n: int = 100, min_size: int = 2) -> DataFrame:
    """The largest clusters with exemplar and activity range.

    The n largest are picked first, so that the exemplar join carries n rows.
    """
    largest = clusters.where(size_between(min_size)).orderBy(F.desc("num_items"), "content_cluster_id").limit(n)
    return with_exemplar(largest, items).orderBy(F.desc("num_items"), "content_cluster_id")


def state_summary(items: DataFrame, states: DataFrame, workspace_id=None) -> DataFrame:
    """Items per workspace and state."""
    joined = with_state(
        items.where(in_workspace(workspace_id)).select("content_item_state_id", "workspace_id"),
        states.select("state_id", "current_state"),
    )
    return joined.groupBy("workspace_id", "current_state").agg(F.count(F.lit(1)).alias("num_items"))


def date_state_counts(items: DataFrame, states: DataFrame, workspace_id=None, max_limit: int | None = None) -> DataFrame:
    """Items per workspace, date_id and state; with ``max_limit`` the first ones in that order."""
    joined = with_state(
        items.where(in_workspace(workspace_id)).select("content_item_state_id", "workspace_id", "date_id"),
        states.select("state_id", "current_state"),
    )
    counted = joined.groupBy("workspace_id", "date_id", "current_state").agg(F.count(F.lit(1)).alias("num_items"))
    if max_limit is None:
        return counted
    return counted.orderBy("workspace_id", "date_id", "current_state").limit(max_limit)
