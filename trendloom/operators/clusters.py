"""Clusters of similar items: assignment, bookkeeping, moves and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.aggregates import items_added, recompute_clusters
from trendloom.operators.pivot_index import find_stored
from trendloom.operators.placing import place
from trendloom.operators.ranking import with_running_sum
from trendloom.operators.similarity import linking_texts
from trendloom.session import cut, cut_and_measure

MAX_ROUNDS = 60


class NotConverged(RuntimeError):
    """Connected components did not settle within the allowed rounds."""


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Smallest reachable id of each item as ``group_id``.

    ``edges`` has (workspace_id, src_id, dst_id). Alternates two star steps (Kiveris et al., 2014): each
    item points its larger neighbours, then its smaller ones, at the smallest id it sees. Rounds grow
    with the logarithm of the longest chain. Neighbour lists are never gathered: a step is one ``min``
    per item, combined map-side, and one join. Each round is written to the checkpoint folder.
    """
    a, b = F.col("src_id"), F.col("dst_id")
    current = edges.where(a != b).select(
        "workspace_id", F.greatest(a, b).alias("v"), F.least(a, b).alias("u")
    ).distinct()
    current, before = cut_and_measure(current, **_edge_print())
    for _ in range(max_rounds):
        current, after = cut_and_measure(_small_star(_large_star(current)), **_edge_print())
        if after == before:
            roots = current.select("workspace_id", F.col("u").alias("v"), "u").distinct()
            everyone = current.unionByName(roots).groupBy("workspace_id", "v").agg(F.min("u").alias("group_id"))
            return everyone.withColumnRenamed("v", "content_item_id")
        before = after
    raise NotConverged(f"components still change after {max_rounds} rounds")


def _edge_print() -> dict[str, Column]:
    """Count and order-free hash of an edge set, to see when it has settled."""
    return {
        "edges": F.count(F.lit(1)),
        "digest": F.coalesce(F.bit_xor(F.xxhash64("workspace_id", "v", "u")), F.lit(0).cast("bigint")),
    }


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of an item at the smallest id around the item."""
    around = edges.select("workspace_id", F.col("v").alias("node"), F.col("u").alias("m")).unionByName(
        edges.select("workspace_id", F.col("u").alias("node"), F.col("u").alias("m"))
    )
    smallest = around.groupBy("workspace_id", "node").agg(F.min("m").alias("m"))
    larger = edges.select("workspace_id", F.col("u").alias("node"), F.col("v").alias("other"))
    moved = larger.join(smallest, ["workspace_id", "node"])
    return moved.select("workspace_id", F.col("other").alias("v"), F.col("m").alias("u"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point every smaller neighbour of an item, and the item, at the smallest of them."""
    smallest = edges.groupBy("workspace_id", "v").agg(F.min("u").alias("m"))
    others = edges.join(smallest, ["workspace_id", "v"]).where(F.col("u") != F.col("m"))
    moved = others.select("workspace_id", F.col("u").alias("v"), F.col("m").alias("u"))
    kept = smallest.select("workspace_id", "v", F.col("m").alias("u"))
    return kept.unionByName(moved).where(F.col("v") != F.col("u")).distinct()


def text_clusters(items: DataFrame, threshold: float, text: str = "content") -> DataFrame:
    """Items in groups of near copies: (workspace_id, content_item_id, content_cluster_id).

    A cluster is named by its smallest item; an item without a similar one forms its own.
    """
    groups = connected_components(linking_texts(items, threshold, connected_components, text))
    named = items.select("workspace_id", "content_item_id").join(groups, ["workspace_id", "content_item_id"], "left")
    return named.select(
        "workspace_id", "content_item_id", F.coalesce("group_id", "content_item_id").alias("content_cluster_id")
    )


def same_text_clusters(items: DataFrame, text: str = "content") -> DataFrame:
    """Clusters of items with equal text, without any iteration."""
    key = F.sha2(text, 256)
    first = items.groupBy("workspace_id", key.alias("k")).agg(F.min("content_item_id").alias("content_cluster_id"))
    return items.withColumn("k", key).join(first, ["workspace_id", "k"]).drop("k")


def assign_clusters(
    items: DataFrame, edges: DataFrame, recluster: DataFrame | None = None, stored_sizes: DataFrame | None = None,
) -> DataFrame:
    """Cluster of each item, given similar pairs.

    ``items`` has (workspace_id, content_item_id, content_cluster_id or null); ``edges`` undirected
    (workspace_id, src_id, dst_id, score). An item without a cluster joins its best neighbour that has one (score, then
    cluster size, then id), until no more can; the rest form new clusters by connected components,
    single items included. Items in ``recluster`` lose their cluster first.

    ``items`` need only have the clustered items that an edge reaches, if ``stored_sizes`` (content_cluster_id, num_items) has
    the sizes of all clusters in question; else sizes are counted from ``items``. See ``placing`` for how long chains of items
    are placed in few rounds.
    """
    members = items.select("workspace_id", "content_item_id", "content_cluster_id")
    if recluster is not None:
        again = recluster.select("content_item_id", F.lit(True).alias("again"))
        members = members.join(again, "content_item_id", "left").select(
            "workspace_id", "content_item_id",
            F.when(F.col("again").isNull(), F.col("content_cluster_id")).alias("content_cluster_id"),
        )
    members = cut(members)
    unplaced = members.where(F.col("content_cluster_id").isNull()).select("workspace_id", "content_item_id")
    both = edges.select("workspace_id", "src_id", "dst_id", "score").unionByName(
        edges.select("workspace_id", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "score")
    )
    both = both.join(unplaced.withColumnRenamed("content_item_id", "src_id"), ["workspace_id", "src_id"], "left_semi")
    there = members.select("workspace_id", F.col("content_item_id").alias("dst_id"), F.col("content_cluster_id").alias("home"))
    links = cut(both.join(there, ["workspace_id", "dst_id"]))
    if stored_sizes is None:
        sizes = members.where("content_cluster_id IS NOT NULL").groupBy("content_cluster_id").agg(F.count(F.lit(1)).alias("num_items"))
    else:
        sizes = stored_sizes
    sizes = sizes.select(F.col("content_cluster_id").alias("cluster"), F.col("num_items").alias("size"))
    found = place(links, sizes).select("workspace_id", "content_item_id", F.col("content_cluster_id").alias("found"))
    members = members.join(found, ["workspace_id", "content_item_id"], "left").select(
        "workspace_id", "content_item_id", F.coalesce("content_cluster_id", "found").alias("content_cluster_id")
    )
    return _new_clusters(cut(members), links, sizes)


def _new_clusters(members: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Components of the items that are still waiting; one that would take the id of a cluster gets a hashed id instead."""
    waiting = members.where(F.col("content_cluster_id").isNull()).select("workspace_id", "content_item_id")
    inside = links.join(waiting.withColumnRenamed("content_item_id", "src_id"), ["workspace_id", "src_id"], "left_semi")
    inside = inside.join(waiting.withColumnRenamed("content_item_id", "dst_id"), ["workspace_id", "dst_id"], "left_semi")
    groups = connected_components(inside)
    named = waiting.join(groups, ["workspace_id", "content_item_id"], "left").withColumn(
        "new_id", F.coalesce("group_id", "content_item_id")
    )
    taken = members.select(F.col("content_cluster_id").alias("new_id")).where("new_id IS NOT NULL")
    taken = taken.unionByName(sizes.select(F.col("cluster").alias("new_id"))).distinct()
    named = named.join(taken.withColumn("is_taken", F.lit(True)), "new_id", "left")
    fresh = F.when(F.col("is_taken"), F.xxhash64(F.lit("cluster"), "new_id")).otherwise(F.col("new_id"))
    placed = members.where(F.col("content_cluster_id").isNotNull())
    return placed.unionByName(
        named.select("workspace_id", "content_item_id", fresh.alias("content_cluster_id"))
    )


def rebuild_clusters(items: DataFrame, assign_events: DataFrame) -> DataFrame:
    """Cluster table from items, with the items ever added from the assignment log."""
    return recompute_clusters(items).join(items_added(assign_events), "content_cluster_id", "left").withColumn(
        "num_items_added", F.greatest(F.coalesce("num_items_added", "num_items"), "num_items")
    )


def cluster_scores(assign_events: DataFrame, **sizes) -> DataFrame:
    """Stress and priority of each cluster from its assignment log.

    The log has (event_id, event_ts, content_cluster_id, kind): ``add`` by a clustering action, ``move``
    for an add by a merge, ``seen`` for an action on an item already in place, ``remove``. The first add
    alone leaves 0 and 0; each later add or move raises priority by 0.1, and a cluster opened as a pair
    starts at 0.1 (``opened_as_pair`` on its first event). Each action that leaves more than two items
    raises stress by 0.1.
    """
    is_add = F.col("kind").isin("add", "move")
    change = F.when(is_add, 1).when(F.col("kind") == "remove", -1).otherwise(0)
    order = ["event_ts", "event_id"]
    sized = with_running_sum(assign_events, ["content_cluster_id"], order, change, "size_after", **sizes)
    by_action = F.col("kind").isin("add", "seen")
    tenths = F.count_if(is_add & (F.col("size_after") > 1)) + F.count_if(F.col("opened_as_pair"))
    return sized.groupBy("content_cluster_id").agg(
        (F.count_if(by_action & (F.col("size_after") > 2)) / 10).alias("stress_score"),
        (tenths / 10).alias("priority_score"),
    )


def move_items(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Items with the cluster that ``moves`` (content_item_id, to_cluster_id) gives them."""
    joined = items.join(moves.select("content_item_id", "to_cluster_id"), "content_item_id", "left")
    return joined.withColumn("content_cluster_id", F.coalesce("to_cluster_id", "content_cluster_id")).select(*items.columns)


def merge_clusters(items: DataFrame, merges: DataFrame) -> DataFrame:
    """Items after merges (source_id, target_id); the source clusters disappear.

    Pairs across workspaces are refused. ``merges`` must not chain; ``collapse_merges`` makes it so.
    """
    joined = items.join(merges.select(F.col("source_id").alias("content_cluster_id"), "target_id"), "content_cluster_id", "left")
    return joined.withColumn("content_cluster_id", F.coalesce("target_id", "content_cluster_id")).select(*items.columns)


def merged_clusters(clusters: DataFrame, merges: DataFrame, items_after: DataFrame) -> DataFrame:
    """Cluster table after merges: counts from items, the target's exemplar kept."""
    kept = clusters.join(merges.select(F.col("source_id").alias("content_cluster_id")), "content_cluster_id", "left_anti")
    fresh = recompute_clusters(items_after).drop("workspace_id", "exemplar_item_id")
    return kept.select("content_cluster_id", "workspace_id", "exemplar_item_id").join(fresh, "content_cluster_id")


def check_same_workspace(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Fail the job on a merge across workspaces."""
    home = clusters.select("content_cluster_id", "workspace_id")
    source = home.select(F.col("content_cluster_id").alias("source_id"), F.col("workspace_id").alias("source_ws"))
    target = home.select(F.col("content_cluster_id").alias("target_id"), F.col("workspace_id").alias("target_ws"))
    joined = merges.join(source, "source_id").join(target, "target_id")
    wrong = F.raise_error(F.lit("clusters of different workspaces cannot be merged"))
    checked = F.when(F.col("source_ws") == F.col("target_ws"), F.col("target_id")).otherwise(wrong)
    return joined.select("source_id", checked.alias("target_id"))


def _looked_at(clusters: DataFrame, n: int | None) -> DataFrame:
    """Clusters with priority: all of them, or the ``n`` of each workspace that come first."""
    if n is None:
        return clusters.where(F.col("priority_score") > 0.0)
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("priority_score"), "content_cluster_id"))
    return clusters.where(F.col("priority_score") > 0.0).withColumn("place", place).where(F.col("place") <= n).drop("place")


def exemplar_pairs(clusters: DataFrame, vectors: DataFrame, root: str, threshold: float, n: int | None = None) -> DataFrame:
    """Similar items of the exemplars of the clusters that a merge pass looks at, from the vector index at ``root``."""
    looked = _looked_at(clusters, n).select(F.col("exemplar_item_id").alias("content_item_id")).distinct()
    queries = vectors.join(looked, "content_item_id", "left_semi").withColumnRenamed("content_item_id", "query_id")
    return find_stored(queries, root, threshold).where(F.col("src_id") != F.col("dst_id"))


def proposed_merges(clusters: DataFrame, items: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """For the clusters with priority: the best similar item of the exemplar in another cluster."""
    from trendloom.operators.ranking import both_ways

    first = _looked_at(clusters, n).select("content_cluster_id", F.col("exemplar_item_id").alias("src_id"))
    owner = items.where(F.col("content_cluster_id").isNotNull()).select(
        F.col("content_item_id").alias("dst_id"), F.col("content_cluster_id").alias("target_id")
    )
    sizes = clusters.select(F.col("content_cluster_id").alias("target_id"), F.col("num_items").alias("cluster_size"))
    near = both_ways(edges).join(first, "src_id").join(owner, "dst_id").join(sizes, "target_id")
    foreign = near.where(F.col("target_id") != F.col("content_cluster_id"))
    best = F.max(F.struct("score", "cluster_size", "dst_id", "target_id"))["target_id"]
    return foreign.groupBy(F.col("content_cluster_id").alias("source_id")).agg(best.alias("target_id"))


def collapse_merges(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Chains of merges brought to their last target.

    A source has one target, so clusters that merges connect have either one target that goes nowhere itself, and all go there,
    or a ring; then they go to the largest of the targets, of equal ones to the smallest id.
    """
    home = clusters.select(F.col("content_cluster_id").alias("source_id"), "workspace_id")
    edges = merges.join(home, "source_id").select(
        "workspace_id", F.col("source_id").alias("src_id"), F.col("target_id").alias("dst_id")
    )
    groups = cut(connected_components(edges).select(F.col("content_item_id").alias("id"), "group_id"))
    targets = merges.select(F.col("target_id").alias("id")).distinct()
    moving = merges.select(F.col("source_id").alias("id"), F.lit(True).alias("moves"))
    sizes = clusters.select(F.col("content_cluster_id").alias("id"), "num_items")
    ends = groups.join(targets, "id", "left_semi").join(moving, "id", "left").join(sizes, "id", "left")
    first = F.min(F.struct(F.coalesce("moves", F.lit(False)).alias("moves"), (-F.coalesce("num_items", F.lit(0))).alias("size"), "id"))
    chosen = ends.groupBy("group_id").agg(first["id"].alias("target_id"))
    return groups.join(chosen, "group_id").where(F.col("id") != F.col("target_id")).select(F.col("id").alias("source_id"), "target_id")


def merge_pass(clusters: DataFrame, items: DataFrame, edges: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One merge pass over all clusters with priority, or the first ``n`` of each workspace: (items, clusters) after it.

    Looked-at clusters without a match get priority 0.
    """
    proposed = cut(proposed_merges(clusters, items, edges, n))
    merges = cut(collapse_merges(check_same_workspace(proposed, clusters), clusters))
    after = merge_clusters(items, merges)
    looked = _looked_at(clusters, n).select("content_cluster_id", F.lit(True).alias("looked"))
    matched = proposed.select(F.col("source_id").alias("content_cluster_id"), F.lit(True).alias("matched"))
    scores = clusters.select("content_cluster_id", "stress_score", "priority_score")
    scores = scores.join(looked, "content_cluster_id", "left").join(matched, "content_cluster_id", "left")
    reset = F.when(F.col("looked") & F.col("matched").isNull(), 0.0).otherwise(F.col("priority_score"))
    scores = scores.select("content_cluster_id", "stress_score", reset.alias("priority_score"))
    return after, merged_clusters(clusters, merges, after).join(scores, "content_cluster_id")


def cluster_members(items: DataFrame, cluster_id: int) -> DataFrame:
    return items.where(F.col("content_cluster_id") == cluster_id)


def discard_vectors(vectors: DataFrame, item_ids: DataFrame | None = None, workspace_id: str | None = None) -> DataFrame:
    """Vectors without those of the given items or of a whole workspace."""
    kept = vectors if workspace_id is None else vectors.where(F.col("workspace_id") != workspace_id)
    return kept if item_ids is None else kept.join(item_ids.select("content_item_id"), "content_item_id", "left_anti")
