"""The stored pivot index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_clusters import brute_pairs, clustered_points, vectors_of
from trendloom.operators import pivot_index
from trendloom.session import work_folder
from trendloom.streaming import models


def found(df):
    rows = [(r["src_id"], r["dst_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def both(m, t, workspaces=2):
    pairs = brute_pairs(m, t, workspaces)
    return pairs | {(b, a) for a, b in pairs} | {(i, i) for i in range(len(m))}


@pytest.mark.parametrize(("threshold", "block"), [(0.95, 4), (0.8, 2000), (0.3, 7)])
def test_lookup_finds_every_pair(spark, threshold, block):
    m = np.concatenate([clustered_points(1), clustered_points(1)[:9]])  # copies too
    df, root = vectors_of(spark, m), work_folder(spark)
    zero = spark.createDataFrame([(900, "w0", [0.0] * 8), (901, "w0", None)], df.schema)
    pivot_index.extend_index(df.unionByName(zero), root)
    queries = df.unionByName(zero).withColumnRenamed("content_item_id", "query_id")
    assert found(pivot_index.find_stored(queries, root, threshold, block_rows=block)) == both(m, threshold)
    top = pivot_index.find_stored(queries, root, threshold, k=2)
    assert top.groupBy("src_id").count().agg(F.max("count")).first()[0] <= 2


def test_batches_extend_and_rebuild(spark):
    m = clustered_points(3, 300)
    df, root = vectors_of(spark, m, 1), work_folder(spark)
    assert pivot_index.find_stored(df.withColumnRenamed("content_item_id", "query_id"), root, 0.9) is None
    for batch, (low, high) in enumerate([(0, 20), (20, 60), (60, 300)]):
        for _ in range(1 + (batch == 1)):  # a repeated batch changes nothing
            pivot_index.extend_index(df.where(f"content_item_id >= {low} AND content_item_id < {high}").withColumn("c", F.lit(batch)), root, str(batch), ["c"])
    assert pivot_index._generation(spark, root) == (1, 300)  # built for 20, built anew past 80
    stored = pivot_index.read_index(spark, root)
    assert sorted(r["content_item_id"] for r in stored.collect()) == list(range(300))
    queries = df.where("content_item_id < 50").withColumnRenamed("content_item_id", "query_id")
    got = pivot_index.find_stored(queries, root, 0.9, columns=["c"])
    assert found(got) == {(a, b) for a, b in both(m, 0.9, 1) if a < 50}
    assert {(r["dst_id"] >= 20) + (r["dst_id"] >= 60) == r["c"] for r in got.collect()} == {True}
    assert found(pivot_index.find_stored(queries, root, 0.9, but="2")) == {(a, b) for a, b in both(m, 0.9, 1) if a < 50 and b < 60}


def test_cells_grow_with_the_square_root_and_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    shares = []
    for n in (256, 4096):
        m = (centres[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, 16))).astype("float32")
        root = work_folder(spark)
        pivot_index.extend_index(vectors_of(spark, m, 1), root)
        tree = pivot_index._read_tree(spark, pivot_index._folder(root, 0))
        cells = sum(len(c) for c in tree.cells)
        assert 0.3 * n**0.5 <= cells <= 1.5 * n**0.5
        unit = m.astype("float64") / np.linalg.norm(m, axis=1, keepdims=True)
        rows, _ = tree.visits(unit, float(np.sqrt(2 - 2 * 0.98)))
        shares.append(len(rows) / n)
        assert len(rows) / n < 0.4 * cells
    one = vectors_of(spark, m[:1], 1).withColumnRenamed("content_item_id", "query_id")
    visited = np.unique(tree.visits(unit[:1], float(np.sqrt(2 - 2 * 0.98)))[1])
    plan = pivot_index.read_index(spark, root, [int(c) for c in visited])
    assert {r["cell"] for r in plan.select("cell").distinct().collect()} <= set(visited.tolist()) and len(visited) < cells
    assert plan.inputFiles() and all(any(f"cell={c}/" in f for c in visited) for f in plan.inputFiles())
    assert pivot_index.find_stored(one, root, 0.98).count() >= 1
    assert shares[1] <= 4 * max(shares[0], 1)


def test_a_repeated_stream_batch_changes_nothing(spark):
    m = clustered_points(8, 80)
    df, root = vectors_of(spark, m, 1), work_folder(spark)
    for tag, rows in (("a-0", df.where("content_item_id < 40")), ("a-1", df.where("content_item_id >= 40")), ("a-1", df.where("content_item_id >= 40"))):
        models.store_vectors(models.cut(models.add_vectors(rows, root, 0.9, tag)), root, tag)
    got = models.stored_vectors(spark, root)
    assert got.count() == 80
    sizes = models.cluster_sizes(spark, root, got.select("workspace_id", "content_item_id", "content_cluster_id"))
    want = got.groupBy("content_cluster_id").agg(F.count(F.lit(1)).alias("num_items"))
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, want.collect()))
