import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import aggregates, clusters, keywords, maintenance, similarity

ITEMS = ("content_item_id BIGINT, workspace_id STRING, content_cluster_id BIGINT, content STRING, content_item_state_id BIGINT, "
         "source_id STRING, minute INT")


def items_of(spark, rows):
    """Rows of (id, cluster, text); older ids are older items."""
    full = [(i, "w", c, t, i, "s", i) for i, c, t in rows]
    return spark.createDataFrame(full, ITEMS).withColumns({
        "raw_created_at": F.expr("timestampadd(MINUTE, minute, TIMESTAMP_NTZ'2024-01-01 00:00:00')"),
        "content_published_date": F.lit(None).cast("timestamp_ntz"), "content_published_url": F.lit(None).cast("string"),
    }).drop("minute")


def book(df):
    return {r["content_cluster_id"]: (r["num_items"], r["num_items_unique"], r["exemplar_item_id"]) for r in df.collect()}


def test_bookkeeping_through_deletes(spark):
    items = items_of(spark, [(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, 8, None), (5, 8, None)])
    table = aggregates.recompute_clusters(items)
    assert book(table) == {7: (3, 2, 1), 8: (2, 1, 4)}
    tables = {"items": items, "clusters": table}
    one = maintenance.delete_items(tables, spark.createDataFrame([(1,)], "content_item_id BIGINT"))
    assert book(one["clusters"]) == {7: (2, 2, 2), 8: (2, 1, 4)}
    two = maintenance.delete_items(one, spark.createDataFrame([(2,), (4,), (5,)], "content_item_id BIGINT"))
    assert book(two["clusters"]) == {7: (1, 1, 3)}


def test_items_added_stay_after_deletes(spark):
    items = items_of(spark, [(2, 7, "a")])
    events = spark.createDataFrame([(7, "add"), (7, "add"), (7, "remove"), (7, "add")], "content_cluster_id BIGINT, kind STRING")
    assert clusters.rebuild_clusters(items, events).first()["num_items_added"] == 3


def test_merge_keeps_target_exemplar(spark):
    items = items_of(spark, [(1, 10, "a"), (2, 10, "b"), (3, 20, "c"), (4, 20, "d")])
    table = aggregates.recompute_clusters(items)
    merges = clusters.check_same_workspace(spark.createDataFrame([(10, 20)], "source_id BIGINT, target_id BIGINT"), table)
    after = clusters.merge_clusters(items, merges)
    assert book(clusters.merged_clusters(table, merges, after)) == {20: (4, 4, 3)}


def test_merge_across_workspaces_is_refused(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "content_cluster_id BIGINT, workspace_id STRING")
    merges = spark.createDataFrame([(1, 2)], "source_id BIGINT, target_id BIGINT")
    with pytest.raises(Exception, match="different workspaces"):
        clusters.check_same_workspace(merges, table).collect()


def test_merge_chains_and_rings_collapse(spark):
    table = spark.createDataFrame([(i, "w", 10 if i == 2 else 1) for i in range(1, 11)], "content_cluster_id BIGINT, workspace_id STRING, num_items INT")
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (7, 8), (8, 10), (9, 8)], "source_id BIGINT, target_id BIGINT")
    got = {tuple(r) for r in clusters.collapse_merges(merges, table).collect()}
    assert got == {(1, 2), (3, 2), (5, 6), (7, 10), (8, 10), (9, 10)}


def test_merge_keeps_the_proposed_target(spark):
    """A cluster of one item joins a larger one with a larger id, whose exemplar stays."""
    items = spark.createDataFrame(
        [("w", 1, 5, "a"), ("w", 2, 9, "b"), ("w", 3, 9, "c")], "workspace_id STRING, content_item_id BIGINT, content_cluster_id BIGINT, content STRING"
    ).withColumns({"raw_created_at": F.expr("timestampadd(DAY, -content_item_id, TIMESTAMP_NTZ '2024-01-01')"), "content_published_date": F.lit(None).cast("timestamp_ntz")})
    table = spark.createDataFrame(
        [(5, "w", 1, 1, 0.3, 0.0), (9, "w", 2, 2, 0.0, 0.0)],
        "content_cluster_id BIGINT, workspace_id STRING, num_items INT, exemplar_item_id BIGINT, priority_score DOUBLE, stress_score DOUBLE",
    )
    edges = spark.createDataFrame([("w", 1, 2, 1.9)], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    after, left = clusters.merge_pass(table, items, edges)
    assert {r.content_cluster_id for r in after.collect()} == {9}
    assert [(r.content_cluster_id, r.exemplar_item_id, r.num_items) for r in left.collect()] == [(9, 2, 3)]


def test_a_long_chain_is_placed(spark):
    n = 500
    items = spark.createDataFrame([("w", i, 7 if i == 0 else None) for i in range(n)], "workspace_id STRING, content_item_id BIGINT, content_cluster_id BIGINT")
    edges = spark.createDataFrame([("w", i, i + 1, 1.9) for i in range(n - 1)], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    assert {r.content_cluster_id for r in clusters.assign_clusters(items, edges).collect()} == {7}


def test_gate_follows_the_rate(spark):
    rows = spark.range(200_000).select(F.lit("w").alias("workspace_id"), F.when(F.col("id") % 10 == 0, "failed").otherwise("ready").alias("current_state"))
    gate = lambda **k: aggregates.error_gate(rows, "workspace_id", **k).first().must_stop
    assert (gate(), gate(most=20_000), gate(most=20_001)) == (False, True, False)
    assert aggregates.error_gate(rows.where("current_state = 'failed'"), "workspace_id").first().must_stop


def test_scores(spark):
    """A pair starts at priority 0.2; the third item adds 0.1 and the first stress."""
    log = [(1, 7, "add", True), (2, 7, "add", False), (3, 7, "add", False), (4, 7, "seen", False), (5, 7, "move", False), (6, 8, "add", False)]
    events = spark.createDataFrame(log, "event_id INT, content_cluster_id INT, kind STRING, opened_as_pair BOOLEAN").withColumn("event_ts", F.col("event_id"))
    for large in (10**6, 1):
        got = {r["content_cluster_id"]: (r["stress_score"], r["priority_score"]) for r in clusters.cluster_scores(events, large_key=large).collect()}
        assert got == {7: (0.2, 0.4), 8: (0.0, 0.0)}


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 120
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)],
        "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
    }[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame([("w", a, b) for a, b in edges], "workspace_id STRING, src_id BIGINT, dst_id BIGINT")
    got = {r["content_item_id"]: r["group_id"] for r in clusters.connected_components(df).collect()}
    want = union_find(n, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}


def vectors_of(spark, m, workspaces=2):
    rows = [(i, f"w{i % workspaces}", [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "content_item_id BIGINT, workspace_id STRING, vector ARRAY<FLOAT>")


def clustered_points(seed, n=160, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return (centres[rng.integers(0, 6, n)] + 0.25 * rng.normal(size=(n, dims))).astype("float32")


def brute_pairs(m, t, workspaces=2):
    u = m.astype("float64")
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if i % workspaces == j % workspaces and c[i, j] >= t}


@pytest.mark.parametrize("threshold,block", [(0.95, 4), (0.875, 9), (0.5, 4), (0.875, 2000)])
def test_similar_vectors_finds_every_pair(spark, threshold, block):
    m = clustered_points(1)
    got = similarity.similar_vectors(vectors_of(spark, m), threshold, block_rows=block).collect()
    pairs = [(r["src_id"], r["dst_id"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(m, threshold)


def test_copies_cost_their_size(spark):
    m = np.repeat(clustered_points(2, 20), 5, axis=0)
    df = vectors_of(spark, m, 1)
    assert df.count() == 100
    members = similarity.copies(df, F.col("vector"))
    assert members.select("rep_id").distinct().count() == 20
    assert similarity.similar_vectors(df, 0.999999).count() == 0


@pytest.mark.parametrize("block", [5, 2000])
def test_find_similar(spark, block):
    m = clustered_points(4)
    df = vectors_of(spark, m)
    queries = df.where("content_item_id < 20").withColumnRenamed("content_item_id", "query_id")
    stored = df.where("content_item_id >= 20")
    got = {(r["src_id"], r["dst_id"]) for r in similarity.find_similar(queries, stored, 0.9, block_rows=block).collect()}
    assert got == {(i, j) for i, j in brute_pairs(m, 0.9) if i < 20 <= j}
    top = similarity.find_similar(queries, stored, 0.9, k=2, block_rows=block)
    assert top.groupBy("src_id").count().agg(F.max("count")).first()[0] <= 2


def texts_of(spark, n=150, seed=9):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(12)] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(bases[min(rng.randrange(25), rng.randrange(25))])
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((f"s{i % 2}", i, " ".join(words)))
    return spark.createDataFrame(rows + [("s0", 900, ""), ("s0", 901, None)], "workspace_id STRING, content_item_id BIGINT, content STRING")


def brute_texts(items, t):
    weights = keywords.word_sets(similarity.representatives(items.where("content IS NOT NULL"), similarity.text_key(), "content")).collect()
    vec = {}
    for r in weights:
        vec.setdefault((r["workspace_id"], r["content_item_id"]), {})[r["term"]] = r["weight"]
    norm = {k: sum(w * w for w in v.values()) ** 0.5 for k, v in vec.items()}
    return {(a[1], b[1]) for a in vec for b in vec if a[0] == b[0] and a[1] < b[1]
            and sum(w * vec[b].get(x, 0) for x, w in vec[a].items()) / (norm[a] * norm[b]) >= t}


@pytest.mark.parametrize("threshold", [0.6, 0.875, 0.95])
def test_similar_texts_finds_every_pair(spark, threshold):
    items = texts_of(spark)
    want = brute_texts(items, threshold)
    for slice_rows in (3, 2000):
        got = [(r["src_id"], r["dst_id"]) for r in similarity.similar_texts(items, threshold, slice_rows=slice_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("large", [1, 5, 200])
def test_text_clusters_equal_components_of_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(similarity, "LARGE_POSTING", large)
    items = texts_of(spark)
    pairs = similarity.similar_texts(items, 0.8).select("workspace_id", "src_id", "dst_id")
    stars = similarity.copies(items.where("content IS NOT NULL"), similarity.text_key()).where("rep_id <> content_item_id")
    edges = pairs.unionByName(stars.select("workspace_id", F.col("rep_id").alias("src_id"), F.col("content_item_id").alias("dst_id")))
    want = {r["content_item_id"]: r["group_id"] for r in clusters.connected_components(edges).collect()}
    got = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.text_clusters(items, 0.8).collect()}
    assert len(got) == 152 and got == {i: want.get(i, i) for i in got}


def test_partition_count_does_not_matter(spark):
    items = texts_of(spark)
    before = sorted(clusters.text_clusters(items, 0.8).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(clusters.text_clusters(items, 0.8).collect()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_identical_texts_form_one_cluster_per_workspace(spark):
    rows = [(w, i, "Same old text") for i, w in enumerate(["a"] * 5 + ["b"])]
    items = spark.createDataFrame(rows, "workspace_id STRING, content_item_id BIGINT, content STRING")
    got = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.text_clusters(items, 0.95).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}


def greedy(members, edges):
    """Layer by layer: waiting items join their best clustered neighbour; the rest form components."""
    cluster = dict(members)
    near = {}
    for a, b, s in edges:
        near.setdefault(a, []).append((s, b))
        near.setdefault(b, []).append((s, a))
    while True:
        size = {}
        for c in cluster.values():
            if c is not None:
                size[c] = size.get(c, 0) + 1
        found = {}
        for i, c in cluster.items():
            if c is None:
                options = [(s, size[cluster[j]], j) for s, j in near.get(i, []) if cluster[j] is not None]
                if options:
                    found[i] = cluster[max(options)[2]]
        if not found:
            break
        cluster.update(found)
    waiting = [i for i, c in cluster.items() if c is None]
    roots = union_find(max(cluster) + 1, [(a, b) for a, b, _ in edges if a in waiting and b in waiting])
    taken = {c for c in cluster.values() if c is not None}
    cluster.update({i: roots[i] if roots[i] not in taken else None for i in waiting})
    return cluster


def test_assign_against_brute_force(spark):
    rng = random.Random(11)
    n = 60
    members = {i: (1000 + i % 4 if rng.random() < 0.2 else None) for i in range(n)}
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), rng.randrange(100) / 100)
                  for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(70)) if a != b}.values())
    items = spark.createDataFrame([("w", i, c) for i, c in members.items()], "workspace_id STRING, content_item_id BIGINT, content_cluster_id BIGINT")
    pairs = spark.createDataFrame([("w", *e) for e in edges], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    got = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.assign_clusters(items, pairs).collect()}
    assert got == greedy(members, edges)


def chains(seed, n=90):
    """Long chains between placed items, side branches, a ring of its own, equal scores that leave the choice to sizes."""
    rng = random.Random(seed)
    members = {i: None for i in range(n)}
    edges = [(i, i + 1, 1.5) for i in range(n - 1) if i % 30 != 29]
    for i in rng.sample(range(n), 5):
        members[i] = 1000 + i % 3
    edges += [(rng.randrange(n), rng.randrange(n), rng.choice([1.5, 1.6])) for _ in range(rng.choice([0, 6, 25]))]
    edges += [(n + i, n + (i + 1) % 8, 1.9) for i in range(8)]
    members |= {n + i: None for i in range(12)}
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), s) for a, b, s in edges if a != b}.values())
    return members, edges


@pytest.mark.parametrize("seed", range(4))
def test_assign_over_chains_and_ties(spark, seed):
    members, edges = chains(seed)
    items = spark.createDataFrame([("w", i, c) for i, c in members.items()], "workspace_id STRING, content_item_id BIGINT, content_cluster_id BIGINT")
    pairs = spark.createDataFrame([("w", *e) for e in edges], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    got = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.assign_clusters(items, pairs).collect()}
    assert got == greedy(members, edges)


def test_recluster_moves_items_out(spark):
    items = spark.createDataFrame([("w", 1, 1), ("w", 2, 1)], "workspace_id STRING, content_item_id BIGINT, content_cluster_id BIGINT")
    none = spark.createDataFrame([], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    again = spark.createDataFrame([(2,)], "content_item_id BIGINT")
    got = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.assign_clusters(items, none, again).collect()}
    assert got == {1: 1, 2: 2}


def test_merge_pass_joins_foreign_cluster_and_resets_priority(spark):
    items = items_of(spark, [(1, 10, "a"), (2, 10, "b"), (3, 20, "c"), (4, 30, "d")])
    table = aggregates.recompute_clusters(items).withColumns({"priority_score": F.lit(0.2), "stress_score": F.lit(0.0)})
    edges = spark.createDataFrame([("w", 1, 3, 1.97), ("w", 1, 2, 1.99)], "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE")
    after, left = clusters.merge_pass(table, items, edges)
    assert {r["content_item_id"]: r["content_cluster_id"] for r in after.collect()} == {1: 10, 2: 10, 3: 10, 4: 30}
    assert {r["content_cluster_id"]: (r["num_items"], r["priority_score"]) for r in left.collect()} == {10: (3, 0.2), 30: (1, 0.0)}
