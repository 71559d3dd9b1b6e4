"""Bounds on what a task holds of similar vectors."""

import numpy as np
import pandas as pd

from tests.test_clusters import vectors_of
from trendloom.operators import pivot_index, similarity


def test_best_of_block_keeps_the_best_of_each_item():
    src, dst = np.array([5, 3, 5, 5, 3, 5]), np.array([1, 2, 4, 3, 9, 2])
    score = np.array([0.5, 0.2, 0.9, 0.5, 0.7, 0.5])
    kept = similarity.best_of_block(src, dst, score, 2)
    assert sorted((src[i], dst[i]) for i in kept) == [(3, 2), (3, 9), (5, 1), (5, 4)]
    assert len(similarity.best_of_block(src[:0], dst[:0], score[:0], 2)) == 0


def test_tasks_give_only_hits_that_can_be_among_the_best(spark, monkeypatch):
    m = np.random.default_rng(4).normal(size=(120, 6)).astype("float32")
    vectors = vectors_of(spark, m)
    pairs = similarity.similar_vectors(vectors, 0.1).toPandas()
    both = pd.concat([pairs, pairs.rename(columns={"src_id": "dst_id", "dst_id": "src_id"})])
    best = both.sort_values(["src_id", "score", "dst_id"], ascending=[True, False, True]).groupby("src_id").head(2)
    rows, top = [], similarity.top_per_key
    monkeypatch.setattr(similarity, "top_per_key", lambda df, *a: [rows.append(df.count()), top(df, *a)][1])
    got = similarity.similar_vectors(vectors, 0.1, k=2).collect()
    assert {(r["src_id"], r["dst_id"]) for r in got} == set(zip(best["src_id"], best["dst_id"], strict=True))
    assert rows[0] <= 2 * 2 * 120 < len(both)


def test_visits_of_many_cells_come_in_small_batches():
    frame = pd.DataFrame({"workspace_id": ["w"] * 300, "content_item_id": range(300), "vector": [[1.0, 2.0]] * 300})
    row, cell = np.repeat(np.arange(300), 50), np.tile(np.arange(50), 300)
    parts = list(pivot_index._by_cell(frame, row, cell))
    assert max(map(len, parts)) <= 2000 and len(parts) == 8
    assert list(pd.concat(parts)["content_item_id"]) == list(row) and list(pd.concat(parts)["cell"]) == list(cell)
