"""Whole id lists of keywords that come in parts."""

from trendloom.operators import keywords


def test_parts_of_id_lists_are_joined_in_order(spark):
    kw = spark.createDataFrame([(10 * i, "w", "m", "#a" if i % 3 else "#b", i) for i in range(1, 30)],
                               "content_keyword_id BIGINT, workspace_id STRING, keyword_model_name STRING, keyword_text STRING, content_item_id BIGINT")
    items = spark.createDataFrame([(i, 7 if i > 15 and i % 3 else None, None) for i in range(1, 30)],
                                  "content_item_id BIGINT, content_cluster_id BIGINT, content_published_date TIMESTAMP_NTZ")
    parts = keywords.keyword_id_lists(kw, items, keywords.keyword_rollup(kw, items, min_count=1), part_size=4)
    got = {r["keyword_text"]: r for r in keywords.joined_id_lists(parts).collect()}
    for tag, ids in (("#a", [i for i in range(1, 30) if i % 3]), ("#b", list(range(3, 30, 3)))):
        row = got[tag]
        assert row["part"] == 0 and row["content_item_ids"] == ",".join(map(str, ids))
        assert row["content_keyword_ids"] == ",".join(str(10 * i) for i in ids)
    assert got["#a"]["content_cluster_ids"] == ",".join("7" for i in range(16, 30) if i % 3) and got["#b"]["content_cluster_ids"] is None
