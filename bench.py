"""Time headline queries: one warm-up, then the median of up to three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from trendloom.plans import catalog
from trendloom.session import local_session

HEADLINE = [
    "keyword_rollup", "keyword_id_lists", "keyword_timeline", "content_rows_filtered", "cluster_rows", "cluster_rebuild",
    "hour_counts_filled", "date_state_counts", "clean_text", "hashtag_keywords", "tfidf_keyphrases", "extract_multi_field",
    "upsert_items", "delete_items_clusters", "apply_events", "transition_durations", "run_attempts", "cluster_scores",
    "similar_vectors", "find_similar", "similar_texts", "text_clusters", "ingest_stream", "workflow_tweets",
]
SLOW = 10.0


def timed(spark, fn, folder: str) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")))
    spent = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        first = timed(spark, fn, folder)
        runs = [timed(spark, fn, folder) for _ in range(1 if first > SLOW else 3)]
        spent[name] = round(statistics.median(runs), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": sf}))


if __name__ == "__main__":
    main()
