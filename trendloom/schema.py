"""Table schemas and state graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ITEM = (
    "run_id STRING, workspace_id STRING, source_id STRING, query_id STRING, page_id STRING, "
    "created_at STRING, content_id STRING, content STRING"
)

# States and allowed transitions of the item and run state graphs.
BASE_GRAPH = {
    "undefined": ["ready", "failed"],
    "ready": ["failed", "completed"],
    "failed": ["ready"],
}
STATE_GRAPHS = {
    "base": {},
    "default": {
        "ready": ["vectorized", "failed"],
        "vectorized": ["clustered", "failed"],
        "clustered": ["completed", "failed"],
    },
    "social": {
        "ready": ["keyworded", "failed"],
        "keyworded": ["vectorized", "failed"],
        "vectorized": ["clustered", "failed"],
        "clustered": ["hashtaged", "failed"],
        "hashtaged": ["completed", "failed"],
    },
    "tweets": {
        "ready": ["text_transformed", "failed"],
        "text_transformed": ["vectorized", "failed"],
        "vectorized": ["clustered", "failed"],
        "clustered": ["completed", "failed"],
    },
    "tipline": {
        "ready": ["vectorized", "failed"],
        "vectorized": ["clustered", "failed"],
        "clustered": ["completed", "failed"],
    },
    "classify": {
        "ready": ["vectorized", "failed"],
        "vectorized": ["clustered", "failed"],
        "clustered": ["hashtaged", "failed"],
        "hashtaged": ["categorized", "failed"],
        "categorized": ["completed", "failed"],
    },
}
RUN_GRAPH = {
    "ready": ["running"],
    "running": ["failed", "completed"],
    "failed": ["running"],
}
# Similarity thresholds per workflow, days an item lives, and limits.
THRESHOLDS = {"default": 0.95, "social": 0.95, "tweets": 0.875, "tipline": 0.875, "classify": 0.95}
RETRY_CAP = 100
IN_FLIGHT_SECONDS = 10
CLASSIFY_IN_FLIGHT_SECONDS = {"hashtaged": 120}
ERROR_RATE, ERROR_RATE_AFTER = 0.25, 100
PAYLOAD_BYTES = 256000


def _edges(graph: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(source, target) for source, targets in graph.items() for target in targets]


def graph_frame(spark: SparkSession, model: str, graph: dict[str, list[str]]) -> DataFrame:
    """A state graph as rows; a handful per model, so it is safe to broadcast."""
    return spark.createDataFrame(
        [(model, a, b) for a, b in _edges(graph)],
        "state_model STRING, from_state STRING, to_state STRING",
    )


def extend_model(base: DataFrame, extra: DataFrame, model: str) -> DataFrame:
    """Add ``extra`` to ``base``; a source state in ``extra`` replaces all its targets in ``base``."""
    kept = base.join(F.broadcast(extra.select("from_state").distinct()), "from_state", "left_anti")
    both = kept.select("from_state", "to_state").unionByName(extra.select("from_state", "to_state"))
    return both.select(F.lit(model).alias("state_model"), "from_state", "to_state")


def state_model(spark: SparkSession, model: str) -> DataFrame:
    """The full transition table of an item workflow."""
    base = graph_frame(spark, "base", BASE_GRAPH)
    if not STATE_GRAPHS[model]:
        return base
    return extend_model(base, graph_frame(spark, model, STATE_GRAPHS[model]), model)


def model_graph(model: str) -> dict[str, list[str]]:
    return RUN_GRAPH if model == "run" else {**BASE_GRAPH, **STATE_GRAPHS[model]}
