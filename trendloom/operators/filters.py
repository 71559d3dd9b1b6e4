"""Predicates of the reports. Each gives a Column, so that Spark can push it to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.schema import PAYLOAD_BYTES

LONG_LIST = 1000


def _all(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    joined = F.lit(True)
    for i, part in enumerate(parts):
        joined = part if i == 0 else joined & part
    return joined


def in_workspace(workspace_id: str | None) -> Column:
    return _all([] if workspace_id is None else [F.col("workspace_id") == workspace_id])


def published_between(start=None, end=None, closed: str = "both", col: str = "content_published_date") -> Column:
    """Range test; an open bound is open. ``closed='right'`` is (start, end]."""
    c, parts = F.col(col), []
    if start is not None:
        s = F.lit(start).cast("timestamp_ntz")
        parts.append(c > s if closed == "right" else c >= s)
    if end is not None:
        parts.append(c <= F.lit(end).cast("timestamp_ntz"))
    return _all(parts)


def in_list(col: str, values) -> Column:
    """IN-list; None, '' and [] mean no filter."""
    if values is None or values == "" or len(values) == 0:
        return F.lit(True)
    return F.col(col).isin(list(values))


def keep_listed(df: DataFrame, col: str, values) -> DataFrame:
    """IN-list on a DataFrame: long lists become a semi join, whose side Spark sizes itself."""
    if values is None or len(values) <= LONG_LIST:
        return df.where(in_list(col, values))
    spark: SparkSession = df.sparkSession
    listed = spark.createDataFrame([(v,) for v in values], f"{col} {df.schema[col].dataType.simpleString()}")
    return df.join(listed, col, "left_semi")


def language_is(*codes: str) -> Column:
    return in_list("content_language_code", codes)


def text_match(text: str | None, mode: str = "literal", col: str = "content") -> Column:
    """Case-sensitive match: literal text, LIKE pattern around it, or a regular expression."""
    if not text:
        return F.lit(True)
    c = F.col(col)
    return {"literal": c.contains(text), "like": c.like(f"%{text}%"), "regex": c.rlike(text)}[mode]


def size_between(low=None, high=None, col: str = "num_items") -> Column:
    parts = []
    if low is not None:
        parts.append(F.col(col) >= low)
    if high is not None:
        parts.append(F.col(col) <= high)
    return _all(parts)


def active_between(start=None, end=None, since=None) -> Column:
    """Clusters with recently added items: both bounds test the newest item, ``since`` the oldest."""
    parts = [published_between(start, end, col="max_pub_date")]
    if since is not None:
        parts.append(F.col("min_pub_date") >= F.lit(since).cast("timestamp_ntz"))
    return _all(parts)


def in_progress(state: str | None = None) -> Column:
    if state is not None:
        return F.col("current_state") == state
    return ~F.col("current_state").isin("undefined", "failed", "completed")


def has_priority() -> Column:
    return F.col("priority_score") > 0.0


def older_than(ts) -> Column:
    """Strictly older; a null date never qualifies."""
    return F.col("content_published_date") < F.lit(ts).cast("timestamp_ntz")


def payload_under(payload: Column, max_bytes: int = PAYLOAD_BYTES) -> Column:
    """UTF-8 size of a request payload below the limit."""
    return F.octet_length(payload) < max_bytes


def count_nulls(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias("nulls"), F.count(F.lit(1)).alias("total"))


def check_non_null(df: DataFrame, col: str) -> None:
    """Stop the job if a row lacks the value. It counts at once, so no later pruning of the column can drop the check."""
    nulls = count_nulls(df, col).first()["nulls"]
    if nulls:
        raise ValueError(f"{nulls} rows without {col}")
