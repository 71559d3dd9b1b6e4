"""Time, JSON, vector and id functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(c: Column) -> Column:
    """ISO timestamp with or without 'Z' and fraction, as naive UTC; null if unreadable."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def date_id(c: Column) -> Column:
    """YYYYMMDD number of a date or timestamp."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def date_of(c: Column) -> Column:
    """Date of a YYYYMMDD number."""
    return F.to_date(c.cast("string"), "yyyyMMdd")


def yesterday() -> Column:
    """Default date_id of a run: yesterday, UTC."""
    return date_id(F.date_sub(F.current_date(), 1))


def day_range(date: Column) -> tuple[Column, Column]:
    """Start (included) and end (excluded) of the day of a date_id."""
    day = date_of(date)
    return day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")


def in_day(ts: Column, date: Column) -> Column:
    start, end = day_range(date)
    return (ts >= start) & (ts < end)


def has_path(payload: Column, path: str) -> Column:
    """True if the path exists, even with a JSON null; a missing path is false."""
    return F.try_variant_get(payload, path, "variant").isNotNull()


def json_path(payload: Column, path: str) -> Column:
    """Text at a path of a VARIANT; JSON null and a missing path both give null."""
    return F.try_variant_get(payload, path, "string")


def dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def similarity_score(x: Column, y: Column) -> Column:
    """Score on the 0..2 scale: one plus cosine."""
    return 1 + cosine(x, y)


def item_id(workspace: Column, raw_content_id: Column, source_field: Column) -> Column:
    """Stable id of an item from its natural key."""
    return F.xxhash64(workspace, raw_content_id, F.coalesce(source_field, F.lit("")))


# JSON shapes of model callbacks and similarity answers.
KEYWORD_RESULT = "keywords ARRAY<ARRAY<STRING>>, error STRING, error_details STRING, error_code INT"
CALLBACK = (
    "body STRUCT<id: STRING, content_hash: STRING, callback_url: STRING, url: STRING, text: STRING, "
    "raw: STRUCT<content_item_id: BIGINT, target_state: STRING, workspace_id: STRING>, "
    "parameters: STRING, result: STRING>, model_name STRING, retry_count INT"
)
SIMILARITY_ANSWER = "result ARRAY<STRUCT<id: STRING, score: DOUBLE>>"


def parse_keywords(result: Column) -> Column:
    """``{"keywords": [[text, score], ...]}`` to an array of (keyword_text, keyword_score)."""
    return F.transform(
        F.from_json(result, KEYWORD_RESULT)["keywords"],
        lambda pair: F.struct(
            pair[0].alias("keyword_text"), pair[1].cast("double").alias("keyword_score")
        ),
    )


def parse_callback(c: Column) -> Column:
    """Model callback to a struct; ``is_error`` when the model reports a code above 200."""
    message = F.from_json(c, CALLBACK)
    body = message["body"]
    result = F.from_json(body["result"], KEYWORD_RESULT)
    return F.struct(
        message["model_name"].alias("model_name"),
        body["raw"]["workspace_id"].alias("workspace_id"),
        body["raw"]["content_item_id"].alias("content_item_id"),
        body["raw"]["target_state"].alias("target_state"),
        body["result"].alias("result"),
        F.coalesce(result["error_code"] > 200, F.lit(False)).alias("is_error"),
        result["error"].alias("error"),
        result["error_code"].alias("error_code"),
    )


def parse_similarity(c: Column) -> Column:
    """Similarity answer to an array of (id, score)."""
    return F.from_json(c, SIMILARITY_ANSWER)["result"]
