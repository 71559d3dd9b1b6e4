"""Raw JSON records to content items.

A record that lacks a needed key, has an unreadable date or is not JSON at all gives exactly one failed
row: its payload as ``raw_content``, an empty ``content`` and a ``failed_reason``. A key that is present
but blank gives no row for that field.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.functions.batches import plain
from trendloom.functions.text import is_blank
from trendloom.functions.values import has_path, item_id, json_path, parse_ts

# Accepted sources, JSON paths and marks of the payload shapes.
POST_SOURCES = ["junkipedia", "faker_testing"]
POST_FIELDS = "$.attributes.search_data_fields"
POST_PUBLISHED = "$.attributes.published_at"
MULTI_FIELDS = ["description", "post_title", "transcript_text"]
TWEET_URL = "https://twitter.com/twitter/status/"

ITEM_COLUMNS = [
    "run_id", "workspace_id", "source_id", "query_id", "date_id", "raw_created_at", "raw_content_id", "raw_content",
    "content_item_id", "content_published_date", "content_published_url", "content", "content_language_code",
    "source_field", "failed_reason",
]


def accepted_sources(raw: DataFrame, sources: list[str]) -> DataFrame:
    """Fail the job on the first record of another source."""
    refused = F.raise_error(F.concat(F.lit("source not accepted: "), F.coalesce("source_id", F.lit("null"))))
    known = F.coalesce(F.col("source_id").isin(sources), F.lit(False))
    return raw.withColumn("source_id", F.when(known, F.col("source_id")).otherwise(refused))


def _open(raw: DataFrame, paths: list[str]) -> DataFrame:
    """Parse the payload once and note the first needed path that is missing."""
    opened = raw.withColumn("payload", F.try_parse_json("content"))
    missing = F.when(F.col("payload").isNull(), F.lit("payload is not JSON"))
    for path in paths:
        missing = missing.when(~has_path(F.col("payload"), path), F.lit(f"missing {path}"))
    return opened.withColumn("failed_reason", missing)


def _finish(df: DataFrame) -> DataFrame:
    """Rows with ``text``, ``published``, ``url``, ``language``, ``source_field``, ``failed_published`` to items.

    This is the one failed-row builder: no extractor writes failed rows of its own.
    """
    failed = F.col("failed_reason").isNotNull()
    nothing = F.lit(None).cast("string")
    field = F.when(~failed, F.col("source_field"))
    return df.select(
        "run_id", "workspace_id", "source_id", "query_id", "date_id",
        parse_ts(F.col("created_at")).alias("raw_created_at"),
        F.col("content_id").alias("raw_content_id"),
        F.when(failed, F.col("content")).otherwise(F.col("text")).alias("raw_content"),
        item_id(F.col("workspace_id"), F.col("content_id"), field).alias("content_item_id"),
        F.when(failed, F.col("failed_published")).otherwise(F.col("published")).alias("content_published_date"),
        F.when(failed, nothing).otherwise(F.col("url")).alias("content_published_url"),
        content_default(F.when(failed, F.lit("")), F.col("text")).alias("content"),
        F.when(failed, nothing).otherwise(F.col("language")).alias("content_language_code"),
        field.alias("source_field"),
        "failed_reason",
    )


def content_default(given: Column, raw_content: Column) -> Column:
    """Content falls back to the raw text when it is null; '' stays."""
    return F.coalesce(given, raw_content)


def _bad_date(reason: Column, published: Column, source: Column) -> Column:
    """A date that is present but unreadable fails the row."""
    return F.coalesce(reason, F.when(source.isNotNull() & published.isNull(), F.lit("unreadable date")))


def extract_default(raw: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One item per record from its ``all_text``; records of the test source carry title and created_at."""
    raw = accepted_sources(raw, sources or POST_SOURCES)
    test = F.col("source_id") == "faker_testing"
    opened = raw.withColumn("payload", F.try_parse_json("content"))
    p = F.col("payload")
    needed = [
        (~test, [POST_PUBLISHED, f"{POST_FIELDS}.all_text", f"{POST_FIELDS}.url"]),
        (test, ["$.title"]),
    ]
    reason = F.when(p.isNull(), F.lit("payload is not JSON"))
    for rows, paths in needed:
        for path in paths:
            reason = reason.when(rows & ~has_path(p, path), F.lit(f"missing {path}"))
    stamp = F.when(test, F.col("created_at")).otherwise(json_path(p, POST_PUBLISHED))
    shaped = opened.withColumns({
        "text": F.when(test, json_path(p, "$.title")).otherwise(json_path(p, f"{POST_FIELDS}.all_text")),
        "published": parse_ts(stamp),
        "url": json_path(p, f"{POST_FIELDS}.url"),
        "language": F.lit(None).cast("string"),
        "source_field": F.lit(None).cast("string"),
        "failed_published": F.lit(None).cast("timestamp_ntz"),
        "failed_reason": _bad_date(reason, parse_ts(stamp), stamp),
    })
    return _finish(shaped)


def extract_multi_field(raw: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Up to three items per record, one for each text field that is not blank, in field order."""
    raw = accepted_sources(raw, sources or POST_SOURCES[:1])
    paths = [POST_PUBLISHED] + [f"{POST_FIELDS}.{f}" for f in [*MULTI_FIELDS, "url", "language_code"]]
    opened = _open(raw, paths)
    p = F.col("payload")
    stamp = json_path(p, POST_PUBLISHED)
    language = json_path(p, f"{POST_FIELDS}.language_code")
    opened = opened.withColumn("failed_reason", _bad_date(F.col("failed_reason"), parse_ts(stamp), stamp))
    found = F.array(*[
        F.struct(F.lit(name).alias("name"), json_path(p, f"{POST_FIELDS}.{name}").alias("text"))
        for name in MULTI_FIELDS
    ])
    kept = F.filter(
        found,
        lambda f: ~is_blank(f["text"]) & ~((f["name"] == "transcript_text") & (f["text"] == " ")),
    )
    failed_one = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text")))
    rows = opened.withColumn("field", F.explode(F.when(F.col("failed_reason").isNotNull(), failed_one).otherwise(kept)))
    shaped = rows.withColumns({
        "text": F.col("field.text"),
        "source_field": F.col("field.name"),
        "published": parse_ts(stamp),
        "url": json_path(p, f"{POST_FIELDS}.url"),
        "language": F.when(~is_blank(language), language),
        "failed_published": F.lit(None).cast("timestamp_ntz"),
    })
    return _finish(shaped)


def extract_tweets(raw: DataFrame) -> DataFrame:
    """One item per tweet that is not a retweet; failed rows keep the raw creation time."""
    opened = _open(raw, ["$.is_retweet", "$.created_at", "$.text", "$.id", "$.lang"])
    p = F.col("payload")
    original = ~F.coalesce(json_path(p, "$.is_retweet") == "t", F.lit(False))
    stamp = json_path(p, "$.created_at")
    shaped = opened.where(original).withColumns({
        "text": json_path(p, "$.text"),
        "published": parse_ts(stamp),
        "url": F.concat(F.lit(TWEET_URL), json_path(p, "$.id")),
        "language": json_path(p, "$.lang"),
        "source_field": F.lit(None).cast("string"),
        "failed_published": parse_ts(F.col("created_at")),
        "failed_reason": _bad_date(F.col("failed_reason"), parse_ts(stamp), stamp),
    })
    return _finish(shaped)


def extract_tipline(raw: DataFrame) -> DataFrame:
    """One item per text request; audio and video requests give none."""
    opened = _open(raw, ["$.request_type", "$.created_at", "$.content"])
    p = F.col("payload")
    kind = json_path(p, "$.request_type")
    is_text = F.coalesce(kind == "text", ~has_path(p, "$.request_type"), F.lit(True))
    stamp = json_path(p, "$.created_at")
    shaped = opened.where(is_text).withColumns({
        "text": json_path(p, "$.content"),
        "published": parse_ts(stamp),
        "url": F.lit(None).cast("string"),
        "language": F.lit(None).cast("string"),
        "source_field": F.lit(None).cast("string"),
        "failed_published": parse_ts(F.col("created_at")),
        "failed_reason": _bad_date(F.col("failed_reason"), parse_ts(stamp), stamp),
    })
    return _finish(shaped)


def custom_extractor(fn: Callable[[dict], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """An extractor from a user's function of one payload, for shapes that paths cannot express.

    ``fn`` gives 0..n dicts with text and, where known, published, url, language, source_field. A missing
    key in the payload (KeyError) or a payload that is not JSON gives the failed row.
    """
    fields = ["text", "published", "url", "language", "source_field"]

    def run(batches):
        for frame in batches:
            rows = []
            for at, payload in zip(frame.index, frame["content"]):
                try:
                    found = [(at, *(one.get(f) for f in fields), None) for one in fn(json.loads(payload))]
                except (KeyError, ValueError, TypeError) as e:
                    found = [(at, *([None] * len(fields)), f"{type(e).__name__} {e}")]
                rows.extend(found)
            made = pd.DataFrame(rows, columns=["at", *fields, "failed_reason"])
            yield plain(frame.join(made.set_index("at"), how="inner"))

    def extractor(raw: DataFrame) -> DataFrame:
        kept = ["run_id", "workspace_id", "source_id", "query_id", "date_id", "created_at", "content_id", "content"]
        shape = ", ".join(f"{c} {'INT' if c == 'date_id' else 'STRING'}" for c in [*kept, *fields, "failed_reason"])
        made = raw.select(*kept).mapInPandas(run, shape)
        stamp = F.col("published")
        return _finish(made.withColumns({
            "published": parse_ts(stamp),
            "failed_published": F.lit(None).cast("timestamp_ntz"),
            "failed_reason": _bad_date(F.col("failed_reason"), parse_ts(stamp), stamp),
        }))

    return extractor


def table_extractor(fn: Callable[[dict], Iterator[dict]]) -> Callable[[DataFrame], DataFrame]:
    """As ``custom_extractor``, by a Python table function that is called laterally on every payload.

    Items leave the function one by one, so a payload with very many is never held as a list. A payload that fails on the way
    gives its items up to there and the failed row.
    """
    fields = ["text", "published", "url", "language", "source_field"]

    class Items:
        def eval(self, content: str):
            try:
                for one in fn(json.loads(content)):
                    yield (*(one.get(f) for f in fields), None)
            except (KeyError, ValueError, TypeError) as e:
                yield (*([None] * len(fields)), f"{type(e).__name__} {e}")

    table = F.udtf(Items, returnType=", ".join(f"{f} STRING" for f in [*fields, "failed_reason"]))

    def extractor(raw: DataFrame) -> DataFrame:
        kept = ["run_id", "workspace_id", "source_id", "query_id", "date_id", "created_at", "content_id", "content"]
        made = raw.select(*kept).lateralJoin(table(F.col("content").outer()))
        stamp = F.col("published")
        return _finish(made.withColumns({
            "published": parse_ts(stamp),
            "failed_published": F.lit(None).cast("timestamp_ntz"),
            "failed_reason": _bad_date(F.col("failed_reason"), parse_ts(stamp), stamp),
        }))

    return extractor


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "default": extract_default,
    "social": extract_multi_field,
    "classify": extract_multi_field,
    "tweets": extract_tweets,
    "tipline": extract_tipline,
}


def ingest_status(items: DataFrame) -> DataFrame:
    """State after import: an empty content is failed, anything else ready."""
    state = F.when(F.coalesce(F.col("content"), F.lit("")) == "", "failed").otherwise("ready")
    return items.withColumn("current_state", state)


def same_workspace(items: DataFrame, workspace_id: str) -> DataFrame:
    """Fail the job on a row of another workspace."""
    wrong = F.raise_error(F.concat(F.lit("row of workspace "), F.coalesce("workspace_id", F.lit("null"))))
    ok = F.coalesce(F.col("workspace_id") == workspace_id, F.lit(False))
    return items.withColumn("workspace_id", F.when(ok, F.col("workspace_id")).otherwise(wrong))


def serialize_rows(df: DataFrame, name: str = "row_json") -> DataFrame:
    """Each row as JSON with ISO timestamps and nulls kept."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(name))


def deserialize_rows(df: DataFrame, schema: str, name: str = "row_json") -> DataFrame:
    """Back from JSON; a field that the schema does not know fails the job."""
    known = StructType.fromDDL(schema).fieldNames()
    unknown = F.array_except(F.json_object_keys(name), F.array(*[F.lit(k) for k in known]))
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    parsed = F.when(F.size(unknown) == 0, F.from_json(F.col(name), schema, options)).otherwise(
        F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ",")))
    )
    return df.select(parsed.alias("r")).select("r.*")
