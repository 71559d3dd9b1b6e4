"""Landed files from outside: API pages, CSV exports, callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trendloom.functions.values import has_path, json_path, parse_callback, parse_keywords, parse_similarity
from trendloom.session import cut

# Column names of the two CSV exports.
TWEET_COLUMNS = [
    "author_id", "conversation_id", "created_at", "edit_history_tweet_ids", "id", "lang", "possibly_sensitive",
    "referenced_tweets", "text", "entities.urls", "public_metrics.impression_count", "public_metrics.like_count",
    "public_metrics.quote_count", "public_metrics.reply_count", "public_metrics.retweet_count", "entities.mentions",
    "attachments.media_keys", "in_reply_to_user_id", "entities.annotations", "entities.hashtags",
    "attachments.poll_ids", "geo.place_id", "clean_text", "cluster_id", "cluster_size", "is_retweet", "dataset",
    "covid_id", "covid_cat", "covid_prob",
]
TIPLINE_COLUMNS = [
    "id", "feed_id", "request_type", "content", "created_at", "updated_at", "request_id", "media_id", "medias_count",
    "requests_count", "last_submitted_at", "webhook_url", "last_called_webhook_at", "subscriptions_count",
    "fact_checked_by_count", "project_medias_count", "quote", "type", "file",
]
BAD_ROW_RATE = 0.1  # share of a file's rows


class TooManyBadRows(RuntimeError):
    """A CSV export with too many rows of the wrong width."""


def _opened(pages: DataFrame) -> DataFrame:
    p = F.try_parse_json("page")
    opened = pages.withColumn("p", p)
    reason = (
        F.when(F.col("p").isNull(), "page is not JSON")
        .when(has_path(F.col("p"), "$.errors"), "page reports errors")
        .when(~has_path(F.col("p"), "$.data") | ~has_path(F.col("p"), "$.links"), "page lacks data or links")
    )
    return opened.withColumn("rejected_reason", reason)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One raw item per element of a page's ``data``; ``pages`` has page_id, workspace_id, query_id, page."""
    good = _opened(pages).where(F.col("rejected_reason").isNull())
    elements = good.select(
        "workspace_id", "query_id", "page_id",
        F.posexplode(F.try_variant_get("p", "$.data", "array<variant>")).alias("position", "element"),
    )
    return elements.select(
        "workspace_id", "query_id", "page_id", "position",
        json_path(F.col("element"), "$.id").alias("content_id"),
        F.to_json("element").alias("content"),
    )


def rejected_pages(pages: DataFrame) -> DataFrame:
    return _opened(pages).where(F.col("rejected_reason").isNotNull()).drop("p")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text CSV with quoted line breaks, plus the ``file`` of each row.

    Rows of another width keep ``_corrupt_record``. A file with line breaks in cells cannot be split, so
    the rows are written once, and all that follows reads them in parallel.
    """
    fields = [StructField(c, StringType()) for c in [*columns, "_corrupt_record"]]
    rows = (
        spark.read.schema(StructType(fields))
        .options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return cut(rows.withColumn("file", F.input_file_name()))


def csv_bad_rows(rows: DataFrame) -> DataFrame:
    """Counts of all rows and of rows of the wrong width, per file."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_rows")
    )


def csv_quarantine(rows: DataFrame) -> DataFrame:
    """The rows of the wrong width as they stand in their files."""
    return rows.where(F.col("_corrupt_record").isNotNull()).select("file", F.col("_corrupt_record").alias("line"))


def csv_items(rows: DataFrame, workspace_id: str, source_id: str, query_id: str, run_id: str, id_column: str = "id", most_bad: float = BAD_ROW_RATE) -> DataFrame:
    """CSV rows of the right width as raw items with the row as JSON payload.

    The export is refused when bad rows make up the limit rate of a file, whatever its length; ``csv_quarantine`` has them.
    A row without id gets one made from its payload, so that it is the same when the export is read again.
    """
    over = csv_bad_rows(rows).where(F.col("bad_rows") >= F.col("total") * most_bad)
    refused = over.where(F.col("bad_rows") > 0).limit(1).collect()
    if refused:
        raise TooManyBadRows(str(refused[0].asDict()))
    columns = [c for c in rows.columns if c not in ("_corrupt_record", "file")]
    good = rows.where(F.col("_corrupt_record").isNull())
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return good.select(
        F.lit(run_id).alias("run_id"), F.lit(workspace_id).alias("workspace_id"), F.lit(source_id).alias("source_id"),
        F.lit(query_id).alias("query_id"), F.lit(None).cast("string").alias("page_id"),
        F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        F.coalesce(f"`{id_column}`", F.sha2(payload, 256)).alias("content_id"), payload.alias("content"),
    )


def read_tweet_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TWEET_COLUMNS)


def read_tipline_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TIPLINE_COLUMNS)


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON lines as ``message`` rows, and the lines that are not JSON."""
    return split_messages(spark.read.text(path).select(F.col("value").alias("message")))


def split_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``message`` rows that are JSON, and those that are not."""
    broken = F.try_parse_json("message").isNull()
    return lines.where(~broken), lines.where(broken)


def callback_rows(messages: DataFrame, column: str = "message") -> DataFrame:
    """Model callbacks opened; ``is_error`` rows change nothing downstream."""
    return messages.select(parse_callback(F.col(column)).alias("c")).select("c.*")


def callback_keyword_sets(callbacks: DataFrame) -> DataFrame:
    """Keyword sets of good callbacks, for ``attach_keywords``."""
    good = callbacks.where(~F.col("is_error"))
    return good.select(
        "workspace_id", "content_item_id", F.col("model_name").alias("keyword_model_name"),
        parse_keywords(F.col("result")).alias("keywords"), "target_state",
    )


def similarity_rows(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Similarity answers as (…, dst_id, score) rows."""
    others = [c for c in answers.columns if c != column]
    return answers.select(*others, F.inline(parse_similarity(F.col(column)))).withColumnRenamed("id", "dst_id")
