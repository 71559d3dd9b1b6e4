"""The content tables derived from the given parquet tables. Texts are taken whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import hashtags
from trendloom.operators.aggregates import recompute_clusters

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _minutes(expr: str) -> Column:
    return F.expr(f"timestampadd(MINUTE, {expr}, {EPOCH})")


def content_items(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as content items, with tags, urls and retweet marks added to the text."""
    d = F.col("doc_id")
    text = F.concat(
        F.when(d % 7 == 0, "RT @user: ").otherwise(""), F.col("text"), F.lit(" #"), F.col("source"),
        F.when(d % 3 == 0, F.concat(F.lit(" #"), F.col("lang"))).otherwise(""), F.lit(" #42"),
        F.when(d % 4 == 1, F.concat(F.lit(" https://t.co/a"), d.cast("string"))).otherwise(""),
    )
    url = (
        F.when(d % 4 == 0, F.concat(F.lit("https://t.me/c/"), d.cast("string")))
        .when(d % 4 == 1, F.concat(F.lit("https://twitter.com/x/"), d.cast("string")))
        .when(d % 4 == 2, F.concat(F.lit("https://www.youtube.com/watch?v="), d.cast("string")))
    )
    return table(spark, folder, "documents").select(
        d.alias("content_item_id"),
        d.alias("content_item_state_id"),
        F.concat(F.lit("ws"), (d % 3).cast("string")).alias("workspace_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("q"), (d % 5).cast("string")).alias("query_id"),
        (20240101 + d % 28).cast("int").alias("date_id"),
        _minutes("doc_id * 7").alias("raw_created_at"),
        F.concat(F.lit("d"), d.cast("string")).alias("raw_content_id"),
        F.when(d % 50 != 49, _minutes("doc_id * 37 % 40000")).alias("content_published_date"),
        url.alias("content_published_url"),
        text.alias("content"),
        F.when(d % 11 != 0, (d % 3) * 1000 + d % 37).alias("content_cluster_id"),
        F.col("lang").alias("content_language_code"),
        F.lit(None).cast("string").alias("source_field"),
    )


def item_states(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    state = (
        F.when(d % 8 == 0, "ready").when(d % 8 == 1, "failed").when(d % 8 == 2, "vectorized")
        .when(d % 8 == 3, "clustered").otherwise("completed")
    )
    start, end = _minutes("doc_id * 7 + 3"), _minutes("doc_id * 7 + 3 + doc_id % 5 - 2")
    return table(spark, folder, "documents").select(
        d.alias("state_id"),
        state.alias("current_state"),
        (d % 211).cast("int").alias("transition_num"),
        start.alias("transition_start"),
        end.alias("transition_end"),
        F.when(state.isin("failed", "completed"), end).alias("completed_timestamp"),
    )


def item_keywords(items: DataFrame) -> DataFrame:
    """Hashtag keywords with ids from item and position."""
    found = items.select(
        "workspace_id", "content_item_id", "content_published_date",
        F.posexplode(hashtags(F.col("content"))).alias("k", "keyword_text"),
    )
    return found.select(
        (F.col("content_item_id") * 10 + F.col("k")).alias("content_keyword_id"),
        "workspace_id", F.lit("hashtags").alias("keyword_model_name"), "content_item_id", "keyword_text",
        F.lit(1.0).alias("keyword_score"), "content_published_date",
    )


def item_clusters(items: DataFrame) -> DataFrame:
    """Clusters recounted from items, with a priority that follows the id."""
    return recompute_clusters(items).withColumn("priority_score", (F.col("content_cluster_id") % 7) / 10)


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return as_item_vectors(table(spark, folder, "embeddings"))


def as_item_vectors(embeddings: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return embeddings.select(
        v.alias("content_item_id"), F.concat(F.lit("ws"), (v % 3).cast("string")).alias("workspace_id"),
        F.col("embedding").alias("vector"),
    )


def state_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as state events of items; errors are starts, the others updates."""
    return as_state_events(table(spark, folder, "events"))


def as_state_events(events: DataFrame) -> DataFrame:
    to_state = (
        F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "view", "vectorized")
        .when(F.col("event_type") == "click", "clustered").when(F.col("event_type") == "purchase", "completed")
        .otherwise("failed")
    )
    return events.select(
        "event_id", F.col("user_id").alias("content_item_id"), F.col("ts").alias("event_ts"), to_state.alias("to_state"),
        F.when(F.col("event_type") == "error", "start").otherwise("update").alias("kind"),
    )


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as run states, one run per user."""
    to_state = (
        F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type").isin("view", "click"), "running")
        .when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    )
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("ts").alias("event_ts"), to_state.alias("to_state"),
    )


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as raw records with a nested JSON payload, as the API delivers them."""
    d = F.col("doc_id")
    fields = F.struct(
        F.col("text").alias("all_text"),
        F.col("text").alias("description"),
        F.when(d % 3 == 0, "null").otherwise(F.concat(F.lit("title "), F.col("source"))).alias("post_title"),
        F.when(d % 2 == 0, " ").otherwise(F.col("lang")).alias("transcript_text"),
        F.concat(F.lit("https://t.me/c/"), d.cast("string")).alias("url"),
        F.when(d % 5 == 0, F.lit(None)).otherwise(F.col("lang")).alias("language_code"),
    )
    stamp = F.concat(F.date_format(_minutes("doc_id * 37 % 40000"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    attributes = F.struct(stamp.alias("published_at"), fields.alias("search_data_fields"))
    broken = F.struct(stamp.alias("published_at"))
    keep = {"ignoreNullFields": "false"}
    payload = F.when(
        d % 13 == 0, F.to_json(F.struct(d.cast("string").alias("id"), broken.alias("attributes")), keep)
    ).otherwise(F.to_json(F.struct(d.cast("string").alias("id"), attributes.alias("attributes")), keep))
    return _raw(spark, folder, payload, F.lit("junkipedia"))


def raw_tweets(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    keep = {"ignoreNullFields": "false"}
    stamp = F.concat(F.date_format(_minutes("doc_id * 37 % 40000"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    payload = F.to_json(F.struct(
        d.cast("string").alias("id"), F.col("text"), F.col("lang"), stamp.alias("created_at"),
        F.when(d % 4 == 0, "t").otherwise("f").alias("is_retweet"),
    ), keep)
    return _raw(spark, folder, payload, F.lit("tweets"))


def raw_tipline(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    stamp = F.date_format(_minutes("doc_id * 37 % 40000"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.when(d % 5 == 0, "video").when(d % 5 == 1, "audio").otherwise("text")
    full = F.to_json(F.struct(kind.alias("request_type"), F.col("text").alias("content"), stamp.alias("created_at")))
    broken = F.to_json(F.struct(kind.alias("request_type"), stamp.alias("created_at")))
    return _raw(spark, folder, F.when(d % 17 == 0, broken).otherwise(full), F.lit("tipline"))


def _raw(spark: SparkSession, folder: str, payload: Column, source: Column) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.lit("run0").alias("run_id"),
        F.concat(F.lit("ws"), (d % 3).cast("string")).alias("workspace_id"),
        source.alias("source_id"),
        F.concat(F.lit("q"), (d % 5).cast("string")).alias("query_id"),
        F.lit("0").alias("page_id"),
        F.date_format(_minutes("doc_id * 7"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        F.concat(F.lit("d"), d.cast("string")).alias("content_id"),
        payload.alias("content"),
        (20240101 + d % 28).cast("int").alias("date_id"),
    )


def api_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as landed API pages: one element per turn, at most 100 elements per page."""
    element = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role"), F.col("text"),
    )
    turns = table(spark, folder, "conversations").withColumn("page_no", F.floor(F.col("turn") / 100))
    pages = turns.groupBy("conv_id", "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", element.alias("e")))), lambda t: t["e"]).alias("data")
    )
    good = F.to_json(F.struct(F.col("data"), F.struct(F.lit(1).alias("n")).alias("meta"), F.struct(F.lit("x").alias("next")).alias("links")))
    bad = F.to_json(F.struct(F.array(F.lit("rate limit")).alias("errors")))
    return pages.select(
        (F.col("conv_id") * 1000 + F.col("page_no")).alias("page_id"), F.lit("ws0").alias("workspace_id"), F.lit("q0").alias("query_id"),
        F.when(F.col("conv_id") % 10 == 9, bad).otherwise(good).alias("page"),
    )


def callbacks(items: DataFrame) -> DataFrame:
    """Model callbacks for items: their hashtags as keyword answers, some as errors."""
    i = F.col("content_item_id")
    pairs = F.transform(hashtags(F.col("content")), lambda t: F.array(t, F.lit("0.5")))
    good = F.to_json(F.struct(pairs.alias("keywords")))
    bad = F.to_json(F.struct(F.lit("model failed").alias("error"), F.lit(500).alias("error_code")))
    raw = F.struct(i.alias("content_item_id"), F.lit("keyworded").alias("target_state"), F.col("workspace_id"))
    result = F.parse_json(F.when(i % 9 == 0, bad).otherwise(good))
    body = F.struct(F.concat(F.lit("item_"), i.cast("string")).alias("id"), raw.alias("raw"), result.alias("result"))
    message = F.struct(body.alias("body"), F.lit("keyphrases").alias("model_name"), F.lit(0).alias("retry_count"))
    return items.select("content_item_id", F.to_json(message).alias("message"))
