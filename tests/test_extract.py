import json

import pytest
from pyspark.sql import functions as F

from trendloom.operators import extract, filters, maintenance
from trendloom.schema import RAW_ITEM


def raw(spark, payloads, source="junkipedia"):
    rows = [("r", "w", source, "q", "0", "2024-01-02 03:04:05.000006", f"c{i}", p if isinstance(p, str) else json.dumps(p, ensure_ascii=False))
            for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RAW_ITEM).withColumn("date_id", F.lit(20240102))


def post(published="2024-01-01T10:00:00.000Z", **fields):
    base = {"description": "a text", "post_title": "A title", "transcript_text": "spoken", "url": "https://t.me/1",
            "language_code": "en", "all_text": "all"}
    base.update(fields)
    return {"id": "1", "attributes": {"published_at": published, "search_data_fields": {k: v for k, v in base.items() if v != "DROP"}}}


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_multi_field_rules(spark):
    got = extract.extract_multi_field(raw(spark, [
        post(), post(post_title="null", transcript_text=" "), post(description=None, post_title="", transcript_text="null"),
        post(description=" "), post(url="DROP"), post(published="soon"), "not json", post(language_code="null", post_title="", transcript_text=None),
    ]))
    rows = rows_of(got, "raw_content_id", F.coalesce("source_field", F.lit("-")), "content", F.col("failed_reason").isNotNull())
    assert rows == sorted([
        ("c0", "description", "a text", False), ("c0", "post_title", "A title", False), ("c0", "transcript_text", "spoken", False),
        ("c1", "description", "a text", False),
        ("c3", "description", " ", False), ("c3", "post_title", "A title", False), ("c3", "transcript_text", "spoken", False),
        ("c4", "-", "", True), ("c5", "-", "", True), ("c6", "-", "", True), ("c7", "description", "a text", False),
    ])
    assert got.where("raw_content_id = 'c7'").first()["content_language_code"] is None
    assert got.where("raw_content_id = 'c6'").first()["raw_content"] == "not json"


def test_default_missing_key_gives_one_failed_row(spark):
    got = extract.ingest_status(extract.extract_default(raw(spark, [post(), post(all_text="DROP"), post(all_text=None)])))
    assert rows_of(got, "raw_content_id", F.coalesce("content", F.lit("<null>")), "current_state") == [
        ("c0", "all", "ready"), ("c1", "", "failed"), ("c2", "<null>", "failed")]


def test_test_source_uses_title(spark):
    got = extract.extract_default(raw(spark, [{"title": "made up"}], "faker_testing")).first()
    assert (got["content"], str(got["content_published_date"])) == ("made up", "2024-01-02 03:04:05.000006")


def test_unknown_source_is_refused(spark):
    with pytest.raises(Exception, match="source not accepted"):
        extract.extract_default(raw(spark, [post()], "other")).collect()


def test_tweets(spark):
    tweet = {"id": "9", "text": "hi", "lang": "en", "created_at": "2024-01-01T00:00:00", "is_retweet": "f"}
    got = extract.extract_tweets(raw(spark, [tweet, {**tweet, "is_retweet": "t"}, {k: v for k, v in tweet.items() if k != "lang"}], "t"))
    assert rows_of(got, "raw_content_id", "content", F.coalesce("content_published_url", F.lit("")), F.col("content_published_date").cast("string")) == [
        ("c0", "hi", "https://twitter.com/twitter/status/9", "2024-01-01 00:00:00"),
        ("c2", "", "", "2024-01-02 03:04:05.000006")]


def test_tipline(spark):
    row = {"request_type": "text", "content": "ask", "created_at": "2024-01-01T00:00:00"}
    got = extract.extract_tipline(raw(spark, [row, {**row, "request_type": "video"}, {"request_type": "text", "created_at": "x"}, {}], "t"))
    assert rows_of(got, "raw_content_id", "content") == [("c0", "ask"), ("c2", ""), ("c3", "")]


def test_custom_extractor(spark):
    def split(payload):
        return [{"text": t, "source_field": f"part{i}"} for i, t in enumerate(payload["parts"])]

    got = extract.custom_extractor(split)(raw(spark, [{"parts": ["x", "y"]}, {"parts": []}, {}, "junk"], "any"))
    assert rows_of(got, "raw_content_id", F.coalesce("source_field", F.lit("-")), "content") == [
        ("c0", "part0", "x"), ("c0", "part1", "y"), ("c2", "-", ""), ("c3", "-", "")]


def test_workspace_check(spark):
    items = extract.extract_default(raw(spark, [post()]))
    assert extract.same_workspace(items, "w").count() == 1
    with pytest.raises(Exception, match="row of workspace w"):
        extract.same_workspace(items, "v").collect()


def test_row_json_keeps_nulls_and_refuses_unknown(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ'2024-01-01 00:00:00.5' AS t")
    text = extract.serialize_rows(df)
    assert json.loads(text.first()[0]) == {"a": 1, "b": None, "t": "2024-01-01T00:00:00.500000"}
    assert extract.deserialize_rows(text, "a INT, b STRING, t TIMESTAMP_NTZ").collect() == df.collect()
    with pytest.raises(Exception, match="unknown fields"):
        extract.deserialize_rows(text, "a INT, b STRING").collect()


def test_reload_sequence(spark):
    """Blank first, then fixed, then ignored, then forced."""
    shape = "content_item_id BIGINT, workspace_id STRING, raw_content_id STRING, source_field STRING, current_state STRING, content STRING"

    def one(i, state, content):
        return spark.createDataFrame([(i, "w", "k", None, state, content, i)], shape + ", arrival BIGINT")

    items = spark.createDataFrame([], shape)
    for step, state, text, force, want in [
        (1, "failed", "", False, ""), (2, "ready", "fixed", False, "fixed"), (3, "ready", "late", False, "fixed"), (4, "ready", "forced", True, "forced"),
    ]:
        items = maintenance.upsert_items(items, one(step, state, text), force)
        assert [r["content"] for r in items.collect()] == [want]


def test_a_missing_value_stops_the_job(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n INT, c STRING")
    filters.check_non_null(rows, "n")
    with pytest.raises(ValueError, match="1 rows without c"):
        filters.check_non_null(rows, "c")
