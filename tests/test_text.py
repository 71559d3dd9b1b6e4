import pytest
from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.functions import values as V

TAGS = {
    # a tag starts at the text's start or after white space
    "#north": ["#north"],
    "up#south": [],
    "(#west)": [],
    "a\t#east\u3000#日曜 b": ["#east", "#日曜"],
    # letters, digits and underscores, in their order, repeats kept
    "#b_1 #a #b_1": ["#b_1", "#a", "#b_1"],
    "#émile, #Ωmega.": ["#émile", "#Ωmega"],
    # digits alone, in any script, are no tag
    "#2024 #٢٠٢٤ #2024a": ["#2024a"],
    "# # ##": [],
    "": [],
}
CLEAN = {
    # references first, so that what they hide is cleaned as well
    "x &lt;y&gt; &amp; z": "x <y> & z",
    # mentions and addresses go, the blanks around them stay
    "ask @Nobody_9 now": "ask   now",
    "see https://host.example/p?q=1#f and go": "see   and go",
    # a repost mark at the start
    "RT: again": "again",
    "start RT: kept": "start RT: kept",
    # nothing left
    " \n\t ": "",
    "@only": "",
    # plain text of any script
    "ночь и день": "ночь и день",
    "สวัสดี": "สวัสดี",
}


def _apply(spark, cases, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i INT, t STRING")
    got = {r["i"]: r["o"] for r in rows.select("i", fn(F.col("t")).alias("o")).collect()}
    return [got[i] for i in range(len(cases))]


def test_hashtags(spark):
    assert _apply(spark, list(TAGS), T.hashtags) == list(TAGS.values())


def test_clean_text(spark):
    assert _apply(spark, list(CLEAN), T.clean_text) == list(CLEAN.values())


def test_null_text(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS t").select(
        T.clean_text(F.col("t")).alias("c"), T.hashtags(F.col("t")).alias("h"), T.is_blank(F.col("t")).alias("b")
    ).first()
    assert (row["c"], row["h"], row["b"]) == (None, None, True)


def test_text_transform(spark):
    assert _apply(spark, ["ab", None], T.text_transform(str.upper)) == ["AB", None]


@pytest.mark.parametrize("url,name", [
    ("https://t.me/x", "telegram"), ("https://twitter.com/x", "twitter"), ("https://www.youtube.com/w", "youtube"),
    ("https://www.instagram.com/p", "instagram"), ("https://www.tiktok.com", "tiktok"),
    ("https://www.facebook.com", "facebook"), ("https://x.example", "unknown"), (None, None),
])
def test_platform(spark, url, name):
    assert spark.createDataFrame([(url,)], "u STRING").select(T.platform(F.col("u"))).first()[0] == name


def test_timestamps(spark):
    cases = ["2023-06-09T10:45:34.123Z", "2023-06-09 10:45:34.715998", "2023-06-09T10:45:34", "junk", None]
    got = [str(v) if v else None for v in _apply(spark, cases, V.parse_ts)]
    assert got == ["2023-06-09 10:45:34.123000", "2023-06-09 10:45:34.715998", "2023-06-09 10:45:34", None, None]


def test_json_null_missing_and_text_null(spark):
    rows = spark.createDataFrame([('{"a": null}',), ('{}',), ('{"a": "null"}',)], "c STRING")
    p = F.parse_json("c")
    got = rows.select(V.has_path(p, "$.a"), V.json_path(p, "$.a"), T.is_blank(V.json_path(p, "$.a"))).collect()
    assert [tuple(r) for r in got] == [(True, None, True), (False, None, True), (True, "null", True)]


def test_callbacks(spark):
    good = ('{"body": {"id": "i_1", "raw": {"content_item_id": 1, "target_state": "ready", "workspace_id": "w"}, '
            '"result": {"keywords": [["a phrase", 0.002], ["b", 0.04]]}}, "model_name": "m", "retry_count": 0}')
    bad = good.replace('{"keywords": [["a phrase", 0.002], ["b", 0.04]]}', '{"error": "no", "error_code": 500}')
    rows = spark.createDataFrame([(good,), (bad,)], "m STRING").select(V.parse_callback(F.col("m")).alias("c")).select("c.*")
    first, second = rows.select("is_error", "content_item_id", V.parse_keywords(F.col("result")).alias("k"), "error_code").collect()
    assert [tuple(k) for k in first["k"]] == [("a phrase", 0.002), ("b", 0.04)]
    assert (first["is_error"], second["is_error"], second["error_code"]) == (False, True, 500)


def test_similarity_answer(spark):
    answer = '{"result": [{"id": "2", "score": 2.0, "_source": {"x": 1}}, {"id": "1", "score": 1.9}]}'
    got = spark.createDataFrame([(answer,)], "a STRING").select(F.inline(V.parse_similarity(F.col("a")))).collect()
    assert [tuple(r) for r in got] == [("2", 2.0), ("1", 1.9)]
