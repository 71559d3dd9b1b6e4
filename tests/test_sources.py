import json

import pytest
from pyspark.sql import functions as F

from trendloom.operators import extract
from trendloom.plans import adapters
from trendloom.session import work_folder
from trendloom.sources import landed, raw_store, snapshots, tables

FOLDER = "/root/testdata/sf0.001"


def test_raw_store(spark):
    path = work_folder(spark)
    posts = adapters.raw_posts(spark, FOLDER)
    raw_store.append_raw(posts, path)
    raw_store.append_raw(posts.withColumn("source_id", F.lit("junkipedia_two")), path)
    one = raw_store.read_raw(spark, path, [20240105], "ws1", "junkipedia")
    assert {r["source_id"] for r in one.collect()} == {"junkipedia"}
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and "date_id" in one._jdf.queryExecution().toString()
    before = raw_store.good_rows(raw_store.read_raw(spark, path)).count()
    assert before == 2 * posts.count()
    assert raw_store.delete_partition(spark, path, 20240105, "ws1", "junkipedia")
    assert not raw_store.delete_partition(spark, path, 20240105, "ws1", "junkipedia")
    assert raw_store.read_raw(spark, path, [20240105], "ws1", "junkipedia").count() == 0
    with pytest.raises(ValueError):
        raw_store.append_raw(posts.drop("content"), path)


def test_malformed_lines_go_to_quarantine(spark):
    path = work_folder(spark)
    good = json.dumps({"run_id": "r", "content_id": "c", "content": {"a": [1, {"b": None}]}})
    spark.createDataFrame([(good,), ("{broken",)], "value STRING").write.text(f"{path}/date_id=20240101/workspace_id=w/source_id=s")
    raw = raw_store.read_raw(spark, path)
    assert [json.loads(r["content"]) for r in raw_store.good_rows(raw).collect()] == [{"a": [1, {"b": None}]}]
    assert raw_store.quarantine(raw).collect()[0]["_corrupt_record"] == "{broken"
    with pytest.raises(Exception):
        raw_store.read_raw(spark, path, strict=True).collect()


def test_external_table(spark):
    path = work_folder(spark)
    raw_store.append_raw(adapters.raw_tweets(spark, FOLDER), path)
    name = f"ext_{path.rsplit('/', 1)[1]}"
    table = raw_store.external_table(spark, name, path)
    assert table.where("date_id = 20240102").count() == adapters.raw_tweets(spark, FOLDER).where("date_id = 20240102").count()
    spark.sql(f"DROP TABLE {name}")


def _csv(spark, lines):
    path = work_folder(spark)
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.text(path)
    return path


def test_csv_rows(spark):
    head = ",".join(landed.TIPLINE_COLUMNS)
    width = len(landed.TIPLINE_COLUMNS)

    def row(i, kind, text):
        cells = ["x"] * width
        cells[0], cells[2], cells[3], cells[4] = str(i), kind, text, "2024-01-01 00:00:00"
        return ",".join(cells)

    path = _csv(spark, [head, row(1, "text", '"two\nlines, ""quoted"""'), "", "short,row", row(2, "audio", "x"), row(3, "text", "plain") + ",extra"])
    rows = landed.read_tipline_csv(spark, path)
    assert landed.csv_bad_rows(rows).agg(F.sum("total"), F.sum("bad_rows")).first() == (4, 2)
    assert sorted(r.line for r in landed.csv_quarantine(rows).collect())[-1] == "short,row"
    items = extract.extract_tipline(landed.csv_items(rows, "w", "s", "q", "r", most_bad=0.9).withColumn("date_id", F.lit(1)))
    assert [(r["raw_content_id"], r["content"]) for r in items.collect()] == [("1", 'two\nlines, "quoted"')]


def test_csv_with_many_bad_rows_is_refused(spark):
    path = _csv(spark, [",".join(landed.TWEET_COLUMNS)] + ["bad,row"] * 150 + [",".join(["x"] * 30)] * 300)
    with pytest.raises(landed.TooManyBadRows):
        landed.csv_items(landed.read_tweet_csv(spark, path), "w", "s", "q", "r")


def test_a_short_csv_of_bad_rows_is_refused_and_kept(spark):
    rows = landed.read_tweet_csv(spark, _csv(spark, [",".join(landed.TWEET_COLUMNS)] + ["bad,row"] * 90 + [",".join(["x"] * 30)]))
    with pytest.raises(landed.TooManyBadRows):
        landed.csv_items(rows, "w", "s", "q", "r")
    assert landed.csv_quarantine(rows).count() == 90


def test_csv_rows_without_id_keep_theirs_when_read_again(spark):
    path = _csv(spark, [",".join(landed.TWEET_COLUMNS), ",".join(["y"] * 4 + [""] + ["y"] * 25)])
    first, second = (landed.csv_items(landed.read_tweet_csv(spark, path), "w", "s", "q", "r").first().content_id for _ in range(2))
    assert first == second is not None


def test_pages(spark):
    pages = [json.dumps({"data": [{"id": "a", "x": {"y": 1}}, {"id": "b"}], "meta": {}, "links": {}}), json.dumps({"errors": ["no"]}),
             json.dumps({"data": []}), "junk", json.dumps({"data": [], "links": {}})]
    df = spark.createDataFrame([(i, "w", "q", p) for i, p in enumerate(pages)], "page_id INT, workspace_id STRING, query_id STRING, page STRING")
    assert [(r["page_id"], r["content_id"], r["content"]) for r in landed.flatten_pages(df).orderBy("position").collect()] == [
        (0, "a", '{"id":"a","x":{"y":1}}'), (0, "b", '{"id":"b"}')]
    assert {(r["page_id"], r["rejected_reason"]) for r in landed.rejected_pages(df).collect()} == {
        (1, "page reports errors"), (2, "page lacks data or links"), (3, "page is not JSON")}


def test_snapshots(spark):
    root = work_folder(spark)
    shape = "content_item_id BIGINT, v STRING"

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), shape)

    def now():
        return sorted(tuple(r) for r in snapshots.read_snapshot(spark, root, shape).collect())

    assert now() == []
    snapshots.commit_changes(rows((1, "a"), (2, "b")), root, batch_id="one")
    snapshots.commit_changes(rows((1, "again")), root, batch_id="one")
    assert now() == [(1, "a"), (2, "b")]
    snapshots.commit_changes(rows((1, "new"), (3, "c")), root, rows((1, "")).select("content_item_id"))
    assert now() == [(1, "new"), (2, "b"), (3, "c")]
    snapshots.compact(spark, root)
    assert now() == [(1, "new"), (2, "b"), (3, "c")]
    snapshots.commit_snapshot(rows((9, "z")), root)
    assert now() == [(9, "z")]


def test_bucketed_tables_join_without_shuffle(spark):
    items, states = adapters.content_items(spark, FOLDER), adapters.item_states(spark, FOLDER)
    root = work_folder(spark)
    tag = root.rsplit("/", 1)[1]
    a = tables.save_bucketed(items, f"items_{tag}", "content_item_state_id", 4, f"{root}/a")
    b = tables.save_bucketed(states, f"states_{tag}", "state_id", 4, f"{root}/b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, a.content_item_state_id == b.state_id)
        assert joined.count() == items.count()
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_messages(spark):
    path = work_folder(spark)
    spark.createDataFrame([('{"a": 1}',), ("{no",)], "value STRING").write.text(path)
    good, broken = landed.read_messages(spark, path)
    assert (good.count(), broken.first()["message"]) == (1, "{no")
