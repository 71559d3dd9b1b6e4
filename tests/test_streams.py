import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendloom import schema
from trendloom.operators import extract, similarity, state
from trendloom.plans import adapters, workflow
from trendloom.session import path_exists, work_folder
from trendloom.sources import raw_store, snapshots
from trendloom.streaming import ingest, models, states
from tests.test_clusters import brute_pairs, clustered_points, union_find, vectors_of
from tests.test_extract import post, raw

FOLDER = "/root/testdata/sf0.001"


def test_state_stream_over_many_batches_equals_the_batch_fold(spark):
    path, out, checkpoint, effects = (work_folder(spark) for _ in range(4))
    events = adapters.state_events(spark, FOLDER)
    events.repartitionByRange(4, "event_ts", "event_id").sortWithinPartitions("event_ts", "event_id").write.parquet(path)
    graph = schema.model_graph("default")
    for step in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(path)
        states.state_stream(stream, graph, effects, out, checkpoint, max_files=10).awaitTermination()
    assert spark.read.parquet(f"{effects}/batch=*").groupBy("content_item_id", "batch_id").count().where("count > 1").isEmpty()
    rows = spark.read.parquet(f"{out}/batch=*")
    last = {r["content_item_id"]: r["s"] for r in rows.groupBy("content_item_id").agg(F.max_by("current_state", "batch_id").alias("s")).collect()}
    assert last == {r["content_item_id"]: r["current_state"] for r in state.apply_events(events, graph).collect()}


class Clock:
    """A state store, its timers and a clock that is set by hand, for one item."""

    def __init__(self):
        self.now, self.timers, self.held = 0, set(), None

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.held is not None
    get = lambda self: self.held
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.remove(at)
    listTimers = lambda self: iter([(t,) for t in sorted(self.timers)])
    getCurrentProcessingTimeInMs = lambda self: self.now

    def update(self, value):
        self.held = value


@pytest.mark.parametrize(("first", "seconds"), [("ready", 10), ("hashtaged", 120)])
def test_timers_give_items_in_flight_back(first, seconds):
    names, clock = ["hashtaged", "ready", "undefined"], Clock()
    processor = states.ItemStateProcessor(names, "undefined", {"hashtaged": 120}, 10)
    processor.init(clock)
    stay = [{"state": i, "end_ts": None, "completed_ts": None} for i in range(3)]
    go = lambda to, at: [{"state": names.index(to), "end_ts": pd.Timestamp(at), "completed_ts": None} for _ in names]

    def feed(batch, effect, starts=0, started=None):
        rows = pd.DataFrame({"batch_id": [batch], "starts": [starts], "started": [pd.Timestamp(started)], "effect": [effect]})
        return pd.concat(list(processor.handleInputRows((7,), iter([rows]), clock))).to_dict("records")[0]

    def step(ms):
        clock.now += ms
        out = []
        for at in [t for t in sorted(clock.timers) if t <= clock.now]:
            clock.timers.discard(at)
            out += [r for f in processor.handleExpiredTimer((7,), clock, None) for r in f.to_dict("records")]
        return out

    assert feed(0, go(first, "2024-01-01 00:00:00"))["current_state"] == first and not clock.timers
    feed(1, stay, 1, "2024-01-01 00:00:05")
    assert step(1000 * seconds - 1) == []
    assert [(r["given_back"], r["current_state"], r["transition_num"]) for r in step(1)] == [(True, first, 1)]
    feed(2, stay, 1, "2024-01-01 00:10:00")  # tried again, and answered in time
    step(5000)
    assert feed(3, go(first, "2024-01-01 00:10:04"))["given_back"] is False
    assert not clock.timers and step(500_000) == []
    feed(4, stay, 1, "2024-01-01 00:20:00")  # a second start replaces the timer of the first
    step(1000 * seconds - 1)
    feed(5, stay, 1, "2024-01-01 00:20:09")
    assert step(1) == [] and len(step(1000 * seconds)) == 1
    assert feed(5, go("ready", "2024-01-01 00:30:00"), 9, "2024-01-01")["transition_num"] == 4  # a batch written again


def test_timers_run_in_a_stream(spark):
    path, effects, out, checkpoint = (work_folder(spark) for _ in range(4))
    rows = [(1, 1, "2024-01-01 00:00:00", "update", "ready"), (1, 2, "2024-01-01 00:00:01", "start", None),
            (2, 3, "2024-01-01 00:00:00", "start", None), (2, 4, "2024-01-01 00:00:01", "update", "ready")]
    events = spark.createDataFrame(rows, "content_item_id BIGINT, event_id BIGINT, event_ts STRING, kind STRING, to_state STRING")
    events.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")).coalesce(1).write.parquet(path)
    graph = schema.model_graph("default")
    shape = spark.read.parquet(path).schema
    states.effect_stream(spark.readStream.schema(shape).parquet(path), graph, effects, f"{checkpoint}/e").awaitTermination()
    timed = states.reduce_stream(states.read_effects(spark, effects), graph, timeouts={}, default=1)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    query = timed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/s").trigger(processingTime="1 second").start()
    back, until = [], time.time() + 90
    try:
        while not back and time.time() < until and query.isActive:  # timers keep the stream busy, so it is never idle
            time.sleep(1)
            if path_exists(spark, out):
                kept = spark.read.schema(f"{states.OUTPUT}, given_back BOOLEAN").parquet(f"{out}/batch=*")
                back = kept.where("given_back").collect()
    finally:
        query.stop()
    assert [r["content_item_id"] for r in back] == [1]


def test_a_hot_item_is_one_row_of_effects(spark):
    graph = schema.model_graph("default")
    hot = spark.range(300_000).select(
        F.lit(5).cast("bigint").alias("content_item_id"), F.col("id").alias("event_id"),
        F.expr("timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-01')").alias("event_ts"), F.lit("update").alias("kind"),
        F.element_at(F.array(*[F.lit(n) for n in state.state_names(graph)]), (F.pmod(F.xxhash64("id"), len(state.state_names(graph))) + 1).cast("int")).alias("to_state"))
    effects = state.event_effects(hot, graph).collect()
    assert len(effects) == 1 and len(effects[0]["effect"]) == len(state.state_names(graph))
    want = state.apply_events(hot.drop("kind"), graph).first()
    got = effects[0]["effect"][state.state_names(graph).index("undefined")]
    assert (state.state_names(graph)[got["state"]], got["end_ts"], got["completed_ts"]) == (want["current_state"], want["transition_end"], want["completed_timestamp"])


def test_ingest_is_idempotent_and_replaces_failed(spark):
    path, root, checkpoint = (work_folder(spark) for _ in range(3))

    def load(payloads):
        raw_store.append_raw(raw(spark, payloads), path)
        ingest.ingest_stream(spark, path, root, checkpoint, extract.extract_default).awaitTermination()
        stored = snapshots.read_snapshot(spark, root, ingest.ITEMS).collect()
        return sorted((r["raw_content_id"], r["current_state"], r["content"]) for r in stored)

    assert load([post(all_text="DROP"), post()]) == [("c0", "failed", ""), ("c1", "ready", "all")]
    assert load([post(all_text="fixed"), post(all_text="late")]) == [("c0", "ready", "fixed"), ("c1", "ready", "all")]
    assert load([post(all_text="again")]) == [("c0", "ready", "fixed"), ("c1", "ready", "all")]


def test_replayed_batch_changes_nothing(spark):
    root = work_folder(spark)
    for text in ("one", "two"):
        ingest.load_items(raw(spark, [post(all_text=text)]), root, extract.extract_default, batch_id="b", force=True)
    assert [r["content"] for r in snapshots.read_snapshot(spark, root, ingest.ITEMS).collect()] == ["one"]


def test_backfill_reports_bad_dates_and_loads_the_rest(spark):
    path, root = work_folder(spark), work_folder(spark)
    raw_store.append_raw(raw(spark, [post()]), path)
    spark.createDataFrame([("{broken",), (json.dumps({"run_id": "r", "workspace_id": "w", "content_id": "z", "content": post()}),)], "value STRING").write.text(
        f"{path}/date_id=20240103/workspace_id=w/source_id=junkipedia")
    report = ingest.backfill(spark, path, root, extract.extract_default, 20240101, 20240103).orderBy("date_id").collect()
    assert [(r["status"], r["inserted"]) for r in report] == [("missing", 0), ("completed", 1), ("error", 1)]


def test_callbacks_of_unknown_items_are_kept_apart(spark):
    path, root, events, refused, checkpoint = (work_folder(spark) for _ in range(5))
    items = adapters.content_items(spark, FOLDER)
    one = items.where("content_item_id in (1, 2)")
    wrong = one.withColumn("workspace_id", F.lit("elsewhere"))
    adapters.callbacks(one.unionByName(wrong)).select("message").write.text(path)
    models.callback_stream(spark, path, items, root, events, refused, checkpoint).awaitTermination()
    got = snapshots.read_snapshot(spark, root, key="content_keyword_id")
    assert {r["content_item_id"] for r in got.collect()} == {1, 2}
    assert spark.read.json(f"{refused}/batch=*").count() == 2
    assert {r["to_state"] for r in spark.read.parquet(f"{events}/batch=*").collect()} == {"keyworded"}


def test_cluster_stream_joins_earlier_clusters(spark):
    m = clustered_points(6, 60)
    df = vectors_of(spark, m, 1)
    root, checkpoint, path = (work_folder(spark) for _ in range(3))
    for low, high in ((0, 30), (30, 60)):
        df.where((F.col("content_item_id") >= low) & (F.col("content_item_id") < high)).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        models.cluster_stream(stream, root, 0.9, checkpoint).awaitTermination()
    got = {r["content_item_id"]: r["content_cluster_id"] for r in models.stored_vectors(spark, root).collect()}
    assert len(got) == 60
    pairs = brute_pairs(m, 0.9, 1)
    first = union_find(30, [p for p in pairs if p[1] < 30])
    assert all(got[i] == first[i] for i in range(30))
    near = {i: {got[j] for a, b in pairs if i in (a, b) for j in (a, b) if j < 30} for i in range(30, 60)}
    assert all(got[i] in near[i] for i in near if near[i])


def test_workflow_of_a_user(spark):
    def shout(items, tables):
        louder = items.withColumn("content", F.upper("content"))
        return workflow.StageResult(louder.withColumn("failed_reason", F.when(F.col("content") == "BAD", "bad word")))

    mine = workflow.Workflow("mine", [workflow.Stage("ready", "shouted", shout), workflow.Stage("shouted", "completed", workflow.pass_on)])
    items = spark.createDataFrame([(1, "w", "good"), (2, "w", "bad")], "content_item_id BIGINT, workspace_id STRING, content STRING").withColumns({
        "content_cluster_id": F.lit(None).cast("bigint"), "current_state": F.lit("ready"),
        "raw_created_at": F.lit("2024-01-01").cast("timestamp_ntz"), "content_published_date": F.lit(None).cast("timestamp_ntz")})
    done = workflow.run_workflow({"items": items}, mine, F.lit("2024-01-02").cast("timestamp_ntz"))
    assert {(r["content"], r["current_state"], r["failed_reason"]) for r in done["items"].collect()} == {
        ("GOOD", "completed", None), ("BAD", "failed", "bad word")}
    assert sorted((r["from_state"], r["to_state"]) for r in done["events"].collect()) == [
        ("ready", "failed"), ("ready", "shouted"), ("shouted", "completed")]


def test_second_run_clusters_into_what_is_there(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")

    def items(rows):
        return spark.createDataFrame(rows, "content_item_id BIGINT, content STRING, content_cluster_id BIGINT").withColumns({
            "workspace_id": F.lit("w"), "content_published_date": F.lit(None).cast("timestamp_ntz"),
            "raw_created_at": F.lit("2024-01-01").cast("timestamp_ntz"),
            "current_state": F.when(F.col("content_cluster_id").isNull(), "ready").otherwise("completed")})

    done = workflow.run_workflow(
        {"items": items([(1, "same text here", 77), (2, "same text here", None), (3, "other words", None)])}, workflow.WORKFLOWS["default"], now)
    assert {r["content_item_id"]: r["content_cluster_id"] for r in done["items"].collect()} == {1: 77, 2: 77, 3: 3}


def test_model_vectors(spark):
    items = adapters.content_items(spark, FOLDER)
    got = workflow.model_vectors(items, "len", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert got.count() == items.count()
    assert similarity.similar_vectors(got, 0.9999999, k=1).count() >= 0
    with pytest.raises(Exception, match="vectors for"):
        workflow.model_vectors(items, "bad", lambda: lambda texts: [[1.0]]).collect()
