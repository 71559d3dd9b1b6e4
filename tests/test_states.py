import random

import pytest
from pyspark.sql import functions as F

from trendloom import schema
from trendloom.operators import aggregates, joins, ranking, state

EVENTS = "event_id BIGINT, content_item_id BIGINT, event_ts TIMESTAMP_NTZ, kind STRING, to_state STRING"


def log(spark, n=400, keys=3, seed=5):
    rng = random.Random(seed)
    names = ["ready", "vectorized", "clustered", "completed", "failed", "strange"]
    rows = [(i, rng.choice([0] * 6 + list(range(keys))), rng.randrange(n // 2), rng.choice(["update", "update", "start"]), rng.choice(names)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id BIGINT, content_item_id BIGINT, m INT, kind STRING, to_state STRING")
    return rows, df.withColumn("event_ts", F.expr("timestampadd(MINUTE, m, TIMESTAMP_NTZ'2024-01-01 00:00:00')")).drop("m")


def walk(rows, graph, initial="undefined"):
    out = {}
    for e in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        now, end, num = out.get(e[1], (initial, None, 0))
        if e[3] == "start":
            num += 1
        elif e[4] in graph.get(now, []):
            now, end = e[4], e[2]
        out[e[1]] = (now, end, num)
    return out


@pytest.mark.parametrize("chunk", [1000, 50, 7, 2])
def test_fold_is_the_same_whole_and_in_stretches(spark, chunk):
    graph = schema.model_graph("default")
    rows, events = log(spark)
    want = walk(rows, graph)
    for large in (10**6, 3):
        got = state.apply_events(events, graph, chunk=chunk, large_key=large).collect()
        minutes = {r["content_item_id"]: r for r in got}
        assert {k: (r["current_state"], r["transition_num"]) for k, r in minutes.items()} == {k: (v[0], v[2]) for k, v in want.items()}
        for k, r in minutes.items():
            end = r["transition_end"]
            assert (None if end is None else (end.day - 1) * 1440 + end.hour * 60 + end.minute) == want[k][1]


def test_previous_and_running_sum_do_not_depend_on_the_split(spark):
    _, events = log(spark, 500, 4)
    order = ["event_ts", "event_id"]
    for fn in (
        lambda large: ranking.with_previous(events, ["content_item_id"], order, "to_state", "x", large),
        lambda large: ranking.with_running_sum(events, ["content_item_id"], order, F.lit(2), "x", large),
    ):
        assert sorted(fn(10**6).select("event_id", "x").collect()) == sorted(fn(5).select("event_id", "x").collect())


def test_start_counts_even_when_refused(spark):
    states = spark.createDataFrame([(1, "completed", 0, None, None, None)],
                                   "state_id BIGINT, current_state STRING, transition_num INT, transition_start TIMESTAMP_NTZ, transition_end TIMESTAMP_NTZ, completed_timestamp TIMESTAMP_NTZ")
    starts = spark.sql("SELECT 1L AS state_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS event_ts FROM range(4)")
    assert state.start_transitions(states, starts).first()["transition_num"] == 4
    update = spark.sql("SELECT 1L AS state_id, 'ready' AS to_state, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS event_ts")
    assert state.apply_transitions(states, update, schema.state_model(spark, "default")).first()["current_state"] == "completed"


def test_models(spark):
    for name, graph in schema.STATE_GRAPHS.items():
        got = {(r["from_state"], r["to_state"]) for r in schema.state_model(spark, name).collect()}
        want = {**schema.BASE_GRAPH, **graph}
        assert got == {(a, b) for a, targets in want.items() for b in targets}
    assert state.processing_stages(schema.state_model(spark, "social")) == ["ready", "keyworded", "vectorized", "clustered", "hashtaged"]
    assert state.processing_stages(schema.state_model(spark, "classify"))[-1] == "categorized"


def test_in_flight_and_cap(spark):
    states = spark.sql("""SELECT * FROM VALUES
      (1, 'ready', 1, TIMESTAMP_NTZ'2024-01-01 00:00:05', CAST(NULL AS TIMESTAMP_NTZ)),
      (2, 'ready', 101, TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:01'),
      (3, 'hashtaged', 100, TIMESTAMP_NTZ'2023-12-31 23:59:00', TIMESTAMP_NTZ'2023-12-31 23:58:00'),
      (4, 'ready', 2, TIMESTAMP_NTZ'2023-12-31 23:59:00', TIMESTAMP_NTZ'2023-12-31 23:58:00')
      AS t(state_id, current_state, transition_num, transition_start, transition_end)""")
    now = F.lit("2024-01-01 00:00:10").cast("timestamp_ntz")
    assert sorted(r[0] for r in state.in_flight(states, now).select("state_id").collect()) == [1, 3]
    assert [r["state_id"] for r in state.exceeded(states).collect()] == [2]


def test_error_gate(spark):
    def outcome(bad, good):
        return spark.range(bad + good).select(F.lit("w").alias("w"), F.when(F.col("id") < bad, "failed").otherwise("ready").alias("current_state"))

    aggregates.check_gate(outcome(50, 50), "w")
    aggregates.check_gate(outcome(20, 181), "w")
    with pytest.raises(aggregates.ErrorRateExceeded):
        aggregates.check_gate(outcome(60, 100), "w")


def test_authorised(spark):
    config = spark.createDataFrame([("a", ["public"]), ("b", ["t1", "t2"]), ("c", ["dev_public"])], "workspace_id STRING, slugs ARRAY<STRING>")
    sessions = spark.createDataFrame([(1, "t1"), (1, "t2"), (2, "none")], "session_id INT, slug STRING")
    assert sorted(map(tuple, joins.authorised_workspaces(config, sessions).collect())) == [(1, "a"), (1, "b"), (2, "a")]
    assert len(joins.authorised_workspaces(config, sessions, "dev").collect()) == 5
    closed = config.where("workspace_id = 'b'")
    assert sorted(map(tuple, joins.authorised_workspaces(closed, sessions).collect())) == [(1, "b")]


def test_attempts(spark):
    rows = [(1, "ready"), (2, "running"), (3, "failed"), (4, "running"), (5, "completed"), (6, "running")]
    events = spark.createDataFrame([(i, "r", s) for i, s in rows], "event_id INT, run_id STRING, to_state STRING").withColumn(
        "event_ts", F.expr("timestampadd(HOUR, event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    got = [(r["attempt_id"], r["current_state"], r["attempt_end"] and r["attempt_end"].hour)
           for r in ranking.number_attempts(events).orderBy("attempt_num").collect()]
    assert got == [("r:1", "failed", 3), ("r:2", "completed", 5), ("r:3", "running", None)]


def test_filled_histogram(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:10:00'), (TIMESTAMP_NTZ'2024-01-01 03:00:00'), (NULL) AS t(content_published_date)")
    assert [r["num_items"] for r in aggregates.filled_histogram(df).orderBy("hour").collect()] == [1, 0, 0, 1]
