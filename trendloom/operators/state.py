"""Item state from an event log.

The log is the truth: a state table is what the events of an item leave behind when they are applied
in order and events that the state graph does not allow are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators.filters import PAYLOAD_BYTES, payload_under
from trendloom.operators.joins import check_transitions
from trendloom.operators.ranking import largest_key, with_running_sum
from trendloom.schema import CLASSIFY_IN_FLIGHT_SECONDS, IN_FLIGHT_SECONDS, RETRY_CAP

FOLD_CHUNK = 1000
ENDS = ("failed", "completed")
RESULT = "struct<state: int, end_ts: timestamp_ntz, completed_ts: timestamp_ntz>"


def apply_transitions(states: DataFrame, updates: DataFrame, transitions: DataFrame) -> DataFrame:
    """One round of updates (state_id, to_state, event_ts) on a state table; refused ones change nothing."""
    asked = states.join(updates.select("state_id", "to_state", "event_ts"), "state_id", "left")
    checked = check_transitions(asked.withColumn("from_state", F.col("current_state")), transitions)
    ok = F.col("is_valid")
    ends = F.col("to_state").isin(*ENDS)
    return checked.withColumns({
        "current_state": F.when(ok, F.col("to_state")).otherwise(F.col("current_state")),
        "transition_end": F.when(ok, F.col("event_ts")).otherwise(F.col("transition_end")),
        "completed_timestamp": F.when(ok & ends, F.col("event_ts")).otherwise(F.col("completed_timestamp")),
    }).select(*states.columns)


def start_transitions(states: DataFrame, starts: DataFrame) -> DataFrame:
    """Count a start on each named state, allowed or not, and note its time."""
    asked = starts.groupBy("state_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("started"))
    return states.join(asked, "state_id", "left").withColumns({
        "transition_num": (F.col("transition_num") + F.coalesce("n", F.lit(0))).cast("int"),
        "transition_start": F.coalesce("started", "transition_start"),
    }).select(*states.columns)


class _Graph:
    """State numbers and the transition table as SQL literals (a handful of states)."""

    def __init__(self, graph: dict[str, list[str]], initial: str):
        self.names = sorted({*graph, *(t for targets in graph.values() for t in targets), initial})
        self.initial = self.names.index(initial)
        self.size = len(self.names)
        self._allowed = [
            target in graph.get(source, []) for source in self.names for target in self.names
        ]

    def number(self, state: Column) -> Column:
        return F.coalesce(F.array_position(self._names(), state).cast("int") - 1, F.lit(-1))

    def name(self, number: Column) -> Column:
        return F.get(self._names(), number)

    def _names(self) -> Column:
        return F.array(*[F.lit(n) for n in self.names])

    def allowed(self, source: Column, target: Column) -> Column:
        table = F.array(*[F.lit(a) for a in self._allowed])
        return F.coalesce(F.get(table, source * self.size + target) & (target >= 0), F.lit(False))

    def is_end(self, number: Column) -> Column:
        return number.isin([self.names.index(n) for n in ENDS if n in self.names])

    def step(self, acc: Column, event: Column) -> Column:
        """One event on a running result; a refused event leaves it as it is."""
        target, ts = event["target"], event["event_ts"]
        ok = self.allowed(acc["state"], target)
        return F.struct(
            F.when(ok, target).otherwise(acc["state"]).alias("state"),
            F.when(ok, ts).otherwise(acc["end_ts"]).alias("end_ts"),
            F.when(ok & self.is_end(target), ts).otherwise(acc["completed_ts"]).alias("completed_ts"),
        ).cast(RESULT)


def _start(state: Column) -> Column:
    none = F.lit(None).cast("timestamp_ntz")
    return F.struct(state.cast("int").alias("state"), none.alias("end_ts"), none.alias("completed_ts")).cast(RESULT)


def _chain(acc: Column, part: Column) -> Column:
    """Run a stretch of the log, given as its result for every start state, on a running result."""
    then = F.get(part["effect"], acc["state"])
    return F.struct(
        then["state"].alias("state"),
        F.coalesce(then["end_ts"], acc["end_ts"]).alias("end_ts"),
        F.coalesce(then["completed_ts"], acc["completed_ts"]).alias("completed_ts"),
    ).cast(RESULT)


def apply_events(
    events: DataFrame, graph: dict[str, list[str]], initial: str = "undefined", key: str = "content_item_id",
    chunk: int = FOLD_CHUNK, large_key: int | None = None,
) -> DataFrame:
    """Fold the events of each item, in (event_ts, event_id) order, through a state graph.

    Gives current_state, transition_num (all start events), transition_end and completed_timestamp.

    While no item has more than ``chunk`` events, one shuffle and one in-row fold do it. Beyond that an
    item's log is cut into stretches of ``chunk`` events, each reduced to its effect on every start state;
    effects chain, so stretches are reduced level by level and no task sees a whole hot log.
    """
    g = _Graph(graph, initial)
    updates = events.where(F.col("kind") == "update") if "kind" in events.columns else events
    updates = updates.select(key, "event_ts", "event_id", g.number(F.col("to_state")).alias("target"))
    ordered = F.array_sort(F.collect_list(F.struct("event_ts", "event_id", "target")))
    if largest_key(updates, [key]) <= chunk:
        folded = updates.groupBy(key).agg(ordered.alias("log")).select(
            key, F.aggregate("log", _start(F.lit(g.initial)), g.step).alias("r")
        )
    else:
        folded = _fold_stretches(updates, g, key, ordered, chunk, large_key)
    result = folded.select(
        key,
        g.name(F.col("r.state")).alias("current_state"),
        F.col("r.end_ts").alias("transition_end"),
        F.col("r.completed_ts").alias("completed_timestamp"),
    )
    if "kind" not in events.columns:
        return result
    starts = events.groupBy(key).agg(
        F.count_if(F.col("kind") == "start").cast("int").alias("transition_num"),
        F.max(F.when(F.col("kind") == "start", F.col("event_ts"))).alias("transition_start"),
    )
    return starts.join(result, key, "left").withColumn(
        "current_state", F.coalesce("current_state", F.lit(initial))
    )


def event_effects(
    events: DataFrame, graph: dict[str, list[str]], initial: str = "undefined", key: str = "content_item_id",
    chunk: int = FOLD_CHUNK, large_key: int | None = None,
) -> DataFrame:
    """One row per item: what its events, in (event_ts, event_id) order, do to each start state.

    ``effect`` has a result for every state in the order of ``state_names``: the state after, and the times of the last allowed
    update and of the last end, null where there was none. ``starts`` and ``started`` count the start events. Effects of one
    batch after another chain, so a log need not be kept to go on from it; no task sees a whole hot log.
    """
    g = _Graph(graph, initial)
    updates = events.where(F.col("kind") == "update").select(key, "event_ts", "event_id", g.number(F.col("to_state")).alias("target"))
    ordered = F.array_sort(F.collect_list(F.struct("event_ts", "event_id", "target")))
    every = F.sequence(F.lit(0), F.lit(g.size - 1))
    if largest_key(updates, [key]) <= chunk:
        effects = updates.groupBy(key).agg(ordered.alias("log")).select(
            key, F.transform(every, lambda s: F.aggregate("log", _start(s), g.step)).alias("effect")
        )
    else:
        effects = _stretch_effects(updates, g, key, ordered, chunk, large_key)
    starts = events.groupBy(key).agg(
        F.count_if(F.col("kind") == "start").cast("int").alias("starts"),
        F.max(F.when(F.col("kind") == "start", F.col("event_ts"))).alias("started"),
    )
    same = F.transform(every, _start)
    return starts.join(effects, key, "left").withColumn("effect", F.coalesce("effect", same))


def state_names(graph: dict[str, list[str]], initial: str = "undefined") -> list[str]:
    return _Graph(graph, initial).names


def _fold_stretches(updates: DataFrame, g: _Graph, key: str, ordered: Column, chunk: int, large_key) -> DataFrame:
    return _stretch_effects(updates, g, key, ordered, chunk, large_key).select(key, F.get("effect", F.lit(g.initial)).alias("r"))


def _stretch_effects(updates: DataFrame, g: _Graph, key: str, ordered: Column, chunk: int, large_key) -> DataFrame:
    sizes = {} if large_key is None else {"large_key": large_key}
    placed = with_running_sum(updates, [key], ["event_ts", "event_id"], F.lit(1), "place", **sizes)
    place = ((F.col("place") - 1) / chunk).cast("bigint")
    every = F.sequence(F.lit(0), F.lit(g.size - 1))
    parts = placed.withColumn("place", F.floor(place)).groupBy(key, "place").agg(ordered.alias("log")).select(
        key, "place",
        F.transform(every, lambda s: F.aggregate("log", _start(s), g.step)).alias("effect"),
    )
    longest = largest_key(updates, [key])
    stretch = F.array_sort(F.collect_list(F.struct("place", "effect")))
    while longest > chunk:
        longest = -(-longest // chunk)
        level = parts.groupBy(key, F.floor(F.col("place") / chunk).alias("next")).agg(stretch.alias("parts"))
        parts = level.select(
            key, F.col("next").alias("place"),
            F.transform(every, lambda s: F.aggregate("parts", _start(s), _chain)).alias("effect"),
        )
    return parts.select(key, "effect")


def in_flight(states: DataFrame, now: Column, timeouts: dict[str, int] | None = None, default: int = IN_FLIGHT_SECONDS) -> DataFrame:
    """States whose last start has no end yet and is younger than the timeout of the state."""
    limit = F.lit(default)
    for state, seconds in (CLASSIFY_IN_FLIGHT_SECONDS if timeouts is None else timeouts).items():
        limit = F.when(F.col("current_state") == state, F.lit(seconds)).otherwise(limit)
    open_start = F.col("transition_end").isNull() | (F.col("transition_start") > F.col("transition_end"))
    age = F.timestamp_diff("MICROSECOND", F.col("transition_start"), now)
    return states.where(open_start & (age < limit.cast("bigint") * 1_000_000))


def exceeded(states: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    """States tried more often than the cap."""
    return states.where(F.col("transition_num") > cap)


def fail_exceeded(states: DataFrame, cap: int = RETRY_CAP) -> DataFrame:
    over = F.col("transition_num") > cap
    return states.withColumn("current_state", F.when(over, "failed").otherwise(F.col("current_state")))


def cap_retries(states: DataFrame, now: Column, cap: int = RETRY_CAP) -> tuple[DataFrame, DataFrame]:
    """States after the retry cap, and the events of it (state_id, from_state, to_state, event_ts).

    A state tried more often than the cap that has not ended is failed, and ends now.
    """
    over = (F.col("transition_num") > cap) & ~F.col("current_state").isin(*ENDS)
    events = states.where(over).select("state_id", F.col("current_state").alias("from_state"), F.lit("failed").alias("to_state"), now.alias("event_ts"))
    failed = states.withColumns({
        "current_state": F.when(over, "failed").otherwise(F.col("current_state")),
        "transition_end": F.when(over, now).otherwise(F.col("transition_end")),
        "completed_timestamp": F.when(over, now).otherwise(F.col("completed_timestamp")),
    })
    return failed.select(*states.columns), events


def fail_oversize(items: DataFrame, request: Column, max_bytes: int = PAYLOAD_BYTES) -> DataFrame:
    """Items (``current_state``, ``failed_reason``) whose model request would not fit are failed instead of sent."""
    fits = F.coalesce(payload_under(request, max_bytes), F.lit(True))
    size = F.octet_length(request)
    return items.withColumns({
        "current_state": F.when(fits, F.col("current_state")).otherwise("failed"),
        "failed_reason": F.when(fits, F.col("failed_reason")).otherwise(F.concat(F.lit("request of "), size.cast("string"), F.lit(" bytes"))),
    })


def processing_stages(transitions: DataFrame) -> list[str]:
    """Stages of a model in order of their longest path from ``ready``.

    A state graph is a handful of rows, so this small ordering is done on the driver.
    """
    ends = {"undefined", "failed", "completed"}
    edges = [
        (r["from_state"], r["to_state"]) for r in transitions.select("from_state", "to_state").collect()
        if r["to_state"] not in ends and r["from_state"] not in ends
    ]
    depth = {"ready": 0}
    for _ in range(len(edges) + 1):
        for source, target in edges:
            if source in depth:
                depth[target] = max(depth.get(target, 0), depth[source] + 1)
    return sorted(depth, key=lambda s: (depth[s], s))
