"""Hashed vector search, the bucketed key table, day sketches and table functions."""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_clusters import brute_pairs, vectors_of
from tests.test_extract import post, raw
from trendloom.operators import aggregates, extract, similarity
from trendloom.session import work_folder
from trendloom.sources import tables


@pytest.mark.parametrize("n", [300, 3000])
def test_hashed_search_finds_nine_of_ten_planted_pairs(spark, n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, 24))
    for i in range(0, n, 3):  # a near copy of every third vector, right above the threshold
        m[i + 1] = m[i] / np.linalg.norm(m[i]) + 0.35 * rng.normal(size=24) / np.sqrt(24)
    want = brute_pairs(m.astype("float32"), 0.9, 1)
    bits, count = similarity.lsh_shape(n, 0.9)
    assert count <= similarity.LSH_TABLES and 2**bits <= max(4, n / 32)
    got = {(r["src_id"], r["dst_id"]) for r in similarity.similar_vectors(vectors_of(spark, m.astype("float32"), 1), 0.9, method="lsh").collect()}
    assert len(want) > n / 5 and got <= want and len(got) >= 0.9 * len(want)


def test_shape_of_the_hashes_follows_size_and_threshold():
    shapes = [similarity.lsh_shape(n, 0.9) for n in (10, 10_000, 10**6, 10**9)]
    assert [b for b, _ in shapes] == sorted(b for b, _ in shapes) and shapes[-1][0] > shapes[0][0]
    assert similarity.lsh_shape(10**6, 0.5)[0] < similarity.lsh_shape(10**6, 0.95)[0]
    with pytest.raises(ValueError, match="method"):
        similarity.similar_vectors(None, 0.9, method="guess")


@pytest.mark.parametrize("block_rows", [20, 2000])
def test_hashed_search_gives_a_pair_once_in_its_first_bucket(spark, block_rows):
    m = np.random.default_rng(3).normal(size=(400, 6)).astype("float32")
    m[7] = 0
    unit = similarity._unit(pd.Series(list(m)))
    bits, tables, probes = 3, 5, 2
    rng = np.random.default_rng(similarity.LSH_SEED)
    planes = np.rint(rng.normal(size=(tables, bits, 6)) * 2**10)
    side = np.rint(unit * 2**20) @ planes.transpose(0, 2, 1)  # by table, vector and bit
    home = ((side > 0) << np.arange(bits)).sum(2)
    unsure = np.argsort(np.abs(side), 2, kind="stable")[:, :, :probes]
    seen = [[{home[t, i], *(home[t, i] ^ (1 << unsure[t, i]))} for i in range(400)] for t in range(tables)]
    cos = unit @ unit.T
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if cos[i, j] >= 0.4
            and any(home[t, j] in seen[t][i] or home[t, i] in seen[t][j] for t in range(tables))}
    vectors = vectors_of(spark, m, 1)
    buckets = similarity._buckets(vectors, bits, tables, probes, similarity.VECTOR_COLUMNS)
    found = similarity._compare_blocks(similarity._blocks(buckets, block_rows), 0.4, False, once=similarity.first_meeting(bits, probes)).collect()
    got = [(r["src_id"], r["dst_id"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_low_thresholds_get_more_bits_where_buckets_beside_count():
    for n, threshold in ((10_000, 0.35), (600_000, 0.35), (600_000, 0.9)):
        bits, tables = similarity.lsh_shape(n, threshold)
        chance = similarity.meeting_chances(threshold, bits, similarity.LSH_PROBES)[bits]
        assert 1 - (1 - chance) ** tables >= similarity.LSH_RECALL and tables <= similarity.LSH_TABLES
    assert similarity.lsh_shape(600_000, 0.35)[0] == 6  # 4 where only the own bucket counted, with three and a half times the comparisons
    same = 1 - np.arccos(0.35) / np.pi  # without buckets beside the chance is that of equal signs
    assert similarity.meeting_chances(0.35, 3, 0)[3] == pytest.approx(same**3, abs=0.02)


def test_vectors_of_unlike_lengths_are_refused():
    with pytest.raises(ValueError, match="unlike lengths"):
        similarity._matrix(pa.array([[1.0, 2.0], [3.0], [4.0]]))
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    assert (similarity._matrix(similarity._packed(m).slice(1, 2)) == m[1:3]).all()


def test_key_table_is_not_shuffled(spark):
    name = f"keys_{uuid.uuid4().hex}"
    shape = "workspace_id STRING, raw_content_id STRING, source_field STRING, content_item_id BIGINT, current_state STRING"
    stored = [("w", f"c{i}", None if i % 2 else "f", i, "failed" if i % 5 == 0 else "ready") for i in range(200)]
    tables.append_keys(spark.createDataFrame(stored, shape), name, 0, 8, f"{work_folder(spark)}/{name}")
    load = spark.createDataFrame([("w", "c1", None, 901, "ready", 0), ("w", "c1", "f", 902, "ready", 1), ("w", "c5", None, 903, "ready", 2),
                                  ("v", "c1", None, 904, "ready", 3), ("w", "c5", None, 905, "ready", 4)], f"{shape}, arrival INT")
    decided = tables.split_by_table(load, name, buckets=8)
    assert {r["content_item_id"]: r["outcome"] for r in decided.collect()} == {901: "ignored", 902: "inserted", 903: "replaced", 904: "inserted"}
    lines = decided._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if f"default.{name}" in line)
    deep = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, depth = [], deep(lines[at])
    for line in reversed(lines[:at]):  # the nodes between the scan and the join
        if deep(line) < depth:
            depth = deep(line)
            if "Join" in line:
                break
            above.append(line)
    assert above and "Bucketed: true" in lines[at] and not any("Exchange" in line for line in above)
    tables.append_keys(decided.where("outcome <> 'ignored'"), name, 1)
    again = {r["content_item_id"]: r["outcome"] for r in tables.split_by_table(load, name, buckets=8).collect()}
    assert set(again.values()) == {"ignored"}
    assert tables.current_keys(spark, name).count() == 202
    spark.sql(f"DROP TABLE {name}")


def test_sketches_roll_up_to_any_range(spark):
    items = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("content_item_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise("b").alias("k"),
        F.expr("timestampadd(DAY, cast(id % 28 as int), timestamp_ntz'2024-01-01 05:00:00')").alias("content_published_date"))
    days = aggregates.day_sketches(items, "k")
    assert days.count() == 56
    for first, last in (("2024-01-01", "2024-01-28"), ("2024-01-05", "2024-01-11")):
        start, end = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (first, last))
        got = {r["k"]: r for r in aggregates.distinct_between(days, "k", start=start, end=end).collect()}
        picked = items.where((F.to_date("content_published_date") >= first) & (F.to_date("content_published_date") <= last))
        for r in picked.groupBy("k").agg(F.count_distinct("content_item_id").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
            assert abs(got[r["k"]]["num_distinct"] - r["n"]) <= 0.04 * r["n"] and got[r["k"]]["num_items"] == r["rows"]
    assert aggregates.distinct_between(days.where("false"), "k").count() == 0


def test_table_function_gives_items_one_by_one(spark):
    def many(payload):
        yield {"text": "first", "published": "2024-01-01T00:00:00.000Z"}
        for i in range(payload["n"]):
            yield {"text": f"t{i}", "published": "2024-01-01T00:00:00.000Z"}

    got = extract.table_extractor(many)(raw(spark, ['{"n": 3}', '{"n": 0}', "{}", "broken", post()])).collect()
    assert sorted((r["raw_content_id"], r["content"], r["failed_reason"] is None) for r in got) == sorted(
        [("c0", "first", True), *[("c0", f"t{i}", True) for i in range(3)], ("c1", "first", True), ("c2", "first", True), ("c2", "", False),
         ("c3", "", False), ("c4", "first", True), ("c4", "", False)])
