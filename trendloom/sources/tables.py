"""Tables laid out for the joins they take part in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.joins import ITEM_KEY
from trendloom.operators.ranking import dedup_winner

ITEM_BUCKETS = 1024


def save_bucketed(df: DataFrame, name: str, key: str = "content_item_id", buckets: int = ITEM_BUCKETS, path: str | None = None) -> DataFrame:
    """Save a table bucketed and sorted by the key.

    Items, states, keywords and vectors saved by the same item id join without a shuffle of either side.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


# ---- natural keys ---------------------------------------------------------------------------------


def _key_hash() -> Column:
    return F.xxhash64(*ITEM_KEY).alias("key_hash")


def append_keys(items: DataFrame, name: str, version: int, buckets: int = ITEM_BUCKETS, path: str | None = None) -> None:
    """Adds (natural key, content_item_id, current_state) of ``items`` to the key table ``name``, bucketed by the hash of the key.

    Rows are only ever added: the one with the largest ``version`` counts. The first call makes the table.
    """
    rows = items.select(_key_hash(), *ITEM_KEY, "content_item_id", "current_state", F.lit(version).cast("bigint").alias("version"))
    if items.sparkSession.catalog.tableExists(name):
        rows.write.insertInto(name)
        return
    writer = rows.repartition(buckets, "key_hash").write.bucketBy(buckets, "key_hash").sortBy("key_hash")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def current_keys(spark: SparkSession, name: str) -> DataFrame:
    """The newest row of every natural key; grouped by bucket, without a shuffle."""
    newest = F.max_by(F.struct("content_item_id", "current_state"), "version")
    return spark.table(name).groupBy("key_hash", *ITEM_KEY).agg(newest.alias("r")).select("key_hash", *ITEM_KEY, "r.*")


def split_by_table(incoming: DataFrame, name: str, force: bool = False, buckets: int = ITEM_BUCKETS) -> DataFrame:
    """As ``maintenance.split_incoming``, against the key table ``name``: only the load is shuffled, the table stays where it is.

    Rows meet by the hash of their key; the key itself is compared in a form that Spark does not take for a second join key,
    since it would then shuffle the table by both. Two keys with one hash thus cost a comparison and no error.
    """
    winners = dedup_winner(incoming, force).withColumn("key_hash", _key_hash()).repartition(buckets, "key_hash")
    stored = current_keys(incoming.sparkSession, name)
    stored = stored.select("key_hash", *[F.col(c).alias(f"existing_{c}") for c in (*ITEM_KEY, "content_item_id", "current_state")])
    equal = sum(F.col(c).eqNullSafe(F.col(f"existing_{c}")).cast("int") for c in ITEM_KEY)
    matched = winners.alias("w").join(stored.alias("s").hint("merge"), (F.col("w.key_hash") == F.col("s.key_hash")) & (equal == len(ITEM_KEY)), "left")
    there = F.col("existing_content_item_id").isNotNull()
    replaceable = F.lit(True) if force else F.coalesce(F.col("existing_current_state") == "failed", F.lit(True))
    outcome = F.when(~there, "inserted").when(replaceable, "replaced").otherwise("ignored")
    return matched.select(*[F.col(f"w.{c}") for c in incoming.columns if c in winners.columns], "existing_content_item_id", outcome.alias("outcome"))
