"""A reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import row_numbers
from trendloom.session import cut_and_measure

PRIME = (1 << 31) - 1
ROUNDS = 6
STEPS = 16  # walks in one pass; further passes follow while a row is outside


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, by the linear congruence of Park and Miller."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        a = x = x * 48271 % PRIME
        b = x = x * 48271 % PRIME
        keys.append((a, b))
    return keys


def half_bits(total: int) -> int:
    """Bits of each half of the smallest even-sided domain that holds ``total`` numbers."""
    return max(1, ((max(total, 1) - 1).bit_length() + 1) // 2)


def permuted(x: int, total: int, seed: int) -> int:
    """The place of row number ``x`` among ``total``; what ``placed`` computes for a column."""
    bits = half_bits(total)
    mask = (1 << bits) - 1
    while True:
        left, right = x >> bits, x & mask
        for a, b in round_keys(seed):
            t = (right * a + b) % PRIME
            left, right = right, left ^ (t * t % PRIME & mask)
        x = left << bits | right
        if x < total:
            return x


def row_at(place: int, total: int, seed: int) -> int:
    """The row number that ``permuted`` puts at ``place``."""
    bits = half_bits(total)
    mask = (1 << bits) - 1
    x = place
    while True:
        left, right = x >> bits, x & mask
        for a, b in reversed(round_keys(seed)):
            t = (left * a + b) % PRIME
            left, right = right ^ (t * t % PRIME & mask), left
        x = left << bits | right
        if x < total:
            return x


def _feistel(x: Column, bits: int, seed: int) -> Column:
    mask = F.lit((1 << bits) - 1).cast("long")
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(seed)])
    start = F.struct(F.shiftright(x, bits).alias("l"), x.bitwiseAND(mask).alias("r"))

    def turn(half: Column, key: Column) -> Column:
        t = F.transform(F.array((half.r * key.a + key.b) % PRIME), lambda t: (t * t % PRIME).bitwiseAND(mask))
        return F.struct(half.r.alias("l"), half.l.bitwiseXOR(F.get(t, 0)).alias("r"))

    return F.aggregate(keys, start, turn, lambda half: F.shiftleft(half.l, bits).bitwiseOR(half.r))


def placed(df: DataFrame, total: int, seed: int, row: str = "row_number", name: str = "place") -> DataFrame:
    """``df`` with the permuted place of each row number, written to the shared folder.

    A number that the permutation of the power of four throws beyond ``total`` is permuted again until it is inside.
    """
    bits = half_bits(total)
    count = F.lit(total).cast("long")
    walk = F.sequence(F.lit(1), F.lit(STEPS))

    def walked(x: Column) -> Column:
        return F.aggregate(walk, x, lambda x, _: F.when(x < count, x).otherwise(_feistel(x, bits, seed)))

    outside = {"outside": F.coalesce(F.count_if(F.col(name) >= count), F.lit(0))}
    result, seen = cut_and_measure(df.withColumn(name, walked(_feistel(F.col(row).cast("long"), bits, seed))), **outside)
    while seen["outside"]:
        result, seen = cut_and_measure(result.withColumn(name, walked(F.col(name))), **outside)
    return result


def sharded(docs: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text): shards whose row counts are at most one apart.

    size: UTF-8 bytes of the text plus 16; text_crc32: unsigned, of those bytes. Rows are numbered from 0 in the order of
    (doc_id, text_crc32, size), nulls first; the permuted number p goes to shard p mod ``shards`` and slot p div ``shards``, so
    ``permuted`` and ``row_at`` find a row's place and a place's row without the table. The result depends on the rows and the
    seed alone. Which of several rows equal in all three comes first makes no difference to it.

    A null text has no bytes: size 16, CRC 0. Rows with a null or repeated doc_id are numbered like any other. Of an empty
    table nothing comes out; with fewer rows than shards some shards are empty. Other columns are not read.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    numbered, total = row_numbers(narrow, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    found = placed(numbered, total, seed)
    shard, slot = F.pmod("place", F.lit(shards)).cast("int"), F.expr(f"place div {shards}")
    return found.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
