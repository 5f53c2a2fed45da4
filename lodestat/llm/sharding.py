"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers 0..N-1 that depend on their values only; a keyed permutation of [0, N) shuffles them; a row's
place p in the shuffle is shard p % shards, slot p // shards. Both ways are computable without data: `place` and `number`
below give a row number's shard and slot and back. Column functions only.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.llm.common import row_key, shielded, table, text_or_empty

SHARDS, SEED, ROUNDS = 16, 42, 6
#: Buckets in which rows are numbered; each is sorted by one task and its first number is known beforehand.
BUCKETS = 4096
#: Steps of the walk that the plan holds; see `walk_steps`.
MOST_STEPS = 64


def domain(n: int) -> tuple[int, int]:
    """Sides a x b of the permuted domain: a * b - n < a, so that few numbers lie outside [0, n)."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def walk_steps(n: int) -> int:
    """A walk passes each number outside at most once, so a*b - n + 1 steps always do; beyond MOST_STEPS the chance of needing more is under (1/MOST_STEPS)**MOST_STEPS, and such a row would raise an error."""
    a, b = domain(n)
    return min(MOST_STEPS, a * b - n + 1)


# -- columns ------------------------------------------------------------------------------------


def _div(x: Column, by: int) -> Column:
    """Whole division without a detour over doubles."""
    return F.call_function("div", x.cast("bigint"), F.lit(by).cast("bigint"))


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    def _mixed_k(side: Column, seed: int, k: Column) -> Column:
        return F.xxhash64(side.cast("bigint"), (F.lit(seed * 1000).cast("bigint") + k.cast("bigint")))

    def one(v: Column, k: Column) -> Column:
        even = k % 2 == 0
        left = F.when(even, F.pmod(v["l"] + F.pmod(_mixed_k(v["r"], seed, k), F.lit(a)), F.lit(a))).otherwise(v["l"])
        right = F.when(even, v["r"]).otherwise(F.pmod(v["r"] + F.pmod(_mixed_k(v["l"], seed, k), F.lit(b)), F.lit(b)))
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    begin = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, one, lambda v: v["l"] * F.lit(b) + v["r"])


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number x of n in the shuffle."""
    a, b = domain(n)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(walk_steps(n))),
        F.lit(-1).cast("bigint"),
        lambda at, _: F.when((at >= 0) & (at < n), at).otherwise(_once(F.when(at < 0, x).otherwise(at), a, b, seed)),
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the cycle walk did not end; raise MOST_STEPS")).cast("bigint"))


# -- the same on the driver, for lookups and tests ------------------------------------------------


def _mix(x: int, k: int, seed: int) -> int:
    h = xxhash.xxh64_intdigest(struct.pack("<q", x), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", seed * 1000 + k), h)
    return h - (1 << 64) if h >> 63 else h


def _step(x: int, a: int, b: int, seed: int, back: bool) -> int:
    left, right = divmod(x, b)
    for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2 == 0:
            left = (left + sign * (_mix(right, k, seed) % a)) % a
        else:
            right = (right + sign * (_mix(left, k, seed) % b)) % b
    return left * b + right


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    a, b = domain(n)
    at = _step(number, a, b, seed, False)
    while at >= n:
        at = _step(at, a, b, seed, False)
    return at % shards, at // shards


def number(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that has this shard and slot."""
    a, b = domain(n)
    at = _step(slot * shards + shard, a, b, seed, True)
    while at >= n:
        at = _step(at, a, b, seed, True)
    return at


# -- operators ------------------------------------------------------------------------------------


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """rows with __number, gapless from 0 and decided by the keys' values, and the count of rows.

    Rows that agree in all keys may swap numbers. They are salted into different buckets by __copy where the caller
    has counted such rows (see `counted`), so that no value fills a bucket.
    """
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), "__n")
    n = sizes.agg(F.sum("__n")).first()[0] or 0
    within = Window.partitionBy("__bucket").orderBy(*[F.col(k) for k in keys])
    ranked = rows.withColumn("__rank", F.row_number().over(within))
    # starts has at most `buckets` rows
    out = ranked.join(F.broadcast(starts.drop("__n")), F.col("__bucket") == F.col("__b"))
    return out.withColumn("__number", F.col("__start") + F.col("__rank") - 1).drop("__b", "__bucket", "__rank", "__start"), n


def shard(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """rows with shard and slot: counts of shards differ by at most one, slots are gapless from 0, reruns agree on any partitioning.

    Rows that agree in all keys stand in one bucket; where a row may repeat without end the caller counts its copies first and makes the copy a key, as
    op2_feistel_shards does. Nulls order first. An empty table stays empty. Columns of rows named shard or slot are replaced.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*names)
    out, n = numbered(rows, keys, buckets)
    if not n:
        return out.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    out = out.withColumn("__at", permuted(F.col("__number"), n, seed))
    return out.select(*names, F.pmod("__at", F.lit(shards)).cast("int").alias("shard"), _div(F.col("__at"), shards).alias("slot"))


@shielded
def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with shard and slot. Rows move once, to the bucket that numbers them. Null and empty texts are rows like any other.

    Rows of one id and text are interchangeable and share a bucket, so a table in which one row makes up a large part is to be deduplicated before, as the pipeline does.
    """
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return shard(keyed, ["__key"], **options).select(*names, "shard", "slot")


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards under the law `rows`; text null: size 1 and the CRC of no bytes."""
    text = text_or_empty("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # equal rows are counted, and numbered as one row a copy, so that they spread over the buckets
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).drop("__n")
    out = shard(rows, ["doc_id", "size", "text_crc32", "__copy"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
