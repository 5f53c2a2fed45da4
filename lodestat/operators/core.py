"""Shared building blocks: tables, size-checked joins, prefix sums that no single task carries."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a grouped side is broadcast.
BROADCAST_ROWS = 50_000
#: Rows of a whole table up to which its groups are sorted without being cut into bins first.
SORTED_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df computed once: written to the folder that spark.checkpoint.dir names and read again, so that no later step or lost executor computes it anew; where none is named, persisted."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root.rstrip('/')}/lodestat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, computed once, with a broadcast hint if a count shows that it has at most `limit` rows, else for a shuffle join."""
    df = stored(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _same(by: list[str], mark: str) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{mark}{c}"))
    return same


def prefix_sums(df: DataFrame, by: list[str], order: str, weight: str | list[str], bins: int = 64, following: bool = False) -> DataFrame:
    """df with `__below` (sum of weight over smaller `order` in the group) and `__upto` (over equal ones too). One row a value in each group.

    Of several weights each has its own, `__below_w` and `__upto_w`; with `following` there is `__next`, the next larger `order` of the group. A window over a whole
    group would sort it in one task. Here groups are cut into bins at approximate quantiles, bins are summed, and only rows of a bin are sorted together; any cut gives the same sums.
    """
    weights = [weight] if isinstance(weight, str) else weight
    df = stored(df)
    if df.limit(SORTED_ROWS + 1).count() <= SORTED_ROWS:  # so few rows in all that a group is no load for a task
        whole = Window.partitionBy(*by).orderBy(order)
        for w in weights:
            name = "" if isinstance(weight, str) else f"_{w}"
            df = df.withColumn(f"__upto{name}", F.sum(w).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            df = df.withColumn(f"__below{name}", F.col(f"__upto{name}") - F.col(w))
        return df.withColumn("__next", F.lead(order).over(whole)) if following else df
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, [k / bins for k in range(1, bins)], 1000).alias("__cuts"))
    cuts = cuts.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__cuts")
    df = df.join(small(cuts), _same(by, "__k_"), "left").drop(*[f"__k_{c}" for c in by])
    df = df.withColumn("__bin", F.size(F.filter("__cuts", lambda x: x < F.col(order)))).drop("__cuts")
    sums = df.groupBy(*by, "__bin").agg(*[F.sum(w).alias(f"__sum_{w}") for w in weights], F.min(order).alias("__first"))
    at = Window.partitionBy(*by).orderBy("__bin")  # at most `bins` rows a group
    starts = [F.coalesce(F.sum(f"__sum_{w}").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__start_{w}") for w in weights]
    sums = sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__bin").alias("__k_bin"), *starts, F.lead("__first").over(at).alias("__then"))
    inner = Window.partitionBy(*by, "__bin").orderBy(order)
    df = df.join(small(sums), _same(by, "__k_") & (F.col("__bin") == F.col("__k_bin")), "left")
    for w in weights:
        name = "" if isinstance(weight, str) else f"_{w}"
        df = df.withColumn(f"__upto{name}", F.col(f"__start_{w}") + F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        df = df.withColumn(f"__below{name}", F.col(f"__upto{name}") - F.col(w))
    if following:
        df = df.withColumn("__next", F.coalesce(F.lead(order).over(inner), F.col("__then")))
    return df.drop("__bin", "__k_bin", "__then", *[f"__start_{w}" for w in weights], *[f"__k_{c}" for c in by])


def rounded(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; minus zero becomes zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


#: Rows that share a bucket of row numbers, so about the most that one task sorts.
BUCKET_ROWS = 100_000


def row_numbers(df: DataFrame, key: str, seed: int, name: str = "row") -> DataFrame:
    """df with gapless numbers from 0 in an order that MD5 of seed and key decides, equal keys in any order: a permutation that any engine with MD5 reproduces.

    Rows go to buckets by the first digits of the hash; sums of the buckets' sizes give their first numbers, and only rows of a bucket are sorted together.
    """
    digits, n = 2, df.count()
    while n > BUCKET_ROWS << (4 * digits):
        digits += 1
    df = df.withColumn("__hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("__bucket", F.substring("__hash", 1, digits))
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__size"))
    starts = sizes.select(F.col("__bucket").alias("__k"), (F.sum("__size").over(Window.orderBy("__bucket")) - F.col("__size")).alias("__start"))  # one row a bucket
    inner = Window.partitionBy("__bucket").orderBy("__hash")
    return df.join(small(starts), F.col("__bucket") == F.col("__k")).withColumn(name, F.col("__start") + F.row_number().over(inner) - 1).drop("__hash", "__bucket", "__k", "__start", "__size")


def exact_folds(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """df with folds 0 to k - 1 of equal size after a keyed shuffle: of n rows the first n mod k folds have one more."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError("folds need at least a row each, and two of them")
    size, more = n // k, n % k
    at = F.col("__row")
    fold = F.when(at < more * (size + 1), F.floor(at / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((at - more * (size + 1)) / F.lit(size)))
    return row_numbers(df, key, seed, "__row").withColumn(name, fold.cast("int")).drop("__row")
