"""Provenance ledgers as graphs: items (id, kind, parents) must have their fields, known kinds and parents, ids of their own, and no item among its own ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import stored


def _edges(items: DataFrame) -> DataFrame:
    """(child, parent) between known items."""
    ids = items.select(F.col("id").alias("__id")).distinct()
    pairs = items.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).dropna().distinct()
    return pairs.join(ids, F.col("parent") == F.col("__id"), "left_semi")


def depths(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, depth), edges left): the longest way from an item without parents. Items are taken off layer by layer; what is left is on a cycle or depends on one. Null ids have no depth."""
    left = stored(_edges(items))
    here = stored(items.select("id").filter("id is not null").distinct())
    done, depth = None, 0
    while True:
        free = stored(here.join(left.select(F.col("child").alias("id")).distinct(), "id", "left_anti"))
        if free.isEmpty():
            break
        layer = free.withColumn("depth", F.lit(depth))
        done = layer if done is None else done.unionByName(layer)
        here = stored(here.join(free, "id", "left_anti"))
        left = stored(left.join(free.select(F.col("id").alias("parent")), "parent", "left_anti").select("child", "parent"))
        depth += 1
    empty = items.select("id").limit(0).withColumn("depth", F.lit(0))
    return done if done is not None else empty, left


def ancestors(edges: DataFrame) -> DataFrame:
    """(child, parent, steps): all pairs that ways along edges join, and the fewest steps; ways double in length each round until no new pair comes."""
    reach = stored(edges.distinct().withColumn("steps", F.lit(1)))
    n = reach.count()
    while True:
        far = reach.select("child", F.col("parent").alias("__m"), F.col("steps").alias("__s"))
        on = reach.select(F.col("child").alias("__c"), "parent", "steps")
        longer = far.join(on, F.col("__m") == F.col("__c")).select("child", "parent", (F.col("__s") + F.col("steps")).alias("steps"))
        new = stored(reach.unionByName(longer).groupBy("child", "parent").agg(F.min("steps").alias("steps")))
        was, n, changed = n, new.count(), not new.exceptAll(reach).isEmpty()
        reach = new
        if n == was and not changed:
            return reach


def cycles(items: DataFrame) -> DataFrame:
    """(id, length): items that are their own ancestors, with the length of the shortest cycle through them. Edges that no way comes to, or goes on from, are taken off in rounds from both ends; only the rest is searched."""
    left = stored(_edges(items))
    n = left.count()
    while n:
        comes = left.select(F.col("child").alias("parent")).distinct()
        goes = left.select(F.col("parent").alias("child")).distinct()
        kept = stored(left.join(goes, "child", "left_semi").join(comes, "parent", "left_semi").select("child", "parent"))
        was, n = n, kept.count()
        left = kept
        if n == was:
            break
    return ancestors(left).filter("child = parent").select(F.col("child").alias("id"), F.col("steps").alias("length"))


def problems(items: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, problem): missing field, unknown kind, repeated id, unknown parent, own ancestor. Null parents count as none."""
    blank = items.filter(F.col("id").isNull() | (F.col("id").cast("string") == "") | F.col("kind").isNull()).select("id", F.lit("missing field").alias("problem"))
    kind = items.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(*kinds)).select("id", F.lit("unknown kind").alias("problem"))
    twice = items.filter("id is not null").groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    pairs = items.select("id", F.explode("parents").alias("parent"))
    lost = pairs.join(items.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("unknown parent").alias("problem")).distinct()
    loop = cycles(items).select("id", F.lit("own ancestor").alias("problem"))
    return blank.unionByName(kind).unionByName(twice).unionByName(lost).unionByName(loop)
