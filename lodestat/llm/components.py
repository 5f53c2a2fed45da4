"""Connected components of links between 64-bit nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import cut

MOST_ROUNDS = 60


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the least of u and all v of the same u. Least values are pre-aggregated, and a hot u's links are split by the adaptive join."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return links.join(least.hint("merge"), F.col("u") == F.col("w")).drop("w")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's least node. links: columns a and b; order, repeats and loops are allowed.

    Each round tells, for every node, larger neighbours of the least neighbour (large star), then smaller ones (small star);
    the number of rounds grows as the logarithm of the longest path. Every round is written to the shared folder.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large.filter("u > v"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select(F.col("p.u").alias("u"), F.col("p.v").alias("v")).filter("u > v").distinct()
        now = cut(small, "links")
        was, sign = sign, tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(u, v, 7), 1000000007))")).first())
        if sign == was:
            break
    else:
        raise RuntimeError("the components have not settled; raise MOST_ROUNDS")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
