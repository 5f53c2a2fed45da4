"""Ranks and distributions: mid-rank scores, average ranks, rank correlation, distances between samples, keep-first."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import prefix_sums, small, stored


def value_counts(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, __c, __below, __upto, __total) of distinct values: a frozen reference."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    out = prefix_sums(counts, by, value, "__c")
    totals = out.groupBy(*by).agg(F.sum("__c").alias("__total")).select(*[F.col(c).alias(f"__t_{c}") for c in by], "__total")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    return out.join(small(totals), same).drop(*[f"__t_{c}" for c in by])


def midrank(long: DataFrame, by: list[str], value: str, out: str = "score") -> DataFrame:
    """long with (#smaller + #not larger) / 2n of each value in its group; null stays null. Ranks are taken over distinct values, then joined."""
    ref = value_counts(long, by, value).select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(value).alias("__r"), ((F.col("__below") + F.col("__upto")) / (2 * F.col("__total"))).alias(out))
    same = F.col(value) == F.col("__r")
    for c in by:
        same = same & (F.col(c) == F.col(f"__r_{c}"))
    return long.join(ref, same, "left").drop("__r", *[f"__r_{c}" for c in by])


def midrank_against(ref: DataFrame, obs: DataFrame, by: list[str], value: str, out: str = "score") -> DataFrame:
    """Distinct values of obs with their mid-rank in another, frozen, sample: one union of counts and one prefix sum."""
    one = ref.select(*by, value, F.lit(1).alias("__ref")).unionByName(obs.select(*by, value, F.lit(0).alias("__ref"))).filter(F.col(value).isNotNull())
    counts = one.groupBy(*by, value).agg(F.sum("__ref").alias("__n"), F.count_if(F.col("__ref") == 0).alias("n_obs"))
    ranked = prefix_sums(counts, by, value, "__n")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total")).select(*[F.col(c).alias(f"__t_{c}") for c in by], "__total")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    return ranked.join(small(totals), same).filter("n_obs > 0").select(*by, value, "n_obs", ((F.col("__below") + F.col("__upto")) / (2 * F.col("__total"))).alias(out))


def average_ranks(long: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """long with average-tie ranks from 1."""
    ref = value_counts(long, by, value).select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(value).alias("__r"), (F.col("__below") + (F.col("__c") + 1) / 2).alias(out))
    same = F.col(value) == F.col("__r")
    for c in by:
        same = same & (F.col(c) == F.col(f"__r_{c}"))
    return long.join(ref, same, "left").drop("__r", *[f"__r_{c}" for c in by])


def spearman_pairs(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """(a, b, rho) of all pairs of names; null where one is constant. Ranks once, then all pairs in one aggregation."""
    ranked = average_ranks(long, [name], value)
    wide = ranked.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col("rank"))).alias(n) for n in names])
    pairs = list(combinations(names, 2))
    stats = wide.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])
    return stats.select(F.explode(rows).alias("p")).select("p.*")


def distances(long: DataFrame, by: list[str], sample: str, first: str, second: str, value: str) -> DataFrame:
    """(by, ks, wasserstein) between two samples: running counts over distinct values, their largest gap and the area between them."""
    counts = long.filter(F.col(sample).isin(first, second) & F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(sample) == first).alias("__a"), F.count_if(F.col(sample) == second).alias("__b"))
    ranked = prefix_sums(counts, by, value, ["__a", "__b"], following=True)
    totals = counts.groupBy(*by).agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb")).select(*[F.col(c).alias(f"__t_{c}") for c in by], "__na", "__nb")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    gap = F.abs(F.col("__upto___a") / F.col("__na") - F.col("__upto___b") / F.col("__nb"))
    ranked = ranked.join(small(totals), same)
    return ranked.groupBy(*by).agg(F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("__next") - F.col(value))), F.lit(0.0)).alias("wasserstein"))


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(by, n, a column for each of probs): exact quantiles, between order statistics by proportion. Null values do not count.

    The order statistics are looked up among running counts of distinct values, so no task holds the values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    ranked = stored(prefix_sums(counts, by, value, "__c"))
    n = ranked.groupBy(*by).agg(F.sum("__c").alias("n")).select(*[F.col(c).alias(f"__t_{c}") for c in by], "n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    at = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in probs.items()}
    stands = lambda place: F.max(F.when((F.col("__below") <= place) & (place < F.col("__upto")), F.col(value)))
    found = ranked.join(small(n), same).groupBy(*by, "n").agg(*[stands(g(h)).alias(f"__{w}_{k}") for k, h in at.items() for w, g in (("low", F.floor), ("high", F.ceil))])
    return found.select(*by, "n", *[(F.col(f"__low_{k}") + (h - F.floor(h)) * (F.col(f"__high_{k}") - F.col(f"__low_{k}"))).alias(k) for k, h in at.items()])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Reduced in every task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)
