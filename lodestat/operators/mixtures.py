"""Mixtures of domains: features of a response surface, coefficient maps, substitution effects, bounded power fits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def response_features(shares: list[str], reference: str, pairs: bool) -> dict[str, Column]:
    """Name and column of each feature: the shares but the reference, and with `pairs` the product of each pair of shares."""
    out = {c: F.col(c) for c in shares if c != reference}
    return out | ({f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(shares, 2)} if pairs else {})


def reference_domain(designs: DataFrame, shares: list[str]) -> DataFrame:
    """(domain, prevalence, sd, is_reference): the reference has the largest prevalence times spread, the first of equals. One aggregation."""
    one = designs.agg(*[f.alias(f"{k}_{c}") for c in shares for k, f in (("n", F.avg((F.col(c) > 0).cast("int"))), ("s", F.stddev_pop(c)))])
    worth = F.array(*[F.col(f"n_{c}") * F.col(f"s_{c}") for c in shares])
    best = F.array_position(worth, F.array_max(worth)) - 1
    rows = F.array(*[F.struct(F.lit(c).alias("domain"), F.col(f"n_{c}").alias("prevalence"), F.col(f"s_{c}").alias("sd"), (best == i).alias("is_reference")) for i, c in enumerate(shares)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _term(name: str, shares: dict[str, Column]) -> Column:
    if name == "__intercept__":
        return F.lit(1.0)
    if name.startswith("interaction:"):
        a, b = name.removeprefix("interaction:").split("*")
        return shares[a] * shares[b]
    return shares[name]


def predict(surface: dict[str, float], shares: dict[str, Column]) -> Column:
    """The surface at a design: coefficients by __intercept__, domain, or interaction:a*b."""
    terms = [F.lit(float(v)) * _term(k, shares) for k, v in surface.items()]
    return sum(terms[1:], terms[0])


def substitution(surface: dict[str, float], shares: dict[str, Column], source: str, target: str, amount: float) -> Column:
    """What moving `amount` of share from source to target changes; null where the design would leave the simplex."""
    moved = shares | {source: shares[source] - amount, target: shares[target] + amount}
    return F.when((moved[source] >= 0) & (moved[target] <= 1), predict(surface, moved) - predict(surface, shares))


def decode(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """A column of coefficient maps as rows (the columns to keep, kind, a, b, coefficient), for joins with long shares."""
    keep = keep or []
    e = df.select(*keep, F.explode(F.map_entries(column)).alias("e")).select(*keep, "e.key", "e.value")
    pair = F.split(F.expr("substring(key, 13)"), r"\*")
    inter, inner = F.col("key").startswith("interaction:"), F.col("key") == "__intercept__"
    return e.select(*keep, F.when(inner, "intercept").when(inter, "interaction").otherwise("linear").alias("kind"), F.when(inter, pair[0]).when(~inner, F.col("key")).alias("a"), F.when(inter, pair[1]).alias("b"), F.col("value").alias("coefficient"))


def power_profile(df: DataFrame, n: str, y: str, exponents: list[float]) -> DataFrame:
    """(c, a, b, rss) of y = a + b n^-c for each exponent: lines, all from one aggregation over df, which is grouped by n."""
    each = df.select(n, y, F.explode(F.array(*[F.lit(float(c)) for c in exponents])).alias("c")).withColumn("__x", F.pow(F.col(n), -F.col("c")))
    return each.groupBy("c").agg(F.regr_intercept(y, "__x").alias("a"), F.regr_slope(y, "__x").alias("b"), (F.regr_syy(y, "__x") * (1 - F.coalesce(F.regr_r2(y, "__x"), F.lit(0.0)))).alias("rss"))
