"""Bootstrap with draws that hashes decide: any engine, partitioning or rerun draws the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions.columns import hash_draw, poisson_number, uniform
from lodestat.operators.core import small, stored
from lodestat.operators.ranks import quantiles


def draws(units: DataFrame, group: str | None, unit: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, group, unit drawn) with as many draws as units. units: one row a unit, grouped beforehand, so few."""
    by = [group] if group else []
    order = Window.partitionBy(*by).orderBy(unit)
    slots = units.withColumn("__slot", F.row_number().over(order) - 1).withColumn("__k", F.count("*").over(Window.partitionBy(*by)))
    each = slots.select(*by, "__slot", "__k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = each.select(*by, "replicate", hash_draw(seed, F.col("replicate"), F.col("__slot"), F.col("__k")).alias("__pos"))
    pool = slots.select(*[F.col(c).alias(f"__p_{c}") for c in by], F.col("__slot").alias("__p_slot"), *[c for c in slots.columns if c not in (*by, "__slot", "__k")])
    same = F.col("__pos") == F.col("__p_slot")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return each.join(small(pool), same).drop("__pos", "__p_slot", *[f"__p_{c}" for c in by])


def ratio_interval(clusters: DataFrame, group: str, unit: str, total: str, count: str, replicates: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, mean, low, high, replicates) of sum(total) / sum(count) with units resampled in each group."""
    boot = draws(clusters.select(group, unit, total, count), group, unit, replicates, seed).groupBy(group, "replicate").agg((F.sum(total) / F.sum(count)).alias("__m"))
    boot = quantiles(boot, [group], "__m", {"low": low, "high": high}).withColumnRenamed("n", "replicates")
    mean = clusters.groupBy(F.col(group).alias("__g")).agg((F.sum(total) / F.sum(count)).alias("mean"))
    return boot.join(small(mean), F.col(group).eqNullSafe(F.col("__g"))).select(group, "mean", "low", "high", "replicates")


def bootstrap(units: DataFrame, unit: str, statistic: Callable[[pd.DataFrame], dict[str, float]], names: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, names...) of any statistic of the drawn units' rows, replicates in parallel; a replicate in which it fails has nulls. units: summed beforehand, so that one replicate fits a task."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            found = statistic(rows.drop(columns="replicate"))
        except (ValueError, ZeroDivisionError, ArithmeticError):
            found = {}
        return pd.DataFrame([{"replicate": rows["replicate"].iloc[0], **{n: found.get(n) for n in names}}])

    schema = "replicate int, " + ", ".join(f"{n} double" for n in names)
    return draws(units, None, unit, replicates, seed).groupBy("replicate").applyInPandas(one, schema)


#: Draws (rows times replicates) of about one task: a second of work.
TASK_DRAWS = 500_000


def weighted(rows: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """rows times replicates with `__rep` and `__w`, the Poisson number that the key's hash decides.

    A file of many rows may be one task's; rows are dealt out first, so that tasks grow in number with them and not in length. Each hash is computed once.
    """
    tasks = -(-rows.count() * replicates // TASK_DRAWS)
    each = (rows.repartition(tasks) if tasks > 1 else rows).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.withColumn("__u", uniform(seed, F.col("__rep"), F.col(key)))  # a column of its own, which the branches of the number share
    return each.withColumn("__w", poisson_number(F.col("__u"))).drop("__u")


def row_interval(df: DataFrame, by: list[str], key: str, value: str, replicates: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, replicates, mean, low, high) of the mean of value with rows resampled: each row weighs by a Poisson number that its key's hash decides, so tasks sum all replicates of their rows."""
    each = weighted(df.select(*by, F.col(key).alias("__k"), F.col(value).alias("__v")), "__k", replicates, seed)
    boot = each.groupBy(*by, "__rep").agg(F.try_divide(F.sum(F.col("__w") * F.col("__v")), F.sum("__w")).alias("__m"))
    q = quantiles(boot, by, "__m", {"low": low, "high": high}).withColumnRenamed("n", "replicates")
    mean = df.groupBy(*[F.col(c).alias(f"__g_{c}") for c in by]).agg(F.avg(value).alias("mean"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return q.join(small(mean), same).select(*by, "replicates", "mean", "low", "high")


def overlap_interval(first: DataFrame, second: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(identities, shared, clashes, difference, low, high) of mean(first) - mean(second), the union of identities resampled. A clash is a shared identity with two values; the first's counts."""
    a, b = first.select(F.col(key).alias("__ka"), F.col(value).alias("__va")), second.select(F.col(key).alias("__kb"), F.col(value).alias("__vb"))
    u = a.join(b, F.col("__ka") == F.col("__kb"), "full")
    ina, inb = F.col("__ka").isNotNull(), F.col("__kb").isNotNull()
    u = stored(u.select(F.coalesce("__ka", "__kb").alias("k"), F.coalesce("__va", "__vb").alias("v"), ina.alias("a"), inb.alias("b"), (ina & inb & ~F.col("__va").eqNullSafe(F.col("__vb"))).alias("clash")))
    each = weighted(u.select("k", "v", "a", "b"), "k", replicates, seed)
    mean = lambda c: F.try_divide(F.sum(F.when(F.col(c), F.col("__w") * F.col("v"))), F.sum(F.when(F.col(c), F.col("__w"))))
    q = quantiles(each.groupBy("__rep").agg((mean("a") - mean("b")).alias("d")), [], "d", {"low": 0.025, "high": 0.975}).drop("n")
    point = u.agg(F.count("*").alias("identities"), F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if("clash").alias("clashes"), (F.avg(F.when(F.col("a"), F.col("v"))) - F.avg(F.when(F.col("b"), F.col("v")))).alias("difference"))
    return point.join(F.broadcast(q))  # one row by one row


def forecast(df: DataFrame, t: str, y: str, scenarios: dict[str, float], horizons: list[int], replicates: int, seed: int) -> DataFrame:
    """(scenario, horizon, central, low, high, noise_sd): a linear trend from its last time on. A scenario multiplies the rate, if that is positive; bands come from rows resampled. df: grouped rows, one a time."""
    fit = df.agg(F.max(t).alias("last"), F.regr_slope(y, t).alias("g"), F.regr_intercept(y, t).alias("a"))
    each = df.join(F.broadcast(fit))  # one row
    e = F.col(y) - F.col("a") - F.col("g") * F.col(t)
    noise = each.agg(F.sqrt(F.sum(e * e) / (F.count("*") - 2)).alias("noise_sd"))
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(m)).alias("mult"), F.lit(h).alias("horizon")) for k, m in scenarios.items() for h in horizons])).alias("c")
    ahead = lambda: F.col("a") + F.col("g") * F.col("last") + F.col("g") * F.when(F.col("g") > 0, F.col("mult")).otherwise(1.0) * F.col("horizon")
    central = fit.select("a", "g", "last", cases).select("a", "g", "last", "c.*").select("scenario", "horizon", ahead().alias("central"))
    boot = draws(df, None, t, replicates, seed).groupBy("replicate").agg(F.regr_slope(y, t).alias("g"), F.regr_intercept(y, t).alias("a"))
    boot = boot.join(F.broadcast(fit.select("last"))).select("a", "g", "last", cases).select("a", "g", "last", "c.*").select("scenario", "horizon", ahead().alias("v"))
    q = quantiles(boot, ["scenario", "horizon"], "v", {"low": 0.025, "high": 0.975}).drop("n")
    return q.join(small(central), ["scenario", "horizon"]).join(F.broadcast(noise))


def leave_level_out(df: DataFrame, level: str, x: str, y: str) -> DataFrame:
    """(level, n, slope, rmse, baseline_rmse): each level predicted by a line, and by the mean, of the other levels. One aggregation by level; levels are few."""
    p = {"n": F.count(y), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y)), "syy": F.sum(F.col(y) * F.col(y))}
    s = stored(df.groupBy(level).agg(*[v.alias(k) for k, v in p.items()]))
    j = s.join(F.broadcast(s.agg(*[F.sum(k).alias(f"t_{k}") for k in p])))  # one row
    c = {k: F.col(k) for k in p}
    r = {k: F.col(f"t_{k}") - F.col(k) for k in p}
    slope = (r["sxy"] - r["sx"] * r["sy"] / r["n"]) / (r["sxx"] - r["sx"] * r["sx"] / r["n"])
    j = j.withColumn("slope", slope).withColumn("mean", r["sy"] / r["n"]).withColumn("level_", (r["sy"] - F.col("slope") * r["sx"]) / r["n"])
    a, b = F.col("level_"), F.col("slope")
    line = c["syy"] - 2 * (a * c["sy"] + b * c["sxy"]) + c["n"] * a * a + 2 * a * b * c["sx"] + b * b * c["sxx"]
    flat = c["syy"] - 2 * F.col("mean") * c["sy"] + c["n"] * F.col("mean") * F.col("mean")
    root = lambda v: F.sqrt(F.greatest(F.lit(0.0), v) / c["n"])
    return j.select(level, "n", "slope", root(line).alias("rmse"), root(flat).alias("baseline_rmse"))


def jackknife(df: DataFrame, by: list[str], block: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(by, left_out, slope, lowest, highest, jackknife_se, same_sign) of a line's slope with each block left out; blocks that leave fewer than `least` rows are not."""
    p = {"n": F.count(y), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    s = stored(df.groupBy(*by, block).agg(*[v.alias(k) for k, v in p.items()]))
    t = s.groupBy(*[F.col(c).alias(f"__g_{c}") for c in by]).agg(*[F.sum(k).alias(f"t_{k}") for k in p])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    slope = lambda v: F.try_divide(v["sxy"] - v["sx"] * v["sy"] / v["n"], v["sxx"] - v["sx"] * v["sx"] / v["n"])
    j = s.join(small(t), same).filter(F.col("t_n") - F.col("n") >= least)
    j = j.withColumn("b", slope({k: F.col(f"t_{k}") for k in p})).withColumn("o", slope({k: F.col(f"t_{k}") - F.col(k) for k in p}))
    low, high = F.min("o"), F.max("o")
    return j.groupBy(*by).agg(F.count("*").alias("left_out"), F.first("b").alias("slope"), low.alias("lowest"), high.alias("highest"), F.sqrt((F.count("*") - 1) * F.var_pop("o")).alias("jackknife_se"), (low * high > 0).alias("same_sign"))
