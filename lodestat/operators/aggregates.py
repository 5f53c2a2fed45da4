"""Aggregations: profiles, variance decomposition, rule ledgers, frontiers, prediction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.operators.core import small, stored
from lodestat.operators.ranks import quantiles


def profile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, missing, median, quartiles, sample variance and deviation by group."""
    df = stored(df)
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("sd"))
    q = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n").select(*[F.col(c).alias(f"__q_{c}") for c in by], "q1", "median", "q3")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__q_{c}"))
    return sums.join(small(q), same, "left").select(*by, "n", "missing", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "variance", "sd")


def icc(df: DataFrame, group: str, item: str, value: str, least_items: int = 2) -> DataFrame:
    """Between, within and total sums of squares over groups with at least so many distinct items, and the share between. Two levels of sums, no windows."""
    each = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count_distinct(item).alias("__items"), F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")).filter(F.col("__items") >= least_items)
    out = each.agg(F.count("*").alias("groups"), F.sum("n").alias("observations"), (F.sum("ss") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("within"), (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"))
    return out.withColumn("total", F.col("within") + F.col("between")).withColumn("icc", F.try_divide("between", "total"))


def ledger(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, fails_alone, removed_in_sequence) in one pass; a rule that is null fails."""
    fails = [~F.coalesce(ok, F.lit(False)) for _, ok in rules]
    first = F.coalesce(*[F.when(f, name) for (name, _), f in zip(rules, fails, strict=True)], F.lit("kept"))
    one = df.agg(*[F.count_if(f).alias(f"f_{name}") for (name, _), f in zip(rules, fails, strict=True)], *[F.count_if(first == name).alias(f"s_{name}") for name, _ in rules], F.count_if(first == "kept").alias("kept"))
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("fails_alone"), F.col(f"s_{name}").alias("removed_in_sequence")) for name, _ in rules]
    rows.append(F.struct(F.lit("kept").alias("rule"), F.lit(0).cast("bigint").alias("fails_alone"), F.col("kept").alias("removed_in_sequence")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def frontier(df: DataFrame, month: str, value: str, k: int = 10, sparse: int = 20) -> DataFrame:
    """n, sparse, p90, best, mean of the k best, median by month. The k best are kept by a bounded aggregate, not collected."""
    df = stored(df)
    q = quantiles(df, [month], value, {"median": 0.5, "p90": 0.9}).select(F.col(month).alias("__q"), "median", "p90")
    per = df.groupBy(month).agg(F.count(value).alias("n"), F.max(value).alias("best")).join(small(q), F.col(month).eqNullSafe(F.col("__q")), "left")
    counts = df.groupBy(month, value).agg(F.count("*").alias("__c"))
    # enough for the k best: values that fewer than k rows exceed; the limit by value keeps k distinct ones at most
    w = Window.partitionBy(month).orderBy(F.desc(value))
    top = counts.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)  # pushed below the shuffle as a group limit
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("__use", F.greatest(F.lit(0), F.least(F.col("__c"), F.lit(k) - F.coalesce(upto, F.lit(0)))))
    top = top.groupBy(F.col(month).alias("__m")).agg((F.sum(F.col(value) * F.col("__use")) / F.sum("__use")).alias("top_mean"))
    return per.join(small(top), F.col(month).eqNullSafe(F.col("__m")), "left").select(month, "n", (F.col("n") < sparse).alias("sparse"), "p90", "best", "top_mean", "median")


def metrics(df: DataFrame, by: list[str], obs: str, pred: str) -> DataFrame:
    """n, mae, rmse, r2 (null if all observed are equal), mean relative errors (null if any observed is zero)."""
    e, o = F.col(pred) - F.col(obs), F.col(obs)
    sse, sst = F.sum(e * e), F.sum(o * o) - F.sum(o) * F.sum(o) / F.count(obs)
    whole = F.every(o != 0)
    return df.groupBy(*by).agg(
        F.count(obs).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.stddev_pop(obs) > 0, 1 - F.try_divide(sse, sst)).alias("r2"), F.when(whole, F.avg(F.try_divide(e, F.abs(o)))).alias("mean_relative"), F.when(whole, F.avg(F.abs(F.try_divide(e, o)))).alias("mean_absolute_relative")
    )


def shape_errors(df: DataFrame, by: list[str], obs: str, pred: str) -> DataFrame:
    """n, rmse, mean error, error without it, and predictions that are not positive."""
    e = F.col(pred) - F.col(obs)
    return df.groupBy(*by).agg(F.count(obs).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("level_shift"), F.stddev_pop(e).alias("centred_rmse"), F.count_if(F.col(pred) <= 0).alias("not_positive"))
