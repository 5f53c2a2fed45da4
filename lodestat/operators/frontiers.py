"""Frontiers in bins of time, bands of their forecasts, and statistics of blocks that may fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.operators.core import small, stored
from lodestat.operators.ranks import quantiles
from lodestat.operators.resample import draws

#: Two-sided 90 % of a normal distribution.
Z90 = 1.6448536269514722


def binned_frontier(df: DataFrame, bin_col: str, value: str, size: str, t: str, tau: float = 0.9, least: int = 20, k: int = 3) -> DataFrame:
    """Per bin: n, sparse (fewer than `least`), quantile, best, mean of the k best, median, rows on or over the quantile, their median size, mean time.

    Rows of a bin are not sorted: quantiles come from running counts of different values, the k best are kept by each task.
    """
    rows = df.select(F.col(bin_col).alias("__b"), F.col(value).cast("double").alias("v"), F.col(size).cast("double").alias("s"), F.col(t).cast("double").alias("t")).filter("v is not null")
    q = stored(quantiles(rows, ["__b"], "v", {"p": tau, "median": 0.5}))
    top = rows.withColumn("nth", F.row_number().over(Window.partitionBy("__b").orderBy(F.desc("v")))).filter(F.col("nth") <= k).groupBy(F.col("__b").alias("b1")).agg(F.avg("v").alias("topk_mean"))
    front = rows.join(small(q.select(F.col("__b").alias("b2"), "p")), F.col("__b") == F.col("b2")).filter("v >= p").select("__b", "s")
    sizes = quantiles(front, ["__b"], "s", {"median_size": 0.5}).select(F.col("__b").alias("b3"), F.col("n").alias("frontier_n"), "median_size")
    one = rows.groupBy(F.col("__b").alias("b4")).agg(F.max("v").alias("best"), F.avg("t").alias("t_mid"))
    out = q
    for side, key in ((top, "b1"), (sizes, "b3"), (one, "b4")):
        out = out.join(small(side), F.col("__b") == F.col(key), "left").drop(key)
    return out.select(F.col("__b").alias("bin"), "n", (F.col("n") < least).alias("sparse"), F.col("p").alias("quantile"), "best", "topk_mean", "median", F.coalesce("frontier_n", F.lit(0)).alias("frontier_n"), "median_size", "t_mid")


def block_slopes(df: DataFrame, block: str, x: str, y: str, replicates: int, seed: int, least: int) -> DataFrame:
    """(replicate, blocks, slope, level) of a line through the rows of drawn blocks; a replicate that draws fewer than `least` different blocks has failed and keeps its row with nulls. Sums by block are drawn, not rows."""
    p = {"n": F.count(y).cast("double"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    units = stored(df.groupBy(block).agg(*[v.alias(k) for k, v in p.items()]))
    s = draws(units, None, block, replicates, seed).groupBy("replicate").agg(F.count_distinct(block).alias("blocks"), *[F.sum(k).alias(k) for k in p])
    slope = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    s = s.withColumn("slope", F.when(F.col("blocks") >= least, slope))
    return s.select("replicate", "blocks", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("level"))


def predictive_bands(rows: DataFrame, block: str, x: str, y: str, anchor: float, scenarios: dict[str, float], horizons: dict[str, float], replicates: int, seed: int, least: int) -> DataFrame:
    """(scenario, horizon, point, boot_low, boot_high, sd_boot, sd_noise, sd_total, pred_low, pred_high, usable): a line carried on from anchor, its spread over resampled blocks, and with the scatter of rows around the line.

    A scenario multiplies a positive slope. Replicates that failed are not used, and counted by that.
    """
    rows = stored(rows)
    fit = rows.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    e = F.col(y) - F.col("a") - F.col("b") * F.col(x)
    noise = rows.join(F.broadcast(fit)).agg(F.stddev_samp(e).alias("sd_noise"))  # one row
    cases = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(float(m)).alias("m"), F.lit(h).alias("horizon"), F.lit(float(v)).alias("h")) for s, m in scenarios.items() for h, v in horizons.items()]))
    ahead = F.col("a") + F.col("b") * anchor + F.col("b") * F.when(F.col("b") > 0, F.col("c.m")).otherwise(1.0) * F.col("c.h")
    point = fit.select("a", "b", cases.alias("c")).select(F.col("c.scenario").alias("ps"), F.col("c.horizon").alias("ph"), ahead.alias("point"))
    boot = block_slopes(rows, block, x, y, replicates, seed, least).filter("slope is not null").select(F.col("level").alias("a"), F.col("slope").alias("b"))
    drawn = stored(boot.select("a", "b", cases.alias("c")).select(F.col("c.scenario").alias("scenario"), F.col("c.horizon").alias("horizon"), ahead.alias("v")))
    q = quantiles(drawn, ["scenario", "horizon"], "v", {"boot_low": 0.05, "boot_high": 0.95}).withColumnRenamed("n", "usable")
    sd = drawn.groupBy(F.col("scenario").alias("ss"), F.col("horizon").alias("sh")).agg(F.stddev_samp("v").alias("sd_boot"))
    out = q.join(small(sd), (F.col("scenario") == F.col("ss")) & (F.col("horizon") == F.col("sh"))).join(small(point), (F.col("scenario") == F.col("ps")) & (F.col("horizon") == F.col("ph"))).join(F.broadcast(noise))  # one row
    total = F.sqrt(F.col("sd_boot") * F.col("sd_boot") + F.col("sd_noise") * F.col("sd_noise"))
    return out.withColumn("sd_total", total).select("scenario", "horizon", "point", "boot_low", "boot_high", "sd_boot", "sd_noise", "sd_total", (F.col("point") - Z90 * F.col("sd_total")).alias("pred_low"), (F.col("point") + Z90 * F.col("sd_total")).alias("pred_high"), "usable")
