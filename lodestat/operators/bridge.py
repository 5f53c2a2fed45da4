"""A bridge from one measure to another: lines, errors at groups that the fit has not seen, predictions with all errors that they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import small, stored


def leave_group_out(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, level, slope, rmse, mae, mean_error): each group predicted by a line through the rows of all others. Sums by group, taken off the sums of all; then one pass of errors. A group that leaves no line has nulls."""
    rows = df.select(F.col(group).alias("__g"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna(subset=["__x", "__y"])
    mean = rows.agg(F.avg("__x").alias("mx"), F.avg("__y").alias("my"))
    rows = stored(rows.join(F.broadcast(mean)).select("__g", (F.col("__x") - F.col("mx")).alias("__x"), (F.col("__y") - F.col("my")).alias("__y"), "mx", "my"))  # one row: centred, so that sums keep their digits
    parts = {"n": F.count("*"), "sx": F.sum("__x"), "sy": F.sum("__y"), "sxx": F.sum(F.col("__x") * F.col("__x")), "sxy": F.sum(F.col("__x") * F.col("__y"))}
    s = stored(rows.groupBy("__g").agg(*[v.alias(k) for k, v in parts.items()], F.first("mx").alias("mx"), F.first("my").alias("my")))
    t = s.agg(*[F.sum(k).alias(f"t_{k}") for k in parts])
    j = s.join(F.broadcast(t)).select("__g", "mx", "my", *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in parts])  # one row
    slope = F.when(F.col("n") >= 2, F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")))
    j = j.withColumn("slope", slope).withColumn("at", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    j = j.select(F.col("__g").alias("__k"), "at", "slope", (F.col("at") + F.col("my") - F.col("slope") * F.col("mx")).alias("level"))
    e = F.col("at") + F.col("slope") * F.col("__x") - F.col("__y")
    out = rows.join(small(j), F.col("__g").eqNullSafe(F.col("__k")))
    return out.groupBy(F.col("__g").alias(group)).agg(F.count("*").alias("n"), F.first("level").alias("level"), F.first("slope").alias("slope"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"))


def block_error(errors: DataFrame) -> DataFrame:
    """(n, rmse, mae, groups) over all groups of leave_group_out, each row as one."""
    return errors.filter("slope is not null").agg(F.sum("n").alias("n"), F.sqrt(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")) / F.sum("n")).alias("rmse"), (F.sum(F.col("n") * F.col("mae")) / F.sum("n")).alias("mae"), F.count("*").alias("groups"))


def prediction(loss: Column, loss_sd: Column, form: str, a: float, b: float, predictive_sd: float, low: float, high: float) -> tuple[Column, Column]:
    """(mean, sd) of the bridge's value at a loss: constant a, linear a + b loss, or logit 100 / (1 + exp(-(a + b loss))).

    sd is that of the bridge's own errors and of the loss carried through the slope, together: neither can be left out. A loss outside [low, high], which the bridge was fitted on, has nulls.
    """
    if not predictive_sd > 0:
        raise ValueError("a bridge without an error of its own cannot give bands")
    if form == "constant":
        mean, slope = F.lit(float(a)), F.lit(0.0)
    elif form == "linear":
        mean, slope = F.lit(float(a)) + F.lit(float(b)) * loss, F.lit(float(b))
    elif form == "logit":
        mean = 100 / (1 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * loss)))
        slope = F.lit(float(b)) * mean * (100 - mean) / 100
    else:
        raise ValueError(f"no form {form!r}")
    inside = (loss >= low) & (loss <= high)
    return F.when(inside, mean), F.when(inside, F.sqrt(F.lit(predictive_sd * predictive_sd) + F.pow(slope * loss_sd, 2)))
