"""Uncertainty of a law's fit: parts left out, clusters resampled, a parameter held. Every refit is a task of its own over the same grouped data, from a warm start.

The law is E + A n^-alpha + B (q^gamma d)^-beta, without q if data has none. Parameters are logarithms of A, B and E, then alpha, beta and gamma, as in optim.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators.optim import BOUNDS, DELTA, MOST_ROWS, QUALITY_BOUNDS, minimise, objective, quality_objective

NAMES = ["A", "B", "E", "alpha", "beta", "gamma"]
#: Steps from the anchor, of each parameter, at which two more starts of a refit lie.
STEP = np.array([0.3, 0.3, 0.05, 0.02, 0.02, 0.05])


def natural(theta: np.ndarray) -> list[float]:
    return [*np.exp(theta[:3]).tolist(), *theta[3:].tolist()]


def anchor(law: dict[str, float]) -> np.ndarray:
    return np.array([*(np.log(law[k]) for k in NAMES[:3]), *(law[k] for k in NAMES[3:] if k in law)])


class Points:
    """Grouped data: logarithms of n, d, loss (and q), weights, and the unit that each row belongs to."""

    def __init__(self, columns: dict[str, np.ndarray], unit: np.ndarray) -> None:
        self.c, self.unit, self.quality = columns, unit, "q" in columns
        self.bounds = QUALITY_BOUNDS if self.quality else BOUNDS

    def value(self, theta: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        c = self.c
        return quality_objective(theta, c["n"], c["d"], c["q"], c["l"], w) if self.quality else objective(theta, c["n"], c["d"], c["l"], w)

    def model(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log residuals and their derivatives by the parameters."""
        c, a, b, e, alpha, beta = self.c, *theta[:5]
        d = c["d"] + theta[5] * c["q"] if self.quality else c["d"]
        z = np.stack([a - alpha * c["n"], b - beta * d, np.full_like(d, e)])
        top = z.max(axis=0)
        ex = np.exp(z - top)
        p = ex / ex.sum(axis=0)
        jac = [p[0], p[1], p[2], -p[0] * c["n"], -p[1] * d, *([-p[1] * beta * c["q"]] if self.quality else [])]
        return top + np.log(ex.sum(axis=0)) - c["l"], np.stack(jac, axis=1)

    def fit(self, begin: np.ndarray, w: np.ndarray, held: dict[int, float] | None = None, spread: bool = True) -> tuple[np.ndarray, float]:
        """The best of the fits from begin and two points beside it, finished by weighted Gauss-Newton steps; held parameters stay."""
        held, step = held or {}, STEP[: len(begin)]
        free = [i for i in range(len(begin)) if i not in held]
        full = begin.copy()
        for i, v in held.items():
            full[i] = v

        def whole(part: np.ndarray) -> np.ndarray:
            out = full.copy()
            out[free] = part
            return out

        def reduced(part: np.ndarray) -> tuple[float, np.ndarray]:
            value, g = self.value(whole(part), w)
            return value, g[free]

        best = None
        for start in (full, full + step, full - step) if spread else (full,):
            x, value, _ = minimise(reduced, start[free], self.bounds[free])
            if best is None or value < best[1]:
                best = (x, value)
        x, value = best
        for _ in range(50):  # the objective is smooth near the optimum, where these steps gain the last digits
            r, jac = self.model(whole(x))
            weight = w * np.minimum(1.0, DELTA / np.maximum(np.abs(r), 1e-300))
            left = jac[:, free] * np.sqrt(weight)[:, None]
            move = np.linalg.lstsq(left, np.sqrt(weight) * r, rcond=1e-13)[0]
            new = np.clip(x - move, self.bounds[free, 0], self.bounds[free, 1])
            other = self.value(whole(new), w)[0]
            if not other < value:
                break
            x, value = new, other
        return whole(x), value


def collected(data: DataFrame, n: str, d: str, loss: str, q: str | None = None, unit: str | None = None, weight: str | None = None) -> tuple[Points, list, DataFrame]:
    """(points, units in order): data grouped to different values of each unit, at most MOST_ROWS of them. Rows without a logarithm are an error."""
    names = {"n": n, "d": d, "l": loss} | ({"q": q} if q else {})
    rows = data.select(*[F.log(F.col(v)).alias(k) for k, v in names.items()], (F.col(unit) if unit else F.lit(0)).alias("u"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    rows = rows.groupBy("u", *names).agg(F.sum("w").alias("w"))
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"group the data to at most {MOST_ROWS} rows")
    got = rows.orderBy("u", *names).toPandas()
    if got[[*names, "w"]].isna().to_numpy().any():
        raise ValueError("sizes, data, quality and losses must be positive")
    units = sorted(got["u"].unique().tolist())
    place = {u: i for i, u in enumerate(units)}
    return Points({k: got[k].to_numpy(float) for k in names} | {"w": got["w"].to_numpy(float)}, got["u"].map(place).to_numpy()), units


def _each(spark: SparkSession, tasks: DataFrame, points: Points, work: callable, schema: str) -> DataFrame:
    """work(points, row) of each row of tasks, one or few a task."""
    sent = spark.sparkContext.broadcast(points)  # at most MOST_ROWS rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([work(sent.value, row) for row in part.to_dict("records")], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return tasks.repartition(min(64, max(1, tasks.count()))).mapInPandas(run, schema)


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def leave_out(data: DataFrame, begin: np.ndarray, unit: str, n: str, d: str, loss: str, q: str | None = None, weight: str | None = None) -> DataFrame:
    """(left_out, rows, objective, rmse_out, parameters): the law fitted without each value of unit, and the root mean square of its log residuals over what was left out."""
    points, units = collected(data, n, d, loss, q, unit, weight)
    spark, names = data.sparkSession, NAMES[: len(begin)]
    kind = data.schema[unit].dataType.simpleString()

    def work(points: Points, row: dict) -> tuple:
        out = points.unit == row["place"]
        theta, value = points.fit(begin, np.where(out, 0.0, points.c["w"]))
        r, w = points.model(theta)[0][out], points.c["w"][out]
        return (row["left_out"], float(points.c["w"][~out].sum()), value, float(np.sqrt((w * r * r).sum() / w.sum())), *natural(theta))

    tasks = spark.createDataFrame([(u, i) for i, u in enumerate(units)], f"left_out {kind}, place int")
    return _each(spark, tasks, points, work, f"left_out {kind}, rows double, objective double, rmse_out double, {_doubles(names)}")


def profile(data: DataFrame, begin: np.ndarray, factors: list[float], n: str, d: str, loss: str, q: str | None = None, weight: str | None = None) -> DataFrame:
    """(parameter, factor, held, objective, excess, parameters): one parameter held at factor times the fit's, the others fitted again, and by how much the objective exceeds the fit's."""
    points, _ = collected(data, n, d, loss, q, None, weight)
    spark, names = data.sparkSession, NAMES[: len(begin)]
    full, base = points.fit(begin, points.c["w"])

    def work(points: Points, row: dict) -> tuple:
        i = names.index(row["parameter"])
        value = full[i] + np.log(row["factor"]) if i < 3 else full[i] * row["factor"]
        theta, found = points.fit(full, points.c["w"], {i: value})
        return (row["parameter"], row["factor"], natural(theta)[i], found, found - base, *natural(theta))

    tasks = spark.createDataFrame([(p, float(f)) for p in names for f in factors], "parameter string, factor double")
    return _each(spark, tasks, points, work, f"parameter string, factor double, held double, objective double, excess double, {_doubles(names)}")


def resampled(data: DataFrame, begin: np.ndarray, weights: DataFrame, unit: str, n: str, d: str, loss: str, q: str | None = None) -> DataFrame:
    """(replicate, failed, objective, parameters): the law fitted with each unit weighed by how often a replicate has drawn it. weights: (replicate, unit, times). A replicate with fewer than three sizes fails; it has a row without parameters."""
    points, units = collected(data, n, d, loss, q, unit)
    spark, names = data.sparkSession, NAMES[: len(begin)]
    place = {u: i for i, u in enumerate(units)}

    def work(points: Points, row: dict) -> tuple:
        times = np.zeros(len(units))
        for u, k in zip(row["units"], row["times"], strict=True):
            times[place[u]] = k
        w = points.c["w"] * times[points.unit]
        if len(np.unique(points.c["n"][w > 0])) < 3:
            return (row["replicate"], True, None, *[None] * len(names))
        theta, value = points.fit(begin, w, spread=False)
        return (row["replicate"], False, value, *natural(theta))

    pairs = weights.groupBy("replicate").agg(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("times").cast("double").alias("k"))).alias("p"))  # at most a row a unit
    tasks = pairs.select("replicate", F.col("p.u").alias("units"), F.col("p.k").alias("times"))
    return _each(spark, tasks, points, work, f"replicate int, failed boolean, objective double, {_doubles(names)}")
