"""Fits without closed forms: starts, replicates and left-out parts run in parallel, one NumPy fit a task group. Data of a fit is grouped beforehand and bounded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA = 1e-3
#: Logarithms of A, B, E, then the exponents.
BOUNDS = np.array([[-20, 40], [-20, 40], [-10, 3], [1e-3, 3], [1e-3, 3]], float)
#: Rows of grouped data that a fit takes; more are an error, as another grouping would be another fit.
MOST_ROWS = 200_000


def starts() -> list[tuple[float, ...]]:
    return list(product((0, 5, 10), (0, 5, 10), (-1, 0, 0.5), (0.3, 0.5), (0.3, 0.5)))


def objective(theta: np.ndarray, ln_n: np.ndarray, ln_d: np.ndarray, ln_l: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted Huber loss of log residuals, and its gradient."""
    a, b, e, alpha, beta = theta
    z = np.stack([a - alpha * ln_n, b - beta * ln_d, np.full_like(ln_n, e)])
    m = z.max(axis=0)
    ex = np.exp(z - m)
    total = ex.sum(axis=0)
    r = m + np.log(total) - ln_l
    q = np.clip(r, -DELTA, DELTA) * w
    p = ex / total
    loss = float((w * np.where(np.abs(r) <= DELTA, 0.5 * r * r, DELTA * (np.abs(r) - 0.5 * DELTA))).sum())
    return loss, np.array([(q * p[0]).sum(), (q * p[1]).sum(), (q * p[2]).sum(), -(q * p[0] * ln_n).sum(), -(q * p[1] * ln_d).sum()])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, bounds: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float, int]:
    """Projected BFGS with backtracking in a box."""
    x = np.clip(np.asarray(x, float), bounds[:, 0], bounds[:, 1])
    value, g = f(x)
    h = np.eye(len(x))
    for step in range(steps):
        fixed = ((x <= bounds[:, 0]) & (g > 0)) | ((x >= bounds[:, 1]) & (g < 0))
        d = -h @ np.where(fixed, 0, g)
        d[fixed] = 0
        if g @ d >= 0:
            h, d = np.eye(len(x)), -np.where(fixed, 0, g)
        if np.abs(d).max(initial=0) < 1e-14:
            return x, value, step
        size = 1.0
        while size > 1e-14:
            new = np.clip(x + size * d, bounds[:, 0], bounds[:, 1])
            other, og = f(new)
            if other <= value + 1e-4 * g @ (new - x) and other < value:
                break
            size /= 2
        else:
            if np.array_equal(h, np.eye(len(x))):
                return x, value, step
            h = np.eye(len(x))
            continue
        s, y = new - x, og - g
        if (sy := s @ y) > 1e-300:
            rho, eye = 1 / sy, np.eye(len(x))
            h = (eye - rho * np.outer(s, y)) @ h @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        done = value - other < 1e-16 * max(1, abs(value)) and np.abs(s).max() < 1e-12
        x, value, g = new, other, og
        if done:
            break
    return x, value, steps


def fit_law(spark: SparkSession, data: DataFrame, n: str, d: str, loss: str, weight: str | None = None) -> DataFrame:
    """(start, objective, A, B, E, alpha, beta): one row a start of the law E + A n^-alpha + B d^-beta; take the least objective. data is grouped to the rows' own values, of which there may be MOST_ROWS, and collected once."""
    rows = data.select(F.log(n).alias("n"), F.log(d).alias("d"), F.log(loss).alias("l"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    rows = rows.groupBy("n", "d", "l").agg(F.sum("w").alias("w"))
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"group the data to at most {MOST_ROWS} rows")
    rows = rows.orderBy("n", "d", "l").toPandas()
    sent = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in "ndlw"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ln_n, ln_d, ln_l, w = sent.value
        for part in parts:
            out = []
            for s in part.itertuples(index=False):
                x, value, _ = minimise(lambda t: objective(t, ln_n, ln_d, ln_l, w), np.array(s[1:]), BOUNDS)
                out.append((s[0], value, *np.exp(x[:3]), *x[3:]))
            yield pd.DataFrame(out, columns=["start", "objective", "A", "B", "E", "alpha", "beta"])

    grid = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(starts())], "start int, a double, b double, e double, alpha double, beta double").repartition(16)
    return grid.mapInPandas(run, "start int, objective double, A double, B double, E double, alpha double, beta double")


def quantile_line(x: np.ndarray, y: np.ndarray, tau: float) -> tuple[float, float]:
    """Exact quantile regression with one regressor: level and slope of a line through two points, by descent from point to point."""
    loss = lambda r: float(np.where(r >= 0, tau * r, (tau - 1) * r).sum())
    i, best = int(np.argsort(y)[int(tau * (len(y) - 1))]), None
    for _ in range(4 * len(y)):
        dx = x - x[i]
        use = dx != 0
        if not use.any():
            return float(np.quantile(y, tau, method="inverted_cdf")), 0.0
        slope, w = (y[use] - y[i]) / dx[use], dx[use]
        order = np.argsort(slope)
        # derivative by the slope: a weighted quantile of the slopes through point i
        down = np.where(w > 0, tau, 1 - tau) * np.abs(w)
        cum = np.cumsum(np.abs(w)[order])
        k = int(np.searchsorted(cum, down.sum()))
        b = float(slope[order[min(k, len(order) - 1)]])
        j = int(np.flatnonzero(use)[order[min(k, len(order) - 1)]])
        value = loss(y - y[i] - b * dx)
        if best is not None and value >= best[0] - 1e-12 * max(1, best[0]):
            break
        best = (value, float(y[i] - b * x[i]), b)
        i = j
    return best[1], best[2]


def quantile_fits(df: DataFrame, by: str, x: str, y: str, tau: float) -> DataFrame:
    """(by, n, level, slope) of a quantile line a group; groups are grouped data such as months, so that one fits a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        level, slope = quantile_line(rows[x].to_numpy(float), rows[y].to_numpy(float), tau)
        return pd.DataFrame([{by: rows[by].iloc[0], "n": len(rows), "level": level, "slope": slope}])

    return df.select(by, x, y).groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, n bigint, level double, slope double")


#: Bounds of the law's parameters and of the exponent of quality; how many screened starts are refined.
QUALITY_BOUNDS = np.vstack([BOUNDS, [[0.0, 5.0]]])
REFINED = 12


def quality_objective(theta: np.ndarray, ln_n: np.ndarray, ln_d: np.ndarray, ln_q: np.ndarray, ln_l: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The objective of the law over data weighed by quality, d q^gamma, and its gradient: that of the plain law at the effective data, and the chain rule for gamma."""
    gamma = theta[5]
    value, g = objective(theta[:5], ln_n, ln_d + gamma * ln_q, ln_l, w)
    a, b, e, alpha, beta = theta[:5]
    z = np.stack([a - alpha * ln_n, b - beta * (ln_d + gamma * ln_q), np.full_like(ln_n, e)])
    m = z.max(axis=0)
    ex = np.exp(z - m)
    total = ex.sum(axis=0)
    r = np.clip(m + np.log(total) - ln_l, -DELTA, DELTA) * w
    return value, np.r_[g, -(r * ex[1] / total * beta * ln_q).sum()]


def fit_quality_law(spark: SparkSession, data: DataFrame, n: str, d: str, q: str, loss: str) -> DataFrame:
    """(start, objective, A, B, E, alpha, beta, gamma) of E + A n^-alpha + B (q^gamma d)^-beta: 324 starts are screened by their objective, the best REFINED refined, all in parallel. data: grouped rows, at most MOST_ROWS."""
    rows = data.select(*[F.log(c).alias(k) for c, k in ((n, "n"), (d, "d"), (q, "q"), (loss, "l"))]).groupBy("n", "d", "q", "l").agg(F.count("*").cast("double").alias("w"))
    if rows.count() > MOST_ROWS:
        raise ValueError(f"group the data to at most {MOST_ROWS} rows")
    rows = rows.orderBy("n", "d", "q", "l").toPandas()
    sent = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in "ndqlw"))
    grid = [(*s, g) for s in starts() for g in (0.2, 0.6, 1.0)]

    def screen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(s[0], quality_objective(np.array(s[1:]), *sent.value)[0]) for s in part.itertuples(index=False)], columns=["start", "objective"])

    def refine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for s in part.itertuples(index=False):
                x, value, _ = minimise(lambda t: quality_objective(t, *sent.value), np.array(s[1:]), QUALITY_BOUNDS)
                out.append((s[0], value, *np.exp(x[:3]), *x[3:]))
            yield pd.DataFrame(out, columns=["start", "objective", "A", "B", "E", "alpha", "beta", "gamma"])

    names = "start int, a double, b double, e double, alpha double, beta double, gamma double"
    frame = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(grid)], names).repartition(16)
    best = [r.start for r in frame.mapInPandas(screen, "start int, objective double").orderBy("objective", "start").limit(REFINED).collect()]
    return frame.filter(F.col("start").isin(best)).repartition(REFINED).mapInPandas(refine, "start int, objective double, A double, B double, E double, alpha double, beta double, gamma double")


def law_statistic(begin: np.ndarray) -> Callable[[pd.DataFrame], dict[str, float]]:
    """For resample.bootstrap: the law fitted to the drawn clusters (columns n, d, loss of lists), from a warm start; clusters of fewer than three sizes are a failure."""

    def fit(rows: pd.DataFrame) -> dict[str, float]:
        ln_n, ln_d, ln_l = (np.log(np.concatenate([np.asarray(v, float) for v in rows[c]])) for c in ("n", "d", "loss"))
        if len(np.unique(ln_n)) < 3:
            raise ValueError("fewer than three sizes")
        x, _, _ = minimise(lambda t: objective(t, ln_n, ln_d, ln_l, np.ones_like(ln_n)), begin, BOUNDS)
        return dict(zip(("A", "B", "E", "alpha", "beta"), [*np.exp(x[:3]), *x[3:]], strict=True))

    return fit
