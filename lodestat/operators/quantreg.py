"""Quantile regression with any number of regressors, exactly.

An optimal plane goes through as many rows as it has coefficients. `vertex` walks from one such plane to a better one until the subgradient
shows that none is. Of many rows only those near the plane take part: the others keep their side, so that all they do is in sums of them, which Spark
aggregates. Rows that do change sides are noticed in the next pass, and the search goes on from there, so that the result is that of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import stored

#: Rows near the plane that are solved at once, rows of the first sample, and passes after which the search gives up.
BAND, SAMPLE, MOST_PASSES = 50_000, 5_000, 80


class NoFit(ValueError):
    """Too few rows, or regressors that depend on each other."""


def _basis(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first rows in this order that are independent, as many as columns."""
    found: list[int] = []
    left = np.zeros((0, x.shape[1]))
    for i in order:
        v = x[i] - left.T @ (left @ x[i])
        v = v - left.T @ (left @ v)
        size = np.linalg.norm(v)
        if size > 1e-9 * np.linalg.norm(x[i]):
            left = np.vstack([left, v / size])
            found.append(int(i))
            if len(found) == x.shape[1]:
                return np.array(found)
    raise NoFit("the regressors depend on each other")


def vertex(x: np.ndarray, y: np.ndarray, tau: float, weight: np.ndarray | None = None, pull: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients that minimise the sum of weighted check losses of y - x b, minus pull @ b (what rows that keep their side add to the slope)."""
    n, p = x.shape
    weight = np.ones(n) if weight is None else weight
    pull = np.zeros(p) if pull is None else pull
    if n < p:
        raise NoFit("fewer rows than coefficients")
    size = np.abs(x).max(axis=0)
    if (size == 0).any():
        raise NoFit("the regressors depend on each other")
    x, pull = x / size, pull / size
    start = np.linalg.lstsq(x, y, rcond=None)[0] if start is None else start * size
    # ties are parted by a nudge far below the data's digits; the rows that it finds are solved without it
    nudge = np.random.default_rng(n).uniform(-1, 1, n) * 1e-10 * max(1e-300, np.abs(y - y.mean()).max(initial=0.0))
    moved = y + nudge
    h = _basis(x, np.argsort(np.abs(moved - x @ start), kind="stable"))
    for _ in range(60 * (n + 50)):
        inverse = np.linalg.inv(x[h])
        r = moved - x @ (inverse @ moved[h])
        out = np.ones(n, bool)
        out[h] = False
        side = np.where(r < 0, tau - 1, tau) * weight
        at = -(inverse.T @ (side[out] @ x[out] + pull))  # what each row of the basis would have to weigh
        low, high = (tau - 1) * weight[h], tau * weight[h]
        wrong = np.maximum(at - high, low - at)
        k = int(np.argmax(wrong))
        if wrong[k] <= 1e-9 * max(1.0, np.abs(pull).max(), weight.max()):
            return np.linalg.solve(x[h], y[h]) / size
        d = inverse[:, k] * (-1.0 if at[k] > high[k] else 1.0)
        slope, step = -wrong[k], x @ d
        may = out & (np.abs(step) > 1e-13) & (np.where(r < 0, -1, 1) * step > 0)
        t = r[may] / step[may]
        rows = np.flatnonzero(may)
        order = np.argsort(t, kind="stable")
        rise = slope + np.cumsum((np.abs(step) * weight)[rows[order]])
        turn = int(np.searchsorted(rise, 0.0))
        if turn >= len(order):
            raise NoFit("the loss has no minimum; rows that were set aside pull without end")
        h[k] = rows[order[turn]]
    raise NoFit("no optimal plane was found")


def check_loss(residual: Column, tau: float) -> Column:
    return F.when(residual >= 0, F.lit(tau) * residual).otherwise(F.lit(tau - 1) * residual)


def _residual(x: list[str], y: str, beta: np.ndarray) -> Column:
    out = F.col(y) - F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:], strict=True):
        out = out - F.lit(float(b)) * F.col(c)
    return out


def quantile_plane(df: DataFrame, x: list[str], y: str, tau: float, weight: str | None = None, band: int = BAND, sample: int = SAMPLE) -> dict[str, float]:
    """Level and slopes of the plane that a share tau of the rows lies below, with `n`, `loss` and `passes`: the exact optimum over all rows.

    Equal rows count together. A sample of bounded size gives a first plane, Newton steps on a smoothed loss over all rows a near one; each pass sums the rows beyond `band` rows around it and solves the rest. The loss of a solution that takes rows to
    the wrong side of the plane underestimates theirs, so that the solution is a bound, and the next plane lies between, where the loss over all rows is less.
    """
    names = ["__one", *x]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*x, y]], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    rows = stored(rows.dropna().groupBy(*x, y).agg(F.sum("__w").alias("__w")).filter("__w > 0").withColumn("__one", F.lit(1.0)))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    if n < len(names):
        raise NoFit("fewer rows than coefficients")

    def local(part: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = part.select(*names, y, "__w").orderBy(*x, y).toPandas()
        return got[names].to_numpy(float), got[y].to_numpy(float), got["__w"].to_numpy(float)

    def loss(*betas: np.ndarray, h: float = 0.0) -> list[float]:
        """The loss over all rows at some planes, with h that of the smoothed loss: a parabola where residuals are under h."""
        each = [(r, F.when(F.abs(r) < h, (tau - 0.5) * r + r * r / (4 * h) + h / 4).otherwise(check_loss(r, tau)) if h else check_loss(r, tau)) for r in (_residual(x, y, b) for b in betas)]
        return list(rows.agg(*[F.sum(F.col("__w") * v).alias(f"l{i}") for i, (_, v) in enumerate(each)]).first())

    def smoothed(beta: np.ndarray, h: float) -> np.ndarray:
        """Newton steps to the optimum of the smoothed loss, near which the exact one lies: a pass for sums of products of rows under h, a pass for the step's length."""
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        value = loss(beta, h=h)[0]
        for _ in range(30):
            r = _residual(x, y, beta)
            slope = F.lit(tau - 1) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r + h) / (2 * h)))
            w, inner = F.col("__w"), F.when(F.abs(r) < h, F.col("__w") / (2 * h)).otherwise(0.0)
            got = rows.agg(*[F.sum(w * slope * F.col(c)) for c in names], *[F.sum(inner * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
            g, m = np.array(got[: len(names)], float), np.zeros((len(names), len(names)))
            for (i, j), v in zip(pairs, got[len(names) :], strict=True):
                m[i, j] = m[j, i] = v
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            step = np.linalg.lstsq(m / np.outer(scale, scale), g / scale, rcond=1e-12)[0] / scale
            cuts = [beta + step * 0.5**k for k in range(-1, 12)]
            losses = loss(*cuts, h=h)
            best = int(np.argmin(losses))
            if losses[best] >= value * (1 - 1e-9):
                break
            beta, value = cuts[best], losses[best]
        return beta

    if n <= band:
        xs, ys, ws = local(rows)
        beta, passes = vertex(xs, ys, tau, ws), 1
    else:
        first = rows.filter(F.pmod(F.xxhash64(*x, y), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / n)) + 1))
        xs, ys, ws = local(first)
        beta = vertex(xs, ys, tau, ws)
        for passes in range(1, MOST_PASSES + 1):
            width = rows.agg(F.percentile_approx(F.abs(_residual(x, y, beta)), min(1.0, 0.3 * band / n), 100_000)).first()[0]
            beta = smoothed(beta, float(width)) if width > 0 and passes <= 6 else beta
            value, r = loss(beta)[0], _residual(x, y, beta)
            # the band: as many rows nearest to the plane as are solved at once
            near = rows.agg(F.percentile_approx(F.abs(r), min(1.0, 0.5 * band / n), 100_000)).first()[0]
            far = F.abs(r) > F.lit(float(near))
            side = F.when(r > 0, F.lit(tau)).otherwise(F.lit(tau - 1)) * F.col("__w")
            pull = np.array([v or 0.0 for v in rows.filter(far).agg(*[F.sum(side * F.col(c)) for c in names]).first()])
            xs, ys, ws = local(rows.filter(~far))
            solved = True
            try:
                new = vertex(xs, ys, tau, ws, pull, beta)
            except NoFit:  # too few rows near the plane hold back the rest: a step down the slope, cut below
                g = rows.agg(*[F.sum(F.when(r > 0, F.lit(tau)).otherwise(F.lit(tau - 1)) * F.col("__w") * F.col(c)) for c in names]).first()
                new, solved = beta + np.array([v or 0.0 for v in g]) / total, False
            if solved and rows.filter(far & (F.signum(r) * _residual(x, y, new) < 0)).isEmpty():  # no row has changed sides
                beta = new
                break
            cuts = [beta + (new - beta) * 0.5**k for k in range(12)]
            losses = loss(*cuts)
            best = int(np.argmin(losses))
            if losses[best] >= value * (1 - 1e-13):
                raise NoFit("the planes do not get better; use a wider band")
            beta, value = cuts[best], losses[best]
        else:
            raise NoFit("the planes have not settled")
    return {"n": n, "loss": loss(beta)[0], "passes": passes, "level": float(beta[0]), **{f"b_{c}": float(b) for c, b in zip(x, beta[1:], strict=True)}}


def quantile_planes(df: DataFrame, by: list[str], x: list[str], y: str, tau: float) -> DataFrame:
    """(by, n, level, b_<x>..., loss) of each group's plane, groups in parallel; groups without a fit have nulls. A group is grouped data, such as months, of at most BAND rows; a larger one is an error, for quantile_plane."""
    names = ["level", *[f"b_{c}" for c in x], "loss"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > BAND:
            raise ValueError("a group has more rows than are solved at once; use quantile_plane")
        xs, ys = np.column_stack([np.ones(len(rows)), *(rows[c].to_numpy(float) for c in x)]), rows[y].to_numpy(float)
        order = np.lexsort((*xs.T, ys))
        try:
            beta = vertex(xs[order], ys[order], tau)
            r = ys - xs @ beta
            values = [*beta, float(np.where(r >= 0, tau * r, (tau - 1) * r).sum())]
        except NoFit:
            values = [None] * len(names)
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in by}, "n": len(rows), **dict(zip(names, values, strict=True))}]).astype({c: float for c in names})

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, *x, y).groupBy(*by).applyInPandas(run, f"{schema}, n bigint, {', '.join(f'{c} double' for c in names)}")
