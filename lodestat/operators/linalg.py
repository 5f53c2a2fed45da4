"""Least squares from sums: Gram matrices are one aggregation, whatever the number of rows; only matrices of features reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, x: list[str], y: list[str], by: list[str] | None = None) -> dict[tuple, np.ndarray]:
    """Group: sums of products of (1, x, y). One pass for all targets and groups; groups are few (folds)."""
    names = [None, *x, *y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    term = lambda n: F.lit(1.0) if n is None else F.col(n).cast("double")
    rows = df.groupBy(*(by or [])).agg(*[F.sum(term(names[i]) * term(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by or [])] = m
    return out


def ridge_from(m: np.ndarray, k: int, target: int, alpha: float) -> np.ndarray:
    """Intercept and k slopes: centred, intercept not penalised. target: place among the y's."""
    n, sx, sy = m[0, 0], m[0, 1 : k + 1], m[0, k + 1 + target]
    sxx = m[1 : k + 1, 1 : k + 1] - np.outer(sx, sx) / n
    sxy = m[1 : k + 1, k + 1 + target] - sx * sy / n
    beta = np.linalg.solve(sxx + alpha * np.eye(k), sxy)
    return np.r_[sy / n - sx @ beta / n, beta]


def squared_error(m: np.ndarray, k: int, target: int, beta: np.ndarray) -> float:
    """Sum of squared residuals from the same sums."""
    t = k + 1 + target
    return float(m[t, t] - 2 * beta @ m[: k + 1, t] + beta @ m[: k + 1, : k + 1] @ beta)


def ridge_cv(df: DataFrame, x: list[str], y: list[str], fold: str, alphas: list[float]) -> list[dict]:
    """Per target: alpha with the least cross-validated error (the first of equals), its rmse, and the fit on all rows. Training sums are all sums minus the fold's."""
    folds = gram(df, x, y, [fold])
    total = sum(folds.values())
    out = []
    for t, name in enumerate(y):
        best = None
        for alpha in alphas:
            sse = sum(squared_error(m, len(x), t, ridge_from(total - m, len(x), t, alpha)) for m in folds.values())
            rmse = float(np.sqrt(max(0.0, sse) / total[0, 0]))
            if best is None or rmse < best[1]:
                best = (alpha, rmse)
        beta = ridge_from(total, len(x), t, best[0])
        out.append({"target": name, "alpha": best[0], "cv_rmse": best[1], "intercept": float(beta[0]), **{f"b_{c}": float(v) for c, v in zip(x, beta[1:], strict=True)}})
    return out


def folds(key: Column, k: int, seed: int) -> Column:
    """A fold by hash of the key; any engine with MD5 agrees."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def exact_split(df: DataFrame, by: list[str], y: str, x: str, t: str) -> DataFrame:
    """Slope of y on t, split into what x carries and the rest: g_time = g + b * s, from covariances in one aggregation."""
    cov = {a + b: F.covar_pop(c, d) for a, c in zip("xty", (x, t, y), strict=True) for b, d in zip("xty", (x, t, y), strict=True)}
    det = cov["xx"] * cov["tt"] - cov["xt"] * cov["xt"]
    b = F.try_divide(cov["xy"] * cov["tt"] - cov["ty"] * cov["xt"], det)
    s = F.try_divide(cov["xt"], cov["tt"])
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(cov["ty"], cov["tt"]).alias("g_time"), b.alias("b"), s.alias("s"), F.try_divide(cov["ty"] - b * cov["xt"], cov["tt"]).alias("g"))


def leave_one_out(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """n and rmse of predicting each row from a line through the others, from leverages: two passes of sums, no refits."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("level"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], "n", "mx", "slope", "level", "sxx")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = df.join(F.broadcast(sums) if not by else sums, same)
    e = (F.col(y) - F.col("level") - F.col("slope") * F.col(x)) / (1 - 1 / F.col("n") - F.try_divide((F.col(x) - F.col("mx")) * (F.col(x) - F.col("mx")), F.col("sxx")))
    return j.groupBy(*by, "n").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def compare(df: DataFrame, simple: list[str], rich: list[str], y: str, fold: str, gain: float, wins: int) -> dict:
    """Cross-validated errors of a simple and a richer least-squares model of y, and which is selected: the richer only if it gains a share of the error and wins so many folds."""
    out, every = {}, list(dict.fromkeys([*simple, *rich]))
    sums = gram(df, every, [y], [fold])
    total = sum(sums.values())
    sse = {}
    for name, x in (("simple", simple), ("rich", rich)):
        at = [0, *[1 + every.index(c) for c in x], len(every) + 1]
        part = lambda m, at=at: m[np.ix_(at, at)]
        sse[name] = {k: squared_error(part(m), len(x), 0, ridge_from(part(total - m), len(x), 0, 0.0)) for k, m in sums.items()}
        out[f"rmse_{name}"] = float(np.sqrt(max(0.0, sum(sse[name].values())) / total[0, 0]))
    out["gain"] = 1 - out["rmse_rich"] / out["rmse_simple"] if out["rmse_simple"] else 0.0
    out["fold_wins"] = sum(sse["rich"][k] < sse["simple"][k] for k in sums)
    return out | {"selected": "rich" if out["gain"] >= gain and out["fold_wins"] >= wins else "simple"}
