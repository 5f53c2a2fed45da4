"""Least squares with group effects absorbed: slopes as if each group of one or several columns had a level of its own, without a column for each group.

One pass sums the rows by cells (combinations of groups). Effects of one column are means; of several they are found by taking turns, over the cells only. What is
left of each column's sums of products after the effects is all that slopes need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import small, stored

#: Turns after which effects that have not settled are an error; cells up to which turns are taken on the driver, where they are sums of a bounded number.
MOST_TURNS, FEW_CELLS = 400, 20_000


def _same(by: list[str], mark: str) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{mark}{c}"))
    return same


def absorbed(df: DataFrame, effects: list[str], columns: list[str], tolerance: float = 1e-11) -> tuple[np.ndarray, float, dict[str, int]]:
    """(sums of products of the columns' residuals, rows, groups of each effect). Rows with a null among the columns do not count; a null group is a group.

    Columns are centred before products are taken, so that digits are not lost to their levels.
    """
    rows = df.select(*effects, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    centre = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    rows = rows.select(*effects, *[(F.col(c) - F.lit(centre[c] or 0.0)).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cells = rows.groupBy(*effects).agg(F.count("*").cast("double").alias("__n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs])
    cells = stored(cells.withColumns({f"f_{c}": F.lit(0.0) for c in columns}))  # f: the effects so far, summed over the effects' columns
    if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        return _few(cells.toPandas(), effects, columns, pairs, tolerance)
    groups = {e: cells.select(e).distinct().count() for e in effects}
    for turn in range(MOST_TURNS):
        moved = 0.0
        for e in effects:
            means = cells.groupBy(F.col(e).alias(f"__g_{e}")).agg(*[(F.sum(F.col(f"s_{c}") - F.col("__n") * F.col(f"f_{c}")) / F.sum("__n")).alias(f"m_{c}") for c in columns])
            means = stored(means)
            step = means.agg(*[F.max(F.abs(f"m_{c}")).alias(c) for c in columns]).first()
            moved = max(moved, *[step[c] or 0.0 for c in columns])
            cells = cells.join(small(means), _same([e], "__g_")).withColumns({f"f_{c}": F.col(f"f_{c}") + F.col(f"m_{c}") for c in columns}).drop(f"__g_{e}", *[f"m_{c}" for c in columns])
        cells = stored(cells)
        if len(effects) == 1 or moved <= tolerance:
            break
    else:
        raise RuntimeError("the effects have not settled")
    # residuals are orthogonal to groups: products of residuals are products of a column with another's residual
    product = lambda i, j: F.sum(F.col(f"p{i}_{j}") - F.col(f"s_{columns[i]}") * F.col(f"f_{columns[j]}"))
    found = cells.agg(F.sum("__n").alias("n"), *[product(i, j).alias(f"r{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        m[i, j] = m[j, i] = found[f"r{i}_{j}"] or 0.0
    return m, found["n"] or 0.0, groups


def _few(cells: pd.DataFrame, effects: list[str], columns: list[str], pairs: list[tuple[int, int]], tolerance: float) -> tuple[np.ndarray, float, dict[str, int]]:
    """The same turns over few cells."""
    n, sums = cells["__n"].to_numpy(float), cells[[f"s_{c}" for c in columns]].to_numpy(float)
    codes = {e: pd.factorize(cells[e], use_na_sentinel=False)[0] for e in effects}
    groups = {e: int(c.max(initial=-1)) + 1 for e, c in codes.items()}
    fitted = np.zeros_like(sums)
    for _ in range(MOST_TURNS):
        moved = 0.0
        for e in effects:
            size = np.bincount(codes[e], n, groups[e])
            means = np.stack([np.bincount(codes[e], sums[:, j] - n * fitted[:, j], groups[e]) / size for j in range(len(columns))], axis=1)
            moved = max(moved, float(np.abs(means).max(initial=0.0)))
            fitted += means[codes[e]]
        if len(effects) == 1 or moved <= tolerance:
            break
    else:
        raise RuntimeError("the effects have not settled")
    m = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        m[i, j] = m[j, i] = cells[f"p{i}_{j}"].sum() - (sums[:, i] * fitted[:, j]).sum()
    return m, float(n.sum()), groups


def slopes(df: DataFrame, effects: list[str], x: list[str], y: str) -> dict[str, float]:
    """Slopes of y on x with a level for all rows (no effects) or for each group of the effects; also n, groups and the residual sum of squares."""
    if effects:
        m, n, groups = absorbed(df, effects, [*x, y])
    else:
        m, n, groups = absorbed(df.withColumn("__all", F.lit(1)), ["__all"], [*x, y])
    k = len(x)
    scale = np.sqrt(np.maximum(np.diag(m)[:k], 1e-300))
    beta = np.linalg.solve(m[:k, :k] / np.outer(scale, scale), m[:k, k] / scale) / scale
    return {"n": n, "groups": sum(groups.values()) if effects else 1, **dict(zip(x, beta.tolist(), strict=True)), "rss": float(m[k, k] - beta @ m[:k, k])}
