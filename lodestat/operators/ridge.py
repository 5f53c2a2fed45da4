"""Ridge regression of many targets on many features with a penalty for each target.

Features and targets are arrays. Tasks multiply matrices of their rows, so that a pass over the data adds up one matrix a fold, whatever
the number of features, targets and penalties. Each training matrix is decomposed once; every penalty and target is read off the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_of_arrays(df: DataFrame, x: str, y: str, fold: str, n_x: int, n_y: int) -> dict[int, np.ndarray]:
    """Fold: sums of products of (1, x, y). Arrays of another length, and nulls in them, are errors; rows are few numbers a task: one matrix a fold."""
    width = 1 + n_x + n_y

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            parts = []
            for name, size in ((x, n_x), (y, n_y)):
                column = batch.column(name)
                flat = column.flatten()
                if column.null_count or flat.null_count or set(column.value_lengths().to_pylist()) - {size}:
                    raise ValueError(f"{name} must have {size} numbers in every row")
                parts.append(flat.to_numpy(zero_copy_only=False).reshape(n, size))
            rows = np.column_stack([np.ones(n), *parts])
            folds = batch.column(fold).to_numpy()
            for k in np.unique(folds):
                part = rows[folds == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sums[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], names=["fold", "sums"])

    rows = df.select(F.col(x).cast("array<double>").alias(x), F.col(y).cast("array<double>").alias(y), F.col(fold).cast("bigint").alias(fold))
    places = rows.mapInArrow(add, "fold bigint, sums array<double>").select("fold", F.posexplode("sums").alias("place", "v"))
    out: dict[int, np.ndarray] = {}
    for r in places.groupBy("fold", "place").agg(F.sum("v").alias("v")).collect():  # folds by the square of features and targets
        out.setdefault(r["fold"], np.zeros(width * width))[r["place"]] = r["v"]
    return {k: v.reshape(width, width) for k, v in sorted(out.items())}


class Path:
    """Ridge fits of all targets at any penalty from one matrix of sums; levels are not penalised."""

    def __init__(self, m: np.ndarray, n_x: int) -> None:
        n, self.mx, self.my = m[0, 0], m[0, 1 : n_x + 1] / m[0, 0], m[0, n_x + 1 :] / m[0, 0]
        sxx = m[1 : n_x + 1, 1 : n_x + 1] - n * np.outer(self.mx, self.mx)
        self.values, self.vectors = np.linalg.eigh(sxx)
        self.rotated = self.vectors.T @ (m[1 : n_x + 1, n_x + 1 :] - n * np.outer(self.mx, self.my))

    def at(self, penalties: float | np.ndarray) -> np.ndarray:
        """Levels in the first row, slopes below, a column for each target; one penalty for all or one for each."""
        beta = self.vectors @ (self.rotated / (np.maximum(self.values, 0.0)[:, None] + np.broadcast_to(penalties, (self.rotated.shape[1],))))
        return np.vstack([self.my - self.mx @ beta, beta])


def squared_errors(m: np.ndarray, n_x: int, beta: np.ndarray) -> np.ndarray:
    """The sum of squared residuals of each target."""
    x, y = slice(0, n_x + 1), slice(n_x + 1, None)
    return np.diag(m[y, y]) - 2 * np.einsum("ij,ij->j", beta, m[x, y]) + np.einsum("ij,ik,kj->j", beta, m[x, x], beta)


def ridge_many(df: DataFrame, x: str, y: str, fold: str, n_x: int, n_y: int, penalties: list[float]) -> dict[str, np.ndarray]:
    """For each target the penalty with the least cross-validated error (the first of equals): `penalty`, `cv_rmse`, `cv` (errors by penalty and target), and `beta`, the fit on all rows."""
    if not penalties or any(not np.isfinite(a) or a <= 0 for a in penalties):
        raise ValueError("penalties must be finite and positive")
    folds = gram_of_arrays(df, x, y, fold, n_x, n_y)
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds at least")
    total = sum(folds.values())
    paths = {k: Path(total - m, n_x) for k, m in folds.items()}
    cv = np.array([np.sqrt(np.maximum(0.0, sum(squared_errors(m, n_x, paths[k].at(a)) for k, m in folds.items())) / total[0, 0]) for a in penalties])
    best = np.argmin(cv, axis=0)
    chosen = np.array(penalties)[best]
    return {"penalty": chosen, "cv_rmse": cv[best, np.arange(n_y)], "cv": cv, "beta": Path(total, n_x).at(chosen)}
