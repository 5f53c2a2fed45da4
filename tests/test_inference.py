"""Exact quantile planes, refits, absorbed effects, many penalties and exact folds against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import allocation, effects, quantreg, refits, ridge
from lodestat.operators.core import exact_folds, row_numbers


def check(r, tau, w=1.0):
    return float((w * np.where(r >= 0, tau * r, (tau - 1) * r)).sum())


@pytest.mark.parametrize("seed", range(6))
def test_vertex_is_the_best_of_all_planes(seed):
    rng = np.random.default_rng(seed)
    for trial in range(8):
        n, p, tau = rng.integers(4, 13), rng.integers(1, 4), rng.choice([0.1, 0.5, 0.9])
        x, y = np.column_stack([np.ones(n), *(rng.normal(size=n) for _ in range(p - 1))]), rng.normal(size=n)
        if trial % 3 == 0:
            x, y = np.round(x), np.round(y)  # ties
        w = rng.integers(1, 4, n).astype(float)
        if np.linalg.matrix_rank(x) < p:
            with pytest.raises(quantreg.NoFit):
                quantreg.vertex(x, y, tau, w)
            continue
        best = min(check(y - x @ np.linalg.solve(x[list(h)], y[list(h)]), tau, w) for h in itertools.combinations(range(n), p) if abs(np.linalg.det(x[list(h)])) > 1e-9)
        assert check(y - x @ quantreg.vertex(x, y, tau, w), tau, w) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize(("tau", "tail"), [(0.9, 2.0), (0.5, 1.2), (0.03, 5.0)])
def test_plane_of_many_rows_needs_few_of_them(spark, tau, tail):
    """With a band of a fiftieth of the rows the optimum of all is found; its subgradient holds zero."""
    rng = np.random.default_rng(4)
    n = 20_000
    a, b = rng.normal(size=n), rng.uniform(0, 7, n)
    y = 3 + a - 2 * b + (1 + b) * rng.standard_t(tail, n)
    df = spark.createDataFrame([(float(p), float(q), float(v)) for p, q, v in zip(a, b, y, strict=True)] + [(None, 1.0, 2.0)], "a double, b double, y double")
    found = quantreg.quantile_plane(df, ["a", "b"], "y", tau, band=400, sample=300)
    x = np.column_stack([np.ones(n), a, b])
    want = quantreg.vertex(x, y, tau)
    assert [found["level"], found["b_a"], found["b_b"]] == pytest.approx(want.tolist(), rel=1e-7)
    r = y - x @ want
    h = np.abs(r) < 1e-9
    at = np.linalg.solve(x[h].T, -(np.where(r[~h] < 0, tau - 1, tau) @ x[~h]))
    assert h.sum() == 3 and (at <= tau + 1e-6).all() and (at >= tau - 1 - 1e-6).all()
    assert found["n"] == n and found["loss"] == pytest.approx(check(r, tau))


def test_planes_by_group_and_failures(spark):
    rows = [("a", float(i), float((i * 7) % 5), float(i * 2 + (i * 13) % 7)) for i in range(30)] + [("b", 1.0, 1.0, 1.0), ("b", 2.0, 2.0, 2.0), (None, 1.0, 2.0, 3.0), (None, 2.0, 1.0, 4.0), (None, 3.0, 3.0, 8.0)]
    got = {r.g: r for r in quantreg.quantile_planes(spark.createDataFrame(rows, "g string, t double, x double, y double"), ["g"], ["x", "t"], "y", 0.9).collect()}
    assert got["b"].level is None and got["b"].n == 2 and got[None].loss == pytest.approx(0, abs=1e-9) and got["a"].n == 30
    with pytest.raises(quantreg.NoFit):
        quantreg.quantile_plane(spark.createDataFrame(rows[-5:-3], "g string, t double, x double, y double"), ["x", "t"], "y", 0.9)


def law_points(spark, noise=3e-3, quality=False):
    rng, rows = np.random.default_rng(1), []
    law = allocation.LAW
    for s, k, h in itertools.product(range(1, 40, 3), range(5), range(4 if quality else 1)):
        n, d, q = s * 1e8, 10.0 ** (8 + k), 0.2 + 0.2 * h if quality else 1.0
        loss = law["E"] + law["A"] * n ** -law["alpha"] + law["B"] * (q**0.8 * d) ** -law["beta"]
        rows.append((s % 4, n, d, q, loss * math.exp(noise * rng.normal())))
    return spark.createDataFrame(rows, "unit int, n double, d double, q double, loss double")


def test_leaving_out_is_fitting_the_rest(spark):
    data, begin = law_points(spark), refits.anchor(allocation.LAW)
    got = {r.left_out: r for r in refits.leave_out(data, begin, "unit", "n", "d", "loss").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for u, r in got.items():
        points, _ = refits.collected(data.filter(f"unit <> {u}"), "n", "d", "loss")
        theta, value = points.fit(begin, points.c["w"])
        assert r.objective == pytest.approx(value, rel=1e-9) and [r.A, r.B, r.E, r.alpha, r.beta] == pytest.approx(refits.natural(theta), rel=1e-5)
        out, _ = refits.collected(data.filter(f"unit = {u}"), "n", "d", "loss")
        assert r.rmse_out == pytest.approx(float(np.sqrt((out.model(theta)[0] ** 2).mean())), rel=1e-5)


@pytest.mark.parametrize("quality", [False, True])
def test_profiles_rise_from_the_fit(spark, quality):
    """Held far from the fit, where residuals pass the Huber bound; no random point with the same parameter held is better."""
    data, begin = law_points(spark, quality=quality), refits.anchor(allocation.LAW | ({"gamma": 0.8} if quality else {}))
    q = "q" if quality else None
    got = refits.profile(data, begin, [0.8, 0.95, 1.0, 1.05, 1.25], "n", "d", "loss", q).collect()
    points, _ = refits.collected(data, "n", "d", "loss", q)
    rng = np.random.default_rng(0)
    for name in refits.NAMES[: len(begin)]:
        rows = sorted((r for r in got if r.parameter == name), key=lambda r: r.factor)
        excess = [r.excess for r in rows]
        assert excess[2] == pytest.approx(0, abs=1e-9) and excess[0] > excess[1] > -1e-12 and excess[4] > excess[3] > -1e-12
        i = refits.NAMES.index(name)
        for r in rows[::4]:
            theta = refits.anchor({k: r[k] for k in refits.NAMES[: len(begin)]})
            assert r.held == pytest.approx(r[name])
            for _ in range(40):
                other = theta + rng.normal(size=len(theta)) * 1e-4
                other[i] = theta[i]
                assert points.value(other, points.c["w"])[0] >= r.objective - 1e-12


def test_resampled_counts_failures(spark):
    data = law_points(spark)
    weights = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (0, 2, 1), (1, 3, 4)], "replicate int, unit int, times int")
    few = data.filter("unit <> 3 or n = 3e8 or n = 7e8").filter("unit <> 3 or n = 7e8")
    got = {r.replicate: r for r in refits.resampled(few, refits.anchor(allocation.LAW), weights, "unit", "n", "d", "loss").collect()}
    assert not got[0].failed and got[1].failed and got[1].alpha is None
    with pytest.raises(ValueError, match="positive"):
        refits.collected(data.selectExpr("-n AS n", "d", "loss"), "n", "d", "loss")


@pytest.mark.parametrize(("by", "few"), [(["g"], 20_000), (["g", "h"], 20_000), (["g"], 0), (["g", "h"], 0)])
def test_absorbed_effects_are_dummies(spark, monkeypatch, by, few):
    monkeypatch.setattr(effects, "FEW_CELLS", few)
    rng = np.random.default_rng(2)
    rows = [(None if g == 4 else f"g{g}", int(rng.integers(0, 6)) if g else int(rng.integers(0, 3)), float(rng.normal() + g), float(rng.normal())) for g in rng.integers(0, 5, 400)]
    rows = [(g, h, x, t, 2 * x - 3 * t + len(str(g)) * h + float(rng.normal()) + 1e6) for g, h, x, t in rows]
    df = spark.createDataFrame([*rows, ("g1", 1, None, 1.0, 2.0)], "g string, h int, x double, t double, y double")
    levels = [sorted({str(r[i]) for r in rows}) for i in range(len(by))]
    dummies = [[float(str(r[i]) == v) for r in rows] for i, vs in enumerate(levels) for v in vs[(i > 0) :]]
    design = np.column_stack([[r[2] for r in rows], [r[3] for r in rows], *dummies])
    y = np.array([r[4] for r in rows])
    beta, *_ = np.linalg.lstsq(design, y - 1e6, rcond=None)
    got = effects.slopes(df, by, ["x", "t"], "y")
    assert [got["x"], got["t"]] == pytest.approx(beta[:2].tolist(), rel=1e-7)
    assert got["rss"] == pytest.approx(float(((y - 1e6 - design @ beta) ** 2).sum()), rel=1e-6)
    assert got["n"] == 400 and got["groups"] == sum(map(len, levels))


def test_ridge_of_many_targets(spark):
    rng = np.random.default_rng(3)
    n, p, t, alphas = 300, 152, 13, [0.1, 1.0, 50.0]
    x = rng.dirichlet(np.ones(p) * 0.3, n)
    y = 2 + x @ (rng.normal(size=(p, t)) * np.geomspace(0.01, 10, t)) + rng.normal(size=(n, t)) * 0.2
    df = spark.createDataFrame([(i % 5, x[i].tolist(), y[i].tolist()) for i in range(n)], "f int, x array<double>, y array<double>").repartition(4)
    got = ridge.ridge_many(df, "x", "y", "f", p, t, alphas)

    def fit(rows, alpha):
        mx, my = x[rows].mean(0), y[rows].mean(0)
        c = x[rows] - mx
        b = np.linalg.solve(c.T @ c + alpha * np.eye(p), c.T @ (y[rows] - my))
        return np.vstack([my - mx @ b, b])

    folds = np.arange(n) % 5
    cv = np.array([np.sqrt(sum(((np.c_[np.ones((folds == k).sum()), x[folds == k]] @ fit(folds != k, a) - y[folds == k]) ** 2).sum(0) for k in range(5)) / n) for a in alphas])
    assert np.allclose(got["cv"], cv, rtol=1e-6)
    best = np.array(alphas)[cv.argmin(0)]
    assert (got["penalty"] == best).all() and len(set(best)) > 1  # penalties differ by target
    assert np.allclose(got["beta"], np.column_stack([fit(np.arange(n), a)[:, j] for j, a in enumerate(best)]), rtol=1e-5, atol=1e-7)
    with pytest.raises(Exception, match="must have 3 numbers"):
        ridge.gram_of_arrays(spark.createDataFrame([(0, [1.0, 2.0], [1.0])], "f int, x array<double>, y array<double>"), "x", "y", "f", 3, 1)


def test_row_numbers_and_folds(spark):
    df = spark.range(1003).withColumn("k", F.col("id") % 900)
    got = [(r.row, r.id) for r in row_numbers(df, "k", 5).collect()]
    assert sorted(r for r, _ in got) == list(range(1003))
    again = dict((i, r) for r, i in [(r.row, r.id) for r in row_numbers(df.repartition(7), "id", 5).collect()])
    assert again == {r.id: r.row for r in row_numbers(df, "id", 5).collect()} and again != {r.id: r.row for r in row_numbers(df, "id", 6).collect()}
    sizes = {r.fold: r["count"] for r in exact_folds(df, "id", 7, 1).groupBy("fold").count().collect()}
    assert sizes == {0: 144, 1: 144, 2: 143, 3: 143, 4: 143, 5: 143, 6: 143}
    with pytest.raises(ValueError):
        exact_folds(df.limit(3), "id", 4, 1)
