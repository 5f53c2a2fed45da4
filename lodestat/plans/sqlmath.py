"""Pieces of SQL for the checks of fits: linear equations, and steps of a fit that end at its optimum."""

from __future__ import annotations


def solved(name: str, source: str, keys: list[str], n: int, width: int) -> str:
    """Recursive CTEs: `name` has keys and m, the n by width matrix m of source (a list of rows) after elimination, so that column n + 1 on holds solutions. Positive definite, so without pivots."""
    k = ", ".join(keys)
    row = f"list_transform(range(1, {width} + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k])"
    step = f"list_transform(range(1, {n} + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k]) ELSE {row} END)"
    return f"{name}_steps AS (SELECT {k}, 1 AS k, m FROM {source} UNION ALL SELECT {k}, k + 1, {step} FROM {name}_steps WHERE k <= {n}), {name} AS (SELECT {k}, m FROM {name}_steps WHERE k = {n} + 1)"


def normal(columns: list[str], rhs: list[str], weight: str) -> str:
    """The matrix of weighted sums of products of columns, with columns of products with each rhs, as a list of rows."""
    return "[" + ", ".join("[" + ", ".join(f"sum({weight} * ({a}) * ({b}))" for b in [*columns, *rhs]) + "]" for a in columns) + "]"


def law_fit(points: str, start: list[float], steps: int = 6, quality: bool = False, fixed: tuple[int, str] | None = None) -> str:
    """CTEs up to `fit` (g, t, objective): the law fitted by least squares of log residuals to each g of points (g, n, d, l, w, and q with quality, all in logarithms but w), by Gauss-Newton steps.

    t: logarithms of A, B, E at the centre of n and d, then alpha, beta, gamma. Where residuals stay under the Huber bound this is the fit's objective. fixed: (place, SQL of points' value) of a parameter that stays.
    """
    n, d = "(n - 22.0)", f"(d - 24.0{' + t[6] * q' if quality else ''})"
    z = [f"exp(t[1] - t[4] * {n})", f"exp(t[2] - t[5] * {d})", "exp(t[3])"]
    total = "(" + " + ".join(z) + ")"
    jac = [f"{z[0]} / {total}", f"{z[1]} / {total}", f"{z[2]} / {total}", f"-{z[0]} / {total} * {n}", f"-{z[1]} / {total} * {d}"]
    if quality:
        jac.append(f"-{z[1]} / {total} * t[5] * q")
    r = f"(ln({total}) - l)"
    free = [i for i in range(len(jac)) if not fixed or i != fixed[0]]
    begin = "[" + ", ".join((fixed[1] if fixed and i == fixed[0] else f"{v!r}::DOUBLE") for i, v in enumerate(start)) + "]"
    parts = [f"t0 AS (SELECT DISTINCT g, {begin} AS t FROM {points})"]
    for s in range(steps):
        parts.append(f"m{s} AS (SELECT p.g, any_value(t) AS t, {normal([jac[i] for i in free], [r], 'w')} AS m FROM {points} p JOIN t{s} USING (g) GROUP BY p.g)")
        parts.append(solved(f"s{s}", f"m{s}", ["g"], len(free), len(free) + 1))
        moved = "[" + ", ".join(f"t[{i + 1}] - s{s}.m[{free.index(i) + 1}][{len(free) + 1}]" if i in free else f"t[{i + 1}]" for i in range(len(jac))) + "]"
        parts.append(f"t{s + 1} AS (SELECT g, {moved} AS t FROM t{s} JOIN s{s} USING (g))")
    parts.append(f"fit AS (SELECT p.g, any_value(t) AS t, sum(w * 0.5 * {r} * {r}) AS objective, max(abs({r})) AS widest FROM {points} p JOIN t{steps} USING (g) GROUP BY p.g)")
    return ", ".join(parts)
