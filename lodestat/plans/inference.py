"""Queries of exact quantile planes, refits of laws, absorbed effects, many penalties at once, exact folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import allocation, effects, quantreg, ranks, refits, resample, ridge
from lodestat.operators.core import exact_folds, rounded, small, stored, table
from lodestat.plans.registry import query
from lodestat.plans.sqlmath import law_fit, normal, solved

TAU = 0.9
#: A share of which few numbers of rows have a whole multiple, so that optimal lines are single ones.
ODD_TAU = 0.8917


# -- exact quantile planes ----------------------------------------------------------------------------


def _months(orders: DataFrame, by: list[str]) -> DataFrame:
    """by, y (90 % quantile of price), x (mean log of customer), t (years) of each month with at least two orders."""
    o = orders.select(*by, F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_totalprice", F.log(F.col("o_custkey") + 1).alias("lx"))
    y = ranks.quantiles(o, [*by, "m"], "o_totalprice", {"y": TAU}).filter("n >= 2").drop("n")
    x = o.groupBy(*[F.col(c).alias(f"x_{c}") for c in [*by, "m"]]).agg(F.avg("lx").alias("x"))
    same = F.lit(True)
    for c in [*by, "m"]:
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    return y.join(small(x), same).select(*by, "y", "x", (((F.substring("m", 1, 4).cast("int") - 1995) * 12 + F.substring("m", 6, 2).cast("int")) / 12).alias("t"))


def _split_sql(rows: str, tau: float = TAU) -> str:
    """CTEs up to `split`: the three quantile fits of (g, x, t, y) by trying every line through two and every plane through three rows, and their split."""
    loss = f"sum(CASE WHEN {{r}} >= 0 THEN {tau} * ({{r}}) ELSE ({tau} - 1) * ({{r}}) END)"
    line = lambda x, y, name: f"""{name}_all AS (SELECT a.g, a.i, b.i AS j, (b.{y} - a.{y}) / (b.{x} - a.{x}) AS slope, a.{y} - (b.{y} - a.{y}) / (b.{x} - a.{x}) * a.{x} AS level FROM r a JOIN r b ON a.g = b.g AND a.i < b.i AND a.{x} <> b.{x}),
{name}_loss AS (SELECT l.g, level, slope, {loss.format(r=f'{y} - level - slope * {x}')} AS loss FROM {name}_all l JOIN r ON r.g = l.g GROUP BY l.g, l.i, l.j, level, slope),
{name} AS (SELECT g, arg_min(level, loss) AS level, arg_min(slope, loss) AS slope, min(loss) AS loss FROM {name}_loss GROUP BY g)"""  # noqa: E731
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, x, y) AS i FROM {rows}),
p3 AS (SELECT a.g, a.i, b.i AS j, c.i AS k, a.x AS ax, a.t AS at_, a.y AS ay, b.x - a.x AS bx, b.t - a.t AS bt, b.y - a.y AS by_, c.x - a.x AS cx, c.t - a.t AS ct, c.y - a.y AS cy FROM r a JOIN r b ON a.g = b.g AND a.i < b.i JOIN r c ON a.g = c.g AND b.i < c.i),
plane_all AS (SELECT g, i, j, k, (by_ * ct - cy * bt) / (bx * ct - cx * bt) AS b, (bx * cy - cx * by_) / (bx * ct - cx * bt) AS s, ax, at_, ay FROM p3 WHERE abs(bx * ct - cx * bt) > 1e-12),
plane_loss AS (SELECT l.g, b, s, ay - b * ax - s * at_ AS level, {loss.format(r='y - ay + b * ax + s * at_ - b * x - s * t')} AS loss FROM plane_all l JOIN r ON r.g = l.g GROUP BY l.g, l.i, l.j, l.k, b, s, ax, at_, ay),
plane AS (SELECT g, arg_min(level, loss) AS level, arg_min(b, loss) AS b, arg_min(s, loss) AS s, min(loss) AS loss FROM plane_loss GROUP BY g),
{line('t', 'y', 'trend')}, {line('t', 'x', 'growth')},
split AS (SELECT plane.g, (SELECT count(*) FROM r WHERE r.g = plane.g) AS n, trend.level AS level0, trend.slope AS g_time, plane.b AS b_scale, plane.s AS resid_rate, growth.slope AS scale_growth, plane.b * growth.slope AS scale_rate, plane.loss AS plane_loss FROM plane JOIN trend USING (g) JOIN growth USING (g))"""


_SPLIT_OUT = """n, round(level0, 2) AS level0, round(g_time, 3) AS g_time, round(scale_rate, 3) AS scale_rate, round(resid_rate, 3) AS resid_rate, round(scale_rate + resid_rate - g_time, 3) AS consistency_gap,
sign(scale_rate + resid_rate) = sign(g_time) AND abs(scale_rate + resid_rate - g_time) <= 0.5 * abs(g_time) AS consistent, round(plane_loss, 2) AS loss"""
_MONTHS = "strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, 0.9) AS y, avg(ln(o_custkey + 1)) AS x FROM {0} GROUP BY 1, 2 HAVING count(*) >= 2"
_T = "((substr(month, 1, 4)::INT - 1995) * 12 + substr(month, 6, 2)::INT) / 12.0 AS t"


def quantile_split(rows: DataFrame, by: list[str], y: str, x: str, t: str, tau: float = TAU) -> DataFrame:
    """(by, n, level0, g_time, b_scale, resid_rate, scale_growth, scale_rate, loss): the quantile trend of y, and the same with x beside t: what x carries by its own trend, and the rest. The parts need not add up."""
    fit = lambda xs, target, names: quantreg.quantile_planes(rows, by, xs, target, tau).select(*[F.col(c).alias(f"__{names[0]}_{c}") for c in by], *[F.col(a).alias(b) for a, b in names[1:]])
    plane = quantreg.quantile_planes(rows, by, [x, t], y, tau).select(*by, "n", F.col(f"b_{x}").alias("b_scale"), F.col(f"b_{t}").alias("resid_rate"), "loss")
    for name, side in (("trend", fit([t], y, ["trend", ("level", "level0"), (f"b_{t}", "g_time")])), ("growth", fit([t], x, ["growth", (f"b_{t}", "scale_growth")]))):
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__{name}_{c}"))
        plane = plane.join(small(side), same).drop(*[f"__{name}_{c}" for c in by])
    return plane.withColumn("scale_rate", F.col("b_scale") * F.col("scale_growth"))


def _split_out(split: DataFrame, *by: str) -> DataFrame:
    total, g = F.col("scale_rate") + F.col("resid_rate"), F.col("g_time")
    consistent = (F.signum(total) == F.signum(g)) & (F.abs(total - g) <= 0.5 * F.abs(g))
    return split.select(*by, "n", rounded("level0", 2).alias("level0"), *[rounded(c, 3).alias(c) for c in ("g_time", "scale_rate", "resid_rate")], rounded(total - g, 3).alias("consistency_gap"), consistent.alias("consistent"), rounded("loss", 2).alias("loss"))


@query(f"WITH m AS (SELECT o_orderpriority AS g, {_MONTHS.format('orders')}), d AS (SELECT g, y, x, {_T} FROM m), {_split_sql('d')} SELECT g AS priority, {_SPLIT_OUT} FROM split")
def quantile_frontier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier's trend by priority from exact quantile fits with one and two regressors, what scale carries, and whether the parts agree with the whole. SQL tries every line and plane through the data."""
    rows = stored(_months(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority"), ["priority"]))
    return _split_out(quantile_split(rows, ["priority"], "y", "x", "t"), "priority")


_POPULATIONS = {"all": "true", "finished": "o_orderstatus = 'F'", "open": "o_orderstatus = 'O'", "pressing": "o_orderpriority <= '2-HIGH'", "calm": "o_orderpriority > '2-HIGH'", "from_1997": "o_orderdate >= TIMESTAMP '1997-01-01'"}


@query(
    f"WITH v AS ({' UNION ALL '.join(f'''SELECT '{k}' AS g, * FROM orders WHERE {c}''' for k, c in _POPULATIONS.items())}), m AS (SELECT g, {_MONTHS.format('v')}), d AS (SELECT g, y, x, {_T} FROM m), {_split_sql('d', ODD_TAU)} SELECT g AS population, {_SPLIT_OUT}, sign(g_time) = sign((SELECT g_time FROM split WHERE g = 'all')) AS same_sign FROM split"
)
def split_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split over six populations, and whether the trend keeps its sign. A row goes to the populations that it is in before anything is grouped."""
    inside = F.array_compact(F.array(*[F.when(F.expr(c.replace("TIMESTAMP '1997-01-01'", "TIMESTAMP_NTZ '1997-01-01'")), F.lit(k)) for k, c in _POPULATIONS.items()]))
    rows = stored(_months(table(spark, sf_dir, "orders").withColumn("population", F.explode(inside)), ["population"]))
    split = stored(quantile_split(rows, ["population"], "y", "x", "t", ODD_TAU))
    whole = split.filter("population = 'all'").select(F.signum("g_time").alias("__sign"))
    out = _split_out(split, "population")
    return out.join(F.broadcast(whole), F.lit(True), "left").withColumn("same_sign", F.signum("g_time") == F.col("__sign")).drop("__sign")  # six rows by one row


@query()
def quantile_plane_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 90 % plane of all orders' prices over time and customer: rows near it are solved, the others enter by their sums."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 365.25).alias("t"), F.log(F.col("o_custkey") + 1).alias("x"))
    found = quantreg.quantile_plane(o, ["t", "x"], "o_totalprice", TAU, band=5_000, sample=2_000)
    r = quantreg._residual(["t", "x"], "o_totalprice", [found["level"], found["b_t"], found["b_x"]])
    sides = o.agg(F.count("*").alias("rows"), F.count_if(r > 1e-6).alias("above"), F.count_if(r < -1e-6).alias("below"), F.sum(quantreg.check_loss(r, TAU)).alias("loss"))
    return sides.select("rows", "above", "below", rounded("loss", 2).alias("loss"), *[F.lit(found[k]).alias(k) for k in ("level", "b_t", "b_x")])


# -- refits of the law --------------------------------------------------------------------------------

#: The noise of the made losses: up to 4e-4, by a hash of the point; residuals stay under the Huber bound, so that the optimum is that of least squares.
_NOISE = "(('0x' || substr(md5('noise|' || s || '|' || k), 1, 4))::BIGINT / 65535.0 - 0.5) * 8e-4"
_LAW = "1.68982 + 406.268 * pow(s * 1e8, -0.339983) + 409.744 * pow(pow({q}, {g}) * pow(10.0, 8 + k), -0.279888)"
_POINTS = f"points AS (SELECT s, k, ln(s * 1e8) AS n, ln(pow(10.0, 8 + k)) AS d, ln({_LAW.format(q='1.0', g='1.0')}) + {_NOISE} AS l FROM (SELECT DISTINCT p_size AS s, p_partkey % 5 AS k FROM part))"
_QPOINTS = f"points AS (SELECT s, k, h, ln(s * 1e8) AS n, ln(pow(10.0, 8 + k)) AS d, ln(0.2 + h * 0.1) AS q, ln({_LAW.format(q='(0.2 + h * 0.1)', g='0.8')}) + {_NOISE} AS l FROM (SELECT DISTINCT p_size AS s, p_partkey % 5 AS k, p_partkey % 8 AS h FROM part))"
_START = [math.log(406.268) - 0.339983 * 22, math.log(409.744) - 0.279888 * 24, math.log(1.68982), 0.339983, 0.279888]
_QSTART = [*_START, 0.8]


def _noise(*parts: Column) -> Column:
    key = F.concat_ws("|", F.lit("noise"), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("bigint") / F.lit(65535.0) - 0.5) * 8e-4


def _noisy(spark: SparkSession, sf_dir: str, quality: bool = False) -> DataFrame:
    """Sizes and data (and quality) of part with a law's losses and noise: model (a cluster of sizes), n, d, q, loss."""
    cols = [F.col("p_size").alias("s"), (F.col("p_partkey") % 5).alias("k"), *([(F.col("p_partkey") % 8).alias("h")] if quality else [])]
    p = table(spark, sf_dir, "part").select(*cols).distinct()
    n, d, q = F.col("s") * 1e8, F.pow(F.lit(10.0), 8 + F.col("k")), (0.2 + F.col("h") * 0.1 if quality else F.lit(1.0))
    exact = C.law(n, d, allocation.LAW | {"gamma": 0.8}, q) if quality else C.law(n, d, allocation.LAW)
    return p.select("s", "k", (F.col("s") % 10).alias("model"), n.alias("n"), d.alias("d"), q.alias("q"), (exact * F.exp(_noise(F.col("s"), F.col("k")))).alias("loss"))


def _fit_columns(names: list[str]) -> list[Column]:
    return [rounded(F.col(c), 5).alias(c) for c in names]


@query(f"WITH RECURSIVE {_POINTS}, w AS (SELECT 'all' AS g, *, 1.0 AS w FROM points), {law_fit('w', _START)} SELECT (SELECT count(*) FROM points) AS points, round(objective * 1e6, 5) AS objective_millionth, round(t[4], 5) AS alpha, round(t[5], 5) AS beta, round(exp(t[3]), 5) AS \"E\", widest < 1e-3 AS smooth FROM fit")
def noisy_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law fitted to noisy losses from many starts: the optimum is not the law that made them. SQL finds it by Gauss-Newton steps of its own."""
    from lodestat.operators import optim

    data = stored(_noisy(spark, sf_dir))
    starts = optim.fit_law(spark, data, "n", "d", "loss")
    best = starts.agg(F.min_by(F.struct("A", "B", "E", "alpha", "beta"), F.struct("objective", "start")).alias("b")).first()[0].asDict()
    points, _ = refits.collected(data, "n", "d", "loss")
    theta, value = points.fit(refits.anchor(best), points.c["w"], spread=False)
    widest = float(abs(points.model(theta)[0]).max())
    one = data.agg(F.count("*").alias("points"))
    return one.select("points", rounded(F.lit(value * 1e6), 5).alias("objective_millionth"), rounded(F.lit(float(theta[3])), 5).alias("alpha"), rounded(F.lit(float(theta[4])), 5).alias("beta"), rounded(F.lit(float(math.exp(theta[2]))), 5).alias("E"), F.lit(widest < 1e-3).alias("smooth"))


@query(
    f"""WITH RECURSIVE {_POINTS}, w AS (SELECT o.m AS g, p.*, 1.0 AS w FROM points p JOIN (SELECT DISTINCT s % 10 AS m FROM points) o ON p.s % 10 <> o.m), {law_fit('w', _START)},
o AS (SELECT fit.g, sqrt(avg((ln(exp(t[1] - t[4] * (n - 22.0)) + exp(t[2] - t[5] * (d - 24.0)) + exp(t[3])) - l) ** 2)) AS rmse FROM fit JOIN points p ON p.s % 10 = fit.g GROUP BY fit.g)
SELECT fit.g AS left_out, (SELECT count(*) FROM points WHERE s % 10 <> fit.g)::DOUBLE AS "rows", round(objective * 1e6, 5) AS objective_millionth, round(rmse * 1e3, 5) AS rmse_out_thousandth, round(t[4], 5) AS alpha, round(t[5], 5) AS beta, round(exp(t[3]), 5) AS "E" FROM fit JOIN o USING (g)"""
)
def law_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law fitted without each cluster of sizes, and its error there."""
    out = refits.leave_out(stored(_noisy(spark, sf_dir)), refits.anchor(allocation.LAW), "model", "n", "d", "loss")
    return out.select("left_out", "rows", rounded(F.col("objective") * 1e6, 5).alias("objective_millionth"), rounded(F.col("rmse_out") * 1e3, 5).alias("rmse_out_thousandth"), *_fit_columns(["alpha", "beta", "E"]))


_HELD = {"A": (0, "+ ln({f})"), "B": (1, "+ ln({f})"), "E": (2, "+ ln({f})"), "alpha": (3, "* {f}"), "beta": (4, "* {f}")}
_FACTORS = [0.9995, 0.9999, 1.0001, 1.0005]


def _profile_sql() -> str:
    """The whole fit, then for each parameter the fits with it held: its own CTEs, in a subquery. A and B are held as they stand in the law, not at the centre."""
    back = ["t[1] + t[4] * 22.0", "t[2] + t[5] * 24.0", "t[3]", "t[4]", "t[5]"]
    whole = f"(WITH RECURSIVE {_POINTS}, w AS (SELECT 0 AS g, *, 1.0 AS w FROM points), {law_fit('w', _START)} SELECT [{', '.join(back)}] AS full_t, objective AS base FROM fit)"
    parts = []
    for name, (i, change) in _HELD.items():
        if i < 2:
            continue  # with A or B held, their exponents move the centre: those are tested apart
        rows = f"w AS (SELECT row_number() OVER () AS g, f FROM (SELECT unnest({_FACTORS}) AS f)), v AS (SELECT w.g, w.f, p.*, 1.0 AS w, full_t[{i + 1}] {change.format(f='w.f')} AS held, base FROM w, points p, {whole} a)"
        fit = law_fit("v", _START, fixed=(i, "held")).replace("SELECT DISTINCT g,", "SELECT DISTINCT g,")
        parts.append(f"SELECT * FROM (WITH RECURSIVE {_POINTS}, {rows}, {fit} SELECT '{name}' AS parameter, (SELECT any_value(f) FROM v WHERE v.g = fit.g) AS factor, (SELECT any_value(base) FROM v) AS base, objective, t FROM fit)")
    return " UNION ALL ".join(parts)


@query(f"SELECT parameter, factor, round(objective * 1e6, 4) AS objective_millionth, round((objective - base) * 1e6, 4) AS excess_millionth, round(t[4], 5) AS alpha, round(t[5], 5) AS beta FROM ({_profile_sql()})")
def law_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the objective rises when E, alpha or beta is held beside its estimate and the others are fitted again."""
    out = refits.profile(stored(_noisy(spark, sf_dir)), refits.anchor(allocation.LAW), _FACTORS, "n", "d", "loss").filter(F.col("parameter").isin("E", "alpha", "beta"))
    return out.select("parameter", "factor", rounded(F.col("objective") * 1e6, 4).alias("objective_millionth"), rounded(F.col("excess") * 1e6, 4).alias("excess_millionth"), *_fit_columns(["alpha", "beta"]))


@query(
    f"""WITH RECURSIVE {_QPOINTS}, w AS (SELECT o.h AS g, p.n, p.d, p.q, p.l, 1.0 AS w FROM points p JOIN (SELECT DISTINCT h FROM points) o ON p.h <> o.h), {law_fit('w', _QSTART, quality=True)},
qo AS (SELECT fit.g, sqrt(avg((ln(exp(t[1] - t[4] * (n - 22.0)) + exp(t[2] - t[5] * (d - 24.0 + t[6] * q)) + exp(t[3])) - l) ** 2)) AS rmse FROM fit JOIN points p ON p.h = fit.g GROUP BY fit.g)
SELECT round(0.2 + g * 0.1, 1) AS quality, round(objective * 1e6, 5) AS objective_millionth, round(rmse * 1e3, 5) AS rmse_out_thousandth, round(t[6], 5) AS gamma, round(t[5], 5) AS beta FROM fit JOIN qo USING (g)"""
)
def leave_quality_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law with quality fitted without each level of quality, and its error at that level."""
    data = stored(_noisy(spark, sf_dir, quality=True).withColumn("level", F.round("q", 1)))
    out = refits.leave_out(data, refits.anchor(allocation.LAW | {"gamma": 0.8}), "level", "n", "d", "loss", "q")
    return out.select(F.col("left_out").alias("quality"), rounded(F.col("objective") * 1e6, 5).alias("objective_millionth"), rounded(F.col("rmse_out") * 1e3, 5).alias("rmse_out_thousandth"), *_fit_columns(["gamma", "beta"]))


@query(
    f"""WITH RECURSIVE {_POINTS}, u AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS slot, count(*) OVER () AS c FROM (SELECT DISTINCT s % 10 AS m FROM points)), rep AS (SELECT unnest(generate_series(0, 39)) AS r),
dr AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || slot), 1, 8))::BIGINT % c AS pos FROM u, rep), times AS (SELECT r, m, count(*)::DOUBLE AS k FROM dr JOIN u ON pos = slot GROUP BY r, m),
w AS (SELECT r AS g, p.n, p.d, p.l, times.k AS w FROM points p JOIN times ON p.s % 10 = m), {law_fit('w', _START)}
SELECT count(*) AS replicates, 0::BIGINT AS failed, round(quantile_cont(t[4], 0.025), 5) AS alpha_low, round(quantile_cont(t[4], 0.975), 5) AS alpha_high, round(quantile_cont(exp(t[3]), 0.025), 5) AS e_low, round(quantile_cont(exp(t[3]), 0.975), 5) AS e_high, quantile_cont(t[4], 0.975) > quantile_cont(t[4], 0.025) AS wide FROM fit"""
)
def noisy_law_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the law's parameters over noisy losses, clusters of sizes resampled; failed replicates are counted."""
    data = stored(_noisy(spark, sf_dir))
    drawn = resample.draws(data.select("model").distinct(), None, "model", 40, 42).groupBy("replicate", "model").agg(F.count("*").alias("times"))
    out = stored(refits.resampled(data, refits.anchor(allocation.LAW), drawn, "model", "n", "d", "loss"))
    q = ranks.quantiles(out, [], "alpha", {"alpha_low": 0.025, "alpha_high": 0.975}).drop("n").join(F.broadcast(ranks.quantiles(out, [], "E", {"e_low": 0.025, "e_high": 0.975}).drop("n")))
    one = out.agg(F.count("*").alias("replicates"), F.count_if("failed").alias("failed"))
    return one.join(F.broadcast(q)).select("replicates", "failed", *[rounded(c, 5).alias(c) for c in ("alpha_low", "alpha_high", "e_low", "e_high")], (F.col("alpha_high") > F.col("alpha_low")).alias("wide"))  # one row by one row


# -- absorbed effects, many penalties, exact folds ----------------------------------------------------


def _resid_sql(rows: str, out: str, columns: list[str], target: str) -> str:
    """CTE `out` with the slope of target on the last of columns beside the others and a level, by normal equations on centred columns; one row a g."""
    mean = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY g) AS {c}" for c in [*columns, target])
    k = len(columns)
    return f"{out}_c AS (SELECT g, {mean} FROM {rows}), {out}_m AS (SELECT g, count(*) AS n, {normal(columns, [target], '1.0')} AS m FROM {out}_c GROUP BY g), {solved(f'{out}_s', f'{out}_m', ['g'], k, k + 1)}, {out} AS (SELECT g, m[{k}][{k + 1}] AS slope FROM {out}_s)"


_YEARS = "(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 86400.0 / 365.25"
_FE = f"o AS (SELECT 1 AS g, ln(o_custkey + 1) AS x, ln(o_custkey + 1) ** 2 AS x2, {_YEARS} AS t, ln(o_totalprice) AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders)"
_TURNS = 12


def _two_way_sql() -> str:
    """Columns less priority and status effects, taken in turns."""
    parts, last = [], "o"
    for i in range(_TURNS):
        by = "p" if i % 2 == 0 else "s"
        parts.append(f"w{i} AS (SELECT g, p, s, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}' for c in ('x', 't', 'y'))} FROM {last})")
        last = f"w{i}"
    return ", ".join(parts)


@query(
    f"""WITH RECURSIVE {_FE}, {_resid_sql('o', 'lin', ['x', 't'], 'y')}, {_resid_sql('o', 'quad', ['x', 'x2', 't'], 'y')}, one AS (SELECT g, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY p) AS {c}' for c in ('t', 'y'))} FROM o), {_resid_sql('one', 'fe', ['t'], 'y')}, {_two_way_sql()}, {_resid_sql(f'w{_TURNS - 1}', 'both_', ['x', 't'], 'y')}
SELECT spec, (SELECT count(*) FROM orders)::DOUBLE AS n, round(slope, 6) AS time_trend FROM (SELECT 'linear' AS spec, slope FROM lin UNION ALL SELECT 'quadratic', slope FROM quad UNION ALL SELECT 'priority_effects', slope FROM fe UNION ALL SELECT 'priority_and_status_effects', slope FROM both_)"""
)
def time_trend_by_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time trend of log price that is left beside scale: linear, quadratic, with a level for each priority, and with levels for priorities and statuses."""
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 365.25
    o = stored(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.log(F.col("o_custkey") + 1).alias("x"), F.pow(F.log(F.col("o_custkey") + 1), 2).alias("x2"), t.alias("t"), F.log("o_totalprice").alias("y")))
    cases = {"linear": ([], ["x", "t"]), "quadratic": ([], ["x", "x2", "t"]), "priority_effects": (["o_orderpriority"], ["t"]), "priority_and_status_effects": (["o_orderpriority", "o_orderstatus"], ["x", "t"])}
    found = {k: effects.slopes(o, by, x, "y") for k, (by, x) in cases.items()}
    rows = F.array(*[F.struct(F.lit(k).alias("spec"), F.lit(v["n"]).alias("n"), rounded(F.lit(v["t"])).alias("time_trend")) for k, v in found.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


_FOLDS = "(SELECT {key} AS fk, CASE WHEN i < more * (size + 1) THEN i // (size + 1) ELSE more + (i - more * (size + 1)) // size END AS f FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || {key})) - 1 AS i, count(*) OVER () // {k} AS size, count(*) OVER () % {k} AS more FROM {rows}))"


@query(f"SELECT f::INT AS fold, count(*) AS n, sum(fk)::BIGINT AS sum_of_keys, min(fk) AS first_key, max(fk) AS last_key FROM {_FOLDS.format(key='o_orderkey', seed=42, k=7, rows='orders')} GROUP BY 1")
def exact_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven folds of orders of sizes that differ by one at most, after a keyed shuffle."""
    f = exact_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 42)
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum_of_keys"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


_PENALTIES = [0.01, 1.0, 30.0]
_RIDGE = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x, [label::DOUBLE, (label % 3)::DOUBLE, embedding[1]::DOUBLE * embedding[2] + label / 10.0] AS y FROM embeddings), fo AS (SELECT * FROM {_FOLDS.format(key='vec_id', seed=7, k=5, rows='embeddings')}),
r AS (SELECT f, list_concat(list_concat([1.0], x), y) AS v FROM e JOIN fo ON vec_id = fk), c AS (SELECT f, unnest(range(1, 69)) AS i, v FROM r), d AS (SELECT f, i, unnest(range(1, 69)) AS j, v FROM c), p AS (SELECT f, i, j, sum(v[i] * v[j]) AS s FROM d GROUP BY ALL),
a AS (SELECT i, j, sum(s) AS s FROM p GROUP BY ALL), tr AS (SELECT p.f, p.i, p.j, a.s - p.s AS s FROM p JOIN a USING (i, j) UNION ALL SELECT -1, i, j, s FROM a),
ce AS (SELECT q.f, q.i, q.j, q.s - u.s * v.s / w.s AS s FROM tr q JOIN tr u ON u.f = q.f AND u.i = 1 AND u.j = q.i JOIN tr v ON v.f = q.f AND v.i = 1 AND v.j = q.j JOIN tr w ON w.f = q.f AND w.i = 1 AND w.j = 1 WHERE q.i BETWEEN 2 AND 65 AND q.j >= 2),
ro AS (SELECT f, al, i, list(s + CASE WHEN i = j THEN al ELSE 0 END ORDER BY j) AS v FROM ce, (SELECT unnest({_PENALTIES}) AS al) GROUP BY f, al, i), ma AS (SELECT f, al, list(v ORDER BY i) AS m FROM ro GROUP BY f, al), {solved('so', 'ma', ['f', 'al'], 64, 67)},
be AS (SELECT f, al, t, list_transform(m, lambda z: z[64 + t]) AS b FROM so, (SELECT unnest([1, 2, 3]) AS t)),
mu AS (SELECT f, list(s ORDER BY j) AS v FROM tr WHERE i = 1 GROUP BY f),
ab AS (SELECT be.f, al, t, b, (mu.v[65 + t] - list_dot_product(b, mu.v[2:65])) / mu.v[1] AS level FROM be JOIN mu USING (f)),
er AS (SELECT al, t, sqrt(avg((level + list_dot_product(b, x) - y[t]) ** 2)) AS rmse FROM ab JOIN fo ON ab.f = fo.f JOIN e ON vec_id = fk GROUP BY al, t), ch AS (SELECT t, arg_min(al, rmse) AS al, min(rmse) AS rmse FROM er GROUP BY t)"""


@query(f"WITH RECURSIVE {_RIDGE} SELECT ch.t::INT AS target, ch.al AS penalty, round(ch.rmse, 6) AS cv_rmse, round(ab.level, 5) AS level, round(list_sum(list_transform(ab.b, lambda z: abs(z))), 4) AS weight, (list_position(list_transform(ab.b, lambda z: abs(z)), list_max(list_transform(ab.b, lambda z: abs(z)))))::INT AS heaviest FROM ch JOIN ab ON ab.f = -1 AND ab.t = ch.t AND ab.al = ch.al")
def ridge_many_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets on all 64 parts of the embedding, each with the penalty that five exact folds choose."""
    label = F.col("label").cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.array(label, label % 3, F.col("embedding")[0].cast("double") * F.col("embedding")[1] + label / 10).alias("y"))
    found = ridge.ridge_many(exact_folds(e, "vec_id", 5, 7), "x", "y", "fold", 64, 3, _PENALTIES)
    slopes = abs(found["beta"][1:])
    rows = [F.struct(F.lit(t + 1).alias("target"), F.lit(float(found["penalty"][t])).alias("penalty"), rounded(F.lit(float(found["cv_rmse"][t]))).alias("cv_rmse"), rounded(F.lit(float(found["beta"][0, t])), 5).alias("level"), rounded(F.lit(float(slopes[:, t].sum())), 4).alias("weight"), F.lit(int(slopes[:, t].argmax()) + 1).alias("heaviest")) for t in range(3)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    f"""WITH RECURSIVE {_QPOINTS}, w AS (SELECT o.h AS g, p.n, p.d, p.q, p.l, 1.0 AS w FROM points p JOIN (SELECT DISTINCT h FROM points) o ON p.h <> o.h), {law_fit('w', _QSTART, quality=True)},
e AS (SELECT avg((ln(exp(t[1] - t[4] * (n - 22.0)) + exp(t[2] - t[5] * (d - 24.0 + t[6] * q)) + exp(t[3])) - l) ** 2) AS own FROM fit JOIN points p ON p.h = fit.g),
c AS (SELECT s, k, count(*) AS c, sum(l) AS sl, regr_slope(l, q) AS slope FROM points GROUP BY 1, 2), b AS (SELECT avg((l - (sl - l) / (c - 1)) ** 2) AS flat FROM points JOIN c USING (s, k) WHERE c >= 2), dn AS (SELECT count(*) FILTER (c >= 3) AS cells, count(*) FILTER (c >= 3 AND slope < 0) AS negative FROM c)
SELECT (SELECT count(DISTINCT h) FROM points) AS levels, cells, negative, round(sqrt(own) * 1e3, 5) AS loqo_rmse_thousandth, round(sqrt(flat), 6) AS baseline_rmse, negative = cells AS direction_gate, own <= 0.25 * flat AS error_gate, (SELECT max(t[6]) - min(t[6]) FROM fit) <= 0.05 AS stability_gate, negative = cells AND own <= 0.25 * flat AND (SELECT max(t[6]) - min(t[6]) FROM fit) <= 0.05 AS candidate FROM e, b, dn"""
)
def quality_candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quality earns its place in the law: losses fall with it in every cell of size and data, levels left out are predicted far better than by the other levels' mean, and the exponent keeps still."""
    data = stored(_noisy(spark, sf_dir, quality=True).withColumn("level", F.round("q", 1)))
    out = stored(refits.leave_out(data, refits.anchor(allocation.LAW | {"gamma": 0.8}), "level", "n", "d", "loss", "q"))
    counts = data.groupBy(F.col("level").alias("left_out")).agg(F.count("*").alias("k"))
    error = out.join(small(counts), "left_out").agg(F.count("*").alias("levels"), (F.sum(F.col("k") * F.col("rmse_out") * F.col("rmse_out")) / F.sum("k")).alias("own"), (F.max("gamma") - F.min("gamma")).alias("spread"))
    cells = stored(data.groupBy("s", "k").agg(F.count("*").alias("c"), F.sum(F.log("loss")).alias("sl"), F.regr_slope(F.log("loss"), F.log("q")).alias("slope")))
    falls = cells.filter("c >= 3").agg(F.count("*").alias("cells"), F.count_if(F.col("slope") < 0).alias("negative"))
    each = data.select("s", "k", F.log("loss").alias("l")).join(small(cells.select(F.col("s").alias("cs"), F.col("k").alias("ck"), "c", "sl").filter("c >= 2")), (F.col("s") == F.col("cs")) & (F.col("k") == F.col("ck")))
    gap = F.col("l") - (F.col("sl") - F.col("l")) / (F.col("c") - 1)
    one = error.join(F.broadcast(falls)).join(F.broadcast(each.agg(F.avg(gap * gap).alias("flat"))))  # one row each
    gates = {"direction_gate": F.col("negative") == F.col("cells"), "error_gate": F.col("own") <= 0.25 * F.col("flat"), "stability_gate": F.col("spread") <= 0.05}
    every = gates["direction_gate"] & gates["error_gate"] & gates["stability_gate"]
    return one.select("levels", "cells", "negative", rounded(F.sqrt("own") * 1e3, 5).alias("loqo_rmse_thousandth"), rounded(F.sqrt("flat")).alias("baseline_rmse"), *[v.alias(k) for k, v in gates.items()], every.alias("candidate"))
