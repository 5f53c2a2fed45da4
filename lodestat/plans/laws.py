"""Mixture, scaling-law and allocation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions import columns as C
from lodestat.operators import aggregates, allocation, linalg, optim, ranks, resample
from lodestat.operators.core import rounded, small, stored, table, unpivot
from lodestat.plans.registry import query

_P = "1.68982::DOUBLE AS e, 406.268::DOUBLE AS a, 0.339983::DOUBLE AS al, 409.744::DOUBLE AS b, 0.279888::DOUBLE AS be"
GAMMA = allocation.LAW | {"gamma": 0.8}


@query("SELECT l_orderkey, l_returnflag, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem GROUP BY 1, 2")
def row_normalised_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of an order's quantity by return flag: pivoted to one row an order, normalised there, unpivoted; one shuffle."""
    flags = ["A", "N", "R"]
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in flags], F.sum("l_quantity").alias("total"))
    return unpivot(wide, ["l_orderkey", "total"], flags, "l_returnflag", "q").filter("q is not null").select("l_orderkey", "l_returnflag", rounded(F.col("q") / F.col("total")).alias("share"))


@query(
    """WITH m AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey IN (0, 2, 3) THEN 0.1 + n_regionkey * 0.2 END AS q FROM nation), s AS (SELECT l_orderkey % 500 AS g, s_nationkey AS k, sum(l_quantity) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
t AS (SELECT g, sum(p) FILTER (q IS NOT NULL) / sum(p) AS mass, sum(p * q) / sum(p) FILTER (q IS NOT NULL) AS quality FROM s JOIN m USING (k) GROUP BY g)
SELECT g, round(coalesce(mass, 0), 6) AS mass, round(quality, 6) AS quality FROM t"""
)
def mapped_mass_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped mass and mean quality over mapped domains; domains without a map count in the mass only."""
    quality = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey").isin(0, 2, 3), 0.1 + F.col("n_regionkey") * 0.2).alias("q"))
    of = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(small(quality), F.col("s_nationkey") == F.col("n_nationkey"))
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("g"), "l_suppkey", "l_quantity").groupBy("g", "l_suppkey").agg(F.sum("l_quantity").alias("p")).join(small(of), F.col("l_suppkey") == F.col("s_suppkey"))
    mapped = F.sum(F.when(F.col("q").isNotNull(), F.col("p")))
    return x.groupBy("g").agg(rounded(F.coalesce(mapped / F.sum("p"), F.lit(0.0))).alias("mass"), rounded(F.try_divide(F.sum(F.col("p") * F.col("q")), mapped)).alias("quality"))


@query(
    """WITH o AS (SELECT o_orderpriority AS p, o_totalprice AS y, date_diff('day', DATE '2001-08-01', o_orderdate::DATE) / 365.25 AS t, ln(o_custkey + 1) AS x FROM orders),
c AS (SELECT p, count(*) AS n, covar_pop(x, y) AS xy, covar_pop(x, t) AS xt, covar_pop(t, y) AS ty, var_pop(x) AS xx, var_pop(t) AS tt FROM o GROUP BY p)
SELECT p AS priority, n, round(ty / tt, 3) AS g_time, round((xy * tt - ty * xt) / (xx * tt - xt * xt), 3) AS b, round(xt / tt, 6) AS s, round((ty - (xy * tt - ty * xt) / (xx * tt - xt * xt) * xt) / tt, 3) AS g FROM c"""
)
def ols_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date")) / F.lit(365.25)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("y"), t.alias("t"), F.log(F.col("o_custkey") + 1).alias("x"))
    out = linalg.exact_split(o, ["priority"], "y", "x", "t")
    return out.select("priority", "n", rounded("g_time", 3).alias("g_time"), rounded("b", 3).alias("b"), rounded("s").alias("s"), rounded("g", 3).alias("g"))


@query(
    """WITH p AS (SELECT p_type AS g, p_retailprice AS y, p_size::DOUBLE AS x FROM part), s AS (SELECT g, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS sl, regr_intercept(y, x) AS le, var_pop(x) * count(*) AS sxx FROM p GROUP BY g)
SELECT p.g AS part_type, s.n, round(sqrt(avg(((y - le - sl * x) / (1 - 1.0 / s.n - (x - mx) ** 2 / sxx)) ** 2)), 6) AS rmse FROM p JOIN s ON p.g = s.g GROUP BY p.g, s.n"""
)
def loo_linear_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("part_type"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))
    return linalg.leave_one_out(p, ["part_type"], "y", "x").select("part_type", "n", rounded("rmse").alias("rmse"))


@query(
    """WITH x AS (SELECT l_shipdate IS NOT NULL AS ok, l_returnflag AS target, l_extendedprice AS o, l_quantity * 2000.0 AS p FROM lineitem)
SELECT target, count(*) AS n, round(avg(abs(p - o)), 4) AS mae, round(sqrt(avg((p - o) ** 2)), 4) AS rmse, round(1 - sum((p - o) ** 2) / (count(*) * var_pop(o)), 6) AS r2, round(avg((p - o) / abs(o)), 6) AS mean_relative, round(avg(abs((p - o) / o)), 6) AS mean_absolute_relative FROM x GROUP BY target"""
)
def regression_metrics_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * 2000.0).alias("p"))
    out = aggregates.metrics(x, ["target"], "o", "p")
    return out.select("target", "n", rounded("mae", 4).alias("mae"), rounded("rmse", 4).alias("rmse"), *[rounded(c).alias(c) for c in ("r2", "mean_relative", "mean_absolute_relative")])


@query(
    """WITH x AS (SELECT l_discount AS x1, ln(l_extendedprice) AS y, ('0x' || substr(md5('42|' || l_orderkey), 1, 8))::BIGINT % 5 AS f FROM lineitem), s AS (SELECT f, count(*) AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY f),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM s), al AS (SELECT * FROM (VALUES (0.0001), (1.0), (100.0)) v(alpha)),
k AS (SELECT alpha, s.f, s.n, s.sx, s.sy, s.sxx, s.sxy, s.syy, ((t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy) / (t.n - s.n)) / ((t.sxx - s.sxx) - (t.sx - s.sx) ** 2 / (t.n - s.n) + alpha) AS b, t.n - s.n AS tn, t.sx - s.sx AS tx, t.sy - s.sy AS tyy FROM s, t, al),
e AS (SELECT alpha, sqrt(sum(syy - 2 * ((tyy / tn - b * tx / tn) * sy + b * sxy) + (tyy / tn - b * tx / tn) ** 2 * n + 2 * (tyy / tn - b * tx / tn) * b * sx + b * b * sxx) / sum(n)) AS rmse FROM k GROUP BY alpha)
SELECT round(arg_min(alpha, rmse), 4) AS alpha, round(min(rmse), 6) AS cv_rmse, round((any_value(t.sxy) - any_value(t.sx) * any_value(t.sy) / any_value(t.n)) / (any_value(t.sxx) - any_value(t.sx) ** 2 / any_value(t.n) + arg_min(alpha, rmse)), 5) AS slope FROM e, t"""
)
def ridge_gram_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with cross-validated penalty from one pass of sums."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x1"), F.log("l_extendedprice").alias("y"), linalg.folds(F.col("l_orderkey"), 5, 42).alias("f"))
    best = linalg.ridge_cv(x, ["x1"], ["y"], "f", [1e-4, 1.0, 100.0])[0]
    return spark.createDataFrame([(best["alpha"], round(best["cv_rmse"], 6), round(best["b_x1"], 5))], "alpha double, cv_rmse double, slope double")


@query(
    """WITH c AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, ln(l_extendedprice) AS y, ln(l_quantity) AS x FROM lineitem), s AS (SELECT flag, status, line, regr_slope(y, x) AS slope FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT count(*) AS cells, count(*) FILTER (slope > 0) AS positive, count(*) FILTER (slope < 0) AS negative, round(median(slope), 6) AS median, round(min(slope), 6) AS lowest, round(max(slope), 6) AS highest FROM s"""
)
def cell_log_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.regr_slope(F.log("l_extendedprice"), F.log("l_quantity")).alias("slope"), F.count("*").alias("n")).filter("n >= 3")
    return s.agg(F.count("*").alias("cells"), F.count_if(F.col("slope") > 0).alias("positive"), F.count_if(F.col("slope") < 0).alias("negative"), rounded(F.percentile("slope", 0.5)).alias("median"), rounded(F.min("slope")).alias("lowest"), rounded(F.max("slope")).alias("highest"))


@query(
    """SELECT count(*) AS n, count(DISTINCT p_size) AS sizes, count(DISTINCT p_type) AS types, count(DISTINCT p_size) * count(DISTINCT p_type) AS cells, count(DISTINCT (p_size, p_type)) AS filled, count(*) - count(DISTINCT (p_size, p_type)) AS repeats,
count(DISTINCT p_size) * count(DISTINCT p_type) = count(DISTINCT (p_size, p_type)) AS complete, min(p_retailprice) AS lowest, max(len(split_part(p_retailprice::VARCHAR, '.', 2))) AS decimals FROM part"""
)
def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    sizes, types, filled = F.count_distinct("p_size"), F.count_distinct("p_type"), F.count_distinct(F.struct("p_size", "p_type"))
    one = p.agg(F.count("*").alias("n"), sizes.alias("sizes"), types.alias("types"), filled.alias("filled"), F.min("p_retailprice").alias("lowest"), F.max(F.length(F.split_part(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(2)))).cast("bigint").alias("decimals"))
    return one.select("n", "sizes", "types", (F.col("sizes") * F.col("types")).alias("cells"), "filled", (F.col("n") - F.col("filled")).alias("repeats"), (F.col("sizes") * F.col("types") == F.col("filled")).alias("complete"), "lowest", "decimals")


@query("SELECT l_returnflag AS flag, min(l_quantity) AS lowest, count(*) FILTER (l_quantity = m) AS times FROM (SELECT l_returnflag, l_quantity, min(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1")
def min_clamp_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the smallest value stands: counts by value, then the count of the least."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    return counts.groupBy(F.col("l_returnflag").alias("flag")).agg(F.min("l_quantity").alias("lowest"), F.min_by("c", "l_quantity").alias("times"))


_LAWQ = f"x AS (SELECT p_partkey, p_size * 1e8 AS n, p_retailprice * 1e8 AS d, 0.2 + (p_partkey % 8) * 0.1 AS q, {_P}, 0.8::DOUBLE AS ga FROM part)"


@query(
    f"""WITH {_LAWQ}, y AS (SELECT *, b * pow(q, -ga * be) * pow(d, -be) AS t FROM x)
SELECT p_partkey, round(e + a * pow(n, -al) + t, 6) AS loss, round(-al * a * pow(n, -al) / (e + a * pow(n, -al) + t), 6) AS el_n, round(-be * t / (e + a * pow(n, -al) + t), 6) AS el_d, round(-ga * be * t / (e + a * pow(n, -al) + t), 6) AS el_q,
round((pow(n, -al) + 0.05 / a) ** (-1 / al) / n - 1, 6) AS saving, round(CASE WHEN pow(n, -al) - 0.05 / a > 0 THEN (pow(n, -al) - 0.05 / a) ** (-1 / al) / n - 1 END, 6) AS equivalent FROM y"""
)
def law_predict_elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1e8).alias("n"), (F.col("p_retailprice") * 1e8).alias("d"), (0.2 + (F.col("p_partkey") % 8) * 0.1).alias("q"))
    n, d, q = F.col("n"), F.col("d"), F.col("q")
    part, loss, drop = C.partials(n, d, q, GAMMA), C.law(n, d, GAMMA, q), F.lit(0.05)
    return x.select(
        "p_partkey", rounded(loss).alias("loss"), rounded(part["dl_dn"] * n / loss).alias("el_n"), rounded(part["dl_dd"] * d / loss).alias("el_d"), rounded(part["dl_dq"] * q / loss).alias("el_q"),
        rounded(C.parameter_saving(n, drop, GAMMA) / n).alias("saving"), rounded(C.equivalent_capacity(n, drop, GAMMA) / n).alias("equivalent"),
    )


@query(f"WITH {_LAWQ}, y AS (SELECT e + a * pow(n, -al) + b * pow(d, -be) AS raw, e + a / pow(1e9, al) * pow(n / 1e9, -al) + b / pow(1e9, be) * pow(d / 1e9, -be) AS scaled FROM x) SELECT count(*) AS n, max(abs(raw / scaled - 1)) < 1e-12 AS invariant, round(avg(raw), 6) AS mean_loss FROM y")
def unit_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law over raw and over scaled units predicts the same."""
    scaled = allocation.LAW | {"A": allocation.LAW["A"] / 1e9 ** allocation.LAW["alpha"], "B": allocation.LAW["B"] / 1e9 ** allocation.LAW["beta"]}
    back = C.to_raw_units(scaled, 1e9, 1e9)
    n, d = F.col("p_size") * 1e8, F.col("p_retailprice") * 1e8
    x = table(spark, sf_dir, "part").select(C.law(n, d, back).alias("raw"), C.law(n / 1e9, d / 1e9, scaled).alias("scaled"))
    return x.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("raw") / F.col("scaled") - 1)) < 1e-12).alias("invariant"), rounded(F.avg("raw")).alias("mean_loss"))


_SOLVE = """g AS (SELECT c AS budget, x AS context, 6.0 + 2e-4 * x AS k, {p}, 7.054e7::DOUBLE AS n0, 1.1965825e10::DOUBLE AS n1, 1.34e8::DOUBLE AS d0, 2.99893e11::DOUBLE AS d1 FROM {grid}),
cand AS (SELECT *, unnest([n0, least(n1, budget / (k * d0)), budget / (k * d1), (al * a / (be * b) * pow(budget / k, be)) ** (1 / (al + be))]) AS n, unnest([1, 2, 3, 4]) AS which FROM g WHERE budget >= k * n0 * d0),
ok AS (SELECT *, least(d1, budget / (k * n)) AS d FROM cand WHERE n >= n0 AND n <= least(n1, budget / (k * d0)) AND (which < 4 OR budget / (k * n) <= d1)),
sol AS (SELECT budget, context, any_value(k) AS k, min(e + a * pow(n, -al) + b * pow(d, -be)) AS loss, arg_min(n, e + a * pow(n, -al) + b * pow(d, -be)) AS n, arg_min(d, e + a * pow(n, -al) + b * pow(d, -be)) AS d FROM ok GROUP BY budget, context),
lab AS (SELECT *, abs(k * n * d - budget) <= 1e-12 * greatest(k * n * d, budget) AS sat, concat_ws('+', CASE WHEN abs(n - 7.054e7) <= 1e-9 * n THEN 'N_min' END, CASE WHEN abs(n - 1.1965825e10) <= 1e-9 * 1.1965825e10 THEN 'N_max' END, CASE WHEN abs(d - 1.34e8) <= 1e-9 * d THEN 'D_min' END, CASE WHEN abs(d - 2.99893e11) <= 1e-9 * 2.99893e11 THEN 'D_max' END) AS bounds FROM sol),
r AS (SELECT *, CASE WHEN sat THEN 'SATURATED:' ELSE 'SLACK:' END || CASE WHEN bounds = '' THEN 'interior' ELSE bounds END AS regime FROM lab)"""
_GRID = "(SELECT DISTINCT pow(10.0, 18 + p_size % 7) AS c, [2048, 4096, 8192, 32768, 131072][1 + p_partkey % 5] AS x FROM part)"


def _points(spark: SparkSession, sf_dir: str, exponent: Column, contexts: list[int]) -> DataFrame:
    """(budget, context) that parts make: a power of ten, and one of the contexts by key; equal ones once."""
    at = F.get(F.array(*[F.lit(c).cast("bigint") for c in contexts]), (F.col("p_partkey") % len(contexts)).cast("int"))
    return table(spark, sf_dir, "part").select(F.pow(F.lit(10.0), exponent).alias("budget"), at.alias("context")).distinct()


@query(f"WITH {_SOLVE.format(p=_P, grid=_GRID)} SELECT context, round(log10(budget), 6) AS log_budget, round(log10(n), 6) AS log_n, round(log10(d), 6) AS log_d, round(loss, 6) AS loss, sat AS saturated, regime FROM r")
def allocation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimum of each budget and context that parts make, over the published contexts."""
    out = allocation.solve(_points(spark, sf_dir, 18 + F.col("p_size") % 7, allocation.CONTEXTS))
    return out.select("context", *[rounded(F.log10(c)).alias(f"log_{c}") for c in ("budget", "n", "d")], rounded("loss").alias("loss"), "saturated", "regime")


_BUDGETS = "(SELECT DISTINCT pow(10.0, 18 + (p_size % 29) * 0.25) AS c, [2048, 32768][1 + p_partkey % 2] AS x FROM part)"


@query(
    f"""WITH {_SOLVE.format(p=_P, grid=_BUDGETS)}, w AS (SELECT context, budget, regime, lag(regime) OVER (PARTITION BY context ORDER BY budget) AS prev FROM r)
SELECT context, round(log10(budget), 4) AS log_budget, prev AS from_regime, regime AS to_regime FROM w WHERE prev IS NOT NULL AND prev <> regime"""
)
def regime_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the regime changes along the budgets that parts make, by context."""
    out = allocation.solve(_points(spark, sf_dir, 18 + (F.col("p_size") % 29) * 0.25, [2048, 32768])).filter("regime is not null")
    w = Window.partitionBy("context").orderBy("budget")
    return out.withColumn("prev", F.lag("regime").over(w)).filter("prev <> regime").select("context", rounded(F.log10("budget"), 4).alias("log_budget"), F.col("prev").alias("from_regime"), F.col("regime").alias("to_regime"))


@query(
    f"""WITH g AS (SELECT x AS context, 6.0 + 2e-4 * x AS k, {_P} FROM (SELECT DISTINCT [2048, 32768, 131072][1 + p_partkey % 3] AS x FROM part))
SELECT context, kind, round(log10(CASE WHEN kind IN ('n_min', 'n_max') THEN k * v * (be * b * pow(v, al) / (al * a)) ** (1 / be) ELSE k * v * (al * a * pow(v, be) / (be * b)) ** (1 / al) END), 6) AS log_budget
FROM g, (VALUES ('n_min', 7.054e7), ('n_max', 1.1965825e10), ('d_min', 1.34e8), ('d_max', 2.99893e11)) s(kind, v)"""
)
def regime_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _points(spark, sf_dir, F.lit(0.0), [2048, 32768, 131072]).select("context")
    return allocation.thresholds(contexts).select("context", "kind", rounded(F.log10("budget")).alias("log_budget"))


@query(
    f"""WITH g AS (SELECT u.c AS budget, u.x AS context, 6.0 + 2e-4 * u.x AS k, 406.268 + s2 * 5e-4 AS a, 0.339983 + s1 * 5e-7 AS al, 409.744::DOUBLE AS b, 0.279888 + s3 * 5e-7 AS be FROM (SELECT DISTINCT pow(10.0, 19 + 2 * (p_size % 2)) AS c, [2048, 32768][1 + p_partkey % 2] AS x FROM part) u, (VALUES (-1), (1)) p(s1), (VALUES (-1), (1)) q(s2), (VALUES (-1), (1)) r(s3)),
o AS (SELECT budget, context, ln((al * a / (be * b) * pow(budget / k, be)) ** (1 / (al + be))) AS v FROM g)
SELECT round(log10(budget), 4) AS log_budget, context, count(*) AS corners, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round((max(v) - min(v)) * 1000, 5) AS width_permille, CASE WHEN max(v) - min(v) = 0 THEN 'DEGENERATE' WHEN max(v) - min(v) > 2e-4 THEN 'RESOLVED' ELSE 'NOT_RESOLVED' END AS verdict FROM o GROUP BY budget, context"""
)
def loo_corner_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the optimum over the corners of what rounding hides in the parameters."""
    points = _points(spark, sf_dir, 19 + 2 * (F.col("p_size") % 2), [2048, 32768])
    signs = spark.createDataFrame([(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], "s1 int, s2 int, s3 int")
    k = allocation.kappa(F.col("context"))
    a, al, b, be = 406.268 + F.col("s2") * 5e-4, 0.339983 + F.col("s1") * 5e-7, F.lit(409.744), 0.279888 + F.col("s3") * 5e-7
    v = F.log(F.pow(al * a / (be * b) * F.pow(F.col("budget") / k, be), 1 / (al + be)))
    o = points.crossJoin(F.broadcast(signs)).select("budget", "context", v.alias("v"))  # 4 points by 8 corners
    width = F.max("v") - F.min("v")
    return o.groupBy("budget", "context").agg(F.count("*").alias("corners"), rounded(F.min("v")).alias("lowest"), rounded(F.max("v")).alias("highest"), rounded(width * 1000, 5).alias("width_permille"), F.when(width == 0, "DEGENERATE").when(width > 2e-4, "RESOLVED").otherwise("NOT_RESOLVED").alias("verdict")).select(rounded(F.log10("budget"), 4).alias("log_budget"), "context", "corners", "lowest", "highest", "width_permille", "verdict")


#: The published cost families.
FAMILIES = [("exponential", 1e7, 6.0), ("power", 5e9, 4.0), ("logarithmic", 2e9, 10.0)]


_FAMILY = "CASE {0}.kind WHEN 'exponential' THEN {0}.gamma * exp({0}.lam * {1}) WHEN 'power' THEN {0}.gamma * pow({1}, {0}.lam) ELSE {0}.gamma * ln(1 + {0}.lam * {1}) END"
_GAP = f"ln({_FAMILY.format('a', '{0}')}) - ln({_FAMILY.format('b', '{0}')})"


@query(
    f"""WITH RECURSIVE fam AS (SELECT f.* FROM (VALUES ('exponential', 1e7, 6.0::DOUBLE), ('power', 5e9, 4.0::DOUBLE), ('logarithmic', 2e9, 10.0::DOUBLE)) f(kind, gamma, lam), (SELECT DISTINCT ['exponential', 'power', 'logarithmic'][1 + p_partkey % 3] AS own FROM part) WHERE own = kind), cell AS (SELECT a.kind AS first, b.kind AS second, pow(10.0, i / 100.0 - 5) AS lo, pow(10.0, (i + 1) / 100.0 - 5) AS hi FROM fam a, fam b, (SELECT unnest(generate_series(0, 499)) AS i) WHERE a.kind < b.kind),
h AS (SELECT first, second, lo, hi, 0 AS step FROM cell JOIN fam a ON a.kind = first JOIN fam b ON b.kind = second WHERE sign({_GAP.format('lo')}) <> sign({_GAP.format('hi')})
UNION ALL SELECT first, second, CASE WHEN sign({_GAP.format('lo')}) * sign({_GAP.format('((lo + hi) / 2)')}) <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN sign({_GAP.format('lo')}) * sign({_GAP.format('((lo + hi) / 2)')}) <= 0 THEN (lo + hi) / 2 ELSE hi END, step + 1 FROM h JOIN fam a ON a.kind = first JOIN fam b ON b.kind = second WHERE step < 60)
SELECT first, second, round((lo + hi) / 2, 12) AS q FROM h WHERE step = 60"""
)
def cost_family_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities at which two cost families cost the same: sign changes on a grid, each halved to the root."""
    own = F.get(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(g).alias("gamma"), F.lit(v).alias("lam")) for k, g, v in FAMILIES]), (F.col("p_partkey") % 3).cast("int"))
    fam = stored(table(spark, sf_dir, "part").select(own.alias("f")).distinct().select("f.*"))  # the families that parts have
    a = fam.select(*[F.col(c).alias(f"a_{c}") for c in fam.columns])
    b = fam.select(*[F.col(c).alias(f"b_{c}") for c in fam.columns])
    pairs = a.join(F.broadcast(b), F.col("a_kind") < F.col("b_kind"))  # three families
    gap = lambda q: F.log(allocation.cost_family(F.col("a_kind"), q, F.col("a_gamma"), F.col("a_lam"))) - F.log(allocation.cost_family(F.col("b_kind"), q, F.col("b_gamma"), F.col("b_lam")))
    cells = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(499)))).withColumn("low", F.pow(F.lit(10.0), F.col("i") / 100 - 5)).withColumn("high", F.pow(F.lit(10.0), (F.col("i") + 1) / 100 - 5))
    cells = cells.filter(F.signum(gap(F.col("low"))) != F.signum(gap(F.col("high"))))
    return cells.select(F.col("a_kind").alias("first"), F.col("b_kind").alias("second"), rounded(allocation.bisect(F.col("low"), F.col("high"), gap), 12).alias("q"))


@query()
def law_fit_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law fitted, from many starts, to losses that a known law makes of part sizes and prices, grouped."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 1e8).alias("n"), (F.round("p_retailprice", -1) * 1e8).alias("d")).groupBy("n", "d").agg(F.count("*").alias("w"))
    out = optim.fit_law(spark, p.withColumn("loss", C.law(F.col("n"), F.col("d"), allocation.LAW)), "n", "d", "loss", "w")
    best = out.agg(F.min_by(F.struct("A", "B", "E", "alpha", "beta"), F.struct("objective", "start")).alias("b"), F.count("*").alias("starts"), F.min("objective").alias("objective"))
    return best.select("b.*", "objective", "starts")


@query("SELECT 108::BIGINT AS starts, 1.7::DOUBLE AS e, 0.34::DOUBLE AS alpha, 0.3::DOUBLE AS beta, true AS exact")
def law_fit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fit finds the law that made its data: as many digits as the smallest tables determine."""
    b = law_fit_multistart(spark, sf_dir)
    return b.select("starts", rounded("E", 1).alias("e"), rounded("alpha", 2).alias("alpha"), rounded("beta", 1).alias("beta"), (F.col("objective") < 1e-9).alias("exact"))


@query(
    """WITH m AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, 0.9) AS y FROM orders GROUP BY 1, 2), d AS (SELECT p, ((substr(month, 1, 4)::INT - 1995) * 12 + substr(month, 6, 2)::INT)::DOUBLE AS x, y FROM m),
l AS (SELECT a.p, (b.y - a.y) / (b.x - a.x) AS slope, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS level FROM d a JOIN d b ON a.p = b.p AND a.x < b.x), e AS (SELECT l.p, slope, level, sum(CASE WHEN y - level - slope * x >= 0 THEN 0.9 * (y - level - slope * x) ELSE -0.1 * (y - level - slope * x) END) AS loss FROM l JOIN d ON l.p = d.p GROUP BY 1, 2, 3)
SELECT p AS o_orderpriority, (SELECT count(*) FROM d WHERE d.p = e.p) AS n, round(min(loss), 2) AS loss FROM e GROUP BY p"""
)
def quantile_line_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact quantile line of each priority loses, which no line through two months undercuts."""
    o = stored(_monthly_best(spark, sf_dir))
    line = optim.quantile_fits(o, "o_orderpriority", "x", "y", 0.9).withColumnRenamed("o_orderpriority", "p")
    r = F.col("y") - F.col("level") - F.col("slope") * F.col("x")
    return o.join(small(line), F.col("o_orderpriority") == F.col("p")).groupBy("o_orderpriority", "n").agg(rounded(F.sum(F.when(r >= 0, 0.9 * r).otherwise(-0.1 * r)), 2).alias("loss"))


def _monthly_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_totalprice")
    y = ranks.quantiles(o, ["o_orderpriority", "m"], "o_totalprice", {"y": 0.9})
    return y.select("o_orderpriority", "y", ((F.substring("m", 1, 4).cast("int") - 1995) * 12 + F.substring("m", 6, 2).cast("int")).cast("double").alias("x"))


@query(
    """WITH m AS (SELECT o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, 0.9) AS y, avg(ln(o_custkey + 1)) AS x FROM orders GROUP BY 1, 2 HAVING count(*) >= 2), d AS (SELECT p, y, x, ((substr(month, 1, 4)::INT - 1995) * 12 + substr(month, 6, 2)::INT) / 12.0 AS t FROM m),
c AS (SELECT p, count(*) AS n, covar_pop(x, y) AS xy, covar_pop(x, t) AS xt, covar_pop(t, y) AS ty, var_pop(x) AS xx, var_pop(t) AS tt FROM d GROUP BY p)
SELECT p AS priority, n, round(ty / tt, 3) AS g_time, round((xy * tt - ty * xt) / (xx * tt - xt * xt) * xt / tt, 3) AS carried, round((ty - (xy * tt - ty * xt) / (xx * tt - xt * xt) * xt) / tt, 3) AS rest, n >= 30 AS eligible FROM c"""
)
def frontier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier's rate by priority, split into what another regressor carries and the rest; which priorities have months enough."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_totalprice", F.log(F.col("o_custkey") + 1).alias("lx"))
    y = ranks.quantiles(o, ["o_orderpriority", "m"], "o_totalprice", {"y": 0.9}).filter("n >= 2").drop("n")
    x = o.groupBy(F.col("o_orderpriority").alias("xp"), F.col("m").alias("xm")).agg(F.avg("lx").alias("x"))
    d = y.join(small(x), (F.col("o_orderpriority") == F.col("xp")) & (F.col("m") == F.col("xm"))).select(F.col("o_orderpriority").alias("priority"), "y", "x", (((F.substring("m", 1, 4).cast("int") - 1995) * 12 + F.substring("m", 6, 2).cast("int")) / 12).alias("t"))
    out = linalg.exact_split(d, ["priority"], "y", "x", "t")
    return out.select("priority", "n", rounded("g_time", 3).alias("g_time"), rounded(F.col("b") * F.col("s"), 3).alias("carried"), rounded("g", 3).alias("rest"), (F.col("n") >= 30).alias("eligible"))


@query()
def quantile_regression_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 90 % quantile line of monthly best prices by priority."""
    return optim.quantile_fits(_monthly_best(spark, sf_dir), "o_orderpriority", "x", "y", 0.9)


@query("SELECT 12::BIGINT AS refined, 1.7::DOUBLE AS e, 0.34::DOUBLE AS alpha, 0.8::DOUBLE AS gamma, true AS exact")
def quality_law_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fit of the law with quality finds the law that made its data: 324 starts screened, twelve refined."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 1e8).alias("n"), (F.pow(F.lit(10.0), 8 + F.col("p_partkey") % 5)).alias("d"), (0.2 + (F.col("p_partkey") % 8) * 0.1).alias("q")).distinct()
    out = optim.fit_quality_law(spark, p.withColumn("loss", C.law(F.col("n"), F.col("d"), GAMMA, F.col("q"))), "n", "d", "q", "loss")
    best = out.agg(F.min_by(F.struct("E", "alpha", "gamma"), F.struct("objective", "start")).alias("b"), F.count("*").alias("refined"), F.min("objective").alias("objective"))
    return best.select("refined", rounded("b.E", 1).alias("e"), rounded("b.alpha", 2).alias("alpha"), rounded("b.gamma", 2).alias("gamma"), (F.col("objective") < 1e-9).alias("exact"))


@query("SELECT 40::BIGINT AS replicates, 0::BIGINT AS failed, 0.34::DOUBLE AS alpha_low, 0.34::DOUBLE AS alpha_high, 1.7::DOUBLE AS e_low, 1.7::DOUBLE AS e_high")
def law_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the law's parameters with clusters resampled and the law fitted again from a warm start; over data that a law made without noise, intervals close on its parameters. Failures are counted, not hidden."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("model"), (F.col("p_size") * 1e8).alias("n"), (F.pow(F.lit(10.0), 8 + F.col("p_partkey") % 5)).alias("d")).distinct()
    units = p.withColumn("loss", C.law(F.col("n"), F.col("d"), allocation.LAW)).groupBy("model").agg(*[F.sort_array(F.collect_list(F.struct("n", "d", "loss")))[c].alias(c) for c in ("n", "d", "loss")])  # at most 250 points a model
    law = allocation.LAW
    begin = np.array([np.log(law["A"] * 1.05), np.log(law["B"] * 0.95), np.log(law["E"]), law["alpha"], law["beta"]])
    out = resample.bootstrap(units, "model", optim.law_statistic(begin), ["A", "B", "E", "alpha", "beta"], 40, 42)
    out = stored(out)
    q = ranks.quantiles(out, [], "alpha", {"alpha_low": 0.025, "alpha_high": 0.975}).drop("n").join(F.broadcast(ranks.quantiles(out, [], "E", {"e_low": 0.025, "e_high": 0.975}).drop("n")))
    one = out.agg(F.count("*").alias("replicates"), F.count_if(F.col("alpha").isNull()).alias("failed"))
    return one.join(F.broadcast(q)).select("replicates", "failed", rounded("alpha_low", 2).alias("alpha_low"), rounded("alpha_high", 2).alias("alpha_high"), rounded("e_low", 1).alias("e_low"), rounded("e_high", 1).alias("e_high"))  # one row by one row


_EMB = "e AS (SELECT vec_id, unnest([1, 2, 3, 4, 5]) AS i, embedding FROM embeddings), v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM e)"


@query(
    f"""WITH {_EMB}, r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2.0 AS r FROM v), p AS (SELECT a.i AS a, b.i AS b, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2),
t AS (SELECT 'antagonistic' AS kind, * FROM (SELECT * FROM p ORDER BY rho LIMIT 3) UNION ALL SELECT 'redundant', * FROM (SELECT * FROM p ORDER BY rho DESC LIMIT 3)) SELECT kind, 'd' || a AS a, 'd' || b AS b, round(rho, 6) AS rho FROM t"""
)
def antagonist_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pairs of list parts that contradict each other most and the three that agree most: a top-k report."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i + 1}") for i in range(5)])
    names = [f"d{i + 1}" for i in range(5)]
    p = stored(ranks.spearman_pairs(unpivot(e, ["vec_id"], names, "name", "x"), "vec_id", "name", "x", names))
    worst, best = p.orderBy("rho").limit(3).withColumn("kind", F.lit("antagonistic")), p.orderBy(F.desc("rho")).limit(3).withColumn("kind", F.lit("redundant"))
    return worst.unionByName(best).select("kind", "a", "b", rounded("rho").alias("rho"))


@query(f"WITH {_EMB.replace('[1, 2, 3, 4, 5]', 'range(1, 65)')}, m AS (SELECT vec_id, i, (2 * (rank() OVER (PARTITION BY i ORDER BY x) - 1) + count(*) OVER (PARTITION BY i, x)) / (2.0 * count(*) OVER (PARTITION BY i)) AS s, x FROM v) SELECT vec_id, round(avg(s), 10) AS ecdf_mean, round(avg(x), 6) AS raw_mean FROM m GROUP BY 1")
def criterion_ecdf_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of criteria as the mean of each one's standing among all rows, beside the plain mean."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return ranks.midrank(e, ["i"], "x", "s").groupBy("vec_id").agg(rounded(F.avg("s"), 10).alias("ecdf_mean"), rounded(F.avg("x")).alias("raw_mean"))


@query(
    r"""WITH t AS (SELECT c_custkey, 'budget 10^' || (18 + c_custkey % 7) || CASE WHEN c_custkey % 2 = 0 THEN ' FLOPs [' || (c_custkey % 5) || '.5, 9]' ELSE ' flops' END AS s FROM customer), p AS (SELECT *, pow(10.0, nullif(regexp_extract(s, '10\^(\d+)', 1), '')::DOUBLE) AS v, try_cast(nullif(regexp_extract(s, '\[([0-9.]+), *([0-9.]+)\]', 1), '') AS DOUBLE) AS lo, try_cast(nullif(regexp_extract(s, '\[([0-9.]+), *([0-9.]+)\]', 2), '') AS DOUBLE) AS hi FROM t)
SELECT regexp_matches(s, '(?i)FLOPs') AS named, round(log10(v), 4) AS exponent, lo, hi, count(*) AS n FROM p GROUP BY 1, 2, 3, 4"""
)
def parsed_source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of ten and intervals out of text; what does not parse is null."""
    i = F.col("c_custkey")
    s = F.concat(F.lit("budget 10^"), (18 + i % 7).cast("string"), F.when(i % 2 == 0, F.concat(F.lit(" FLOPs ["), (i % 5).cast("string"), F.lit(".5, 9]"))).otherwise(F.lit(" flops")))
    t = table(spark, sf_dir, "customer").select(s.alias("s"))
    low, high = C.parsed_interval(F.col("s"))
    return t.groupBy(F.col("s").rlike("(?i)FLOPs").alias("named"), rounded(F.log10(C.power_of_ten(F.col("s"))), 4).alias("exponent"), low.alias("lo"), high.alias("hi")).agg(F.count("*").alias("n"))
