"""Compute allocation over budgets, sizes and costs that the tables hold: a row is a problem of its own, solved in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import allocation, mixtures
from lodestat.operators.core import rounded, small, table
from lodestat.plans.laws import _P, _SOLVE
from lodestat.plans.registry import query

_ROWS = "(SELECT DISTINCT o_totalprice * pow(10.0, 12 + o_orderkey % 9) AS c, [2048, 4096, 8192, 32768, 131072][1 + o_custkey % 5] AS x FROM orders)"


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(budget, context): what each order may spend, in powers of ten by its key, and the context of its customer; equal problems once."""
    contexts = F.array(*[F.lit(c).cast("bigint") for c in allocation.CONTEXTS])
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") * F.pow(F.lit(10.0), 12 + F.col("o_orderkey") % 9)).alias("budget"), F.get(contexts, (F.col("o_custkey") % 5).cast("int")).alias("context"))
    return o.distinct()


@query(f"WITH {_SOLVE.format(p=_P, grid=_ROWS)} SELECT context, regime, count(*) AS n, round(avg(log10(n)), 6) AS log_n, round(avg(log10(d)), 6) AS log_d, round(avg(loss), 6) AS loss, count(*) FILTER (sat) AS saturated, round(log10(min(budget)), 6) AS lowest, round(log10(max(budget)), 6) AS highest FROM r GROUP BY 1, 2")
def allocation_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimum of every order's budget in its context, by regime: sizes, data, loss, and the budgets between which the regime stands."""
    out = allocation.solve(_problems(spark, sf_dir)).filter("regime is not null")
    return out.groupBy("context", "regime").agg(F.count("*").alias("n"), *[rounded(F.avg(F.log10(c))).alias(f"log_{c}") for c in ("n", "d")], rounded(F.avg("loss")).alias("loss"), F.count_if("saturated").alias("saturated"), rounded(F.log10(F.min("budget"))).alias("lowest"), rounded(F.log10(F.max("budget"))).alias("highest"))


@query(
    f"""WITH {_SOLVE.format(p=_P, grid=_ROWS)}, el AS (SELECT *, regime LIKE 'SLACK%' OR (regime LIKE '%N\\_%' ESCAPE '\\' AND regime LIKE '%D\\_%' ESCAPE '\\') AS still, regime LIKE '%N\\_%' ESCAPE '\\' AS nb, regime LIKE '%D\\_%' ESCAPE '\\' AS db FROM r)
SELECT context, round(avg(CASE WHEN still OR nb THEN 0 WHEN db THEN 1 ELSE 0.279888 / (0.339983 + 0.279888) END), 6) AS n_elasticity, round(avg(CASE WHEN still THEN 0 WHEN nb THEN 1 WHEN db THEN 0 ELSE 0.339983 / (0.339983 + 0.279888) END), 6) AS d_elasticity, count(*) AS n FROM el GROUP BY 1"""
)
def elasticities_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sizes and data answer to a little more budget, on average over the orders of a context."""
    out = allocation.solve(_problems(spark, sf_dir)).filter("regime is not null")
    n, d = allocation.elasticities(F.col("regime"))
    return out.groupBy("context").agg(rounded(F.avg(n)).alias("n_elasticity"), rounded(F.avg(d)).alias("d_elasticity"), F.count("*").alias("n"))


@query(
    f"""WITH p AS {_ROWS}, g AS (SELECT x AS context, 6.0 + 2e-4 * x AS k, {_P} FROM (SELECT DISTINCT x FROM p)),
t AS (SELECT context, kind, CASE WHEN kind IN ('n_min', 'n_max') THEN k * v * (be * b * pow(v, al) / (al * a)) ** (1 / be) ELSE k * v * (al * a * pow(v, be) / (be * b)) ** (1 / al) END AS limit_ FROM g, (VALUES ('n_min', 7.054e7), ('n_max', 1.1965825e10), ('d_min', 1.34e8), ('d_max', 2.99893e11)) s(kind, v))
SELECT context, kind, round(log10(any_value(limit_)), 6) AS log_threshold, count(*) FILTER (c < limit_) AS below, count(*) FILTER (c >= limit_) AS above FROM t JOIN p ON p.x = t.context GROUP BY 1, 2"""
)
def budgets_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many budgets lie below and above each threshold of their context. Contexts are few; the budgets are counted where they are read."""
    p = _problems(spark, sf_dir)
    t = allocation.thresholds(p.select("context").distinct()).select(F.col("context").alias("__c"), "kind", F.col("budget").alias("at"))
    j = p.join(small(t), F.col("context") == F.col("__c"))
    return j.groupBy("context", "kind").agg(rounded(F.log10(F.first("at"))).alias("log_threshold"), F.count_if(F.col("budget") < F.col("at")).alias("below"), F.count_if(F.col("budget") >= F.col("at")).alias("above"))


@query(
    """WITH p AS (SELECT p_partkey, p_retailprice * pow(10.0, 16 + p_size % 5) AS c, CASE WHEN p_partkey % 2 = 0 THEN 2048 ELSE 32768 END AS x, p_size % 4 AS digits FROM part), s AS (SELECT * FROM (VALUES (-1), (1)) a(s1), (VALUES (-1), (1)) b(s2), (VALUES (-1), (1)) d(s3)),
o AS (SELECT p_partkey, x, ln(((0.339983 + s1 * 5e-7 * h) * (406.268 + s2 * 5e-4 * h) / ((0.279888 + s3 * 5e-7 * h) * 409.744) * pow(c / (6.0 + 2e-4 * x), 0.279888 + s3 * 5e-7 * h)) ** (1 / (0.339983 + s1 * 5e-7 * h + 0.279888 + s3 * 5e-7 * h))) AS v FROM (SELECT *, CASE digits WHEN 0 THEN 0 ELSE pow(10.0, digits - 1) END AS h FROM p), s),
w AS (SELECT p_partkey, any_value(x) AS x, max(v) - min(v) AS w, count(*) AS corners FROM o GROUP BY p_partkey)
SELECT x AS context, CASE WHEN w = 0 THEN 'DEGENERATE' WHEN w > 2e-4 THEN 'RESOLVED' ELSE 'NOT_RESOLVED' END AS verdict, count(*) AS n, sum(corners)::BIGINT AS corners, round(avg(w) * 1000, 5) AS width_permille FROM w GROUP BY 1, 2"""
)
def corner_robustness_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the optimum of each part's budget moves over the eight corners of what rounding to fewer or more digits hides in the parameters."""
    size, key = F.col("p_size"), F.col("p_partkey")
    half = F.when(size % 4 == 0, 0.0).otherwise(F.pow(F.lit(10.0), size % 4 - 1))
    p = table(spark, sf_dir, "part").select((F.col("p_retailprice") * F.pow(F.lit(10.0), 16 + size % 5)).alias("c"), F.when(key % 2 == 0, 2048).otherwise(32768).alias("context"), half.alias("h"))

    def optimum(s1: int, s2: int, s3: int) -> Column:
        law = {"alpha": 0.339983 + s1 * 5e-7 * F.col("h"), "A": 406.268 + s2 * 5e-4 * F.col("h"), "beta": 0.279888 + s3 * 5e-7 * F.col("h"), "B": 409.744}
        ratio = law["alpha"] * law["A"] / (law["beta"] * law["B"])
        return F.log(F.pow(ratio * F.pow(F.col("c") / allocation.kappa(F.col("context")), law["beta"]), 1 / (law["alpha"] + law["beta"])))

    corners = F.array(*[optimum(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)])
    w = p.select("context", (F.array_max(corners) - F.array_min(corners)).alias("w"), F.size(corners).alias("corners"))
    verdict = F.when(F.col("w") == 0, "DEGENERATE").when(F.col("w") > 2e-4, "RESOLVED").otherwise("NOT_RESOLVED")
    return w.groupBy("context", verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum("corners").alias("corners"), rounded(F.avg("w") * 1000, 5).alias("width_permille"))


_GAP = "(ln(g1) + l1 * {0}) - (ln(g2) + l2 * ln({0}))"


@query(
    f"""WITH RECURSIVE p AS (SELECT p_partkey, p_retailprice AS g1, 1.0 + p_size / 10.0 AS l1, p_retailprice * exp(1.0537 + p_partkey % 5) AS g2, 2.0 + p_size % 4 AS l2 FROM part), h AS (SELECT *, 0.01::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM p WHERE sign({_GAP.format('0.01')}) * sign({_GAP.format('1.0')}) <= 0
UNION ALL SELECT p_partkey, g1, l1, g2, l2, CASE WHEN sign({_GAP.format('lo')}) * sign({_GAP.format('((lo + hi) / 2)')}) <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN sign({_GAP.format('lo')}) * sign({_GAP.format('((lo + hi) / 2)')}) <= 0 THEN (lo + hi) / 2 ELSE hi END, step + 1 FROM h WHERE step < 60)
SELECT p.p_partkey, round((lo + hi) / 2, 9) AS crossing, round(CASE WHEN lo IS NULL THEN NULL ELSE g1 * exp(l1 * (lo + hi) / 2) END, 4) AS cost FROM p LEFT JOIN (SELECT p_partkey, lo, hi FROM h WHERE step = 60) USING (p_partkey)"""
)
def cost_crossing_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality at which an exponential and a power cost of each part meet, by halving inside one expression; null where they do not."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", price.alias("g1"), (1.0 + size / 10.0).alias("l1"), (price * F.exp(1.0537 + F.col("p_partkey") % 5)).alias("g2"), (2.0 + size % 4).alias("l2"))
    first = lambda q: allocation.cost_family(F.lit("exponential"), q, F.col("g1"), F.col("l1"))
    gap = lambda q: F.log(first(q)) - F.log(allocation.cost_family(F.lit("power"), q, F.col("g2"), F.col("l2")))
    out = p.withColumn("q", allocation.bisect(F.lit(0.01), F.lit(1.0), gap, 60))
    return out.select("p_partkey", rounded("q", 9).alias("crossing"), rounded(first(F.col("q")), 4).alias("cost"))


@query(
    """WITH c AS (SELECT DISTINCT pow(10.0, 18 + p_size / 10.0) AS budget FROM part), g AS (SELECT budget, exp(ln(1e7) + (ln(1e12) - ln(1e7)) * i / 4096) AS n FROM c, (SELECT unnest(generate_series(0, 4096)) AS i)), l AS (SELECT budget, n, 1.68982 + 406.268 * pow(n, -0.339983) + 409.744 * pow(budget / (6 * n), -0.279888) AS loss FROM g),
m AS (SELECT budget, arg_min(n, loss) AS n, min(loss) AS loss FROM l GROUP BY 1) SELECT round(log10(budget), 4) AS log_budget, round(log10(n), 3) AS log_n_grid, round(loss, 8) AS loss, abs(log10(n) - log10(pow(0.339983 * 406.268 / (0.279888 * 409.744) * pow(budget / 6, 0.279888), 1 / (0.339983 + 0.279888)))) < 0.0013 AS agrees FROM m"""
)
def numeric_optimum_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimum of every budget that sizes of parts make, by a fine logarithmic grid, against the closed form."""
    c = table(spark, sf_dir, "part").select(F.pow(F.lit(10.0), 18 + F.col("p_size") / 10.0).alias("budget")).distinct()
    n = F.transform(F.sequence(F.lit(0), F.lit(4096)), lambda i: F.exp(math.log(1e7) + (math.log(1e12) - math.log(1e7)) * i / 4096))
    best = F.array_min(F.transform(n, lambda v: F.struct(C.law(v, F.col("budget") / (6 * v), allocation.LAW).alias("loss"), v.alias("n"))))
    m = c.select("budget", best.alias("b")).select("budget", "b.*")
    return m.select(rounded(F.log10("budget"), 4).alias("log_budget"), rounded(F.log10("n"), 3).alias("log_n_grid"), rounded("loss", 8).alias("loss"), (F.abs(F.log10("n") - F.log10(C.compute_optimal(F.col("budget"), F.lit(6.0), allocation.LAW))) < 0.0013).alias("agrees"))


@query(
    """WITH p AS (SELECT p_size % 5 AS a, p_size % 7 AS b, p_retailprice / 100 AS v FROM part), e AS (SELECT 'intercept' AS kind, NULL::VARCHAR AS a, NULL::VARCHAR AS b, v AS coefficient FROM p UNION ALL SELECT 'linear', a::VARCHAR, NULL, v * 2 FROM p UNION ALL SELECT 'interaction', a::VARCHAR, b::VARCHAR, -v FROM p)
SELECT kind, a, b, count(*) AS n, round(sum(coefficient), 4) AS total FROM e GROUP BY ALL"""
)
def coefficient_maps_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of coefficients of each part as rows, summed by term."""
    a, b, v = (F.col("p_size") % 5).cast("string"), (F.col("p_size") % 7).cast("string"), F.col("p_retailprice") / 100
    p = table(spark, sf_dir, "part").select(F.create_map(F.lit("__intercept__"), v, a, v * 2, F.concat(F.lit("interaction:"), a, F.lit("*"), b), -v).alias("m"))
    return mixtures.decode(p, "m").groupBy("kind", "a", "b").agg(F.count("*").alias("n"), rounded(F.sum("coefficient"), 4).alias("total"))
