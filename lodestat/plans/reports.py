"""Compound reports: frontiers with their bands, shifts of distributions, composition against targets, marginal effects, compute fits, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import allocation, frontiers, ranks
from lodestat.operators.core import rounded, small, stored, table
from lodestat.plans.registry import query

GAMMA = allocation.LAW | {"gamma": 0.8}


def _month(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _index(month: str) -> Column:
    return ((F.substring(month, 1, 4).cast("int") - 1995) * 12 + F.substring(month, 6, 2).cast("int")).cast("double")


@query(
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS v, o_custkey::DOUBLE AS s, (epoch(date_trunc('day', o_orderdate)) - epoch(TIMESTAMP '1995-01-01')) / 86400.0 AS t FROM orders), q AS (SELECT month, count(*) AS n, quantile_cont(v, 0.9) AS p, quantile_cont(v, 0.5) AS median, max(v) AS best, avg(t) AS t_mid FROM o GROUP BY 1),
k AS (SELECT month, avg(v) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC) AS i FROM o) WHERE i <= 3 GROUP BY 1), f AS (SELECT o.month, count(*) AS c, quantile_cont(s, 0.5) AS ms FROM o JOIN q ON o.month = q.month AND v >= p GROUP BY 1)
SELECT q.month, n, n < 30 AS sparse, round(p, 4) AS quantile, best, round(topk, 4) AS topk_mean, round(median, 4) AS median, c AS frontier_n, round(ms, 4) AS median_size, round(t_mid, 4) AS t_mid FROM q JOIN k USING (month) JOIN f USING (month)"""
)
def binned_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a month's frontier has: whether the month is thin, its quantile, best and mean of the three best, how many rows reach the quantile, their median size, its middle."""
    o = table(spark, sf_dir, "orders").select(_month("o_orderdate").alias("month"), "o_totalprice", "o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("t"))
    out = frontiers.binned_frontier(o, "month", "o_totalprice", "o_custkey", "t", least=30)
    return out.select(F.col("bin").alias("month"), "n", "sparse", rounded("quantile", 4).alias("quantile"), "best", *[rounded(c, 4).alias(c) for c in ("topk_mean", "median")], "frontier_n", *[rounded(c, 4).alias(c) for c in ("median_size", "t_mid")])


_LINE = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, 0.9) AS y FROM orders GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT ((substr(month, 1, 4)::INT - 1995) * 12 + substr(month, 6, 2)::INT)::DOUBLE AS x, y FROM m), b AS (SELECT (x - 1)::INT // 6 AS block, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM k GROUP BY 1), u AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS slot, count(*) OVER () AS c FROM b), d AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::BIGINT % c AS pos FROM u, (SELECT unnest(generate_series(0, 119)) AS rep)), r AS (SELECT rep, count(DISTINCT block) AS blocks, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM d JOIN u ON pos = u.slot GROUP BY rep), s AS (SELECT rep, blocks, CASE WHEN blocks >= 9 THEN (sxy - sx * sy / n) / (sxx - sx * sx / n) END AS b, n, sx, sy FROM r), t AS (SELECT rep, blocks, b, (sy - b * sx) / n AS a FROM s)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_month("o_orderdate").alias("month"), "o_totalprice")
    q = ranks.quantiles(o, ["month"], "o_totalprice", {"y": 0.9}).filter("n >= 5")
    return q.select(_index("month").alias("x"), "y").withColumn("block", F.floor((F.col("x") - 1) / 6).cast("int"))


@query(f"WITH {_LINE} SELECT count(*) AS replicates, count(*) FILTER (b IS NULL) AS failed, round(quantile_cont(b, 0.025), 4) AS low, round(quantile_cont(b, 0.975), 4) AS high, round(avg(blocks), 4) AS mean_blocks FROM t")
def block_slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier's slope over resampled half-years; replicates that draw too few of them fail, keep their row and are counted."""
    s = stored(frontiers.block_slopes(_months(spark, sf_dir), "block", "x", "y", 120, 42, 9))
    q = ranks.quantiles(s, [], "slope", {"low": 0.025, "high": 0.975}).drop("n")
    one = s.agg(F.count("*").alias("replicates"), F.count_if(F.col("slope").isNull()).alias("failed"), rounded(F.avg("blocks"), 4).alias("mean_blocks"))
    return one.join(F.broadcast(q)).select("replicates", "failed", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "mean_blocks")  # one row by one row


@query(
    f"""WITH {_LINE}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k), e AS (SELECT stddev_samp(y - a - b * x) AS noise FROM k, f), c AS (SELECT * FROM (VALUES ('steady', 1.0), ('half', 0.5), ('stall', 0.0)) s(scenario, m), (VALUES ('one_year', 12.0), ('two_years', 24.0)) h(horizon, h)),
p AS (SELECT scenario, horizon, a + b * 80 + b * CASE WHEN b > 0 THEN m ELSE 1 END * h AS point FROM f, c), v AS (SELECT scenario, horizon, a + b * 80 + b * CASE WHEN b > 0 THEN m ELSE 1 END * h AS v FROM t, c WHERE b IS NOT NULL),
g AS (SELECT scenario, horizon, count(*) AS usable, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi, stddev_samp(v) AS sd FROM v GROUP BY 1, 2)
SELECT scenario, horizon, round(point, 2) AS point, round(lo, 2) AS boot_low, round(hi, 2) AS boot_high, round(sd, 2) AS sd_boot, round(noise, 2) AS sd_noise, round(sqrt(sd * sd + noise * noise), 2) AS sd_total, round(point - 1.6448536269514722 * sqrt(sd * sd + noise * noise), 2) AS pred_low, round(point + 1.6448536269514722 * sqrt(sd * sd + noise * noise), 2) AS pred_high, usable FROM p JOIN g USING (scenario, horizon), e"""
)
def predictive_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier ahead by scenario and horizon, with the spread of the fit and with that of single months around it."""
    out = frontiers.predictive_bands(_months(spark, sf_dir), "block", "x", "y", 80.0, {"steady": 1.0, "half": 0.5, "stall": 0.0}, {"one_year": 12.0, "two_years": 24.0}, 120, 42, 9)
    return out.select("scenario", "horizon", *[rounded(c, 2).alias(c) for c in out.columns[2:-1]], "usable")


_Q = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(
    f"""WITH o AS (SELECT o_orderpriority AS g, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), l AS (SELECT g, quantile_cont(v, {_Q}) FILTER (s = 'F') AS a, quantile_cont(v, {_Q}) FILTER (s = 'O') AS b FROM o GROUP BY g), q AS (SELECT g, unnest({_Q}) AS p, unnest(a) AS a, unnest(b) AS b FROM l),
c AS (SELECT g, v, count(*) FILTER (s = 'F') AS a, count(*) FILTER (s = 'O') AS b FROM o GROUP BY 1, 2), w AS (SELECT *, sum(a) OVER (PARTITION BY g ORDER BY v) AS upto, sum(a) OVER (PARTITION BY g) AS na, sum(b) OVER (PARTITION BY g) AS nb FROM c), r AS (SELECT g, sum(b * (2 * upto - a) / (2.0 * na)) / any_value(nb) AS standing FROM w GROUP BY g)
SELECT g AS priority, p AS prob, round(a, 4) AS finished, round(b, 4) AS open, round(b - a, 4) AS shift, round(standing, 6) AS mean_standing FROM q JOIN r USING (g)"""
)
def quantile_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each quantile of open orders lies from that of finished ones, by priority, and where open orders stand on average among finished ones, in ranks."""
    o = stored(table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v")))
    names = {f"p{i}": p for i, p in enumerate(_Q)}
    q = ranks.quantiles(o, ["g", "s"], "v", names).drop("n")
    each = q.select("g", "s", F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(k).alias("v")) for k, p in names.items()])).alias("x")).select("g", "s", "x.*")
    wide = each.groupBy("g", "prob").agg(F.max(F.when(F.col("s") == "F", F.col("v"))).alias("a"), F.max(F.when(F.col("s") == "O", F.col("v"))).alias("b"))
    standing = ranks.midrank_against(o.filter("s = 'F'"), o.filter("s = 'O'"), ["g"], "v", "standing")
    standing = standing.groupBy(F.col("g").alias("sg")).agg((F.sum(F.col("standing") * F.col("n_obs")) / F.sum("n_obs")).alias("standing"))
    j = wide.join(small(standing), F.col("g") == F.col("sg"))
    return j.select(F.col("g").alias("priority"), "prob", rounded("a", 4).alias("finished"), rounded("b", 4).alias("open"), rounded(F.col("b") - F.col("a"), 4).alias("shift"), rounded("standing").alias("mean_standing"))


@query(
    """WITH x AS (SELECT l_orderkey AS o, l_returnflag AS target, round(sum(l_quantity * CASE l_linestatus WHEN 'O' THEN 0.3 ELSE 0.7 END) / sum(l_quantity), 7) AS q, round(avg(l_extendedprice), 5) AS y FROM lineitem GROUP BY 1, 2), w AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY q) + (count(*) OVER (PARTITION BY target, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2.0 AS ry FROM x),
s AS (SELECT target, count(*) AS n, regr_slope(y, q) AS slope, regr_r2(y, q) AS r2, corr(rq, ry) AS rho FROM w GROUP BY 1), a AS (SELECT target, n, slope, r2, rho FROM s UNION ALL SELECT 'macro', sum(n)::BIGINT, avg(slope), avg(r2), avg(rho) FROM s)
SELECT target, n, round(slope, 3) AS slope, round(r2, 6) AS r2, round(rho, 6) AS rho, coalesce(rho > 0.3 AND r2 > 0.1, false) AS gate FROM a"""
)
def composition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix's mean quality says of each target: slope, share explained, agreement of ranks, the mean over targets, and whether the gate opens."""
    w = F.when(F.col("l_linestatus") == "O", 0.3).otherwise(0.7)
    x = stored(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("target")).agg(F.round(F.sum(F.col("l_quantity") * w) / F.sum("l_quantity"), 7).alias("q"), F.round(F.avg("l_extendedprice"), 5).alias("y")))
    ranked = ranks.average_ranks(ranks.average_ranks(x, ["target"], "q", "rq"), ["target"], "y", "ry")
    s = stored(ranked.groupBy("target").agg(F.count("*").alias("n"), F.regr_slope("y", "q").alias("slope"), F.regr_r2("y", "q").alias("r2"), F.corr("rq", "ry").alias("rho")))
    macro = s.agg(F.lit("macro").alias("target"), F.sum("n").alias("n"), F.avg("slope").alias("slope"), F.avg("r2").alias("r2"), F.avg("rho").alias("rho"))
    gate = F.coalesce((F.col("rho") > 0.3) & (F.col("r2") > 0.1), F.lit(False))
    return s.unionByName(macro).select("target", "n", rounded("slope", 3).alias("slope"), rounded("r2").alias("r2"), rounded("rho").alias("rho"), gate.alias("gate"))


@query(
    """WITH p AS (SELECT p_partkey, p_size * 1e8 AS n, p_retailprice * 1e8 AS d, 0.2 + (p_partkey % 7) * 0.1 AS q FROM part), x AS (SELECT p.*, unnest([q * 1.1, q * 1.25, q * 2.0]) AS raw FROM p), y AS (SELECT DISTINCT p_partkey, n, d, q, round(least(raw, 1.0), 9) AS target FROM x), z AS (SELECT * FROM y WHERE target > q + 1e-12),
v AS (SELECT *, 406.268 * pow(n, -0.339983) AS an, 409.744 * pow(q, -0.8 * 0.279888) * pow(d, -0.279888) AS bd, 409.744 * pow(target, -0.8 * 0.279888) * pow(d, -0.279888) AS bt FROM z),
w AS (SELECT *, 1.68982 + an + bd AS loss, bd - bt AS gain, -0.339983 * an / n AS dn, -0.279888 * bd / d AS dd, -0.8 * 0.279888 * bd / q AS dq FROM v)
SELECT round(target, 4) AS target, count(*) AS points, round(avg(loss), 6) AS loss, round(avg(gain), 8) AS gain, round(avg(dn * n), 6) AS per_log_n, round(avg(dd * d), 6) AS per_log_d, round(avg(dq), 6) AS per_quality, round(avg(log10(dq / dn)), 6) AS log_n_per_quality, round(avg(log10(dq / dd)), 6) AS log_d_per_quality, round(avg(pow((an + gain) / an, -1 / 0.339983)), 6) AS n_needed, round(avg(pow(target / q, -0.8)), 6) AS d_needed FROM w GROUP BY 1"""
)
def substitution_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal effects of size, data and quality at every point, and what better quality is worth: the share of size, and of data, that reaches the same loss."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") * 1e8).alias("n"), (F.col("p_retailprice") * 1e8).alias("d"), (0.2 + (F.col("p_partkey") % 7) * 0.1).alias("q"))
    z = p.select("n", "d", "q", F.explode(C.upward_targets(F.col("q"), 1.0, [1.1, 1.25, 2.0])).alias("target"))
    n, d, q = F.col("n"), F.col("d"), F.col("q")
    part = C.partials(n, d, q, GAMMA)
    loss, better = C.law(n, d, GAMMA, q), C.law(n, d, GAMMA, F.col("target"))
    gain = loss - better
    needed = 1 + C.parameter_saving(n, gain, GAMMA) / n
    out = z.select(
        rounded("target", 4).alias("target"), loss.alias("loss"), gain.alias("gain"), (part["dl_dn"] * n).alias("per_log_n"), (part["dl_dd"] * d).alias("per_log_d"), part["dl_dq"].alias("per_quality"), F.log10(part["dl_dq"] / part["dl_dn"]).alias("log_n_per_quality"),
        F.log10(part["dl_dq"] / part["dl_dd"]).alias("log_d_per_quality"), needed.alias("n_needed"), F.pow(F.col("target") / q, -GAMMA["gamma"]).alias("d_needed"),
    )
    return out.groupBy("target").agg(F.count("*").alias("points"), *[rounded(F.avg(c), 8 if c == "gain" else 6).alias(c) for c in out.columns[1:]])


@query(
    """WITH p AS (SELECT p_brand AS brand, log10(6 * p_size * 1e8 * p_retailprice * 1e8) AS c, 40 + 10 * ln(p_size) + p_retailprice / 500 AS y FROM part WHERE p_size <> 13), f AS (SELECT brand, count(*) AS n, regr_slope(y, c) AS b, regr_intercept(y, c) AS a, min(c) AS lo, max(c) AS hi, regr_r2(y, c) AS r2 FROM p GROUP BY 1),
t AS (SELECT brand, n, b, a, lo, hi, r2, unnest([lo - 0.5, (lo + hi) / 2, hi + 1]) AS at FROM f)
SELECT brand, n, n >= 80 AS eligible, round(CASE WHEN n >= 80 THEN b END, 6) AS slope, round(CASE WHEN n >= 80 THEN r2 END, 6) AS r2, round(at, 6) AS log_compute, round(CASE WHEN n >= 80 THEN a + b * at END, 5) AS predicted, at < lo OR at > hi AS extrapolated, round(greatest(lo - at, at - hi, 0), 6) AS beyond FROM t""".replace(" AS at FROM f", " AS at_ FROM f").replace("round(at,", "round(at_,").replace("b * at END", "b * at_ END").replace("at < lo OR at > hi", "at_ < lo OR at_ > hi").replace("lo - at, at - hi", "lo - at_, at_ - hi")
)
def compute_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score on log compute by brand, for brands of enough rows, whose number travels along; predictions say whether and how far they lie outside what was fitted."""
    p = table(spark, sf_dir, "part").filter("p_size <> 13").select(F.col("p_brand").alias("brand"), F.log10(6 * (F.col("p_size") * 1e8) * (F.col("p_retailprice") * 1e8)).alias("c"), (40 + 10 * F.log("p_size") + F.col("p_retailprice") / 500).alias("y"))
    f = p.groupBy("brand").agg(F.count("*").alias("n"), F.regr_slope("y", "c").alias("b"), F.regr_intercept("y", "c").alias("a"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.regr_r2("y", "c").alias("r2"))
    t = f.withColumn("at", F.explode(F.array(F.col("lo") - 0.5, (F.col("lo") + F.col("hi")) / 2, F.col("hi") + 1)))
    fits, at = F.col("n") >= 80, F.col("at")
    return t.select("brand", "n", fits.alias("eligible"), rounded(F.when(fits, F.col("b"))).alias("slope"), rounded(F.when(fits, F.col("r2"))).alias("r2"), rounded("at").alias("log_compute"), rounded(F.when(fits, F.col("a") + F.col("b") * at), 5).alias("predicted"), ((at < F.col("lo")) | (at > F.col("hi"))).alias("extrapolated"), rounded(F.greatest(F.col("lo") - at, at - F.col("hi"), F.lit(0.0))).alias("beyond"))


@query(
    """WITH j AS (SELECT l_returnflag AS kind, year(o_orderdate) AS oy, year(l_shipdate) AS ly, l_discount AS a, l_tax AS b, o_totalprice AS p, l_quantity AS q FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
SELECT kind, count(*) AS n, count(*) FILTER (oy IS NULL) AS unmatched, count(*) FILTER (oy = ly) AS year_agrees, count(*) FILTER (ly > oy) AS later, count(*) FILTER (a = 0 AND b = 0) AS zero_filled, count(*) FILTER (abs((a + b) / 2 - 0.04) > 0.02 + 1e-9) AS not_the_mean FROM j GROUP BY 1"""
)
def auxiliary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of kinds that are not in quarantine against their orders: years that agree, fields filled with zeros, parts that do not give the mean."""
    li = table(spark, sf_dir, "lineitem").filter(~F.col("l_returnflag").isin("R"))
    j = li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("oy")), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    a, b, ly, oy = F.col("l_discount"), F.col("l_tax"), F.year("l_shipdate"), F.col("oy")
    return j.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(oy.isNull()).alias("unmatched"), F.count_if(oy == ly).alias("year_agrees"), F.count_if(ly > oy).alias("later"), F.count_if((a == 0) & (b == 0)).alias("zero_filled"), F.count_if(F.abs((a + b) / 2 - 0.04) > 0.02 + 1e-9).alias("not_the_mean"))


@query(
    """WITH p AS (SELECT p_retailprice * (1 + (p_partkey % 5 - 2) * 4e-10) AS v, p_type AS g FROM part), b AS (SELECT g, min(v) AS lo, max(v) AS hi FROM p WHERE v < 1200 GROUP BY g)
SELECT p.g AS part_type, count(*) AS n, count(*) FILTER (v >= lo AND v <= hi) AS inside, count(*) FILTER (v >= lo * (1 - 1e-9) AND v <= hi * (1 + 1e-9)) AS inside_with_slack, count(*) FILTER (abs(v - lo) <= 1e-9 * abs(lo) OR abs(v - hi) <= 1e-9 * abs(hi)) AS at_an_end FROM p JOIN b ON p.g = b.g GROUP BY 1"""
)
def inside_with_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside the range of the cheaper ones of their type, with and without a slack of a billionth, and at its ends."""
    p = table(spark, sf_dir, "part").select((F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5 - 2) * 4e-10)).alias("v"), F.col("p_type").alias("g"))
    b = p.filter("v < 1200").groupBy(F.col("g").alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    end = (F.abs(v - lo) <= 1e-9 * F.abs(lo)) | (F.abs(v - hi) <= 1e-9 * F.abs(hi))
    return p.join(small(b), F.col("g") == F.col("b")).groupBy(F.col("g").alias("part_type")).agg(F.count("*").alias("n"), F.count_if(C.inside(v, lo, hi)).alias("inside"), F.count_if(C.inside(v, lo, hi, 1e-9)).alias("inside_with_slack"), F.count_if(end).alias("at_an_end"))


_ROLES = "CASE l_linenumber WHEN 5 THEN 'in_design' WHEN 6 THEN 'scaled' WHEN 7 THEN 'out_of_design' END"


@query(
    f"""WITH f AS (SELECT l_returnflag AS target, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_extendedprice) AS mean FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
v AS (SELECT {_ROLES} AS role, l_returnflag AS target, l_extendedprice AS y, a + b * l_quantity AS p, mean FROM lineitem JOIN f ON l_returnflag = target WHERE l_linenumber >= 5), r AS (SELECT *, rank() OVER (PARTITION BY role, target ORDER BY y) + (count(*) OVER (PARTITION BY role, target, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY role, target ORDER BY p) + (count(*) OVER (PARTITION BY role, target, p) - 1) / 2.0 AS rp FROM v),
t AS (SELECT role, target, count(*) AS n, sqrt(avg((p - y) ** 2)) AS rmse, sqrt(avg((mean - y) ** 2)) AS base, 1 - avg((p - y) ** 2) / var_pop(y) AS r2, avg(abs((p - y) / y)) AS mare, sqrt(var_pop(p - y)) / stddev_pop(y) AS nrmse, corr(ry, rp) AS rho FROM r GROUP BY 1, 2),
m AS (SELECT role, sum(n)::BIGINT AS n, avg(r2) AS r2, avg(rmse) / avg(base) AS ratio, avg(nrmse) AS nrmse, avg(rho) AS rho, avg(mare) AS mare FROM t GROUP BY 1)
SELECT role, n, round(r2, 6) AS macro_r2, round(ratio, 6) AS baseline_ratio, round(nrmse, 6) AS centred_nrmse, round(rho, 6) AS macro_rho, round(mare, 6) AS relative_error, mare <= 0.5 AS absolute_pass, CASE role WHEN 'in_design' THEN r2 >= 0.5 AND ratio <= 0.8 WHEN 'out_of_design' THEN rho >= 0.7 AND nrmse <= 0.6 ELSE true END AS role_pass, (SELECT bool_and(CASE role WHEN 'in_design' THEN r2 >= 0.5 AND ratio <= 0.8 WHEN 'out_of_design' THEN rho >= 0.7 AND nrmse <= 0.6 ELSE true END) FROM m) AS release_pass FROM m"""
)
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines fitted by target and frozen, against rows in three roles that took no part: errors against the mean's, shape and ranks; what each role must pass, and whether the fit may be released."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    f = li.filter("line <= 4").groupBy(F.col("target").alias("ft")).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("mean"))
    role = F.when(F.col("line") == 5, "in_design").when(F.col("line") == 6, "scaled").when(F.col("line") == 7, "out_of_design")
    v = stored(li.filter("line >= 5").join(small(f), F.col("target") == F.col("ft")).select(role.alias("role"), "target", "y", (F.col("a") + F.col("b") * F.col("x")).alias("p"), "mean"))
    r = ranks.average_ranks(ranks.average_ranks(v, ["role", "target"], "y", "ry"), ["role", "target"], "p", "rp")
    e, g = F.col("p") - F.col("y"), F.col("mean") - F.col("y")
    t = r.groupBy("role", "target").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(g * g)).alias("base"), (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"), F.avg(F.abs(e / F.col("y"))).alias("mare"), (F.stddev_pop(e) / F.stddev_pop("y")).alias("nrmse"), F.corr("ry", "rp").alias("rho"))
    m = stored(t.groupBy("role").agg(F.sum("n").alias("n"), F.avg("r2").alias("r2"), (F.avg("rmse") / F.avg("base")).alias("ratio"), F.avg("nrmse").alias("nrmse"), F.avg("rho").alias("rho"), F.avg("mare").alias("mare")))
    passes = F.when(F.col("role") == "in_design", (F.col("r2") >= 0.5) & (F.col("ratio") <= 0.8)).when(F.col("role") == "out_of_design", (F.col("rho") >= 0.7) & (F.col("nrmse") <= 0.6)).otherwise(True)
    release = m.agg(F.bool_and(passes).alias("release_pass"))
    return m.join(F.broadcast(release)).select("role", "n", rounded("r2").alias("macro_r2"), rounded("ratio").alias("baseline_ratio"), rounded("nrmse").alias("centred_nrmse"), rounded("rho").alias("macro_rho"), rounded("mare").alias("relative_error"), (F.col("mare") <= 0.5).alias("absolute_pass"), passes.alias("role_pass"), "release_pass")  # three rows by one row


@query(
    """WITH p AS (SELECT p_partkey % 2 AS own, p_size * 1e8 AS n, p_retailprice * 1e8 AS d FROM part), l AS (SELECT *, 1.68982 + 406.268 * pow(n, -0.339983) + 409.744 * pow(d, -0.279888) AS published, 1.7012 + 401.5 * pow(n, -0.3391) + 412.3 * pow(d, -0.2803) AS fitted FROM p),
o AS (SELECT *, round(CASE WHEN own = 1 THEN published ELSE fitted END, 4) AS loss FROM l), x AS (SELECT unnest(['published', 'fitted']) AS law, n, d, loss, unnest([published, fitted]) AS predicted FROM o)
SELECT law, count(*) AS n, count(*) FILTER (abs(predicted - loss) <= 5e-5 * (1 + 1e-9)) AS fits, count(*) FILTER (n >= 7.054e7 * (1 - 1e-9) AND n <= 1.1965825e10 * (1 + 1e-9) AND d >= 1.34e8 * (1 - 1e-9) AND d <= 2.99893e11 * (1 + 1e-9)) AS inside_box, round(max(abs(predicted - loss)), 6) AS widest, round(sqrt(avg((predicted - loss) ** 2)), 8) AS rmse FROM x GROUP BY 1"""
)
def law_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two laws made losses that are given to four digits: how many each predicts to the digit, and how many lie in the box that the laws hold in."""
    n, d = F.col("p_size") * 1e8, F.col("p_retailprice") * 1e8
    other = {"E": 1.7012, "A": 401.5, "alpha": 0.3391, "B": 412.3, "beta": 0.2803}
    laws = {"published": C.law(n, d, allocation.LAW), "fitted": C.law(n, d, other)}
    loss = F.round(F.when(F.col("p_partkey") % 2 == 1, laws["published"]).otherwise(laws["fitted"]), 4)
    p = table(spark, sf_dir, "part").select(n.alias("n"), d.alias("d"), loss.alias("loss"), F.explode(F.array(*[F.struct(F.lit(k).alias("law"), v.alias("predicted")) for k, v in laws.items()])).alias("x")).select("n", "d", "loss", "x.*")
    e, box = F.abs(F.col("predicted") - F.col("loss")), allocation.BOX
    inside = C.inside(F.col("n"), box["n_min"], box["n_max"], 1e-9) & C.inside(F.col("d"), box["d_min"], box["d_max"], 1e-9)
    return p.groupBy("law").agg(F.count("*").alias("n"), F.count_if(e <= 5e-5 * (1 + 1e-9)).alias("fits"), F.count_if(inside).alias("inside_box"), rounded(F.max(e)).alias("widest"), rounded(F.sqrt(F.avg(e * e)), 8).alias("rmse"))


@query(
    """WITH l AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Parameter-scale ' WHEN 1 THEN 'Historical continuation ' WHEN 2 THEN 'compute ' ELSE '' END || 'train_the_pile_' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '_val_loss' WHEN 1 THEN ' slowdown' ELSE '' END AS label FROM part),
e AS (SELECT regexp_replace(regexp_replace(label, '^.*train_the_pile_', ''), '(_val_loss| slowdown)$', '') AS domain, list_filter([CASE WHEN NOT contains(lower(label), 'parameter-scale') THEN 'not marked as parameter-scale' END, CASE WHEN contains(lower(label), 'compute') THEN 'mentions compute' END, CASE WHEN contains(lower(label), 'historical') AND contains(lower(label), 'slowdown') THEN 'continuation called a slowdown' END], lambda x: x IS NOT NULL) AS errors FROM l)
SELECT domain, error, count(*) AS n FROM (SELECT domain, unnest(CASE WHEN len(errors) = 0 THEN ['none'] ELSE errors END) AS error FROM e) GROUP BY 1, 2"""
)
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their prefix and suffix taken off, and what each says that it must not, or does not say that it must."""
    key, size = F.col("p_partkey") % 4, F.col("p_size") % 3
    head = F.when(key == 0, "Parameter-scale ").when(key == 1, "Historical continuation ").when(key == 2, "compute ").otherwise("")
    label = F.concat(head, F.lit("train_the_pile_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.when(size == 0, "_val_loss").when(size == 1, " slowdown").otherwise(""))
    p = table(spark, sf_dir, "part").select(label.alias("label"))
    domain = F.regexp_replace(F.regexp_replace("label", "^.*train_the_pile_", ""), "(_val_loss| slowdown)$", "")
    says = lambda w: F.contains(F.lower("label"), F.lit(w))
    errors = F.array_compact(F.array(F.when(~says("parameter-scale"), "not marked as parameter-scale"), F.when(says("compute"), "mentions compute"), F.when(says("historical") & says("slowdown"), "continuation called a slowdown")))
    e = p.select(domain.alias("domain"), F.explode(F.when(F.size(errors) == 0, F.array(F.lit("none"))).otherwise(errors)).alias("error"))
    return e.groupBy("domain", "error").agg(F.count("*").alias("n"))
