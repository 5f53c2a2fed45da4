"""Mixture queries: designs of shares, response surfaces, frozen validation, effects and their bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import aggregates, linalg, mixtures, ranks, resample
from lodestat.operators.core import rounded, small, stored, table
from lodestat.plans.registry import query

DOMAINS = ["0", "1", "2", "3"]
_DESIGN = """li AS (SELECT l_orderkey % 300 AS g, (l_linenumber % 4)::VARCHAR AS d, l_quantity AS q, l_discount, l_tax FROM lineitem),
lo AS (SELECT g, d, sum(q) / sum(sum(q)) OVER (PARTITION BY g) AS p FROM li GROUP BY g, d),
wide AS (SELECT g, coalesce(max(p) FILTER (d = '0'), 0) AS p0, coalesce(max(p) FILTER (d = '1'), 0) AS p1, coalesce(max(p) FILTER (d = '2'), 0) AS p2, coalesce(max(p) FILTER (d = '3'), 0) AS p3 FROM lo GROUP BY g),
tg AS (SELECT g, avg(l_discount) AS y1, avg(l_tax) AS y2 FROM li GROUP BY g)"""


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group of orders: shares of quantity by domain (0 where absent) and two targets. One shuffle."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("g"), (F.col("l_linenumber") % 4).cast("string").alias("d"), "l_quantity", "l_discount", "l_tax")
    sums = li.groupBy("g").agg(*[F.sum(F.when(F.col("d") == d, F.col("l_quantity")).otherwise(0.0)).alias(f"q{d}") for d in DOMAINS], F.sum("l_quantity").alias("all"), F.avg("l_discount").alias("y1"), F.avg("l_tax").alias("y2"))
    return sums.select("g", *[(F.col(f"q{d}") / F.col("all")).alias(f"p{d}") for d in DOMAINS], "y1", "y2")


@query(
    f"""WITH {_DESIGN}, f AS (SELECT g, p0, p1, p2, p0 * p1 AS "p0*p1", p0 * p2 AS "p0*p2", p0 * p3 AS "p0*p3", p1 * p2 AS "p1*p2", p1 * p3 AS "p1*p3", p2 * p3 AS "p2*p3" FROM wide), u AS (SELECT feature, value FROM f UNPIVOT (value FOR feature IN (p0, p1, p2, "p0*p1", "p0*p2", "p0*p3", "p1*p2", "p1*p3", "p2*p3")))
SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM u GROUP BY feature"""
)
def response_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the response surface: shares without the reference, and the product of each pair. All moments in one aggregation."""
    features = mixtures.response_features([f"p{d}" for d in DOMAINS], "p3", pairs=True)
    one = _design(spark, sf_dir).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}|{name}") for name, c in features.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.col("n"), rounded(F.col(f"`m|{name}`")).alias("mean"), rounded(F.col(f"`s|{name}`")).alias("sd")) for name in features])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(
    f"""WITH {_DESIGN}, u AS (SELECT d, p FROM wide UNPIVOT (p FOR d IN (p0, p1, p2, p3))), s AS (SELECT d, avg((p > 0)::INT) AS prevalence, stddev_pop(p) AS sd FROM u GROUP BY d)
SELECT d AS domain, round(prevalence, 6) AS prevalence, round(sd, 6) AS sd, d = (SELECT arg_max(d, prevalence * sd) FROM (SELECT * FROM s ORDER BY d)) AS is_reference FROM s"""
)
def reference_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference domain: the largest prevalence times spread, the first of equals."""
    return mixtures.reference_domain(_design(spark, sf_dir), [f"p{d}" for d in DOMAINS]).select("domain", rounded("prevalence").alias("prevalence"), rounded("sd").alias("sd"), "is_reference")


@query(
    f"""WITH {_DESIGN} SELECT count(*) AS n, round(min(p0 + p1 + p2 + p3), 9) AS least_sum, round(max(p0 + p1 + p2 + p3), 9) AS most_sum, round(avg(((p0 = 0)::INT + (p1 = 0)::INT + (p2 = 0)::INT + (p3 = 0)::INT) / 4.0), 6) AS zero_share,
count(*) - count(DISTINCT (round(p0, 9), round(p1, 9), round(p2, 9), round(p3, 9))) AS repeated_designs, round(avg(p0 + p1), 6) AS mean_coverage, count(*) FILTER (abs(round(p0, 2) * 100 - round(round(p0, 2) * 100)) < 1e-9) AS on_grid FROM wide"""
)
def mixture_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of designs looks like: row sums, zeros, repeats, covered mass, decimals on the grid of hundredths."""
    p = [F.col(f"p{d}") for d in DOMAINS]
    total, zero = sum(p[1:], p[0]), sum(((c == 0).cast("int") for c in p[1:]), (p[0] == 0).cast("int"))
    return _design(spark, sf_dir).agg(
        F.count("*").alias("n"), rounded(F.min(total), 9).alias("least_sum"), rounded(F.max(total), 9).alias("most_sum"), rounded(F.avg(zero / 4.0)).alias("zero_share"),
        (F.count("*") - F.count_distinct(F.struct(*[F.round(c, 9) for c in p]))).alias("repeated_designs"), rounded(F.avg(p[0] + p[1])).alias("mean_coverage"), F.count_if(C.on_grid(F.round(p[0], 2), "0.01")).alias("on_grid"),
    )


#: A frozen response surface: what a fit of the reference's kind hands over.
SURFACE = {"__intercept__": 0.05, "0": 0.02, "1": -0.03, "2": 0.01, "interaction:0*1": 0.4, "interaction:1*3": -0.2}


@query(
    f"""WITH {_DESIGN} SELECT wide.g, round(0.05 + 0.02 * p0 - 0.03 * p1 + 0.01 * p2 + 0.4 * p0 * p1 - 0.2 * p1 * p3, 8) AS predicted,
round(CASE WHEN p1 >= 0.05 THEN 0.02 * 0.05 + 0.03 * 0.05 + 0.4 * ((p0 + 0.05) * (p1 - 0.05) - p0 * p1) - 0.2 * ((p1 - 0.05) * p3 - p1 * p3) END, 8) AS effect FROM wide"""
)
def surface_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a surface given as a map of coefficients, and the effect of moving 0.05 from domain 1 to domain 0; null where the design would leave the simplex."""
    p = {d: F.col(f"p{d}") for d in DOMAINS}
    return _design(spark, sf_dir).select("g", rounded(mixtures.predict(SURFACE, p), 8).alias("predicted"), rounded(mixtures.substitution(SURFACE, p, "1", "0", 0.05), 8).alias("effect"))


@query(
    """WITH c AS (SELECT n_nationkey AS g, unnest(map_entries(MAP {'__intercept__': 0.05 + n_regionkey, '0': 0.02, '1': -0.03, '2': 0.01 * n_nationkey, 'interaction:0*1': 0.4, 'interaction:1*3': -0.2})) AS e FROM nation)
SELECT g, CASE WHEN e.key = '__intercept__' THEN 'intercept' WHEN e.key LIKE 'interaction:%' THEN 'interaction' ELSE 'linear' END AS kind, CASE WHEN e.key LIKE 'interaction:%' THEN split_part(substr(e.key, 13), '*', 1) WHEN e.key <> '__intercept__' THEN e.key END AS a,
CASE WHEN e.key LIKE 'interaction:%' THEN split_part(substr(e.key, 13), '*', 2) END AS b, e.value::DOUBLE AS coefficient FROM c"""
)
def coefficient_map_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of coefficients as rows: kind, one or two domains, value."""
    changed = SURFACE | {"__intercept__": F.lit(SURFACE["__intercept__"]) + F.col("n_regionkey"), "2": F.lit(SURFACE["2"]) * F.col("n_nationkey")}
    m = F.create_map(*[x for k, v in changed.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    return mixtures.decode(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"), m.alias("m")), "m", ["g"])


@query(
    f"""WITH {_DESIGN}, e AS (SELECT 0.05 + 0.02 * p0 - 0.03 * p1 + 0.01 * p2 + 0.4 * p0 * p1 - 0.2 * p1 * p3 AS x, y1, y2, wide.g % 10 < 7 AS train FROM wide JOIN tg ON wide.g = tg.g),
o AS (SELECT t AS target, x, CASE t WHEN 'y1' THEN y1 ELSE y2 END AS y FROM e, (VALUES ('y1'), ('y2')) v(t) WHERE NOT train)
SELECT target, count(*) AS n, round(sqrt(avg((x - y) ** 2)), 8) AS rmse, round(avg(x - y), 8) AS level_shift, round(sqrt(greatest(0, avg((x - y) ** 2) - avg(x - y) ** 2)), 8) AS centred_rmse, count(*) FILTER (x <= 0) AS not_positive FROM o GROUP BY ROLLUP(target) HAVING target IS NOT NULL"""
)
def frozen_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen surface against designs that it was not fitted on, by target: error, level shift, error of the shape, predictions that make no sense."""
    p = {d: F.col(f"p{d}") for d in DOMAINS}
    e = _design(spark, sf_dir).filter("g % 10 >= 7").select(mixtures.predict(SURFACE, p).alias("x"), "y1", "y2")
    long = e.select("x", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in ("y1", "y2")])).alias("t")).select("x", "t.*")
    out = aggregates.shape_errors(long, ["target"], "y", "x")
    return out.select("target", "n", *[rounded(c, 8).alias(c) for c in ("rmse", "level_shift", "centred_rmse")], "not_positive")


@query(f"WITH {_DESIGN}, tr AS (SELECT round(p0, 2) AS a, round(p1, 2) AS b, round(p2, 2) AS c FROM wide WHERE g % 10 < 7), te AS (SELECT round(p0, 2) AS a, round(p1, 2) AS b, round(p2, 2) AS c FROM wide WHERE g % 10 >= 7) SELECT count(*) AS tested, count(*) FILTER ((a, b, c) IN (SELECT (a, b, c) FROM tr)) AS leaked, count(*) FILTER ((a, b, c) NOT IN (SELECT (a, b, c) FROM tr)) AS outside FROM te")
def design_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs for testing that also stand among those for training, to two decimals; the others are the rows of an anti join."""
    d = _design(spark, sf_dir).select((F.col("g") % 10 < 7).alias("train"), *[F.round(f"p{k}", 2).alias(f"r{k}") for k in "012"])
    seen = d.filter("train").select("r0", "r1", "r2").distinct().withColumn("seen", F.lit(True))
    j = d.filter("not train").join(seen, ["r0", "r1", "r2"], "left")
    return j.agg(F.count("*").alias("tested"), F.count("seen").alias("leaked"), F.count_if(F.col("seen").isNull()).alias("outside"))


@query(
    """WITH c AS (SELECT l_partkey % 60 AS k, l_linestatus AS s, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), j AS (SELECT a.v AS x, b.v AS y FROM c a JOIN c b ON a.k = b.k AND a.s = 'F' AND b.s = 'O'),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT count(*) AS pairs, round(avg(y - x), 4) AS shift, round(corr(rx, ry), 6) AS ordering, round(stddev_pop(y) / stddev_pop(x), 6) AS sd_ratio, round(stddev_pop(y - x), 4) AS centred_rmse FROM r"""
)
def paired_scale_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same designs at two scales: shift, whether they keep their order, ratio of spreads, error of the shape."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 60).alias("k")).agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("x"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("y")).na.drop()
    c = stored(c)
    rho = ranks.spearman_pairs(c.unpivot(["k"], ["x", "y"], "name", "v"), "k", "name", "v", ["x", "y"]).select(rounded("rho").alias("ordering"))
    one = c.agg(F.count("*").alias("pairs"), rounded(F.avg(F.col("y") - F.col("x")), 4).alias("shift"), rounded(F.stddev_pop("y") / F.stddev_pop("x")).alias("sd_ratio"), rounded(F.stddev_pop(F.col("y") - F.col("x")), 4).alias("centred_rmse"))
    return one.join(F.broadcast(rho)).select("pairs", "shift", "ordering", "sd_ratio", "centred_rmse")  # one row by one row


@query(
    f"""WITH {_DESIGN}, m AS (SELECT wide.g, p0 + p1 AS mass, p0 AS x, y1 AS y FROM wide JOIN tg ON wide.g = tg.g), q AS (SELECT quantile_cont(mass, 1 / 3.0) AS a, quantile_cont(mass, 2 / 3.0) AS b FROM m),
t AS (SELECT m.*, CASE WHEN mass <= a THEN 'low' WHEN mass <= b THEN 'middle' ELSE 'high' END AS tercile FROM m, q), r AS (SELECT *, rank() OVER (PARTITION BY tercile ORDER BY x) + (count(*) OVER (PARTITION BY tercile, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY tercile ORDER BY y) + (count(*) OVER (PARTITION BY tercile, y) - 1) / 2.0 AS ry FROM t)
SELECT tercile, count(*) AS n, round(regr_r2(y, x), 6) AS r2, round(corr(rx, ry), 6) AS rho FROM r GROUP BY tercile"""
)
def mapped_mass_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and rank correlation by tercile of mapped mass; the cuts are quantiles, not equal counts."""
    m = stored(_design(spark, sf_dir).select("g", (F.col("p0") + F.col("p1")).alias("mass"), F.col("p0").alias("x"), F.col("y1").alias("y")))
    cuts = ranks.quantiles(m, [], "mass", {"a": 1 / 3, "b": 2 / 3})
    t = stored(m.join(F.broadcast(cuts)).withColumn("tercile", F.when(F.col("mass") <= F.col("a"), "low").when(F.col("mass") <= F.col("b"), "middle").otherwise("high")))  # the cuts are one row
    fit = t.groupBy("tercile").agg(F.count("*").alias("n"), rounded(F.regr_r2("y", "x")).alias("r2"))
    rank = ranks.average_ranks(ranks.average_ranks(t, ["tercile"], "x", "rx"), ["tercile"], "y", "ry").groupBy(F.col("tercile").alias("tt")).agg(rounded(F.corr("rx", "ry")).alias("rho"))
    return fit.join(small(rank), F.col("tercile") == F.col("tt")).select("tercile", "n", "r2", "rho")


_FOLD = "('0x' || substr(md5('42|' || {0}), 1, 8))::BIGINT % 5"


@query(
    f"""WITH x AS (SELECT ln(l_quantity) AS x, ln(l_extendedprice) AS y, {_FOLD.format('l_orderkey')} AS f FROM lineitem), s AS (SELECT f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY f),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s), k AS (SELECT s.*, t.n - s.n AS tn, t.sx - s.sx AS tx, t.sy - s.sy AS ty, ((t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy) / (t.n - s.n)) / ((t.sxx - s.sxx) - (t.sx - s.sx) ** 2 / (t.n - s.n)) AS b FROM s, t),
e AS (SELECT f, n, syy - 2 * ty / tn * sy + n * (ty / tn) ** 2 AS e0, syy - 2 * ((ty / tn - b * tx / tn) * sy + b * sxy) + n * (ty / tn - b * tx / tn) ** 2 + 2 * (ty / tn - b * tx / tn) * b * sx + b * b * sxx AS e1 FROM k),
m AS (SELECT sqrt(sum(e0) / sum(n)) AS r0, sqrt(sum(e1) / sum(n)) AS r1, count(*) FILTER (e1 < e0) AS wins FROM e) SELECT round(r0, 6) AS rmse_simple, round(r1, 6) AS rmse_rich, round(1 - r1 / r0, 6) AS gain, wins AS fold_wins, CASE WHEN 1 - r1 / r0 >= 0.05 AND wins >= 4 THEN 'rich' ELSE 'simple' END AS selected FROM m"""
)
def model_selection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A richer model is taken only if it gains 5 % and wins four folds of five. Errors of all folds come from one pass of sums."""
    x = table(spark, sf_dir, "lineitem").select(F.log("l_quantity").alias("x"), F.log("l_extendedprice").alias("y"), linalg.folds(F.col("l_orderkey"), 5, 42).alias("f"))
    got = linalg.compare(x, [], ["x"], "y", "f", gain=0.05, wins=4)
    return spark.createDataFrame([(round(got["rmse_simple"], 6), round(got["rmse_rich"], 6), round(got["gain"], 6), got["fold_wins"], got["selected"])], "rmse_simple double, rmse_rich double, gain double, fold_wins long, selected string")


@query(
    """WITH p AS (SELECT p_size::DOUBLE AS n, avg(p_retailprice) AS y FROM part GROUP BY 1), c AS (SELECT i / 20.0 AS c FROM (SELECT unnest(generate_series(1, 40)) AS i)), r AS (SELECT c, regr_intercept(y, pow(n, -c)) AS a, regr_slope(y, pow(n, -c)) AS b, regr_syy(y, pow(n, -c)) * (1 - coalesce(regr_r2(y, pow(n, -c)), 0)) AS rss FROM p, c GROUP BY c)
SELECT round(arg_min(c, rss), 4) AS c, round(arg_min(a, rss), 3) AS a, round(arg_min(b, rss), 3) AS b, round(min(rss), 2) AS rss, count(*) AS tried FROM r"""
)
def limited_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y = a + b n^-c over a bounded grid of exponents: for each, a and b are a line's, so all are one aggregation over grouped sizes."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("n")).agg(F.avg("p_retailprice").alias("y"))
    tried = mixtures.power_profile(p, "n", "y", [i / 20 for i in range(1, 41)])
    best = tried.agg(F.min_by(F.struct("c", "a", "b"), "rss").alias("x"), F.min("rss").alias("rss"), F.count("*").alias("tried"))
    return best.select(rounded("x.c", 4).alias("c"), rounded("x.a", 3).alias("a"), rounded("x.b", 3).alias("b"), rounded("rss", 2).alias("rss"), "tried")


_POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 ELSE 7 END"
_U = "('0x' || substr(md5('42|' || rep || '|' || {0}), 1, 8))::BIGINT / 4294967296.0"


@query(
    f"""WITH x AS (SELECT c_mktsegment AS s, c_acctbal AS v, rep, {_U.format('c_custkey')} AS u FROM customer, (SELECT unnest(generate_series(0, 49)) AS rep)), b AS (SELECT s, rep, sum(w * v) / sum(w) AS m FROM (SELECT *, {_POISSON} AS w FROM x) GROUP BY 1, 2)
SELECT b.s AS segment, count(*) AS replicates, round(any_value(p.m), 5) AS mean, round(quantile_cont(b.m, 0.025), 5) AS low, round(quantile_cont(b.m, 0.975), 5) AS high FROM b JOIN (SELECT c_mktsegment AS s, avg(c_acctbal) AS m FROM customer GROUP BY 1) p ON p.s = b.s GROUP BY b.s"""
)
def row_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of a mean, rows resampled by Poisson weights that hashes of the key decide: no draws are shuffled, each task sums all replicates."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    out = resample.row_interval(c, ["c_mktsegment"], "c_custkey", "c_acctbal", replicates=50, seed=42)
    return out.select(F.col("c_mktsegment").alias("segment"), "replicates", *[rounded(k, 5).alias(k) for k in ("mean", "low", "high")])


@query(
    f"""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0), u AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, a.k IS NOT NULL AS ina, b.k IS NOT NULL AS inb, a.v IS DISTINCT FROM b.v AND a.k IS NOT NULL AND b.k IS NOT NULL AS clash FROM a FULL JOIN b ON a.k = b.k),
x AS (SELECT u.*, rep, {_U.format('k')} AS u FROM u, (SELECT unnest(generate_series(0, 49)) AS rep)), r AS (SELECT rep, sum(w * v) FILTER (ina) / sum(w) FILTER (ina) - sum(w * v) FILTER (inb) / sum(w) FILTER (inb) AS d FROM (SELECT *, {_POISSON} AS w FROM x) GROUP BY rep)
SELECT (SELECT count(*) FROM u) AS identities, (SELECT count(*) FROM u WHERE ina AND inb) AS shared, (SELECT count(*) FROM u WHERE clash) AS clashes, round((SELECT avg(v) FILTER (ina) - avg(v) FILTER (inb) FROM u), 5) AS difference, round(quantile_cont(d, 0.025), 5) AS low, round(quantile_cont(d, 0.975), 5) AS high FROM r"""
)
def overlapping_sample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the means of two samples that share identities: the union of identities is resampled, so a shared one weighs the same in both."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    out = resample.overlap_interval(c.filter("k % 3 <> 0"), c.filter("k % 5 <> 0"), "k", "v", replicates=50, seed=42)
    return out.select("identities", "shared", "clashes", *[rounded(x, 5).alias(x) for x in ("difference", "low", "high")])


@query(
    f"""WITH {_DESIGN}, m AS (SELECT wide.g % 20 AS cl, p0 AS x, y1 AS y FROM wide JOIN tg ON wide.g = tg.g), s AS (SELECT cl, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, row_number() OVER (ORDER BY cl) - 1 AS slot, count(*) OVER () AS k FROM m GROUP BY cl),
d AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::BIGINT % k AS pos FROM s, (SELECT unnest(generate_series(0, 99)) AS rep)), b AS (SELECT rep, (sum(sxy) - sum(sx) * sum(sy) / sum(n)) / (sum(sxx) - sum(sx) ** 2 / sum(n)) AS e FROM d JOIN s ON pos = slot GROUP BY rep),
p AS (SELECT (sum(sxy) - sum(sx) * sum(sy) / sum(n)) / (sum(sxx) - sum(sx) ** 2 / sum(n)) AS e FROM s)
SELECT round(any_value(p.e), 6) AS effect, round(quantile_cont(b.e, 0.025), 6) AS low, round(quantile_cont(b.e, 0.975), 6) AS high, count(*) FILTER (sign(b.e) <> sign(p.e)) AS reversals, quantile_cont(b.e, 0.025) > 0 OR quantile_cont(b.e, 0.975) < 0 AS resolved FROM b, p"""
)
def effect_sign_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect, its interval with clusters resampled, and how often its sign turns. Clusters are summed before any replicate."""
    m = _design(spark, sf_dir).select((F.col("g") % 20).alias("cl"), F.col("p0").alias("x"), F.col("y1").alias("y"))
    s = m.groupBy("cl").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    s = stored(s)
    slope = (F.sum("sxy") - F.sum("sx") * F.sum("sy") / F.sum("n")) / (F.sum("sxx") - F.sum("sx") * F.sum("sx") / F.sum("n"))
    b = stored(resample.draws(s, None, "cl", 100, 42).groupBy("replicate").agg(slope.alias("e")))
    q = ranks.quantiles(b, [], "e", {"low": 0.025, "high": 0.975})
    point = s.agg(slope.alias("effect"))
    turned = b.join(F.broadcast(point)).agg(F.first("effect").alias("effect"), F.count_if(F.signum("e") != F.signum("effect")).alias("reversals"))
    out = turned.join(F.broadcast(q))  # one row by one row
    return out.select(rounded("effect").alias("effect"), rounded("low").alias("low"), rounded("high").alias("high"), "reversals", ((F.col("low") > 0) | (F.col("high") < 0)).alias("resolved"))
