"""Evolution queries: populations and their variants, dates, identity between sources, audits of scores, bridges, forecasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions import columns as C
from lodestat.operators import linkage, ranks, resample
from lodestat.operators.allocation import LAW
from lodestat.operators.core import rounded, small, stored, table, unpivot
from lodestat.operators.mixtures import power_profile
from lodestat.plans.registry import query

_LAG = "SELECT o_orderkey, o_orderpriority, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"WITH l AS ({_LAG}) SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND coalesce(abs(lag) > 900, false))) AS consistent, round(avg(lag), 4) AS mean_lag FROM l GROUP BY 1")
def date_lag_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date is inconsistent only if its source is a primary one and the lag is too long; no lag passes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    lag = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return l.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(C.consistent_lag(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), lag, 900)).alias("consistent"), rounded(F.avg(lag), 4).alias("mean_lag"))


@query(
    """WITH v AS (SELECT 'primary' AS variant, * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'with_pending', * FROM orders WHERE o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1996-01-01'
UNION ALL SELECT 'any_price', * FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'any_date', * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 UNION ALL SELECT 'high_only', * FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority < '3'
UNION ALL SELECT 'all', * FROM orders)
SELECT variant, CASE WHEN o_orderpriority < '3' THEN 'A' ELSE 'BC' END AS grp, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean_price, max(o_orderdate)::DATE::VARCHAR AS anchor FROM v GROUP BY 1, 2"""
)
def population_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six populations from switches of the same rules: each row is copied into the variants that admit it, in one pass. A population's anchor is its own last date."""
    o = table(spark, sf_dir, "orders")
    rules = {"status": F.col("o_orderstatus") != "P", "price": F.col("o_totalprice") > 1000, "date": F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), "high": F.col("o_orderpriority") < "3"}
    usual = ["status", "price", "date"]
    variants = {"primary": usual, "with_pending": usual[1:], "any_price": ["status", "date"], "any_date": usual[:2], "high_only": [*usual, "high"], "all": []}
    rows = linkage.variants(o, rules, variants)
    return rows.groupBy("variant", F.when(F.col("o_orderpriority") < "3", "A").otherwise("BC").alias("grp")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), rounded(F.avg("o_totalprice"), 4).alias("mean_price"), F.max("o_orderdate").cast("date").cast("string").alias("anchor"))


@query(
    """WITH a AS (SELECT max(o_orderdate)::DATE AS anchor FROM orders), m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, avg(log10(o_totalprice * 1e9)) AS log10_n, avg(date_diff('day', anchor, o_orderdate::DATE) / 365.25) AS t_years FROM orders, a GROUP BY 1)
SELECT month::VARCHAR AS month, n, round(log10_n, 6) AS log10_n, round(t_years, 6) AS t_years, date_diff('day', month, last_day(month)) / 2.0 AS mid_offset_days, (SELECT (anchor + INTERVAL 12 MONTH)::DATE::VARCHAR FROM a) AS horizon_12, (SELECT (anchor + INTERVAL 24 MONTH)::DATE::VARCHAR FROM a) AS horizon_24 FROM m"""
)
def annotated_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from the population's own last date, logarithm of the raw size, the middle of each month, and the dates 12 and 24 months on."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    anchor = F.broadcast(o.agg(F.max(F.col("o_orderdate").cast("date")).alias("anchor")))  # one row
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    m = o.join(anchor).groupBy(month.alias("m"), "anchor").agg(F.count("*").alias("n"), F.avg(F.log10(F.col("o_totalprice") * 1e9)).alias("log10_n"), F.avg(C.years_from(F.col("anchor"), F.col("o_orderdate"))).alias("t_years"))
    return m.select(F.col("m").cast("string").alias("month"), "n", rounded("log10_n").alias("log10_n"), rounded("t_years").alias("t_years"), C.month_mid_days(F.col("m")).alias("mid_offset_days"), *[F.add_months("anchor", k).cast("string").alias(f"horizon_{k}") for k in (12, 24)])


@query(
    """WITH p AS (SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'Operation counting' WHEN p_partkey % 3 = 1 THEN 'Hardware' ELSE 'operation counting, Hardware' END AS method, p_size * 1e9 AS n, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 1e19 END AS c FROM part),
d AS (SELECT *, CASE WHEN contains(method, 'Operation counting') AND n > 0 AND c > 0 THEN c / (6 * n) END AS d FROM p)
SELECT p_partkey, round(log10(d), 6) AS log10_d, d IS NOT NULL AND n BETWEEN 7.054e7 AND 1.1965825e10 AND d BETWEEN 1.34e8 AND 2.99893e11 AS inside, round(CASE WHEN d IS NOT NULL THEN 1.68982 + 406.268 * pow(n, -0.339983) + 409.744 * pow(d, -0.279888) END, 6) AS loss FROM d"""
)
def inferred_data_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data from compute and size, D = C / 6N, only where operations were counted; whether the point lies in the law's box; its loss."""
    i = F.col("p_partkey")
    method = F.concat_ws(" ", "p_name", F.when(i % 3 == 0, "Operation counting").when(i % 3 == 1, "Hardware").otherwise("operation counting, Hardware"))
    n, c = F.col("p_size") * 1e9, F.when(i % 5 != 0, F.col("p_retailprice") * 1e19)
    d = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), C.inferred_data(method, n, c).alias("d"))
    inside = F.coalesce(C.inside(F.col("n"), 7.054e7, 1.1965825e10) & C.inside(F.col("d"), 1.34e8, 2.99893e11), F.lit(False))
    return d.select("p_partkey", rounded(F.log10("d")).alias("log10_d"), inside.alias("inside"), rounded(C.law(F.col("n"), F.col("d"), LAW)).alias("loss"))


_KIND = "CASE WHEN contains(k, 'nickel') THEN 'train' WHEN contains(k, 'plated') THEN 'train_eval' WHEN contains(k, 'tin') OR contains(k, 'steel') THEN 'eval' ELSE 'unknown' END"


@query(f"""WITH a AS (SELECT p_partkey, lower(p_type) AS t, {_KIND.replace('k,', 'lower(p_type || p_name),')} AS kind, p_size AS x FROM part)
SELECT kind, CASE WHEN kind = 'unknown' THEN 'not_comparable' WHEN x % 2 = 0 THEN 'same_scale' ELSE 'other_scale' END AS stratum, count(*) AS n FROM a GROUP BY 1, 2""")
def loss_kind_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of loss a source reports, by the first of ordered substrings, and in which stratum it is comparable."""
    kind = C.first_keyword(F.lower(F.concat("p_type", "p_name")), [("nickel", "train"), ("plated", "train_eval"), ("tin", "eval"), ("steel", "eval")], "unknown")
    p = table(spark, sf_dir, "part").select(kind.alias("kind"), "p_size")
    return p.groupBy("kind", F.when(F.col("kind") == "unknown", "not_comparable").when(F.col("p_size") % 2 == 0, "same_scale").otherwise("other_scale").alias("stratum")).agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT p_partkey, 0.2 + (p_partkey % 8) * 0.1 AS q FROM part), t AS (SELECT p_partkey, q, list_sort(list_distinct(list_filter(list_transform([1.05, 1.1, 1.25, 1.5, 2.0], lambda m: round(least(q * m, 0.85), 9)), lambda x: x > q + 1e-12))) AS targets FROM q)
SELECT p_partkey, len(targets) AS n_targets, round(targets[1], 6) AS first, round(targets[-1], 6) AS last FROM t"""
)
def upward_quality_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets above a quality: its multiples, clipped, without those that do not improve or repeat, in order."""
    q = 0.2 + (F.col("p_partkey") % 8) * 0.1
    t = table(spark, sf_dir, "part").select("p_partkey", C.upward_targets(q, 0.85, [1.05, 1.1, 1.25, 1.5, 2.0]).alias("t"))
    return t.select("p_partkey", F.size("t").cast("bigint").alias("n_targets"), rounded(F.get("t", F.lit(0))).alias("first"), rounded(F.get("t", F.size("t") - 1)).alias("last"))


@query(
    """SELECT p_size, CASE WHEN p_size <= 1 + 1e-9 THEN 'lower' WHEN p_size >= 50 - 1e-9 THEN 'upper' ELSE 'interior' END AS bound, p_size BETWEEN 5 AND 45 AS inside, round(0.5 * pow(10, floor(log10(p_size * 1.0)) - 5), 9) AS half_unit, count(*) AS n,
CASE WHEN p_size < 10 THEN 'both' ELSE 'one' END AS boxes, round(least(45, 40.0) - greatest(5, 10.0), 4) AS common_width FROM part GROUP BY p_size"""
)
def validity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a value lies in its bounds and box, half a unit of its sixth digit, and how wide two boxes' common interval is."""
    x = F.col("p_size")
    low, high = C.intersect((5.0, 45.0), (10.0, 40.0))
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", C.bound_status(x, 1, 50, 1e-9).alias("bound"), C.inside(x, 5, 45).alias("inside"), rounded(C.half_unit(x), 9).alias("half_unit"), "n", F.when(x < 10, "both").otherwise("one").alias("boxes"), rounded(F.lit(high - low), 4).alias("common_width"))


@query(
    """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, min_by(c_acctbal, c_custkey) AS v FROM customer GROUP BY 1, 2), b AS (SELECT c_nationkey AS k, c_mktsegment AS s, max_by(c_acctbal, c_custkey) AS v FROM customer GROUP BY 1, 2)
SELECT a.s AS segment, count(*) AS n, count(*) FILTER (abs(a.v - b.v) <= 1e-9) AS identical, round(max(abs(a.v - b.v)), 4) AS widest FROM a JOIN b ON a.k = b.k AND a.s = b.s GROUP BY 1"""
)
def score_identity_between_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, each with one row a key by its own rule, joined: how many scores are the same."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    a = ranks.keep_first(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"]).select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("v"))
    b = ranks.keep_last(c, ["c_nationkey", "c_mktsegment"], ["c_custkey"]).select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("w"))
    gap = F.abs(F.col("v") - F.col("w"))
    return a.join(b, ["c_nationkey", "c_mktsegment"]).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(gap <= 1e-9).alias("identical"), rounded(F.max(gap), 4).alias("widest"))


@query(
    """WITH a AS (SELECT doc_id AS k, md5(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || n_chars) AS sig FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS k, md5(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END) AS sig FROM documents WHERE doc_id % 3 = 0)
SELECT count(*) AS identities, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (a.sig = b.sig) AS agreeing, count(*) FILTER (b.k IS NULL) AS only_first, count(*) FILTER (a.k IS NULL) AS only_second FROM a FULL JOIN b ON a.k = b.k"""
)
def union_membership_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two samples by identity, and whether shared identities carry the same content: signatures are compared, rows do not move."""
    d = table(spark, sf_dir, "documents")
    sig = lambda n: F.md5(F.concat_ws("|", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), n.cast("string")))
    a = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("ka"), sig(F.col("n_chars")).alias("sa"))
    b = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("kb"), sig(F.when(F.col("doc_id") % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).alias("sb"))
    j = a.join(b, F.col("ka") == F.col("kb"), "full")
    return j.agg(F.count("*").alias("identities"), F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("shared"), F.count_if(F.col("sa") == F.col("sb")).alias("agreeing"), F.count_if(F.col("kb").isNull()).alias("only_first"), F.count_if(F.col("ka").isNull()).alias("only_second"))


@query(
    """WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS q FROM lineitem WHERE l_orderkey % 2 = 0), s AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_orderkey % 6 <> 1)
SELECT count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k AND t.i = s.i AND t.q = s.q)) AS outside FROM s"""
)
def indexed_subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that are not rows of another by index and value."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"), "l_partkey")  # noqa: E741
    t = l.filter("k % 2 = 0").select("k", "i", "q").distinct().withColumn("hit", F.lit(True))
    s = l.filter("k % 6 <> 1").withColumn("q", F.when(F.col("l_partkey") % 50 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return s.join(t, ["k", "i", "q"], "left").agg(F.count("*").alias("rows"), F.count_if(F.col("hit").isNull()).alias("outside"))


@query("SELECT p_type AS part_type, p_size, round(max(cd), 6) AS share FROM (SELECT p_type, p_size, cume_dist() OVER (PARTITION BY p_type ORDER BY p_size) AS cd FROM part) GROUP BY 1, 2")
def right_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows that are not larger, by group: running counts of distinct values."""
    out = ranks.value_counts(table(spark, sf_dir, "part"), ["p_type"], "p_size")
    return out.select(F.col("p_type").alias("part_type"), "p_size", rounded(F.col("__upto") / F.col("__total")).alias("share"))


@query(
    """WITH m AS (SELECT c_nationkey AS nation, round(avg(c_acctbal), 0) AS q, count(*) AS n FROM customer GROUP BY 1) SELECT nation, n, q AS mean_q, round(rank() OVER (ORDER BY q DESC) + (count(*) OVER (PARTITION BY q) - 1) / 2.0, 1) AS rank, row_number() OVER (ORDER BY q DESC, nation) AS place FROM m"""
)
def domain_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending average ranks of the domains' means, and their order with ties by name. Domains are grouped first: few rows."""
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 0).alias("mean_q"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("mean_q"))
    return m.select("nation", "n", "mean_q", F.round(F.rank().over(w) + (F.count("*").over(Window.partitionBy("mean_q")) - 1) / 2, 1).alias("rank"), F.row_number().over(Window.orderBy(F.desc("mean_q"), "nation")).alias("place"))


_SUB = "s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, avg(value) FILTER (event_type = 'purchase') AS c, avg(value) FILTER (event_type = 'error') AS e FROM events GROUP BY 1), f AS (SELECT *, (a + b + c + e) / 4 AS m FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL)"


@query(
    f"""WITH {_SUB}, l AS (SELECT user_id, dim, v, m, (4 * m - v) / 3 AS others FROM f UNPIVOT (v FOR dim IN (a, b, c, e))),
r AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY v) + (count(*) OVER (PARTITION BY dim, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY dim ORDER BY round(others, 9)) + (count(*) OVER (PARTITION BY dim, round(others, 9)) - 1) / 2.0 AS ro FROM l)
SELECT dim, count(*) AS n, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(max(abs(v - m)), 6) AS widest, round(corr(rv, ro), 6) AS rho_others FROM r GROUP BY dim"""
)
def score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension's range, its distance from the macro score, and its rank correlation with the mean of the others."""
    dims = {"a": "click", "b": "view", "c": "purchase", "e": "error"}
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(k) for k, t in dims.items()]).na.drop()
    f = f.withColumn("m", C.family_mean([[F.col(k)] for k in dims]))
    long = stored(unpivot(f, ["user_id", "m"], list(dims), "dim", "v").withColumn("others", F.round((4 * F.col("m") - F.col("v")) / 3, 9)))
    ranked = ranks.average_ranks(ranks.average_ranks(long, ["dim"], "v", "rv"), ["dim"], "others", "ro")
    return ranked.groupBy("dim").agg(F.count("*").alias("n"), rounded(F.min("v")).alias("lowest"), rounded(F.max("v")).alias("highest"), rounded(F.max(F.abs(F.col("v") - F.col("m")))).alias("widest"), rounded(F.corr("rv", "ro")).alias("rho_others"))


@query(
    """WITH t AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2), u AS (SELECT user_id, sum(s) / sum(n) AS pooled, avg(s / n) AS averaged, string_agg(event_type || ':' || n, ';' ORDER BY event_type || ':' || n) AS signature FROM t GROUP BY 1)
SELECT signature, count(*) AS users, round(max(abs(pooled - averaged)), 6) AS widest, round(avg(pooled), 6) AS pooled, round(avg(averaged), 6) AS averaged FROM u GROUP BY 1"""
)
def pooled_versus_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks pooled by their counts against tasks averaged, by the signature of a user's tasks; at most as many parts a signature as there are task types."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    u = t.groupBy("user_id").agg((F.sum("s") / F.sum("n")).alias("pooled"), F.avg(F.col("s") / F.col("n")).alias("averaged"), C.signature(F.concat_ws(":", "event_type", "n")).alias("signature"))
    return u.groupBy("signature").agg(F.count("*").alias("users"), rounded(F.max(F.abs(F.col("pooled") - F.col("averaged")))).alias("widest"), rounded(F.avg("pooled")).alias("pooled"), rounded(F.avg("averaged")).alias("averaged"))


@query(
    """WITH x AS (SELECT p_size % 7 AS q, p_retailprice AS y FROM part), l AS (SELECT q, dense_rank() OVER (ORDER BY q) AS up, dense_rank() OVER (ORDER BY q DESC) AS down FROM (SELECT DISTINCT q FROM x)), m AS (SELECT l.q, r.q AS rq FROM l JOIN l r ON l.up = r.down),
r AS (SELECT 'as_is' AS reading, q::DOUBLE AS q, y FROM x UNION ALL SELECT 'one_minus', 6.0 - q, y FROM x UNION ALL SELECT 'rank_reversed', rq, y FROM x JOIN m ON x.q = m.q) SELECT reading, count(*) AS n, round(regr_slope(y, q), 6) AS slope, CASE WHEN regr_slope(y, q) > 0 THEN 'up' ELSE 'down' END AS direction FROM r GROUP BY 1"""
)
def quality_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality scale read as it is, turned round, and with its levels in reverse: the direction of the effect under each reading."""
    x = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("q"), F.col("p_retailprice").alias("y"))
    levels = stored(x.select("q").distinct())  # seven rows
    l = levels.select("q", F.dense_rank().over(Window.orderBy("q")).alias("up"), F.dense_rank().over(Window.orderBy(F.desc("q"))).alias("down"))  # noqa: E741
    m = l.select("q", "up").join(F.broadcast(l.select(F.col("q").alias("rq"), "down")), F.col("up") == F.col("down")).select(F.col("q").alias("mq"), "rq")
    read = lambda name, q: F.struct(F.lit(name).alias("reading"), q.cast("double").alias("q"))
    r = x.join(F.broadcast(m), F.col("q") == F.col("mq")).select("y", F.explode(F.array(read("as_is", F.col("q")), read("one_minus", 6 - F.col("q")), read("rank_reversed", F.col("rq")))).alias("r")).select("y", "r.*")
    return r.groupBy("reading").agg(F.count("*").alias("n"), rounded(F.regr_slope("y", "q")).alias("slope"), F.when(F.regr_slope("y", "q") > 0, "up").otherwise("down").alias("direction"))


@query(
    """WITH b AS (SELECT * FROM (VALUES ('low', 0.0, 60000.0), ('middle', 60000.0, 180000.0), ('high', 150000.0, 1e9)) t(regime, lo, hi)) SELECT regime, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN b ON lo <= o_totalprice AND o_totalprice < hi GROUP BY 1"""
)
def regime_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to the intervals that hold them, which may overlap. The intervals are a fixed, small table, so each row is compared with all of them where it is."""
    b = spark.createDataFrame([("low", 0.0, 60000.0), ("middle", 60000.0, 180000.0), ("high", 150000.0, 1e9)], "regime string, lo double, hi double")
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    return o.join(F.broadcast(b), (F.col("lo") <= F.col("o_totalprice")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("regime").agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean_price"))


def _forms_sql(x: str, y: str) -> str:
    return f"""s AS (SELECT count(*) AS n, avg({x}) AS mx, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_sxx({y}, {x}) AS sxx, sum({y}) AS sy, regr_slope(ln({y} / (100 - {y})), {x}) AS lb, regr_intercept(ln({y} / (100 - {y})), {x}) AS la FROM p),
e AS (SELECT {y} - (sy - {y}) / (n - 1) AS e_constant, ({y} - a - b * {x}) / (1 - 1.0 / n - ({x} - mx) ** 2 / sxx) AS e_linear,
{y} - 100 / (1 + exp(-(ln({y} / (100 - {y})) - (ln({y} / (100 - {y})) - la - lb * {x}) / (1 - 1.0 / n - ({x} - mx) ** 2 / sxx)))) AS e_logit FROM p, s)"""


@query(
    f"""WITH p AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) / 20 AS y FROM part GROUP BY 1 HAVING avg(p_retailprice) / 20 < 100), {_forms_sql('x', 'y')},
r AS (SELECT 'constant' AS form, 1 AS k, sqrt(avg(e_constant ** 2)) AS rmse, stddev_samp(e_constant ** 2) / sqrt(count(*)) AS se2 FROM e UNION ALL SELECT 'linear', 2, sqrt(avg(e_linear ** 2)), stddev_samp(e_linear ** 2) / sqrt(count(*)) FROM e UNION ALL SELECT 'logit', 3, sqrt(avg(e_logit ** 2)), stddev_samp(e_logit ** 2) / sqrt(count(*)) FROM e),
b AS (SELECT min(rmse) ** 2 + arg_min(se2, rmse) AS bar FROM r) SELECT form, round(rmse, 6) AS loo_rmse, rmse ** 2 <= bar AS within_one_se, form = (SELECT arg_min(form, k) FROM r, b WHERE rmse ** 2 <= bar) AS selected FROM r, b"""
)
def bridge_forms_one_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms of a bridge by what each predicts of left-out rows; the simplest within one standard error of the best is selected. Left-out predictions come from leverages."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg((F.avg("p_retailprice") / 20).alias("y")).filter("y < 100")
    return linkage.bridge_forms(stored(p), "x", "y").select("form", rounded("loo_rmse").alias("loo_rmse"), "within_one_se", "selected")


@query(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, 0.9) AS y, (year(min(o_orderdate)) - 1995) * 12 + month(min(o_orderdate)) AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT max(k) AS last, regr_slope(y, k) AS g, regr_intercept(y, k) AS a FROM m), s AS (SELECT m.*, row_number() OVER (ORDER BY k) - 1 AS slot, count(*) OVER () AS c FROM m), sd AS (SELECT sqrt(sum((y - a - g * k) ** 2) / (count(*) - 2)) AS noise FROM m, f),
d AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::BIGINT % c AS pos FROM s, (SELECT unnest(generate_series(0, 99)) AS rep)), b AS (SELECT rep, regr_slope(y, k) AS g, regr_intercept(y, k) AS a FROM d JOIN s ON pos = s.slot GROUP BY rep),
h AS (SELECT scenario, mult, horizon FROM (VALUES ('steady', 1.0), ('half', 0.5), ('stall', 0.0)) x(scenario, mult), (VALUES (12), (24)) y(horizon))
SELECT scenario, horizon, round(any_value(f.a + f.g * last + f.g * CASE WHEN f.g > 0 THEN mult ELSE 1 END * horizon), 3) AS central, round(quantile_cont(b.a + b.g * last + b.g * CASE WHEN b.g > 0 THEN mult ELSE 1 END * horizon, 0.025), 3) AS low, round(quantile_cont(b.a + b.g * last + b.g * CASE WHEN b.g > 0 THEN mult ELSE 1 END * horizon, 0.975), 3) AS high, round(any_value(noise), 3) AS noise_sd FROM h, b, f, sd GROUP BY scenario, horizon"""
)
def forecast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier carried on by scenario and horizon, with bands from months resampled: a multiplier of the rate binds only where the rate is positive. Months are grouped first."""
    m = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    k = (F.substring("month", 1, 4).cast("int") - 1995) * 12 + F.substring("month", 6, 2).cast("int")
    m = stored(ranks.quantiles(m, ["month"], "o_totalprice", {"y": 0.9}).filter("n >= 20").select(k.alias("k"), "y"))
    return resample.forecast(m, "k", "y", {"steady": 1.0, "half": 0.5, "stall": 0.0}, [12, 24], replicates=100, seed=42).select("scenario", "horizon", *[rounded(c, 3).alias(c) for c in ("central", "low", "high", "noise_sd")])


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT unnest(range(1, len(v) + 1)) AS i, v FROM e), o AS (SELECT i, count(*) AS n, round(min(v[i]), 6) AS lowest, round(median(v[i]), 6) AS median, round(max(v[i]), 6) AS highest, round(stddev_pop(v[i]), 6) AS sd, round(corr(v[i], v[1]), 6) AS r_first, count(*) FILTER (isnan(v[i]) OR isinf(v[i])) AS not_finite, count(*) FILTER (len(v) <> 64) AS wrong_width FROM s GROUP BY i) SELECT * FROM o"""
)
def list_part_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of a list column: range, median, spread, correlation with the first, parts that are not finite, lists of another width."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    long = stored(e.select(F.posexplode("v").alias("i", "x"), F.col("v")[0].alias("f"), (F.size("v") != 64).alias("w")).withColumn("i", F.col("i") + 1))
    q = ranks.quantiles(long, ["i"], "x", {"median": 0.5}).select(F.col("i").alias("qi"), "median")
    infinite = F.isnan("x") | (F.abs("x") == float("inf"))
    one = long.groupBy("i").agg(F.count("*").alias("n"), rounded(F.min("x")).alias("lowest"), rounded(F.max("x")).alias("highest"), rounded(F.stddev_pop("x")).alias("sd"), rounded(F.corr("x", "f")).alias("r_first"), F.count_if(infinite).alias("not_finite"), F.count_if("w").alias("wrong_width"))
    return one.join(small(q), F.col("i") == F.col("qi")).select("i", "n", "lowest", rounded("median").alias("median"), "highest", "sd", "r_first", "not_finite", "wrong_width")


@query(
    """WITH c AS (SELECT * FROM (VALUES (2048), (8192), (32768)) x(context)), p AS (SELECT p_partkey, p_size * 1e8 AS n, p_retailprice * 1e8 AS d FROM part), k AS (SELECT context, 6 * n * d AS dense, 2e-4 * context * n * d AS attention, 0.1 * 6 * n * d AS other FROM p, c)
SELECT context, count(*) AS points, round(avg(dense / (dense + attention)), 6) AS dense_of_model, round(avg(dense / (dense + attention + other)), 6) AS dense_of_all, round(avg(attention / (dense + attention + other)), 6) AS attention_of_all, round(log10(sum(dense + attention + other)), 6) AS log10_total FROM k GROUP BY 1"""
)
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of cost by context, as shares of the model's cost and of all cost. The contexts are exploded in place."""
    n, d = F.col("p_size") * 1e8, F.col("p_retailprice") * 1e8
    p = table(spark, sf_dir, "part").select((n * d).alias("nd"), F.explode(F.array(*[F.lit(c) for c in (2048, 8192, 32768)])).alias("context"))
    dense, attention, other = 6 * F.col("nd"), 2e-4 * F.col("context") * F.col("nd"), 0.1 * 6 * F.col("nd")
    whole = dense + attention + other
    return p.groupBy("context").agg(F.count("*").alias("points"), rounded(F.avg(dense / (dense + attention))).alias("dense_of_model"), rounded(F.avg(dense / whole)).alias("dense_of_all"), rounded(F.avg(attention / whole)).alias("attention_of_all"), rounded(F.log10(F.sum(whole))).alias("log10_total"))


@query(
    """WITH p AS (SELECT p_type AS g, p_size * 1e8 AS n, p_retailprice * 1e8 AS d, 1.68982 + 406.268 * pow(p_size * 1e8, -0.339983) + 409.744 * pow(p_retailprice * 1e8, -0.279888) AS f FROM part), e AS (SELECT g, f, f * (1 + (n % 7 - 3) / 100) AS o FROM (SELECT g, f, (n / 1e8)::BIGINT AS n FROM p))
SELECT g AS part_type, count(*) AS n, round(sqrt(avg((f - o) ** 2)), 6) AS rmse, round(avg(abs(f - o)), 6) AS mae, round(avg((f - o) / o), 6) AS mean_relative, round(median(abs(f - o) / o), 6) AS median_relative, round(max(abs(f - o) / o), 6) AS widest_relative, median(abs(f - o) / o) <= 3 * 0.5e-2 / median(o) AS recovers FROM e GROUP BY 1"""
)
def law_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law against observed losses by group: errors, median and widest relative error, and whether the median is within three times what rounding alone makes."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("part_type"), F.col("p_size").alias("s"), C.law(F.col("p_size") * 1e8, F.col("p_retailprice") * 1e8, LAW).alias("f"))
    e = stored(p.withColumn("o", F.col("f") * (1 + (F.col("s") % 7 - 3) / 100)).withColumn("r", F.abs(F.col("f") - F.col("o")) / F.col("o")))
    q = ranks.quantiles(e, ["part_type"], "r", {"median_relative": 0.5}).drop("n").withColumnRenamed("part_type", "qt")
    qo = ranks.quantiles(e, ["part_type"], "o", {"mo": 0.5}).drop("n").withColumnRenamed("part_type", "ot")
    d = F.col("f") - F.col("o")
    one = e.groupBy("part_type").agg(F.count("*").alias("n"), rounded(F.sqrt(F.avg(d * d))).alias("rmse"), rounded(F.avg(F.abs(d))).alias("mae"), rounded(F.avg(d / F.col("o"))).alias("mean_relative"), rounded(F.max("r")).alias("widest_relative"))
    j = one.join(small(q), F.col("part_type") == F.col("qt")).join(small(qo), F.col("part_type") == F.col("ot"))
    return j.select("part_type", "n", "rmse", "mae", "mean_relative", rounded("median_relative").alias("median_relative"), "widest_relative", (F.col("median_relative") <= 3 * 0.5e-2 / F.col("mo")).alias("recovers"))


@query(
    """WITH c AS (SELECT DISTINCT pow(10.0, 19 + p_size % 4) AS budget FROM part), g AS (SELECT budget, i, exp(ln(1e7) + (ln(1e12) - ln(1e7)) * i / 4096) AS n FROM c, (SELECT unnest(generate_series(0, 4096)) AS i)), l AS (SELECT budget, n, 1.68982 + 406.268 * pow(n, -0.339983) + 409.744 * pow(budget / (6 * n), -0.279888) AS loss FROM g),
m AS (SELECT budget, arg_min(n, loss) AS n, min(loss) AS loss FROM l GROUP BY 1) SELECT round(log10(budget), 4) AS log_budget, round(log10(n), 3) AS log_n_grid, round(loss, 8) AS loss, abs(log10(n) - log10(pow(0.339983 * 406.268 / (0.279888 * 409.744) * pow(budget / 6, 0.279888), 1 / (0.339983 + 0.279888)))) < 0.0013 AS agrees FROM m"""
)
def numeric_optimum_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimum by a fine logarithmic grid against the closed form."""
    c = table(spark, sf_dir, "part").select(F.pow(F.lit(10.0), 19 + F.col("p_size") % 4).alias("budget")).distinct()
    n = F.exp(math.log(1e7) + (math.log(1e12) - math.log(1e7)) * F.col("i") / 4096)
    g = c.select("budget", F.explode(F.sequence(F.lit(0), F.lit(4096))).alias("i")).select("budget", n.alias("n"))
    m = g.withColumn("loss", C.law(F.col("n"), F.col("budget") / (6 * F.col("n")), LAW)).groupBy("budget").agg(F.min_by("n", "loss").alias("n"), F.min("loss").alias("loss"))
    exact = C.compute_optimal(F.col("budget"), F.lit(6.0), LAW)
    return m.select(rounded(F.log10("budget"), 4).alias("log_budget"), rounded(F.log10("n"), 3).alias("log_n_grid"), rounded("loss", 8).alias("loss"), (F.abs(F.log10("n") - F.log10(exact)) < 0.0013).alias("agrees"))


@query(
    """WITH x AS (SELECT p_size % 6 AS level, ln(p_size) AS x, ln(p_retailprice) AS y FROM part), s AS (SELECT level, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM x GROUP BY 1), t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s),
k AS (SELECT s.*, t.n - s.n AS tn, t.sx - s.sx AS tx, t.sy - s.sy AS ty, ((t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy) / (t.n - s.n)) / ((t.sxx - s.sxx) - (t.sx - s.sx) ** 2 / (t.n - s.n)) AS b FROM s, t)
SELECT level AS held_out, n, round(b, 6) AS slope, round(sqrt(greatest(0, syy - 2 * ((ty - b * tx) / tn * sy + b * sxy) + n * ((ty - b * tx) / tn) ** 2 + 2 * (ty - b * tx) / tn * b * sx + b * b * sxx) / n), 6) AS rmse, round(sqrt(greatest(0, syy - 2 * ty / tn * sy + n * (ty / tn) ** 2) / n), 6) AS baseline_rmse FROM k"""
)
def leave_level_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level predicted by a fit of the others, and by their mean: sums of a level are taken from all sums, nothing is fitted again."""
    x = table(spark, sf_dir, "part").select((F.col("p_size") % 6).alias("level"), F.log("p_size").alias("x"), F.log("p_retailprice").alias("y"))
    return resample.leave_level_out(x, "level", "x", "y").select(F.col("level").alias("held_out"), "n", rounded("slope").alias("slope"), rounded("rmse").alias("rmse"), rounded("baseline_rmse").alias("baseline_rmse"))


@query(
    """WITH p AS (SELECT p_size::DOUBLE AS n, avg(p_retailprice) AS y FROM part GROUP BY 1), c AS (SELECT f, 0.3 * f AS al FROM (VALUES (0.5), (0.8), (0.9), (1.0), (1.1), (1.25), (2.0)) v(f)), r AS (SELECT f, regr_intercept(y, pow(n, -al)) AS e, regr_slope(y, pow(n, -al)) AS a, regr_syy(y, pow(n, -al)) * (1 - coalesce(regr_r2(y, pow(n, -al)), 0)) AS rss FROM p, c GROUP BY f)
SELECT f AS factor, round(e, 3) AS e, round(a, 3) AS a, round(rss / (SELECT min(rss) FROM r) - 1, 6) AS excess FROM r"""
)
def parameter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter fixed at multiples of its value, the others fitted again: how much the error grows shows how well it is determined."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("n")).agg(F.avg("p_retailprice").alias("y"))
    factors = [0.5, 0.8, 0.9, 1.0, 1.1, 1.25, 2.0]
    r = stored(power_profile(p, "n", "y", [0.3 * f for f in factors]))
    least = r.agg(F.min("rss").alias("least"))
    return r.join(F.broadcast(least)).select(F.round(F.col("c") / 0.3, 6).alias("factor"), rounded("a", 3).alias("e"), rounded("b", 3).alias("a"), rounded(F.col("rss") / F.col("least") - 1).alias("excess"))  # one row by few


@query(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS y, (year(min(o_orderdate)) - 1995) * 12 + month(min(o_orderdate)) AS k FROM orders GROUP BY 1), s AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) // 6 AS block FROM m), b AS (SELECT block, count(*) AS n, sum(y) AS sy, row_number() OVER (ORDER BY block) - 1 AS slot, count(*) OVER () AS c FROM s GROUP BY block),
d AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::BIGINT % c AS pos FROM b, (SELECT unnest(generate_series(0, 99)) AS rep)), r AS (SELECT rep, sum(sy) / sum(n) AS v FROM d JOIN b ON pos = b.slot GROUP BY rep)
SELECT (SELECT count(*) FROM b) AS blocks, round((SELECT avg(y) FROM m), 3) AS mean, round(quantile_cont(v, 0.025), 3) AS low, round(quantile_cont(v, 0.975), 3) AS high FROM r"""
)
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of a mean over months, half-years resampled as blocks so that neighbouring months stay together."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("y"))
    k = (F.substring("month", 1, 4).cast("int") - 1995) * 12 + F.substring("month", 6, 2).cast("int")
    b = m.withColumn("block", F.floor((F.row_number().over(Window.orderBy(k)) - 1) / 6)).groupBy("block").agg(F.count("*").alias("n"), F.sum("y").alias("sy"))  # months: few rows
    b = stored(b)
    r = resample.draws(b, None, "block", 100, 42).groupBy("replicate").agg((F.sum("sy") / F.sum("n")).alias("v"))
    q = ranks.quantiles(r, [], "v", {"low": 0.025, "high": 0.975}).drop("n")
    return b.agg(F.count("*").alias("blocks"), rounded(F.sum("sy") / F.sum("n"), 3).alias("mean")).join(F.broadcast(q)).select("blocks", "mean", rounded("low", 3).alias("low"), rounded("high", 3).alias("high"))  # one row by one row


@query(
    """WITH p AS (SELECT p_type AS g, ln(p_size) AS x, ln(p_retailprice) AS y, ((p_size - 1) // 10) AS f FROM part), s AS (SELECT g, f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM p GROUP BY 1, 2), t AS (SELECT g, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, count(*) AS c FROM s GROUP BY 1),
j AS (SELECT s.g, c, (t.sxy - t.sx * t.sy / t.n) / (t.sxx - t.sx ** 2 / t.n) AS b, ((t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy) / (t.n - s.n)) / ((t.sxx - s.sxx) - (t.sx - s.sx) ** 2 / (t.n - s.n)) AS bo FROM s JOIN t ON s.g = t.g WHERE t.n - s.n >= 3)
SELECT g AS part_type, count(*) AS left_out, round(any_value(b), 6) AS slope, round(min(bo), 6) AS lowest, round(max(bo), 6) AS highest, round(sqrt((count(*) - 1) * var_pop(bo)), 6) AS jackknife_se, min(bo) * max(bo) > 0 AS same_sign FROM j GROUP BY 1"""
)
def jackknife_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope with each block of sizes left out in turn: its range, jackknife error and whether the sign holds. Sums of a block are taken from all sums."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("part_type"), F.log("p_size").alias("x"), F.log("p_retailprice").alias("y"), F.floor((F.col("p_size") - 1) / 10).alias("f"))
    out = resample.jackknife(p, ["part_type"], "f", "x", "y")
    return out.select("part_type", "left_out", *[rounded(c).alias(c) for c in ("slope", "lowest", "highest", "jackknife_se")], "same_sign")
