"""Data-quality queries: indicators of texts, mid-rank scores, conflict between indicators, samples compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import ranks, resample
from lodestat.operators.core import rounded, small, stored, table, unpivot
from lodestat.plans.registry import query

INDICATORS = ["words", "word_length", "unique_share", "digit_share", "upper_share", "line_ends"]
FAMILIES = [["words"], ["word_length", "digit_share", "upper_share"], ["unique_share", "line_ends"]]
LOWER = {"digit_share", "upper_share"}


def indicators(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and six indicators of the text; of an empty text all but the count of words are null."""
    text = F.coalesce("text", F.lit(""))
    w = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    docs = docs.select("doc_id", "lang", "source", text.alias("text"), w.alias("w"))
    n, size = F.size("w"), F.length("text")
    count = lambda p: F.regexp_count("text", F.lit(p))
    among = lambda chars: size - F.length(F.translate("text", chars, ""))
    return docs.select(
        "doc_id", "lang", "source", n.cast("double").alias("words"), C.desirable(F.try_divide(F.length(F.array_join("w", "")), n), 3, 10).alias("word_length"), F.try_divide(F.size(F.array_distinct("w")), n).alias("unique_share"),
        F.try_divide(among("0123456789"), size).alias("digit_share"), F.try_divide(among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size).alias("upper_share"), F.try_divide(count(r"[.!?]\n"), count(r"\n") + 1).alias("line_ends"),
    )


_IND = r"""
t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
c AS (SELECT *, len(w)::DOUBLE AS n, length(text)::DOUBLE AS size FROM t),
ind AS (SELECT doc_id, lang, source, n AS words,
    -greatest(3.0 - len(regexp_extract_all(text, '\S')) / nullif(n, 0), 0.0, len(regexp_extract_all(text, '\S')) / nullif(n, 0) - 10.0) AS word_length,
    len(list_distinct(w)) / nullif(n, 0) AS unique_share, len(regexp_extract_all(text, '[0-9]')) / nullif(size, 0) AS digit_share,
    len(regexp_extract_all(text, '[A-Z]')) / nullif(size, 0) AS upper_share, len(regexp_extract_all(text, '[.!?]\n')) / (len(regexp_extract_all(text, '\n')) + 1.0) AS line_ends FROM c),
long AS (SELECT doc_id, lang, source, indicator, value FROM ind UNPIVOT (value FOR indicator IN (words, word_length, unique_share, digit_share, upper_share, line_ends)))
"""
_SCORE = (
    _IND
    + """,
mid AS (SELECT *, (2 * (rank() OVER (PARTITION BY indicator ORDER BY value) - 1) + count(*) OVER (PARTITION BY indicator, value)) / (2.0 * count(*) OVER (PARTITION BY indicator)) AS s FROM long),
sc AS (SELECT doc_id, lang, source, indicator, CASE WHEN indicator IN ('digit_share', 'upper_share') THEN 1 - s ELSE s END AS s FROM mid),
wide AS (SELECT doc_id, lang, source, max(s) FILTER (indicator = 'words') AS words, max(s) FILTER (indicator = 'word_length') AS word_length, max(s) FILTER (indicator = 'unique_share') AS unique_share,
    max(s) FILTER (indicator = 'digit_share') AS digit_share, max(s) FILTER (indicator = 'upper_share') AS upper_share, max(s) FILTER (indicator = 'line_ends') AS line_ends FROM sc GROUP BY doc_id, lang, source),
q AS (SELECT *, (words + (word_length + digit_share + upper_share) / 3 + (unique_share + line_ends) / 2) / 3 AS q FROM wide)
"""
)


def scores(docs: DataFrame) -> DataFrame:
    """Indicators as mid-rank scores in [0, 1], lower-is-better ones turned round, and q, their family-balanced mean. Complete rows only."""
    ind = stored(indicators(docs)).na.drop(subset=INDICATORS)  # six numbers a document; the drop must not reach the texts' expressions
    long = unpivot(ind, ["doc_id", "lang", "source"], INDICATORS, "indicator", "value")
    scored = ranks.midrank(long, ["indicator"], "value", "s")
    wide = scored.groupBy("doc_id", "lang", "source").agg(*[F.max(F.when(F.col("indicator") == n, (1 - F.col("s")) if n in LOWER else F.col("s"))).alias(n) for n in INDICATORS])
    return wide.withColumn("q", C.family_mean([[F.col(n) for n in f] for f in FAMILIES]))


@query(
    f"""WITH {_SCORE}, cl AS (SELECT lang, source, sum(q) AS s, count(*) AS n FROM q GROUP BY lang, source)
SELECT coalesce(lang, 'ALL') AS domain, sum(n)::BIGINT AS n, count(*) AS clusters, round(sum(s) / sum(n), 6) AS mean_q, round(sum(n) * sum(n) / sum(n * n), 4) AS kish
FROM cl GROUP BY GROUPING SETS ((lang), ())"""
)
def quality_midrank_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by language and overall, with the effective number of source clusters. Documents are summed by cluster first."""
    clusters = scores(table(spark, sf_dir, "documents")).groupBy("lang", "source").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    out = clusters.groupingSets([[F.col("lang")], []], "lang").agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), rounded(F.sum("s") / F.sum("n")).alias("mean_q"), rounded(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 4).alias("kish"))
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("domain"), "n", "clusters", "mean_q", "kish")


@query(
    f"""WITH {_SCORE}, g AS (SELECT greatest(words, word_length, unique_share, digit_share, upper_share, line_ends) - least(words, word_length, unique_share, digit_share, upper_share, line_ends) AS spread FROM q)
SELECT threshold, round(avg((spread >= threshold)::INT), 6) AS rate, round(quantile_cont(spread, 0.5), 6) AS spread_50, round(quantile_cont(spread, 0.9), 6) AS spread_90, round(quantile_cont(spread, 0.95), 6) AS spread_95
FROM g, (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) t(threshold) GROUP BY threshold"""
)
def quality_conflict_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a document's indicators lie apart: shares over thresholds, and quantiles of the spread. One aggregation for all thresholds."""
    every = [F.col(n) for n in INDICATORS]
    spread = stored(scores(table(spark, sf_dir, "documents")).select((F.greatest(*every) - F.least(*every)).alias("spread")))
    marks = [0.1, 0.3, 0.5, 0.7, 0.9]
    one = spread.agg(*[F.avg((F.col("spread") >= t).cast("int")).alias(f"r{i}") for i, t in enumerate(marks)])
    q = ranks.quantiles(spread, [], "spread", {f"spread_{k}": k / 100 for k in (50, 90, 95)}).drop("n")
    rows = one.join(F.broadcast(q)).select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"r{i}").alias("rate")) for i, t in enumerate(marks)])).alias("x"), *q.columns)  # one row by one row
    return rows.select("x.threshold", rounded("x.rate").alias("rate"), *[rounded(c).alias(c) for c in q.columns])


_RANK = "rk AS (SELECT doc_id, indicator, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0 AS r FROM long)"


@query(
    f"""WITH {_IND}, {_RANK},
p AS (SELECT a.indicator AS a, b.indicator AS b, CASE WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END AS rho FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND a.indicator < b.indicator GROUP BY a.indicator, b.indicator)
SELECT a, b, round(rho, 6) AS rho, CASE WHEN rho <= -0.3 THEN 'antagonistic' WHEN rho >= 0.3 THEN 'redundant' WHEN rho IS NULL THEN 'undefined' ELSE 'weak' END AS association FROM p"""
)
def indicator_spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of every pair of indicators and what it amounts to."""
    long = unpivot(stored(indicators(table(spark, sf_dir, "documents"))).na.drop(subset=INDICATORS), ["doc_id"], INDICATORS, "indicator", "value")
    out = ranks.spearman_pairs(long, "doc_id", "indicator", "value", sorted(INDICATORS))
    kind = F.when(F.col("rho").isNull(), "undefined").when(F.col("rho") <= -0.3, "antagonistic").when(F.col("rho") >= 0.3, "redundant").otherwise("weak")
    return out.select("a", "b", rounded("rho").alias("rho"), kind.alias("association"))


@query(
    f"""WITH {_SCORE}, v AS (SELECT lang, list_sort([words, word_length, unique_share, digit_share, upper_share, line_ends]) AS x FROM q),
g AS (SELECT lang, (-5 * x[1] - 3 * x[2] - x[3] + x[4] + 3 * x[5] + 5 * x[6]) / 15 AS gap, len(list_filter(x, lambda y: y < 0.5)) * len(list_filter(x, lambda y: y > 0.5)) / 15.0 AS disagreement, sqrt(list_var_pop(x)) AS sd FROM v)
SELECT coalesce(lang, 'ALL') AS domain, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(avg(disagreement), 6) AS mean_disagreement, round(avg(sd), 6) AS mean_sd FROM g GROUP BY GROUPING SETS ((lang), ())"""
)
def conflict_by_domain_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pair gap, disagreement about the middle and spread of a document's scores, by language and overall."""
    every = [F.col(n) for n in INDICATORS]
    v = scores(table(spark, sf_dir, "documents")).select("lang", C.mean_pair_gap(every).alias("gap"), F.array(*every).alias("x"))
    low, high = F.size(F.filter("x", lambda y: y < 0.5)), F.size(F.filter("x", lambda y: y > 0.5))
    mean = sum(every[1:], every[0]) / len(every)
    m = F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / len(every)
    sd = F.sqrt(F.aggregate(F.transform("x", lambda y: (y - m) * (y - m)), F.lit(0.0), lambda a, b: a + b) / len(every))
    v = v.select("lang", "gap", (low * high / 15.0).alias("dis"), sd.alias("sd"))
    out = v.groupingSets([[F.col("lang")], []], "lang").agg(F.count("*").alias("n"), rounded(F.avg("gap")).alias("mean_gap"), rounded(F.avg("dis")).alias("mean_disagreement"), rounded(F.avg("sd")).alias("mean_sd"))
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("domain"), "n", "mean_gap", "mean_disagreement", "mean_sd")


@query(
    """WITH e AS (SELECT vec_id, label, embedding[1:6]::DOUBLE[] AS v, embedding[7:8]::DOUBLE[] AS two FROM embeddings),
s AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM e), p AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM s)
SELECT vec_id, round(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5] + 5 * p[6], 6) AS ordinal, (list_position(v, list_max(v)) - 1)::INT AS ordinal_argmax, round(1 / (1 + exp(two[1] - two[2])), 6) AS second, round(v[1], 6) AS first FROM p"""
)
def logit_list_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of logits to scalars: expected level, its argmax, second of two, first part."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 6).cast("array<double>").alias("v"), F.slice("embedding", 7, 2).cast("array<double>").alias("two"))
    v = C.require_width(F.col("v"), 6)
    return e.select("vec_id", rounded(C.expected_level(v)).alias("ordinal"), C.argmax(F.col("v")).alias("ordinal_argmax"), rounded(C.second_of_two(F.col("two"))).alias("second"), rounded(F.col("v")[0]).alias("first"))


@query(
    """WITH o AS (SELECT o_orderpriority AS p, o_totalprice AS x, o_orderdate < TIMESTAMP '1998-01-01' AS is_ref FROM orders),
c AS (SELECT p, x, count(*) FILTER (is_ref) AS n, count(*) FILTER (NOT is_ref) AS n_obs FROM o GROUP BY p, x),
r AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY x) AS upto, sum(n) OVER (PARTITION BY p) AS total FROM c)
SELECT p AS priority, sum(n_obs)::BIGINT AS n, round(sum(n_obs * (2 * upto - n) / (2.0 * total)) / sum(n_obs), 6) AS mean_score, round(max((2 * upto - n) / (2.0 * total)), 6) AS max_score FROM r WHERE n_obs > 0 GROUP BY p"""
)
def foreign_reference_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later orders scored against a frozen reference of earlier ones."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_ref"))
    out = ranks.midrank_against(o.filter("is_ref"), o.filter("not is_ref"), ["o_orderpriority"], "o_totalprice")
    n = F.sum("n_obs")
    return out.groupBy(F.col("o_orderpriority").alias("priority")).agg(n.alias("n"), rounded(F.sum(F.col("n_obs") * F.col("score")) / n).alias("mean_score"), rounded(F.max("score")).alias("max_score"))


@query(
    f"""WITH {_SCORE}, m AS (SELECT q.*, l.quality, l.toxic FROM q LEFT JOIN labels l USING (doc_id)),
f AS (SELECT lang, fill, (q + CASE WHEN quality IS NULL THEN fill ELSE quality END) / 2 AS v FROM m, (VALUES (0.0), (0.5), (1.0)) t(fill) UNION ALL SELECT lang, NULL, (q + quality) / 2 FROM m WHERE quality IS NOT NULL),
a AS (SELECT lang, fill, count(*) AS n, avg(v) AS mean_v FROM f GROUP BY lang, fill)
SELECT a.lang, coalesce(a.fill::VARCHAR, 'complete') AS scenario, a.n, round(a.mean_v, 6) AS mean_v, round(a.mean_v - b.mean_v, 6) AS delta FROM a JOIN a b ON a.lang = b.lang AND b.fill IS NULL"""
)
def missing_scenario_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases against fills of the missing part of a score with 0, 0.5 and 1. One row is exploded to its scenarios."""
    q = scores(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    case = lambda name, v: F.struct(F.lit(name).alias("scenario"), v.alias("v"))
    fills = [case(s, (F.col("q") + F.coalesce(F.col("quality").cast("double"), F.lit(float(s)))) / 2) for s in ("0.0", "0.5", "1.0")]
    long = q.select("lang", F.explode(F.array(*fills, case("complete", (F.col("q") + F.col("quality")) / 2))).alias("c")).select("lang", "c.*").filter("v is not null")
    a = long.groupBy("lang", "scenario").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    base = a.filter("scenario = 'complete'").select(F.col("lang").alias("l"), F.col("m").alias("b"))
    return a.join(small(base), F.col("lang") == F.col("l")).select("lang", "scenario", "n", rounded("m").alias("mean_v"), rounded(F.col("m") - F.col("b")).alias("delta"))


@query(
    """WITH c AS (SELECT o_orderpriority AS p, o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
r AS (SELECT p, x, abs(sum(a) OVER (PARTITION BY p ORDER BY x) / sum(a) OVER (PARTITION BY p)::DOUBLE - sum(b) OVER (PARTITION BY p ORDER BY x) / sum(b) OVER (PARTITION BY p)::DOUBLE) AS gap, lead(x) OVER (PARTITION BY p ORDER BY x) AS nx FROM c)
SELECT p AS priority, round(max(gap), 6) AS ks, round(coalesce(sum(gap * (nx - x)), 0), 3) AS wasserstein FROM r GROUP BY p"""
)
def ks_wasserstein_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the prices of two order states, by priority."""
    out = ranks.distances(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus", "o_totalprice"), ["priority"], "o_orderstatus", "F", "O", "o_totalprice")
    return out.select("priority", rounded("ks").alias("ks"), rounded("wasserstein", 3).alias("wasserstein"))


@query(
    """WITH d AS (SELECT doc_id, lang, text, n_chars FROM documents), x AS (
SELECT lang, 'n_chars' AS field, CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars <> length(text) THEN 'mismatch' WHEN n_chars < 40 THEN 'short' END AS kind FROM d UNION ALL
SELECT lang, 'text', CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marks' END FROM d)
SELECT lang, field, kind, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY 1, 2, 3"""
)
def defect_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by language, field and kind; a row may have several."""
    d = table(spark, sf_dir, "documents")
    item = lambda field, kind: F.when(kind.isNotNull(), F.struct(F.lit(field).alias("field"), kind.alias("kind")))
    chars = F.when(F.col("n_chars").isNull(), "null").when(F.col("n_chars") != F.length("text"), "mismatch").when(F.col("n_chars") < 40, "short")
    text = F.when(F.col("text").isNull(), "null").when(F.col("text") == "", "empty").when(F.col("text").rlike("[#$%&*]{3}"), "marks")
    return d.select("lang", F.explode(F.array_compact(F.array(item("n_chars", chars), item("text", text)))).alias("i")).groupBy("lang", "i.field", "i.kind").agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT lang, source, sum(n_chars) AS s, count(*) AS n FROM documents GROUP BY lang, source),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS k FROM k),
r AS (SELECT rep FROM (SELECT unnest(generate_series(0, 199)) AS rep)),
d AS (SELECT rep, s.lang, ('0x' || substr(md5('42|' || rep || '|' || s.slot), 1, 8))::BIGINT % s.k AS pos FROM r, s),
b AS (SELECT d.lang, d.rep, sum(s.s) / sum(s.n) AS m FROM d JOIN s ON d.lang = s.lang AND d.pos = s.slot GROUP BY 1, 2)
SELECT b.lang, round(any_value(p.m), 4) AS mean, round(quantile_cont(b.m, 0.025), 4) AS low, round(quantile_cont(b.m, 0.975), 4) AS high, count(*) AS replicates
FROM b JOIN (SELECT lang, sum(s) / sum(n) AS m FROM k GROUP BY lang) p ON p.lang = b.lang GROUP BY b.lang"""
)
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean length by language, sources resampled. Documents are summed by cluster before any replicate."""
    clusters = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n"))
    out = resample.ratio_interval(clusters, "lang", "source", "s", "n", replicates=200, seed=42)
    return out.select("lang", rounded("mean", 4).alias("mean"), rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "replicates")
