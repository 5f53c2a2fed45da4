"""Panel queries: linkage, reconciliation, rules, strata, dates, frontiers, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions import columns as C
from lodestat.operators import aggregates, expect, handoff, linkage, names, ranks
from lodestat.operators.core import rounded, small, stored, table
from lodestat.plans.registry import query
from lodestat.streaming import events

_KEY = "nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_LINK = f"""p AS (SELECT p_partkey, p_brand || '/' || p_name AS full_name, {_KEY.format("p_brand || '/' || p_name")} AS k_full, {_KEY.format('p_brand')} AS k_brand, {_KEY.format('p_name')} AS k_name FROM part WHERE p_size <= 25),
r AS (SELECT p_partkey AS r_id, {_KEY.format("p_brand || ' ' || p_name")} AS r_full, {_KEY.format("p_brand || ' ' || p_name || ' ' || p_type")} AS r_type, {_KEY.format('p_name')} AS r_name FROM part WHERE p_size > 25),
u1 AS (SELECT r_full AS k, any_value(r_id) AS v FROM r WHERE r_full IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
u2 AS (SELECT r_name AS k, any_value(r_id) AS v FROM r WHERE r_name IS NOT NULL AND r_name IN (SELECT k_name FROM p GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT p.*, coalesce(u1.v, u2.v) AS linked, CASE WHEN u1.v IS NOT NULL THEN 'full' WHEN u2.v IS NOT NULL THEN 'name' ELSE 'unlinked' END AS link_method FROM p LEFT JOIN u1 ON p.k_full = u1.k LEFT JOIN u2 ON p.k_name = u2.k)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    whole = F.concat_ws("/", "p_brand", "p_name")
    both = names.with_keys(part.select("p_partkey", "p_size", whole.alias("whole"), "p_name"), {"whole": "full", "p_name": "name"})
    left = both.filter("p_size <= 25").select("p_partkey", F.col("full").alias("k_full"), F.col("name").alias("k_name"))
    right = both.filter("p_size > 25").select(F.col("p_partkey").alias("r_id"), F.col("full").alias("r_full"), F.col("name").alias("r_name"))
    return linkage.ladder(left, right, [("full", "k_full", "r_full", False), ("name", "k_name", "r_name", True)], "r_id"), right


@query(f"WITH {_LINK} SELECT p_partkey, linked::VARCHAR AS linked, link_method FROM l")
def linkage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts linked to large ones by full name, then by name alone where that is unique on both sides."""
    return _linked(spark, sf_dir)[0].select("p_partkey", F.col("linked").cast("string").alias("linked"), "link_method")


@query(
    f"""WITH {_LINK}, rc AS (SELECT r_full AS k, count(*) AS rn FROM r GROUP BY 1), lc AS (SELECT k_full AS k, count(*) AS ln FROM p GROUP BY 1)
SELECT CASE WHEN link_method <> 'unlinked' THEN link_method WHEN rn > 1 THEN 'ambiguous_right' WHEN rn = 1 AND ln > 1 THEN 'ambiguous_left' ELSE 'unmatched' END AS outcome, count(*) AS n
FROM l LEFT JOIN rc ON l.k_full = rc.k LEFT JOIN lc ON l.k_full = lc.k GROUP BY 1"""
)
def linkage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every row that was to be linked."""
    linked, right = _linked(spark, sf_dir)
    return linkage.audit(linked, "k_full", right, "r_full")


@query(
    f"""WITH p AS (SELECT p_partkey, {_KEY.format("p_brand || '/' || p_name")} AS k_full, {_KEY.format("p_brand || ' ' || p_type || ' ' || p_name")} AS k_org, {_KEY.format('p_name')} AS k_name, {_KEY.format("replace(p_name, 'small', 'large')")} AS k_alias FROM part WHERE p_size <= 25),
r AS (SELECT p_partkey AS r_id, {_KEY.format("p_brand || ' ' || p_name")} AS r_full, {_KEY.format("p_brand || ' ' || p_type || ' ' || p_name")} AS r_org, {_KEY.format('p_name')} AS r_name FROM part WHERE p_size > 25),
u1 AS (SELECT r_full AS k, any_value(r_id) AS v FROM r WHERE r_full IS NOT NULL GROUP BY 1 HAVING count(*) = 1), u2 AS (SELECT r_org AS k, any_value(r_id) AS v FROM r WHERE r_org IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
u3 AS (SELECT r_name AS k, any_value(r_id) AS v FROM r WHERE r_name IN (SELECT k_name FROM p WHERE k_name IS NOT NULL GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1), u4 AS (SELECT r_name AS k, any_value(r_id) AS v FROM r WHERE r_name IN (SELECT k_alias FROM p WHERE k_alias IS NOT NULL GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, coalesce(u1.v, u2.v, u3.v, u4.v)::VARCHAR AS linked, CASE WHEN u1.v IS NOT NULL THEN 'full' WHEN u2.v IS NOT NULL THEN 'org' WHEN u3.v IS NOT NULL THEN 'name' WHEN u4.v IS NOT NULL THEN 'alias' ELSE 'unlinked' END AS link_method
FROM p LEFT JOIN u1 ON k_full = u1.k LEFT JOIN u2 ON k_org = u2.k LEFT JOIN u3 ON k_name = u3.k LEFT JOIN u4 ON k_alias = u4.k"""
)
def linkage_four_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder: full name, owner with family and name, name alone, alias. Name and alias must be unique on both sides."""
    part = table(spark, sf_dir, "part")
    of = {"full": F.concat_ws(" ", "p_brand", "p_name"), "org": F.concat_ws(" ", "p_brand", "p_type", "p_name"), "name": F.col("p_name"), "alias": F.replace(F.col("p_name"), F.lit("small"), F.lit("large"))}
    both = names.with_keys(part.select("p_partkey", "p_size", *[c.alias(f"of_{k}") for k, c in of.items()]), {f"of_{k}": f"k_{k}" for k in of})
    left = both.filter("p_size <= 25").select("p_partkey", *[f"k_{k}" for k in of])
    right = both.filter("p_size > 25").select(F.col("p_partkey").alias("r_id"), *[F.col(f"k_{k}").alias(f"r_{k}") for k in ("full", "org", "name")], F.col("k_name").alias("r_alias"))
    out = linkage.ladder(left, right, [("full", "k_full", "r_full", False), ("org", "k_org", "r_org", False), ("name", "k_name", "r_name", True), ("alias", "k_alias", "r_alias", True)], "r_id")
    return out.select("p_partkey", F.col("linked").cast("string").alias("linked"), "link_method")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, by time, then id."""
    out = ranks.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", rounded("value").alias("value"))


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation."""
    return ranks.keep_last(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_nationkey AS x, round(c_acctbal, 1) AS y FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_nationkey AS x, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 1) END AS y FROM customer WHERE c_custkey % 5 <> 0)
SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y END AS equal, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1, 2"""
)
def nullsafe_table_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table compared by key, nulls as equals."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"), F.round("c_acctbal", 1).alias("y"))
    b = c.filter("k % 5 <> 0").withColumn("y", F.when(F.col("k") % 7 != 0, F.col("y")))
    return linkage.presence(c.filter("k % 3 <> 0"), b, ["k"], ["x", "y"]).groupBy("side", "equal").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_returnflag = 'A')
SELECT CASE WHEN b.pk IS NULL THEN 'left_only' WHEN a.pk IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.pk = b.pk AND a.sk = b.sk GROUP BY 1"""
)
def full_outer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the part and supplier pairs of two return flags: one aggregation of flags instead of a join."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "A").alias("b"))
    return li.groupBy(F.when(~F.col("b"), "left_only").when(~F.col("a"), "right_only").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) AS semi,
count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) AS anti FROM customer GROUP BY 1"""
)
def semi_anti_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without a large order."""
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(small(large), F.col("c_custkey") == F.col("k"), "left")
    return c.groupBy("c_mktsegment").agg(F.count_if(F.col("hit").isNotNull()).alias("semi"), F.count_if(F.col("hit").isNull()).alias("anti"))


@query(
    """SELECT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_orderpriority FROM orders WHERE o_totalprice < 0"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = lambda c: o.filter(c).select(F.col("o_orderpriority").alias("p"))
    return p("o_orderstatus = 'F'").intersect(p("o_orderstatus = 'P'")).subtract(p("o_totalprice < 0"))


@query(
    """WITH j AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN '2024-02-' || lpad((d.doc_id % 31 + 1)::VARCHAR, 2, '0') END AS a, CASE WHEN l.quality = 1 THEN '2023-' || lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') || '-15' END AS b, DATE '2022-01-01' + (d.doc_id % 600)::INT AS c FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'secondary' ELSE 'fallback' END AS date_source FROM j)
SELECT doc_id, CASE date_source WHEN 'primary' THEN try_cast(a AS DATE) WHEN 'secondary' THEN try_cast(b AS DATE) ELSE c END::VARCHAR AS analysis_date, date_source, CASE date_source WHEN 'primary' THEN 'high' WHEN 'secondary' THEN 'medium' ELSE 'low' END AS confidence FROM s"""
)
def date_fallback_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that is not null is committed to, even if its text is no date (30 February)."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    i = F.col("doc_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    a, b = F.when(i % 4 == 0, F.concat(F.lit("2024-02-"), two(i % 31 + 1))), F.when(F.col("quality") == 1, F.concat(F.lit("2023-"), two(i % 12 + 1), F.lit("-15")))
    source = F.when(a.isNotNull(), "primary").when(b.isNotNull(), "secondary").otherwise("fallback")
    date = F.when(a.isNotNull(), F.try_to_date(a, "yyyy-MM-dd")).when(b.isNotNull(), F.try_to_date(b, "yyyy-MM-dd")).otherwise(F.date_add(F.lit("2022-01-01").cast("date"), (i % 600).cast("int")))
    return d.select("doc_id", date.cast("string").alias("analysis_date"), source.alias("date_source"), F.when(source == "primary", "high").when(source == "secondary", "medium").otherwise("low").alias("confidence"))


@query(
    """SELECT CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality IS NOT NULL OR d.source IN ('src1', 'src2') THEN 'no' ELSE 'unknown' END AS open_state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"""
)
def eligibility_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = C.tri_state(F.col("quality") == 1, F.col("quality").isNotNull() | F.col("source").isin("src1", "src2"))
    return d.groupBy(state.alias("open_state")).agg(F.count("*").alias("n"))


#: Name keywords in order of precedence, and the stratum of each class.
KEYWORDS = [("chat", "chat"), ("instruct", "chat"), ("-it", "chat"), ("-dpo", "chat"), ("-sft", "chat"), ("-ift", "chat"), ("-rlhf", "chat"), ("-ppo", "chat"), ("-tulu", "chat"), ("-kto", "chat"), ("-simpo", "chat"), ("-orpo", "chat"), ("-cpt", "base"), ("continuously-pretrained", "base"), ("-base", "base"), ("-pretrained", "base"), ("-merge", "merge"), ("-moerge", "merge"), ("-slerp", "merge"), ("-ties", "merge"), ("-dare", "merge")]
STRATA = {"base": "A", "chat": "B", "finetuned": "C", "merge": "D", "multimodal": "E", "other": "E"}


@query(
    """WITH x AS (SELECT lower(p_type) || '-' || lower(p_name) AS n FROM part), c AS (SELECT CASE WHEN contains(n, 'brass') THEN 'chat' WHEN contains(n, 'steel') THEN 'base' WHEN contains(n, 'blue') THEN 'merge' WHEN contains(n, 'red') THEN 'finetuned' ELSE 'other' END AS coarse FROM x)
SELECT coarse, CASE coarse WHEN 'base' THEN 'A' WHEN 'chat' THEN 'B' WHEN 'finetuned' THEN 'C' WHEN 'merge' THEN 'D' ELSE 'E' END AS stratum, count(*) AS n FROM c GROUP BY 1, 2"""
)
def strata_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword classes of part names, and their strata."""
    name = F.concat_ws("-", F.lower("p_type"), F.lower("p_name"))
    coarse = C.first_keyword(name, [("brass", "chat"), ("steel", "base"), ("blue", "merge"), ("red", "finetuned")], "other")
    stratum = F.element_at(F.create_map(*[F.lit(x) for kv in STRATA.items() for x in kv]), F.col("coarse"))
    return table(spark, sf_dir, "part").groupBy(coarse.alias("coarse")).agg(F.count("*").alias("n")).select("coarse", stratum.alias("stratum"), "n")


@query(
    """WITH r AS (SELECT o_orderdate >= TIMESTAMP '1996-01-01' AS r1, o_totalprice > 1000 AS r2, o_orderstatus <> 'P' AS r3, o_orderpriority NOT LIKE '5%' AS r4, o_custkey % 10 <> 3 AS r5 FROM orders),
f AS (SELECT *, CASE WHEN NOT r1 THEN 'R1' WHEN NOT r2 THEN 'R2' WHEN NOT r3 THEN 'R3' WHEN NOT r4 THEN 'R4' WHEN NOT r5 THEN 'R5' ELSE 'kept' END AS first FROM r)
SELECT x.rule, CASE x.rule WHEN 'R1' THEN count(*) FILTER (NOT r1) WHEN 'R2' THEN count(*) FILTER (NOT r2) WHEN 'R3' THEN count(*) FILTER (NOT r3) WHEN 'R4' THEN count(*) FILTER (NOT r4) WHEN 'R5' THEN count(*) FILTER (NOT r5) ELSE 0 END AS fails_alone, count(*) FILTER (first = x.rule) AS removed_in_sequence
FROM f, (VALUES ('R1'), ('R2'), ('R3'), ('R4'), ('R5'), ('kept')) x(rule) GROUP BY x.rule"""
)
def rule_ledger_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("R1", F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")), ("R2", F.col("o_totalprice") > 1000), ("R3", F.col("o_orderstatus") != "P"), ("R4", ~F.col("o_orderpriority").like("5%")), ("R5", F.col("o_custkey") % 10 != 3)]
    return aggregates.ledger(table(spark, sf_dir, "orders"), rules)


_ENDINGS = ["", "-Instruct", "-7b-it", "-DPO", "-base", "-slerp", "-continuously-pretrained", "-merge-chat", "-vision"]
_NAMED = "lower(p_name || (" + str(_ENDINGS).replace('"', "'") + ")[(p_partkey % 9 + 1)::INT])"


@query(
    f"""WITH x AS (SELECT {_NAMED} AS n FROM part), c AS (SELECT CASE {' '.join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in KEYWORDS)} ELSE 'finetuned' END AS coarse FROM x)
SELECT coarse, CASE coarse WHEN 'base' THEN 'A' WHEN 'chat' THEN 'B' WHEN 'finetuned' THEN 'C' WHEN 'merge' THEN 'D' ELSE 'E' END AS stratum, count(*) AS n FROM c GROUP BY 1, 2"""
)
def strata_by_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of names by the whole list of keywords, in its order."""
    name = F.lower(F.concat("p_name", F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_partkey") % 9 + 1).cast("int"))))
    out = table(spark, sf_dir, "part").groupBy(C.first_keyword(name, KEYWORDS, "finetuned").alias("coarse")).agg(F.count("*").alias("n"))
    return out.select("coarse", F.element_at(F.create_map(*[F.lit(x) for kv in STRATA.items() for x in kv]), F.col("coarse")).alias("stratum"), "n")


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS best FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows by type: the batch form of the stream's aggregation, which carries a watermark."""
    out = events.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", rounded("total", 4).alias("total"), rounded("best", 4).alias("best"))


@query(
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
g AS (SELECT user_id, k, count(*) AS n, sum(value) AS total FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest, round(sum(total), 4) AS total FROM g GROUP BY 1"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by half an hour without events."""
    out = events.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), rounded(F.sum("total"), 4).alias("total"))


@query(
    """WITH c AS (SELECT unnest(['doc_id', 'lang', 'source', 'quality', 'toxic']) AS col), j AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT col AS "column", (SELECT CASE col WHEN 'doc_id' THEN count(doc_id) WHEN 'lang' THEN count(lang) WHEN 'source' THEN count(source) WHEN 'quality' THEN count(quality) ELSE count(toxic) END FROM j) AS present,
round((SELECT CASE col WHEN 'doc_id' THEN count(doc_id) WHEN 'lang' THEN count(lang) WHEN 'source' THEN count(source) WHEN 'quality' THEN count(quality) ELSE count(toxic) END / count(*) FROM j), 6) AS share FROM c"""
)
def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each column a panel has."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("day", F.lit("2024-01-01"))
    return handoff.panel_reports(j, "doc_id", "lang", "day")["schema"].filter("column <> 'day'").select("column", "present", "share")


@query(
    """WITH e AS (SELECT 'price over 0' AS expectation, count(*) AS n, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS failed FROM orders UNION ALL SELECT 'known status', count(*), count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders UNION ALL SELECT 'not late', count(*), count(*) FILTER (NOT coalesce(o_orderdate < TIMESTAMP '1999-01-01', false)) FROM orders) SELECT * FROM e"""
)
def expectations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a table, counted in one pass; null does not hold."""
    every = [expect.Expectation("price over 0", F.col("o_totalprice") > 0), expect.Expectation("known status", F.col("o_orderstatus").isin("F", "O")), expect.Expectation("not late", F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))]
    return expect.report(table(spark, sf_dir, "orders"), every)


_MONTH = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS v, o_orderstatus AS s FROM orders)"


@query(
    f"""WITH {_MONTH}, t AS (SELECT month, avg(v) AS top_mean FROM (SELECT month, v, row_number() OVER (PARTITION BY month ORDER BY v DESC) AS k FROM m) WHERE k <= 10 GROUP BY month)
SELECT m.month, count(*) AS n, count(*) < 20 AS sparse, round(quantile_cont(v, 0.9), 4) AS p90, round(max(v), 4) AS best, round(any_value(top_mean), 4) AS top_mean, round(median(v), 4) AS median FROM m JOIN t ON m.month = t.month GROUP BY m.month"""
)
def monthly_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.frontier(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("v")), "month", "v")
    return out.select("month", "n", "sparse", *[rounded(c, 4).alias(c) for c in ("p90", "best", "top_mean", "median")])


@query(f"WITH {_MONTH}, q AS (SELECT *, quantile_cont(v, 0.9) OVER (PARTITION BY month) AS p90, count(*) OVER (PARTITION BY month) AS n FROM m) SELECT month, s AS status, count(*) AS n_frontier, round(avg(v), 6) AS mean_v FROM q WHERE n >= 20 AND v >= p90 GROUP BY 1, 2")
def frontier_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at or over the 90th percentile of their own month, of months with 20 or more; the percentiles are aggregated and joined, not windowed."""
    m = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"))
    p = ranks.quantiles(m, ["month"], "v", {"p90": 0.9}).filter("n >= 20").select(F.col("month").alias("mm"), "p90")
    return m.join(small(p), F.col("month") == F.col("mm")).filter("v >= p90").groupBy("month", "status").agg(F.count("*").alias("n_frontier"), rounded(F.avg("v"), 6).alias("mean_v"))


@query(
    """WITH o AS (SELECT CASE WHEN o_totalprice < 50000 THEN '[0,50k)' WHEN o_totalprice < 150000 THEN '[50k,150k)' ELSE '[150k,inf)' END AS band, date_diff('day', DATE '2001-08-01', o_orderdate::DATE) / 365.25 AS t, o_totalprice AS y FROM orders)
SELECT band, count(*) AS n, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 4) AS level FROM o GROUP BY band HAVING count(*) >= 30"""
)
def frontier_band_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear trend by half-open price bands with 30 rows or more; time in years from a fixed anchor."""
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date")) / F.lit(365.25)
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") < 50000, "[0,50k)").when(F.col("o_totalprice") < 150000, "[50k,150k)").otherwise("[150k,inf)").alias("band"), t.alias("t"), F.col("o_totalprice").alias("y"))
    return o.groupBy("band").agg(F.count("*").alias("n"), rounded(F.regr_slope("y", "t"), 4).alias("slope"), rounded(F.regr_intercept("y", "t"), 4).alias("level")).filter("n >= 30")


@query(
    f"""WITH {_MONTH}, b AS (SELECT month, quantile_cont(v, 0.9) AS p90, (substr(month, 1, 4)::INT - 1995) * 12 + substr(month, 6, 2)::INT AS k FROM m GROUP BY month HAVING count(*) >= 20),
o AS (SELECT t.k, t.p90 AS actual, count(*) AS n_train, arg_max(b.p90, b.k) AS persistence, regr_slope(b.p90, b.k) * t.k + regr_intercept(b.p90, b.k) AS trend FROM b t JOIN b ON b.k <= t.k - 6 GROUP BY t.k, t.p90 HAVING count(*) >= 6)
SELECT count(*) AS origins, round(sqrt(avg((persistence - actual) ** 2)), 3) AS rmse_persistence, round(sqrt(avg((trend - actual) ** 2)), 3) AS rmse_trend FROM o"""
)
def rolling_origin_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six months ahead from every origin with six months or more behind it: last value and linear trend. Months are grouped first, so the join is over months."""
    m = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    k = (F.substring("month", 1, 4).cast("int") - 1995) * 12 + F.substring("month", 6, 2).cast("int")
    b = stored(ranks.quantiles(m, ["month"], "o_totalprice", {"p90": 0.9}).filter("n >= 20").select(k.alias("k"), "p90"))
    t = b.select(F.col("k").alias("tk"), F.col("p90").alias("actual"))
    fit = F.regr_slope("p90", "k") * F.col("tk") + F.regr_intercept("p90", "k")
    o = t.join(small(b), F.col("k") <= F.col("tk") - 6).groupBy("tk", "actual").agg(F.count("*").alias("n_train"), F.max_by("p90", "k").alias("persistence"), fit.alias("trend")).filter("n_train >= 6")
    rmse = lambda c: rounded(F.sqrt(F.avg((F.col(c) - F.col("actual")) * (F.col(c) - F.col("actual")))), 3)
    return o.agg(F.count("*").alias("origins"), rmse("persistence").alias("rmse_persistence"), rmse("trend").alias("rmse_trend"))


_CELL = "e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2)"


@query(f"WITH {_CELL} SELECT event_type, count(v) AS n, count(*) - count(v) AS missing, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3, round(var_samp(v), 5) AS variance, round(stddev_samp(v), 5) AS sd FROM e GROUP BY 1")
def subtask_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = aggregates.profile(cells, ["event_type"], "v")
    return out.select("event_type", "n", "missing", *[rounded(c, 5).alias(c) for c in ("q1", "median", "q3", "variance", "sd")])


@query(
    f"""WITH {_CELL}, g AS (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT event_type) >= 2), x AS (SELECT e.user_id, v, avg(v) OVER (PARTITION BY e.user_id) AS gm, avg(v) OVER () AS m FROM e JOIN g ON e.user_id = g.user_id)
SELECT count(DISTINCT user_id) AS groups, count(*) AS observations, round(sum((gm - m) ** 2), 2) AS between_ss, round(sum((v - gm) ** 2), 2) AS within_ss, round(sum((gm - m) ** 2) / sum((v - m) ** 2), 6) AS icc FROM x"""
)
def variance_decomposition_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = aggregates.icc(cells, "user_id", "event_type", "v")
    return out.select("groups", "observations", rounded("between", 2).alias("between_ss"), rounded("within", 2).alias("within_ss"), rounded("icc").alias("icc"))


@query(f"WITH {_CELL}, s AS (SELECT user_id, stddev_samp(v) AS sd, max(v) - min(v) AS spread FROM e GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS n, round(quantile_cont(sd, 0.25), 5) AS q1, round(median(sd), 5) AS median, round(quantile_cont(sd, 0.75), 5) AS q3, round(max(spread), 5) AS widest FROM s")
def within_group_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    s = cells.groupBy("user_id").agg(F.count("*").alias("c"), F.stddev_samp("v").alias("sd"), (F.max("v") - F.min("v")).alias("spread")).filter("c >= 2")
    s = stored(s)
    q = ranks.quantiles(s, [], "sd", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.join(F.broadcast(s.agg(F.max("spread").alias("widest")))).select("n", *[rounded(k, 5).alias(k) for k in ("q1", "median", "q3")], rounded("widest", 5).alias("widest"))  # one row by one row


@query(
    """WITH r AS (SELECT user_id, event_type, avg(json_extract_string(props, '$.k')::DOUBLE) / 100 AS raw FROM events GROUP BY 1, 2), b AS (SELECT *, CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 0.5 ELSE 0.0 END AS base FROM r)
SELECT user_id, round(avg(greatest(0.0, (raw - base) / (1 - base)) * 100), 6) AS score, count(*) AS subtasks FROM b GROUP BY 1"""
)
def baseline_rescale_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from JSON, rescaled over the guessing baseline of each subtask, then averaged."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    raw = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.avg(k) / 100).alias("raw"))
    base = F.when(F.col("event_type") == "click", 0.25).when(F.col("event_type") == "view", 0.1).when(F.col("event_type") == "purchase", 0.5).otherwise(0.0)
    return raw.groupBy("user_id").agg(rounded(F.avg(C.rescaled(F.col("raw"), base))).alias("score"), F.count("*").alias("subtasks"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS rebuilt FROM lineitem GROUP BY 1), j AS (SELECT o_orderpriority AS p, abs(rebuilt - o_totalprice) AS d FROM orders JOIN l ON o_orderkey = k)
SELECT p AS priority, count(*) AS n, round(avg(d), 3) AS mean_delta, round(median(d), 3) AS median_delta, round(quantile_cont(d, 0.95), 3) AS p95_delta, round(avg((d <= 50000)::INT), 6) AS share_within, CASE WHEN avg((d <= 50000)::INT) >= 0.95 THEN 'reconciled' ELSE 'quarantined' END AS verdict FROM j GROUP BY 1"""
)
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals rebuilt from their lines, against what orders say."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("rebuilt"))
    j = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("priority"), F.abs(F.col("rebuilt") - F.col("o_totalprice")).alias("d"))
    share = F.avg((F.col("d") <= 50000).cast("int"))
    j = stored(j)
    q = ranks.quantiles(j, ["priority"], "d", {"median_delta": 0.5, "p95_delta": 0.95}).drop("n").withColumnRenamed("priority", "pr")
    out = j.groupBy("priority").agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), share.alias("share")).join(small(q), F.col("priority").eqNullSafe(F.col("pr")))
    share = F.col("share")
    return out.select("priority", "n", *[rounded(c, 3).alias(c) for c in ("mean_delta", "median_delta", "p95_delta")], rounded(share).alias("share_within"), F.when(share >= 0.95, "reconciled").otherwise("quarantined").alias("verdict"))


@query(
    """SELECT o_orderkey, round(delta, 3) AS delta FROM (SELECT o_orderkey, abs(o_totalprice - s) AS delta FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) ORDER BY abs(delta) DESC, o_orderkey LIMIT 5"""
)
def worst_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest differences: a top-k report."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    j = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.abs(F.col("o_totalprice") - F.col("s")).alias("delta"))
    return j.orderBy(F.desc("delta"), "o_orderkey").limit(5).select("o_orderkey", rounded("delta", 3).alias("delta"))


@query("WITH c AS (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2) SELECT n AS multiplicity, count(*) AS groups, sum(n)::BIGINT AS rows FROM c GROUP BY 1")
def shared_key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


@query("SELECT role, count(*) AS turns, count(*) FILTER (prev IS NOT NULL AND prev <> role) AS changes, count(*) FILTER (prev = role) AS repeats FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM conversations) GROUP BY 1")
def adjacent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between neighbouring rows of a group."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(w))
    return x.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.col("prev") != F.col("role")).alias("changes"), F.count_if(F.col("prev") == F.col("role")).alias("repeats"))
