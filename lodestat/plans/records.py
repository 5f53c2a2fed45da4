"""Queries of records and their order, raw tokens, names, provenance, bridges, and a frontier kept by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators import bridge, names, provenance
from lodestat.operators.core import rounded, small, stored, table
from lodestat.plans.registry import query
from lodestat.sources import positions, rawlines, support
from lodestat.streaming import events, frontier

# -- order of files -----------------------------------------------------------------------------------

_CHANGED = "CASE WHEN position % 997 = 700 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_totalprice + CASE WHEN o_orderkey % 101 = 7 THEN 0.25 ELSE 0 END AS o_totalprice, CASE WHEN position % 53 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus"


@query(
    f"""WITH l AS (SELECT row_number() OVER () - 1 AS position, o_orderkey, o_totalprice, o_orderstatus FROM orders), r AS (SELECT position, {_CHANGED} FROM l WHERE position < (SELECT count(*) - 3 FROM l)),
j AS (SELECT coalesce(l.position, r.position) AS p, l.o_orderkey IS DISTINCT FROM r.o_orderkey AS moved, l.o_totalprice IS DISTINCT FROM r.o_totalprice OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus AS other, abs(l.o_totalprice - r.o_totalprice) AS gap FROM l FULL JOIN r ON l.position = r.position)
SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, count(*) FILTER (moved) = 0 AS same_order, min(p) FILTER (moved) AS first_disorder, min(p) FILTER (moved OR other) AS first_difference, count(*) FILTER (NOT moved AND other) AS differing_rows, round(max(gap) FILTER (NOT moved AND other), 6) AS widest FROM j"""
)
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order of their file against a copy with changed rows, in which the last rows are missing: whether keys stand in the same order, and the first place where they do not."""
    left = positions.in_file_order(table(spark, sf_dir, "orders")).select("position", "o_orderkey", "o_totalprice", "o_orderstatus")
    right = left.filter(F.col("position") < left.count() - 3).selectExpr("position", *[x for x in _CHANGED.replace(" AS o_totalprice", " AS o_totalprice;").replace(" AS o_orderkey,", " AS o_orderkey;").replace("o_totalprice;,", "o_totalprice;").split(";")])
    out = positions.compared(left, right, "o_orderkey", ["o_totalprice", "o_orderstatus"])
    return out.withColumn("widest", rounded("widest"))


# -- raw tokens ---------------------------------------------------------------------------------------

_WIDTH = 64


@query(
    f"""WITH k AS (SELECT CASE WHEN vec_id % 11 = 3 THEN 'confirmed' WHEN vec_id % 11 = 5 THEN 'partial' WHEN vec_id % 11 = 7 THEN 'unreconciled' WHEN vec_id % 11 = 8 THEN 'infinity' WHEN vec_id % 11 = 9 THEN 'defect' WHEN vec_id % 11 = 10 THEN 'unparsed' ELSE 'complete' END AS status,
CASE vec_id % 11 WHEN 3 THEN {_WIDTH} WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS tokens, vec_id % 7 AS id FROM embeddings)
SELECT status, count(*) AS n, sum(tokens)::BIGINT AS nan_tokens, (SELECT count(*) FROM (SELECT id FROM k GROUP BY id HAVING count(*) > 1)) AS repeated_identities FROM k GROUP BY 1"""
)
def confirmed_nan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as JSON lines with planted defects, read back raw beside parsed: whole vectors of NaN are confirmed; NaN in part of a vector, in another field or as infinity is not; a string that says NaN is none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]")).alias("v"))
    m = F.col("vec_id") % 11
    whole = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("NaN"), _WIDTH), ", "), F.lit("]"))
    v = F.when(m == 3, whole).when(m == 5, F.regexp_replace("v", r"^\[[^,]*", "[NaN")).when(m == 8, F.regexp_replace("v", r"^\[[^,]*", "[-Infinity")).when(m == 9, F.regexp_replace("v", r"^\[[^,]*,", "[")).otherwise(F.col("v"))
    text = F.concat(F.lit('{"id": '), (F.col("vec_id") % 7).cast("string"), F.lit(', "note": "NaN, \\"v\\": [NaN]", "v": '), v, F.when(m == 7, ', "score": NaN').otherwise(', "score": 1.5'), F.when(m == 10, "").otherwise("}"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("score", T.DoubleType())])
    found = stored(rawlines.confirmed(e.select("vec_id", text.alias("value")), schema, {"v": _WIDTH}, ["v"]).select("vec_id", "nan_tokens", "status"))
    again = rawlines.repeated(e.select((F.col("vec_id") % 7).alias("id")), ["id"]).agg(F.count("*").alias("repeated_identities"))
    return found.groupBy("status").agg(F.count("*").alias("n"), F.sum("nan_tokens").alias("nan_tokens")).join(F.broadcast(again))  # seven rows by one row


# -- names --------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT unnest(string_split(translate(text, chr(10) || chr(9), '  '), ' ')) AS word FROM documents), k AS (SELECT word, nullif(regexp_replace(regexp_replace(lower(strip_accents(word)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS name FROM w)
SELECT name, count(*) AS n, count(DISTINCT word) AS spellings FROM k WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT word) FILTER (regexp_matches(word, '[^\\x00-\\x7F]')) > 0"""
)
def decomposed_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the words of all documents that are spelled with other than ASCII letters somewhere, and in how many ways."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.translate("text", "\n\t", "  "), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    k = names.with_keys(stored(w), {"word": "name"}).filter("name is not null")
    out = k.groupBy("name").agg(F.sum("c").alias("n"), F.count("*").alias("spellings"), F.count_if(F.col("word").rlike(r"[^\x00-\x7F]")).alias("odd"))
    return out.filter("odd > 0").drop("odd")


# -- provenance ---------------------------------------------------------------------------------------

_ITEMS = "items AS (SELECT DISTINCT p_partkey % 97 AS id, CASE WHEN p_partkey % 97 = 5 THEN [] WHEN p_partkey % 97 = 9 THEN [1000] ELSE [(p_partkey % 97) * (p_partkey % 97) % 97, ((p_partkey % 97) + 31) % 50] END AS parents FROM part)"


@query(
    f"""WITH RECURSIVE {_ITEMS}, edge AS (SELECT child, parent FROM (SELECT id AS child, unnest(parents) AS parent FROM items) WHERE parent IN (SELECT id FROM items)), way AS (SELECT child, parent, 1 AS steps FROM edge UNION SELECT w.child, e.parent, w.steps + 1 FROM way w JOIN edge e ON w.parent = e.child WHERE w.steps < 97),
loops AS (SELECT child AS id, min(steps) AS length FROM way WHERE child = parent GROUP BY 1), lost AS (SELECT DISTINCT id FROM (SELECT id, unnest(parents) AS parent FROM items) WHERE parent NOT IN (SELECT id FROM items))
SELECT id, 'own ancestor' AS problem, length::INT AS length FROM loops UNION ALL SELECT id, 'unknown parent', NULL FROM lost"""
)
def provenance_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with two parents an item: which items are their own ancestors, by how short a way, and which name a parent that is not there."""
    i = F.col("p_partkey") % 97
    parents = F.when(i == 5, F.array().cast("array<bigint>")).when(i == 9, F.array(F.lit(1000).cast("bigint"))).otherwise(F.array(i * i % 97, (i + 31) % 50))
    items = stored(table(spark, sf_dir, "part").select(i.alias("id"), F.lit("derived").alias("kind"), parents.alias("parents")).distinct())
    found = provenance.problems(items, ["derived"])
    length = provenance.cycles(items).select(F.col("id").alias("__id"), "length")
    return found.join(small(length), (F.col("id") == F.col("__id")) & (F.col("problem") == "own ancestor"), "left").select("id", "problem", "length")


@query("SELECT p_size AS value, count(*) AS n, min(trim(p_name)) AS first_name, max(trim(p_name)) AS last_name, (SELECT count(DISTINCT p_size) FROM part) AS grid FROM part GROUP BY 1")
def support_grid_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that parts have, how often, and the first and last name of each."""
    g = stored(support.support_grid(table(spark, sf_dir, "part"), "p_size", "p_name"))
    return g.join(F.broadcast(g.agg(F.count("*").alias("grid"))))  # one row


# -- bridges ------------------------------------------------------------------------------------------

_BRIDGE = "p AS (SELECT p_brand AS g, ln(p_size) AS x, p_retailprice / 25.0 AS y FROM part), f AS (SELECT o.g, count(*) AS rest, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT g FROM p) o JOIN p ON p.g <> o.g GROUP BY o.g)"


@query(f"WITH {_BRIDGE} SELECT p.g AS brand, count(*) AS n, round(any_value(a), 6) AS level, round(any_value(b), 6) AS slope, round(sqrt(avg((a + b * x - y) ** 2)), 6) AS rmse, round(avg(abs(a + b * x - y)), 6) AS mae, round(avg(a + b * x - y), 6) AS mean_error FROM p JOIN f USING (g) GROUP BY p.g")
def bridge_brand_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line from size to price without each brand, and its error there. SQL fits each anew."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.log("p_size").alias("x"), (F.col("p_retailprice") / 25.0).alias("y"))
    out = bridge.leave_group_out(p, "brand", "x", "y")
    return out.select("brand", "n", *[rounded(c).alias(c) for c in ("level", "slope", "rmse", "mae", "mean_error")])


@query(
    f"""WITH {_BRIDGE}, e AS (SELECT sqrt(avg((a + b * x - y) ** 2)) AS sd FROM p JOIN f USING (g)), w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, quantile_disc(x, 0.1) AS lo, quantile_disc(x, 0.9) AS hi FROM p),
q AS (SELECT p_partkey, ln(p_size) AS x, 0.01 * (1 + p_partkey % 5) AS xsd FROM part), r AS (SELECT *, x >= lo AND x <= hi AS inside FROM q, w, e)
SELECT form, count(*) AS n, count(*) FILTER (inside) AS supported, round(avg(CASE WHEN inside THEN m END), 6) AS mean, round(avg(CASE WHEN inside THEN sqrt(sd * sd + (s * xsd) ** 2) END), 6) AS sd, round(max(CASE WHEN inside THEN sqrt(sd * sd + (s * xsd) ** 2) END), 6) AS widest_sd
FROM (SELECT r.*, 'linear' AS form, a + b * x AS m, b AS s FROM r UNION ALL SELECT r.*, 'constant', a, 0 FROM r UNION ALL SELECT r.*, 'logit', 100 / (1 + exp(-(-2 + 0.7 * x))), 0.7 * (100 / (1 + exp(-(-2 + 0.7 * x)))) * (100 - 100 / (1 + exp(-(-2 + 0.7 * x)))) / 100 FROM r) GROUP BY form"""
)
def bridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three forms with both errors that they carry, that of the bridge at brands it has not seen and that of the size; none outside the sizes it was fitted on."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("g"), F.log("p_size").alias("x"), (F.col("p_retailprice") / 25.0).alias("y"))
    sd = bridge.block_error(bridge.leave_group_out(t, "g", "x", "y")).first()["rmse"]
    sizes = t.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect()  # at most as many sizes as parts come in
    total, line, run, cut = sum(r["n"] for r in sizes), t.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first(), 0, []
    for r in sizes:
        run += r["n"]
        cut += [r["x"]] * sum(run - r["n"] < k <= run for k in (max(1, -(-total * 1 // 10)), max(1, -(-total * 9 // 10))))
    xsd = 0.01 * (1 + F.col("p_partkey") % 5)
    forms = {"linear": (line["a"], line["b"]), "constant": (line["a"], 0.0), "logit": (-2.0, 0.7)}
    each = [F.struct(F.lit(k).alias("form"), *[c.alias(n) for c, n in zip(bridge.prediction(F.col("x"), xsd, k, a, b, sd, cut[0], cut[1]), ("m", "s"), strict=True)]) for k, (a, b) in forms.items()]
    out = t.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return out.groupBy("form").agg(F.count("*").alias("n"), F.count("m").alias("supported"), rounded(F.avg("m")).alias("mean"), rounded(F.avg("s")).alias("sd"), rounded(F.max("s")).alias("widest_sd"))


# -- a frontier kept by a stream ----------------------------------------------------------------------


@query(
    """WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN user_id % 7 = 0 THEN 'unlinked' ELSE 'group' || (user_id % 3) END AS grp, value FROM events WHERE value IS NOT NULL)
SELECT month, grp, n, rank::INT AS rank, round(value, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY month, grp) AS n, row_number() OVER (PARTITION BY month, grp ORDER BY value DESC) AS rank FROM e) WHERE rank <= 5"""
)
def event_frontier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best values of each month and linked group, kept by a stream over the events with a state of its own; users are linked by a table that does not change."""
    static = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 7 <> 0").select("user_id", F.concat(F.lit("group"), (F.col("user_id") % 3).cast("string")).alias("grp"))
    updates = frontier.frontier_stream(frontier.linked(events.stream(spark, sf_dir), static, "user_id"), 5)
    out = frontier.run(spark, updates, f"frontier_{uuid.uuid4().hex}")
    return out.select("month", "grp", "n", "rank", rounded("value").alias("value"))
