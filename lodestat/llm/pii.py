"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Base matches of the whole corpus are seed entities. The words beside an identifier are its lexical patterns: the two words before it, the
word before it, and the words on both sides. Patterns and identifiers form a bipartite graph, and confidence runs over it in rounds: a pattern is as sure of a kind as the share of
its known identifiers that are of it, where unknown ones count a little against it; an identifier that no base pattern matched is as sure as its patterns are together, if its shape is at home in such
patterns; sure ones are known in the next round and admit further patterns. Column functions only: texts are read once, then only
candidate strings (runs of words with digits, and words with an @).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import ascii_lower, cut, let, spans, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in forms that never backtrack over a run: possessive, and begun only where a run or the last match ends.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Rounds of the bootstrap; confidence from which a pattern or an identifier is sure; distinct known identifiers that a pattern must have;
#: share of a shape's identifiers that must stand in sure patterns.
ROUNDS, SURE, SUPPORT, FIT = 3, 0.8, 5, 0.1
#: In a pattern's confidence: weight of an unseen identifier (few prove little), and of one that is not known to be of any kind.
PRIOR, UNKNOWN = 1.0, 0.1
#: What can be an identifier: a word with a digit or @, and words after single blanks that carry its digits on; at least so many digits, or an @.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@](?:\S++|(?<=[0-9)])\x20(?=[0-9(+]))*+"
DIGITS = 5
#: Rows of the small side of a join are repeated so often that a hot key of the other side is read by as many tasks.
SALTS = 16
FOUND = "array<struct<kind: int, start: bigint, end: bigint, value: string>>"
SEEN = "array<struct<kind: int, start: bigint, end: bigint, value: string, v: bigint, shape: bigint, p: array<bigint>>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    weighed = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":  # by digits, so that long runs don't overflow
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gate(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATE[kind])


def _patterns(left: Column, right: Column) -> Column:
    """Hashes of the lexical patterns of an identifier between two stretches of text: words lower-cased, digits as 0. No word before it: no pattern."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(ascii_lower(c), "[0-9]+", "0"), r"\s+", " ")
    two = clean(F.regexp_extract(left, r"(?<!\S)((?:\S++\s++)?\S++)\s*+\z", 1))
    after = clean(F.regexp_extract(right, r"^\s*+(\S++)", 1))

    def named(two: Column) -> Column:
        one = F.substring_index(two, " ", -1)
        parts = [("two", two), ("one", one), ("both", F.concat(one, F.lit(" _ "), after))]
        return F.transform(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("w")) for n, c in parts]), lambda x: two != ""), lambda x: F.xxhash64(x["n"], x["w"]))

    return F.array_distinct(let(two, named))


def _shape(value: Column) -> Column:
    """Hash of what an identifier looks like: runs of digits as 9, of letters as a, and how many digits there are by fours."""
    mask = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[^0-9@.:/_+()\\x20-]+", "a")
    return F.xxhash64(mask, F.floor(F.length(F.regexp_replace(value, "[^0-9]", "")) / 4))


def _seen(kind: Column, start: Column, value: Column, left: Column, right: Column) -> Column:
    return F.struct(
        kind.cast("int").alias("kind"), start.cast("bigint").alias("start"), (start + F.length(value)).cast("bigint").alias("end"), value.alias("value"),
        F.xxhash64(ascii_lower(value)).alias("v"), _shape(value).alias("shape"), _patterns(left, right).alias("p"),
    )


def base_seen(text: Column) -> Column:
    """Base matches in order of kind, then start, each with its value's and shape's hashes and its patterns."""
    return let(text, lambda t: F.concat(*[_of_kind(t, i, kind) for i, kind in enumerate(KINDS)]))


def _of_kind(text: Column, i: int, kind: str) -> Column:
    found = F.filter(spans(text, F.lit(BASE[kind])), lambda s: valid(kind, s["value"]))
    return F.when(_gate(text, kind), F.transform(found, lambda s: _seen(F.lit(i), s["start"], s["value"], s["left"], s["right"]))).otherwise(F.array().cast(SEEN))


def masked(text: Column) -> Column:
    """The text with line breaks in place of base matches, at the same places."""
    for kind in KINDS:
        text = _masked(text, kind)
    return text


def _masked(text: Column, kind: str) -> Column:
    return let(text, lambda t: F.when(_gate(t, kind), _without(t, kind)).otherwise(t))


def _without(text: Column, kind: str) -> Column:
    between, found = F.split(text, BASE[kind], -1), F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))

    def blank(p: Column) -> Column:
        return F.concat(p["b"], F.when(p["f"].isNull(), "").when(valid(kind, p["f"]), F.repeat(F.lit("\n"), F.length(p["f"]))).otherwise(p["f"]))

    return F.array_join(F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), blank), "")


def candidates(text: Column) -> Column:
    """Strings that can be identifiers, kind null, with their patterns. Marks around one are not part of it; a bracket stays if its other half does."""
    lead = r"^[^A-Za-z0-9+(]+|^\((?=[^)]*\z)"

    def trimmed(s: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(s["value"], lead, ""), r"[^A-Za-z0-9)]++\z|(?<![(][^()]{0,9})\)\W*+\z", "")
        start = s["start"] + F.length(s["value"]) - F.length(F.regexp_replace(s["value"], lead, ""))
        return _seen(F.lit(None), start, core, s["left"], s["right"])

    enough = lambda s: (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= DIGITS) | F.contains(s["value"], F.lit("@"))
    return F.filter(F.transform(F.filter(spans(text, F.lit(_CANDIDATE)), enough), trimmed), lambda s: (F.length(s["value"]) > 0) & (F.size(s["p"]) > 0))


def _salted(big: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """big joined with few, whose key is unique. A hot key of big is dealt out by another column; few is repeated for each part."""
    few = few.withColumnRenamed(key, "__few").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.join(few, (F.col(key) == F.col("__few")) & (F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int") == F.col("__salt")), how).drop("__few", "__salt")


def sure_patterns(edges: DataFrame, known: DataFrame | None, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """(p, of, confidence, known): patterns that are sure of a kind, from edges (p, v, kind) and what earlier rounds found (v, of, score)."""
    if known is None:
        scored = edges.select("p", F.col("kind").alias("__of"), F.lit(1.0).alias("__score"))
    else:
        scored = _salted(edges.select("p", "v", "kind"), known.select("v", "of", "score"), "v", "p", "left")
        scored = scored.select("p", F.coalesce("kind", "of").alias("__of"), F.when(F.col("kind").isNull(), F.col("score")).otherwise(1.0).alias("__score"))
    of = [F.col("__of") == k for k in range(len(KINDS))]
    sums = scored.groupBy("p").agg(F.count("*").alias("n"), *[F.sum(F.when(c, F.col("__score"))).alias(f"m{k}") for k, c in enumerate(of)], *[F.count_if(c).alias(f"k{k}") for k, c in enumerate(of)])
    mass = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) for k in range(len(KINDS))]
    against = sum(mass, F.lit(PRIOR)) + (F.col("n") - sum((F.col(f"k{k}") for k in range(len(KINDS))), F.lit(0))) * UNKNOWN
    each = F.array(*[F.struct(F.round(mass[k] / against, 9).alias("confidence"), F.lit(k).alias("of"), F.col(f"k{k}").alias("known")) for k in range(len(KINDS))])
    best = F.array_max(F.filter(each, lambda x: x["known"] >= support))
    return sums.select("p", best.alias("b")).filter(F.col("b.confidence") >= sure).select("p", "b.of", "b.confidence", "b.known")


def discover(edges: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT, fit: float = FIT) -> DataFrame:
    """(v, of, score): identifiers without a kind that the rounds are sure of.

    edges: p, v, shape, kind (null if no base pattern matched). All steps are grouped sums with partial sums in every task, and joins with the few sure patterns and identifiers,
    which are repeated so that a pattern or identifier of a third of all edges is no single task's.
    """
    edges = cut(edges.groupBy("p", "v").agg(F.min("kind").alias("kind"), F.min("shape").alias("shape")), "edges")
    unknown = edges.filter("kind is null")
    shapes = unknown.groupBy("v").agg(F.min("shape").alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
    known: DataFrame | None = None
    for _ in range(rounds):
        patterns = cut(sure_patterns(edges, known, sure, support), "patterns")
        reach = _salted(unknown, patterns.select("p", "of", "confidence"), "p", "v").groupBy("v", "of").agg(F.min("shape").alias("shape"), (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("s"))
        best = cut(reach.groupBy("v").agg(F.min("shape").alias("shape"), F.max(F.struct(F.round("s", 9).alias("score"), (-F.col("of")).alias("of"))).alias("b")).select("v", "shape", "b.score", (-F.col("b.of")).alias("of")), "reach")
        home = best.groupBy("shape", "of").agg(F.sum("score").alias("s")).join(shapes, "shape").filter(F.round(F.col("s") / F.col("n"), 9) >= fit)
        home = home.select(F.concat_ws("/", "shape", "of").alias("home"))
        known = cut(_salted(best.filter(F.col("score") >= sure).withColumn("home", F.concat_ws("/", "shape", "of")), home, "home", "v").select("v", "of", "score"), "known")
    return known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT, fit: float = FIT) -> DataFrame:
    """One row a row of docs: __id, base and more, both array<struct<kind, start, end, value>>; more holds what the bootstrap found.

    Null and empty texts have no finds. Every row stays, also those that repeat, each with finds of its own; null ids and further columns, also of clashing names, do not matter. Of kinds that
    are equally sure of an identifier the first stands. Texts are read whole, in time that grows with their length. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    some = text.rlike("[0-9@]")
    rows = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.when(some, base_seen(text)).otherwise(F.array().cast(SEEN)).alias("base"), F.when(some, candidates(masked(text))).otherwise(F.array().cast(SEEN)).alias("cand"))
    rows = cut(rows, "pii")
    each = rows.filter("size(base) + size(cand) > 0").select(F.explode(F.concat("base", "cand")).alias("c")).select("c.*")
    known = discover(each.select(F.explode("p").alias("p"), "v", "shape", "kind"), rounds, sure, support, fit)
    held = rows.filter("size(cand) > 0")
    new = _salted(held.select("__row", F.explode("cand").alias("c")).select("__row", "c.start", "c.end", "c.value", "c.v"), known.select("v", "of"), "v", "__row")
    new = new.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(F.col("of").cast("int").alias("kind"), "start", "end", "value"))).alias("more")).withColumnRenamed("__row", "__of_row")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("base")
    none = F.array().cast(FOUND)
    with_new = held.join(new, F.col("__row") == F.col("__of_row"), "left").select("__id", base, F.coalesce("more", none).alias("more"))
    return with_new.unionByName(rows.filter("size(cand) = 0").select("__id", base, none.alias("more")))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts of the base spans by kind, their digest, and all spans."""
    out = personal_data(table(spark, sf_dir, "documents"))
    count = [_count(i, kind) for i, kind in enumerate(KINDS)]
    return out.select(F.col("__id").alias("doc_id"), *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))


def _count(i: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == i)).cast("bigint").alias(f"n_{kind}")
