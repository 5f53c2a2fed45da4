"""Licence scan: ordered signature rules gated by a keyword prefilter, overlaps resolved by priority and containment.

Everything is a column expression of one row: texts without a keyword are counted and passed on; the others become a string of
words over which those rules run whose keyword is in it. Nothing is shuffled. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import BLOCK, ascii_lower, let, shielded, spans, table, text_or_empty
from lodestat.llm.license_rules import GRANT, PHRASES, SENTENCE_WORDS, rules

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = "[^0-9a-z]+"
#: What a lower-cased text must hold for a rule or phrase to match in it: one of these, or a hint and then the pattern of that hint. Forms
#: with a word for licence are in the first; grants, addresses, names and phrases that need none have hints.
GATE = ("licen", "spdx", "creativecommons", "opendatacommons", "unlicense", "wtfpl", "unencumbered", "blueoakcouncil", *SENTENCE_WORDS)
HINTS = {
    "under": f"{GRANT}{_GAP}(?:only{_GAP})?under(?![0-9a-z])",
    "cc": f"(?<![0-9a-z])cc{_GAP}by(?![0-9a-z])",
    "org": f"(?:python|mozilla|boost|sil|gnu|apache|eclipse|opensource){_GAP}org",
    "database": f"open{_GAP}database",
    "reserved": f"all{_GAP}rights{_GAP}reserved",
    "domain": f"public{_GAP}domain",
    "permission": f"permission{_GAP}(?:is|to)",
    "redistribution": f"redistribution{_GAP}and",
    "software": f"free{_GAP}software",
    "altered": f"altered{_GAP}source",
    "mariadb": f"mariadb{_GAP}com",
    "php": f"php{_GAP}net",
    "elastic": f"elastic{_GAP}co",
}

DETECTION = "struct<first: bigint, last: bigint, rank: int, priority: int, label: string, score: double>"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with single spaces between and around them."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(text), F.lit(f"({_WORD})"), 1), " "), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """array<struct<first, last>> of word numbers at which the pattern matches, in order."""
    return F.transform(spans(words, pattern, _spaces), lambda s: F.struct((s["start"] - 1).alias("first"), (s["end"] - 1).alias("last")))


def suppress(found: Column) -> Column:
    """Detections, sorted by start, then longest, then rank, without those that lie inside an earlier one of the same or a higher priority.

    How far the detections of each priority reach is a running maximum: blocks of detections are passed one by one from the reach of the blocks before them. (One that is
    suppressed reaches no farther than the one it lies in, so all count.)
    """
    levels = sorted({r[0] for r in rules()})
    ordered = F.array_sort(found, lambda x, y: F.when(x["first"] != y["first"], F.when(x["first"] < y["first"], -1).otherwise(1)).when(x["last"] != y["last"], F.when(x["last"] > y["last"], -1).otherwise(1)).otherwise(F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0)))
    start = F.array(*[F.lit(-1).cast("bigint")] * len(levels))
    numbers = F.array(*[F.lit(x) for x in levels])
    none = F.array().cast(f"array<{DETECTION}>")

    def reached(reach: Column, d: Column) -> Column:
        return F.zip_with(numbers, reach, lambda p, r: F.when(p == d["priority"], F.greatest(r, d["last"])).otherwise(r))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.arrays_zip(numbers.alias("p"), acc["reach"].alias("r")), lambda z: (z["p"] >= d["priority"]) & (z["r"] >= d["last"]))
        return F.struct(reached(acc["reach"], d).alias("reach"), F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], d)).alias("out"))

    def passed(acc: Column, block: Column) -> Column:
        one = F.aggregate(block, F.struct(acc["reach"].alias("reach"), none.alias("out")), step)
        return let(one, lambda x: F.struct(x["reach"].alias("reach"), F.array_append(acc["out"], x["out"]).alias("out")))

    begin = F.struct(start.alias("reach"), F.array().cast(f"array<array<{DETECTION}>>").alias("out"))
    blocks = lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(d, i, BLOCK))
    return let(ordered, lambda d: F.flatten(F.aggregate(blocks(d), begin, passed, lambda acc: acc["out"])))


def _rule_table() -> Column:
    rows = [F.struct(F.lit(i).alias("rank"), F.lit(p).alias("priority"), F.array(*[F.lit(x) for x in k]).alias("keywords"), F.lit(label).alias("label"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"), F.lit(s).alias("score")) for i, (p, k, label, pattern, s) in enumerate(rules())]
    return F.array(*rows)


def _gate(low: Column) -> Column:
    """Literals are searched as bytes; a pattern runs only where its hint stands."""
    out = F.lit(False)
    for word in GATE:
        out = out | low.contains(word)
    for word, pattern in HINTS.items():
        out = out | (low.contains(word) & low.rlike(pattern))
    return out


def _places(label: str, phrase: str) -> Column:
    """Where the words of a base phrase stand consecutively."""
    at = places(F.col("__words"), F.lit(f"(?<= ){phrase}(?= )"))
    return F.transform(at, lambda s: F.struct(F.lit(label).alias("label"), s["first"].alias("first"), s["last"].alias("last")))


@shielded
def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __n_words, __base (label, first, last of the base phrases) and __found (detections that stand).

    Null text counts as empty and finds nothing; a text without a keyword gets empty arrays. Every row stays, repeated ones too, each with finds of its own; detections that tie in place
    and length go by rank. Texts are read whole, in time that grows with their length and detections. An empty table stays empty; other columns stay as they are.
    """
    text = text_or_empty(text_col)
    gated = _gate(F.col("__low"))
    docs = docs.withColumn("__n_words", F.regexp_count(text, F.lit(_ANY_CASE_WORD)).cast("bigint"))
    docs = docs.withColumn("__low", F.lower(text)).withColumn("__words", F.when(gated, words_of(text))).drop("__low")
    base = F.concat(*[_places(label, phrase) for label, phrase in PHRASES])
    chosen = F.filter(_rule_table(), lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("__words"), k)))
    found = F.flatten(
        F.transform(
            chosen,
            lambda r: F.transform(
                places(F.col("__words"), r["pattern"]),
                lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), r["rank"].alias("rank"), r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score")),
            ),
        )
    )
    none = F.col("__words").isNull()
    docs = docs.withColumn("__base", F.when(none, F.array().cast("array<struct<label: string, first: bigint, last: bigint>>")).otherwise(base))
    return docs.withColumn("__found", F.when(none, F.array().cast(f"array<{DETECTION}>")).otherwise(suppress(found))).drop("__words")


def labels_of(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda d: d["label"]) for a in arrays]))), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. The score is the strongest detection's, and at least 0.5 with a base phrase."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, found = F.col("__base"), F.col("__found")
    starts = F.transform(base, lambda b: b["first"])
    score = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["score"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0))
    return out.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(base, found).alias("labels"), score.alias("score"), F.size(found).cast("bigint").alias("n_found"),
    )
