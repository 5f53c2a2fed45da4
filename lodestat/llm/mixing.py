"""Mixing sources to target weights by Pareto order sampling.

A source's target says how often each of its words is wanted: k = target / size of the source. Every document is taken
floor(k) times for certain; the rest, k - floor(k), is its inclusion probability in a sample of fixed size, by
Pareto's order: documents are ranked by the odds of a random number divided by the odds of inclusion, and the
first are taken until the source has its words. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.llm.common import cut, join_dim, row_key, shielded, table, text_or_empty, unit_hash

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (3.0, 1.0, 2.0), 42
#: Parts of a source's order of rank that are summed before the one part that holds its border is sorted.
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (__source, source_size: one row a source) with __weight and target.

    Weights repeat over the sources by code point, null last. Targets are the water level: level * weight, or cap times the
    source's size where that is less, with the level that makes them sum to share of all sizes. That is what resharing
    the excess by weight comes to.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    s = sizes.withColumn("__weight", pick).withColumn("__limit", F.col("source_size") * cap)
    fill = Window.orderBy((F.col("__limit") / F.col("__weight")).asc(), F.col("__source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    rest = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    s = s.withColumn("__level", left / rest)
    # the first source, in the order in which a rising level fills them, that the level does not fill; none if share >= cap
    s = s.withColumn("__nth", F.row_number().over(fill))
    first = F.min(F.when(F.col("__level") * F.col("__weight") <= F.col("__limit"), F.struct("__nth", "__level"))).over(everything)
    s = s.withColumn("__line", first["__level"])
    target = F.when(F.col("__line").isNull(), F.col("__limit")).otherwise(F.least(F.col("__limit"), F.col("__line") * F.col("__weight")))
    return s.select("__source", "source_size", "__weight", target.cast("double").alias("target"))


def mix(rows: DataFrame, source_col: str, size_col: str, keys: list[str], *, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """rows with source_size, target and copies (0, 1, 2, ...).

    keys decide a row's random number, so reruns agree. A source of a third of all rows is summed by bins of its order in
    every task; only the bin with its border is sorted. The border document is taken if the words come nearer to the target with it.
    Sources without words get no copies; an empty table stays empty.
    """
    names = rows.columns
    rows = rows.withColumns({"__source": F.col(source_col), "__size": F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")})
    plan = targets(rows.groupBy("__source").agg(F.sum("__size").alias("source_size")), share, cap, weights)
    k = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("__k", F.when(F.abs(k - F.round(k)) < 1e-9, F.round(k)).otherwise(k))
    plan = plan.withColumn("__whole", F.floor("__k").cast("bigint")).withColumn("__frac", F.col("__k") - F.col("__whole")).withColumn("__want", F.col("target") - F.col("__whole") * F.col("source_size")).drop("__weight", "__k")
    rows = join_dim(rows, plan, ["__source"])
    u = unit_hash(F.lit(seed), *[F.col(c) for c in keys])
    odds = (u / (1 - u)) / (F.col("__frac") / (1 - F.col("__frac")))
    rows = rows.withColumn("__at", F.when(F.col("__frac") > 0, odds))
    # odds / (1 + odds) lies in (0, 1) and keeps the order
    rows = rows.withColumn("__bin", F.when(F.col("__at").isNotNull(), F.least(F.lit(bins - 1), F.floor(F.col("__at") / (1 + F.col("__at")) * bins)).cast("int")))
    sums = rows.filter("__bin is not null").groupBy("__source", "__bin").agg(F.sum("__size").alias("__words"), F.first("__want").alias("__want"))
    upto = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__upto", F.sum("__words").over(upto))
    # the first bin that reaches what is wanted, and the words before it
    border = sums.filter(F.col("__upto") >= F.col("__want")).groupBy("__source").agg(F.min(F.struct("__bin", (F.col("__upto") - F.col("__words")).alias("__before"))).alias("__b"))
    border = border.select("__source", F.col("__b.__bin").alias("__border"), F.col("__b.__before").alias("__before"))
    rows = join_dim(rows, border, ["__source"])
    inside = F.col("__bin") == F.col("__border")
    # rows that are not in a border bin need no order; they are spread by their own hash
    part = F.when(inside, F.lit(-1).cast("bigint")).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(1 << 20)))
    order = Window.partitionBy("__source", "__part").orderBy("__at", *[F.col(c) for c in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__part", part)
    rows = rows.withColumn("__run", F.col("__before") + F.sum("__size").over(order))
    near = F.abs(F.col("__run") - F.col("__want")) <= F.abs(F.col("__run") - F.col("__size") - F.col("__want"))
    taken = (
        F.when(F.col("__bin").isNull(), False)
        .when(F.col("__border").isNull(), True)
        .when(F.col("__bin") < F.col("__border"), True)
        .when(inside, (F.col("__run") <= F.col("__want")) | ((F.col("__run") - F.col("__size") < F.col("__want")) & near))
        .otherwise(False)
    )
    return rows.withColumn("copies", F.col("__whole") + taken.cast("bigint")).select(*[c for c in names if c not in ("source_size", "target", "copies")], "source_size", "target", "copies")


@shielded
def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, each row as often as the mix takes it. Sizes and keys are mixed; texts move once, in the join with the copies.

    Rows that agree in id, text and source are numbered, so that each gets copies of its own; they come out as one row repeated by the sum.
    """
    key = F.concat_ws("/", row_key(id_col, text_col), F.hex(F.xxhash64(source_col)))
    slim = docs.select(key.alias("__key"), F.col(source_col).alias("__src"), word_count(text_or_empty(text_col)).alias("__words"))
    slim = cut(slim.groupBy("__key", "__src", "__words").agg(F.count("*").alias("__n")).withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))), "sizes")
    plan = mix(slim, "__src", "__words", ["__key", "__nth"], **options)
    plan = plan.groupBy("__key").agg(F.sum("copies").alias("__copies")).filter("__copies > 0").withColumnRenamed("__key", "__taken")
    # the join leaves rows of one key in one partition, where the first of them stays
    out = docs.withColumn("__key", key).join(plan, F.col("__key") == F.col("__taken")).dropDuplicates(["__key"])
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*docs.columns)


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Text null: size 0. Sizes, targets and taken count words. Texts are read once; the rest works on their sizes."""
    text = text_or_empty("text")
    rows = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("__digest")), "sizes")
    out = mix(rows, "source", "size", ["doc_id", "source", "size", "__digest"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))
