"""What the corpus operators share: reading, keys, shared storage, size-checked joins."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows of at most some hundred bytes each.
BROADCAST_ROWS = 50_000
#: Matches of a text that are placed one after the other; blocks of them are placed by their sums.
BLOCK = 256
SPAN = "struct<start: bigint, end: bigint, value: string, left: string, right: string>"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row by its id and text. Rows that agree in it are interchangeable for these operators."""
    text = text_or_empty(text_col)
    return F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.hex(F.xxhash64(text)), F.octet_length(text).cast("string"))


def free(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as no column of df has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on docs whose columns of its own begin with two underscores: columns of docs that do are renamed before and named back after, so that none is lost. What the operator itself returns under such a name replaces the column."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        hidden: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                hidden[c] = free(docs, f"kept{len(hidden)}")
        if not hidden:
            return operator(docs, *args, **options)
        named = lambda x: hidden.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(hidden), *map(named, args), **{k: named(v) for k, v in options.items()})
        made = set(out.columns)
        return out.drop(*[v for k, v in hidden.items() if k in made]).withColumnsRenamed({v: k for k, v in hidden.items() if k not in made and v in made})

    return run


@shielded
def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose row_key is not in keys (column __key). Few keys, as counted, are broadcast; else both sides are shuffled."""
    gone = keys.select(F.col("__key").alias("__gone")).distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, row_key(id_col, text_col) == F.col("__gone"), "left_anti")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset (tests, one machine) a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/lodestat-shared"
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df into the shared folder and reads it again: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_dim(big: DataFrame, dim: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a grouped (small) side: broadcast if its counted rows are within limit, else an adaptive shuffle join, which splits skewed keys. Keys compare null-safe."""
    dim = dim.select(*[F.col(c).alias(f"__dim_{c}") if c in on else F.col(c) for c in dim.columns])
    small = dim.limit(limit + 1).count() <= limit
    cond = None
    for c in on:
        one = big[c].eqNullSafe(F.col(f"__dim_{c}"))
        cond = one if cond is None else cond & one
    out = big.join(F.broadcast(dim) if small else dim.hint("merge"), cond, how)
    return out.drop(*[f"__dim_{c}" for c in on])


def join_hot(big: DataFrame, few: DataFrame, big_key: str, few_key: str, weight: str, total: int, how: str = "inner", short: Column | None = None) -> DataFrame:
    """big joined with few, which has one row a key and knows in `weight` how many of big's `total` rows have it.

    Keys with so many rows that there can be at most BROADCAST_ROWS of them (and rows that are `short`, where keys can be long) are broadcast, so that no task reads all rows of a
    hot key; the others are joined by a shuffle, where a key has few.
    """
    hot = F.col(weight) >= max(2, -(-total // BROADCAST_ROWS))
    hot = hot & short if short is not None else hot
    first = F.broadcast(few.filter(hot))
    rest = big.join(F.broadcast(few.filter(hot).select(few_key)), F.col(big_key) == F.col(few_key), "left_anti")
    return big.join(first, F.col(big_key) == F.col(few_key)).unionByName(rest.join(few.filter(~hot).hint("merge"), F.col(big_key) == F.col(few_key), how))


def unit_hash(*cols: Column) -> Column:
    """A double in (0, 1) that depends on the values only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start, end, value, left, right>> of all matches, in code points or another measure that adds up; left and right: what stands between it and the matches beside it.

    Places are sums within blocks and sums of blocks, so the work grows with the matches, not with their square.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def within(block: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start = (acc["at"] + measure(p["b"])).cast("bigint")
            end = (start + measure(p["f"])).cast("bigint")
            one = F.struct(start.alias("start"), end.alias("end"), p["f"].alias("value"), p["b"].alias("left"), p["a"].alias("right"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(block, begin, step)

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).cast("bigint").alias("start"), (s["end"] + by).cast("bigint").alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    def joined(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        step = lambda acc, b: F.struct((acc["at"] + b["at"]).cast("bigint").alias("at"), F.array_append(acc["out"], F.transform(b["out"], lambda s: moved(s, acc["at"]))).alias("out"))
        return F.flatten(F.aggregate(blocks, begin, step, lambda acc: acc["out"]))

    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = let(F.struct(between.alias("b"), found.alias("f")), lambda x: F.arrays_zip(F.slice(x["b"], 1, F.size(x["f"])).alias("b"), x["f"].alias("f"), F.slice(x["b"], 2, F.size(x["f"])).alias("a")))
    return let(pairs, lambda p: joined(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(BLOCK)), lambda i: within(F.slice(p, i, BLOCK)))))
