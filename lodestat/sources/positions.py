"""Tables compared row by row in the order of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestat.operators.core import small, stored


def in_file_order(df: DataFrame, name: str = "position") -> DataFrame:
    """df, just read from files, with the place of each row from 0: by file name, then by place in the file.

    Parquet knows the number of a row in its file. Of other formats a block of a file is one task, which numbers its rows as it reads them. Sums over the
    files (or blocks) give first places, so no task sees more than a block; rows of one block of text are sorted together.
    """
    taken = {c.lower() for c in df.columns} & {"__file", "__block", "__at", "__k", "__b", "__start", "__size", name.lower()}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    columns, parquet = df.columns, all(f.rsplit(".", 1)[-1] == "parquet" for f in df.inputFiles())
    at = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    block = F.lit(0).cast("bigint") if parquet else F.col("_metadata.file_block_start")
    rows = df.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_name").alias("__file"), block.alias("__block"), at.alias("__at"))
    rows = rows if parquet else stored(rows)  # numbers of a task hold for one reading
    sizes = rows.groupBy("__file", "__block").agg(F.count("*").alias("__size"))
    order = Window.orderBy("__file", "__block")
    starts = sizes.select(F.col("__file").alias("__k"), F.col("__block").alias("__b"), (F.sum("__size").over(order) - F.col("__size")).alias("__start"))  # one row a file or block
    rows = rows.join(small(starts), (F.col("__file") == F.col("__k")) & (F.col("__block") == F.col("__b")))
    inside = F.col("__at") if parquet else F.row_number().over(Window.partitionBy("__file", "__block").orderBy("__at")) - 1
    return rows.select(*[F.col(f"`{c}`") for c in columns], (F.col("__start") + inside).alias(name))


def _numbers(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def differences(left: DataFrame, right: DataFrame, key: str, columns: list[str], position: str = "position") -> DataFrame:
    """One row a position at which the tables differ, or one of them ends: position, left_key, right_key, `columns` (names of those that differ, nulls as equals), `widest` (largest difference of two numbers)."""
    pick = lambda df, side: df.select(F.col(position).alias(f"__{side}"), F.struct(F.col(key).alias("__key"), *columns).alias(side))
    both = pick(left, "l").join(pick(right, "r"), F.col("__l") == F.col("__r"), "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]))
    gaps = [F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")).cast("double") for c in _numbers(left, columns)]
    widest = F.array_max(F.array_compact(F.array(*gaps))) if gaps else F.lit(None).cast("double")
    same = F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("l.__key").eqNullSafe(F.col("r.__key")) & (F.size(differ) == 0)
    return both.filter(~same).select(F.coalesce("__l", "__r").alias("position"), F.col("l.__key").alias("left_key"), F.col("r.__key").alias("right_key"), differ.alias("columns"), widest.alias("widest"))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str], position: str = "position") -> DataFrame:
    """One row: rows of both, whether keys stand in the same order, the first position whose keys differ, rows whose values differ at equal keys, the largest difference of numbers."""
    d = differences(left, right, key, columns, position)
    keys = ~F.col("left_key").eqNullSafe(F.col("right_key")) | (F.col("left_key").isNull() & F.col("right_key").isNull())
    one = d.agg(F.min(F.when(keys, F.col("position"))).alias("first_disorder"), F.min("position").alias("first_difference"), F.count_if(~keys).alias("differing_rows"), F.max(F.when(~keys, F.col("widest"))).alias("widest"))
    counts = left.agg(F.count("*").alias("left_rows")).join(F.broadcast(right.agg(F.count("*").alias("right_rows"))))  # one row by one row
    return counts.join(F.broadcast(one)).select("left_rows", "right_rows", F.col("first_disorder").isNull().alias("same_order"), "first_disorder", "first_difference", "differing_rows", F.coalesce("widest", F.lit(0.0)).alias("widest"))


def paired(left: DataFrame, right: DataFrame, key: str, position: str = "position") -> DataFrame:
    """left joined with right's other columns at the same position; an error names the first position at which the keys are not the same."""
    r = right.select(F.col(position).alias("__r"), F.col(key).alias("__key"), *[c for c in right.columns if c not in (position, key)])
    both = left.join(r, F.col(position) == F.col("__r"), "full")
    bad = both.filter(~F.col(key).eqNullSafe(F.col("__key")) | F.col(position).isNull() | F.col("__r").isNull()).agg(F.min(F.coalesce(position, "__r"))).first()[0]
    if bad is not None:
        raise ValueError(f"the tables do not pair in order: they differ at position {bad}")
    if left.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    return both.drop("__r", "__key")


