"""Keys of names: compatibility decomposition, marks off, lower case, runs of other characters as one underscore."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import BROADCAST_ROWS, stored


def _bare(name: str) -> str:
    """Decomposed, without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()


def bare(name: Column) -> Column:
    return F.pandas_udf(lambda names: names.map(_bare, na_action="ignore"), "string")(name)


def underscored(x: Column) -> Column:
    """Runs of anything but a-z and 0-9 as one underscore, none at the ends; empty becomes null."""
    key = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key != "", key)


def with_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with a key column (values of names) for each name column (its keys). Plain ASCII names stay in the JVM; of the others each different one is decomposed once, in Arrow batches, and joined back."""
    plain = r"^[\x00-\x7F]*$"
    every = df.select(F.explode(F.filter(F.array(*names), lambda x: ~x.rlike(plain))).alias("__name")).distinct()
    odd = stored(every.select("__name", bare(F.col("__name")).alias("__bare")))
    n = odd.limit(BROADCAST_ROWS + 1).count()
    for column, out in names.items():
        if n:
            df = df.join(F.broadcast(odd) if n <= BROADCAST_ROWS else odd, F.col(column) == F.col("__name"), "left")
        df = df.withColumn(out, underscored(F.coalesce("__bare", F.lower(column)) if n else F.lower(column)))
        df = df.drop("__name", "__bare")
    return df
