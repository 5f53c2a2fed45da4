"""Sinks: checked JSON, CSV, Parquet, Markdown tables of small results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_nan(df: DataFrame) -> DataFrame:
    """df, or an error at the first NaN or infinity."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys and finite numbers."""
    no_nan(df).select(*sorted(df.columns)).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def cell(value: object) -> str:
    if value is None:
        return "undefined"
    if isinstance(value, float):
        return "undefined" if math.isnan(value) else f"{value:.9g}"
    return str(value).replace("|", "/").replace("\n", " ")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A pipe table of a small result; more rows than `limit` are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; group them first")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
