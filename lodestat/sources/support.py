"""Support of a field as a table of its files shows it, tied to what a manifest says of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators.core import stored


def support_grid(df: DataFrame, field: str, name: str) -> DataFrame:
    """(value, n, first_name, last_name) of the different values of a field; every value must be a positive whole number and have a name, else an error."""
    fine = (F.col(field) > 0) & (F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    value = F.when(fine, F.col(field)).otherwise(F.raise_error(F.concat(F.lit(f"{field} needs a positive value and a name: "), F.coalesce(F.col(name), F.lit("null")))).cast(df.schema[field].dataType))
    return df.select(value.alias("value"), F.trim(name).alias("__name")).groupBy("value").agg(F.count("*").alias("n"), F.min("__name").alias("first_name"), F.max("__name").alias("last_name"))


def reconciled(spark: SparkSession, path: str, schema: str, listed: DataFrame) -> DataFrame:
    """(name, bytes, rows, broken, status) of CSV files under path against listed (name, bytes, rows): ok, or the first that holds of missing, unlisted, bytes, broken (rows that do not fit the schema), rows.

    Sizes and rows come from one reading: a file's size is known to each of its rows. Files with a header only are found by their listing; one without bytes is missing.
    """
    full = T._parse_datatype_string(schema).add("__broken", T.StringType())
    rows = spark.read.csv(path, schema=full, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__broken", recursiveFileLookup=True)
    # parsed whole and kept before it is counted: the parser would look only at columns that are asked for
    parsed = stored(rows.select(F.col("_metadata.file_name").alias("name"), "__broken", F.struct(*full.fieldNames()[:-1]).alias("row")))
    each = parsed.groupBy("name").agg(F.count("*").alias("rows"), F.count("__broken").alias("broken"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))  # contents are not read
    there = files.join(each, "name", "left").select("name", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("broken", F.lit(0)).alias("broken"))
    j = there.join(listed.select("name", F.col("bytes").alias("__bytes"), F.col("rows").alias("__rows")), "name", "full")
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("__bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("__bytes"), "bytes").when(F.col("broken") > 0, "broken").when(F.col("rows") != F.col("__rows"), "rows").otherwise("ok")
    return j.select("name", "bytes", "rows", "broken", status.alias("status"))
