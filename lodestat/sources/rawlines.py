"""Records read with their raw text beside the parsed values, so that what parsing makes equal stays apart: NaN tokens, strings that say NaN, missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import issues

#: Keys with their colon, or strings that are values.
_STRINGS = r'("(?:[^"\\]|\\.)*+"\s*:)|"(?:[^"\\]|\\.)*+"'


def without_strings(raw: Column) -> Column:
    """Raw JSON with keys as they are and strings among values taken out."""
    return F.regexp_replace(raw, _STRINGS, "$1")


def raw_field(raw: Column, field: str) -> Column:
    """The text of a field's value, a list or a single value, without the strings in it; null where the field is not there."""
    bare = without_strings(raw)
    found = F.regexp_extract(bare, rf'"{field}"\s*:\s*(\[[^\]]*+\]|[^,}}\]]*+)', 1)
    return F.when(bare.rlike(rf'"{field}"\s*:'), F.trim(found))


def tokens(raw: Column, token: str = "NaN") -> Column:
    """How often a bare token stands in raw text, outside strings."""
    return F.regexp_count(without_strings(raw), F.lit(rf'(?<![\w"-])-?{token}(?![\w"])'))


def confirmed(lines: DataFrame, schema: T.StructType, lists: dict[str, int], allowed: list[str], value: str = "value") -> DataFrame:
    """lines with the parsed columns and `nan_tokens` (of the whole line), `nan_fields` (tokens by list field), `missing` (fields that are whole NaN vectors), `status`.

    complete: every list is whole and finite. confirmed: what is not finite are whole vectors of NaN in allowed fields, and the line has as many NaN tokens as these vectors have parts. Else a
    reason: unparsed, infinity (a bare Infinity), defect (null, short or infinite lists), partial (NaN in part of a list), not_allowed (a whole vector elsewhere), unreconciled (NaN tokens elsewhere).
    """
    full = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    j = F.from_json(value, full, {"allowNonNumericNumbers": "true", "columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"})
    others = [c for c in lines.columns if c not in {f.name for f in schema.fields}]
    rows = lines.withColumn("__j", j).select(*others, "__j.*")
    rows = rows.withColumn("nan_tokens", tokens(F.col(value))).withColumn("nan_fields", F.create_map(*[x for c in lists for x in (F.lit(c), F.coalesce(tokens(raw_field(F.col(value), c)), F.lit(0)))]))
    found = F.flatten(F.array(*[issues(c, F.col(c), n) for c, n in lists.items()]))
    size = F.create_map(*[F.lit(x) for c, n in lists.items() for x in (c, n)])
    rows = rows.withColumn("__issues", found).withColumn("missing", F.transform(F.filter("__issues", lambda s: (s["kind"] == "nan") & (F.size(s["parts"]) == size[s["field"]])), lambda s: s["field"]))
    parts = F.aggregate("__issues", F.lit(0), lambda acc, s: acc + F.when(s["kind"] == "nan", F.size(s["parts"])).otherwise(0))
    infinite = tokens(F.col(value), "Infinity") > 0
    status = (
        F.when(F.col("__corrupt").isNotNull(), "unparsed").when(infinite, "infinity").when(F.exists("__issues", lambda s: s["kind"] != "nan"), "defect")
        .when(F.size("missing") < F.size(F.filter("__issues", lambda s: s["kind"] == "nan")), "partial").when(F.size(F.array_except("missing", F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))) > 0, "not_allowed")
        .when(F.col("nan_tokens") != parts, "unreconciled").when(F.size("missing") > 0, "confirmed").otherwise("complete")
    )
    return rows.withColumn("status", status).drop("__issues", "__corrupt")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): identities that more than one row has, nulls as equals."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
