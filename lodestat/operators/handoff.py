"""Hand-offs between stages: closed tables with provenance, and the guards of what a later stage may use them for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators import expect
from lodestat.operators.core import rounded

#: Columns of each hand-off.
COLUMNS = {
    "quality": ["domain", "q", "low", "high", "n", "coverage", "trust", "sha256"],
    "mixture": ["target", "term", "value", "scope", "trust", "sha256"],
    "law": ["parameter", "value", "low", "high", "scope", "trust", "sha256"],
    "forecast": ["primary_stratum", "horizon", "central", "low", "high", "prediction_error", "anchors", "trust", "sha256"],
}


def build(kind: str, df: DataFrame, trust: str, sha256: str) -> DataFrame:
    """df as a hand-off: its columns just those of the kind, with trust and the digest of what it was made from."""
    out = df.withColumns({"trust": F.lit(trust), "sha256": F.lit(sha256)})
    expect.require_columns(out, COLUMNS[kind])
    expect.require(out, [expect.Expectation("trust", F.col("trust").isin(*expect.TRUST)), expect.Expectation("digest", F.col("sha256").rlike("^[0-9a-f]{64}$"))])
    return out.select(*COLUMNS[kind])


def require_scope(handoff: DataFrame, scope: str) -> DataFrame:
    """handoff, or an error if any row was made for another scope than what it is wanted for."""
    return expect.require(handoff, [expect.Expectation(f"scope {scope}", F.col("scope") == scope)])


def require_scale(handoff: DataFrame, size: float, fitted: float, ratio: float = 1.0) -> DataFrame:
    """handoff, or an error if it is wanted at a scale farther than `ratio` from the one it was fitted at."""
    if not fitted / ratio <= size <= fitted * ratio:
        raise expect.ContractError(f"fitted at {fitted:g}, wanted at {size:g}")
    return handoff


def require_not_imputed(handoff: DataFrame, least: float) -> DataFrame:
    """Quality over part of the domains, not filled up: coverage as measured, at least so much."""
    return expect.require(handoff, [expect.Expectation("coverage", F.col("coverage").between(least, 1)), expect.Expectation("interval", F.col("low").isNotNull() & F.col("high").isNotNull())])


def allocation_records(solved: DataFrame) -> DataFrame:
    """Solved budgets as nested records, one a budget and context, for a JSON sink."""
    point = F.struct(rounded(F.log10("n")).alias("log10_n"), rounded(F.log10("d")).alias("log10_d"), rounded("loss").alias("loss"))
    return solved.select(F.struct("budget", "context").alias("at"), F.when(F.col("n").isNotNull(), point).alias("optimum"), "saturated", "regime")


def panel_reports(panel: DataFrame, key: str, strata: str, date: str) -> dict[str, DataFrame]:
    """Reports of a panel: its schema with coverage by column, strata, and dates by month. One aggregation each."""
    one = panel.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(panel.columns)])
    kinds = dict(panel.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"c{i}").alias("present"), rounded(F.try_divide(F.col(f"c{i}"), F.col("n"))).alias("share")) for i, c in enumerate(panel.columns)])
    return {
        "schema": one.select(F.explode(rows).alias("r")).select("r.*"),
        "strata": panel.groupBy(strata).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")),
        "dates": panel.groupBy(F.trunc(F.col(date).cast("date"), "month").alias("month")).agg(F.count("*").alias("n")),
    }
