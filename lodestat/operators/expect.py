"""Expectations and contracts: what must hold for a table is counted in one pass, and hand-offs are refused if it does not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust classes of a hand-off.
TRUST = ("observed", "subset", "interpolated", "semi_synthetic", "estimated", "mixed", "reference")


@dataclass(frozen=True)
class Expectation:
    name: str
    holds: Column


class ContractError(ValueError):
    """A table does not meet its contract."""


def report(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """(expectation, n, failed) in one aggregation; null does not hold."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(e.holds, F.lit(False))).alias(f"e{i}") for i, e in enumerate(expectations)])
    rows = F.array(*[F.struct(F.lit(e.name).alias("expectation"), F.col("n").alias("n"), F.col(f"e{i}").alias("failed")) for i, e in enumerate(expectations)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def require(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """df, or a ContractError that names what fails."""
    failed = [(r.expectation, r.failed) for r in report(df, expectations).filter("failed > 0").collect()]
    if failed:
        raise ContractError("; ".join(f"{name}: {n} rows" for name, n in failed))
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """A closed schema: no column missing, none extra."""
    if set(df.columns) != set(names):
        raise ContractError(f"missing {sorted(set(names) - set(df.columns))}, extra {sorted(set(df.columns) - set(names))}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    n = df.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if n:
        raise ContractError(f"{', '.join(keys)} repeat")
    return df


def quality_contract() -> list[Expectation]:
    """domain, q, low, high, n, coverage: scores and coverage in [0, 1], an interval that holds its score."""
    return [Expectation("q in [0, 1]", F.col("q").between(0, 1)), Expectation("interval", (F.col("low") <= F.col("q")) & (F.col("q") <= F.col("high"))), Expectation("n", F.col("n") > 0), Expectation("coverage", F.col("coverage").between(0, 1)), Expectation("domain", F.col("domain") != "")]


def mixture_contract(reference: str) -> list[Expectation]:
    """target, term, value: only the reference domain may lack a coefficient, values are finite."""
    return [Expectation("value", F.col("value").isNotNull() & ~F.isnan("value")), Expectation("reference", F.col("term") != reference)]


def law_contract(box: dict[str, tuple[float, float]]) -> list[Expectation]:
    """Rows of (n, d, q) inside the box that the law was fitted on, with a relative slack of 1e-9; bootstrap_unit is model."""
    slack = lambda c, lo, hi: F.col(c).between(lo * (1 - 1e-9), hi * (1 + 1e-9))
    return [*[Expectation(f"{c} in the box", slack(c, *b)) for c, b in box.items()], Expectation("bootstrap unit", F.col("bootstrap_unit") == "model")]


def forecast_contract() -> list[Expectation]:
    return [Expectation("stratum", F.col("primary_stratum").isin("A", "B", "C", "D", "E")), Expectation("prediction error", F.col("prediction_error") > 0), Expectation("anchors", F.col("anchors") > 0)]


def provenance_contract() -> list[Expectation]:
    return [Expectation("source", F.col("source") != ""), Expectation("trust", F.col("trust").isin(*TRUST)), Expectation("digest", F.col("sha256").rlike("^[0-9a-f]{64}$"))]


def provenance_graph(items: DataFrame) -> DataFrame:
    """(id, problem) of a provenance ledger (id, kind, parents): ids that repeat, parents that are not there."""
    twice = items.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    parents = items.select("id", F.explode("parents").alias("parent"))
    lost = parents.join(items.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("unknown parent").alias("problem"))
    return twice.unionByName(lost)
