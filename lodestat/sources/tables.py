"""Tables with a class of trust: training logs, convergence points, graded experiments, domain maps. Each says how far its losses are to be believed; checks run where the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators.expect import TRUST, ContractError

#: Kinds of a domain map, and those that map to nothing.
KINDS, UNMAPPED = ("direct", "near_direct", "inferred", "unmapped", "none"), ("unmapped", "none")


def trusted(df: DataFrame, trust: str) -> DataFrame:
    """df with the class of trust of its losses as a column."""
    if trust not in TRUST:
        raise ValueError(f"unknown class of trust {trust!r}")
    return df.withColumn("trust", F.lit(trust))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")


def training_log(spark: SparkSession, path: str, size: str = "N_params_B") -> DataFrame:
    """Checkpoints of trained models, with model_id from the size: the unit that resampling draws. A log with one row a model is refused, as its clusters would be rows."""
    df = trusted(_csv(spark, path), "observed").withColumn("model_id", F.round(size, 6).cast("string"))
    n = df.agg(F.count("*").alias("rows"), F.count_distinct("model_id").alias("models")).first()
    if n.models >= n.rows:
        raise ContractError("each row is a model of its own, so that models cannot be resampled as clusters")
    return df


def calibrated_log(spark: SparkSession, path: str) -> DataFrame:
    """A log that a law and noise made: semi-synthetic."""
    return trusted(_csv(spark, path), "semi_synthetic")


def cross_family(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("Pythia",)) -> DataFrame:
    """Convergence points of several families, without those that the fit has seen; all families only if asked for by an empty exclusion."""
    df = trusted(_csv(spark, path), "observed")
    return df.filter(~F.col("family").isin(list(exclude)) | F.col("family").isNull()) if exclude else df


def published(spark: SparkSession, path: str) -> DataFrame:
    """Convergence points from publications, independent of the fit."""
    return trusted(_csv(spark, path), "observed")


def graded(spark: SparkSession, path: str) -> DataFrame:
    """Losses with a quality grade; a table that says how each row came about (data_type) is mixed and to be used by stratum."""
    df = _csv(spark, path)
    return trusted(df, "mixed" if "data_type" in df.columns else "semi_synthetic")


def estimates(spark: SparkSession, path: str) -> DataFrame:
    """Losses that a fitted law gave: they bound disagreement and validate nothing."""
    return trusted(_csv(spark, path), "estimated")


def domain_map(spark: SparkSession, path: str, expected: list[str], columns: tuple[str, str, str] = ("mixture_domain", "quality_domain", "mapping_type")) -> DataFrame:
    """(domain, target, kind): to which quality domain each mixture domain maps; (none) and blanks are null. Domains must be just the expected ones, each once."""
    source, to, kind = columns
    goal = F.trim(F.coalesce(F.col(to), F.lit("")))
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    df = raw.select(F.col(source).alias("domain"), F.when(~goal.isin("", "(none)"), goal).alias("target"), F.trim(kind).alias("kind"))
    seen = df.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~F.col("kind").isin(*KINDS)).alias("odd"), F.count_if(F.col("kind").isin(*UNMAPPED) & F.col("target").isNotNull()).alias("clash")).limit(len(expected) + 1).collect()
    if {r.domain for r in seen} != set(expected) or any(r.n > 1 or r.odd or r.clash for r in seen):
        raise ContractError("the map's domains, their number or their kinds are not those expected")
    return df


def mapped_quality(shares: DataFrame, mapping: DataFrame, quality: DataFrame, key: str = "index") -> DataFrame:
    """(key, mass, quality) from long shares (key, domain, share), a domain map and quality (target, q): mapped mass, and the mean quality over it; null where nothing maps.

    A mapped domain without a quality in [0, 1] is an error. Maps are as small as the list of domains.
    """
    joined = mapping.join(F.broadcast(quality), "target", "left")
    fine = F.col("target").isNull() | F.col("q").between(0, 1)
    joined = joined.withColumn("q", F.when(fine, F.col("q")).otherwise(F.raise_error(F.concat(F.lit("no quality for "), F.col("target"))).cast("double")))
    x = shares.join(F.broadcast(joined.select("domain", "target", "q")), "domain")
    mass = F.sum(F.when(F.col("target").isNotNull(), F.col("share")).otherwise(0.0))
    return x.groupBy(key).agg(mass.alias("mass"), F.try_divide(F.sum(F.when(F.col("target").isNotNull(), F.col("share") * F.col("q"))), mass).alias("quality"))


def bridge_tables(spark: SparkSession, losses: str, anchors: str) -> tuple[DataFrame, DataFrame]:
    """Losses by source, and the anchors that a bridge is fitted on."""
    return _csv(spark, losses), _csv(spark, anchors)
