"""Entity linkage by a ladder of keys, audits of what stays ambiguous, and comparison of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.core import small


def unique_keys(df: DataFrame, key: str, carry: str, as_key: str, as_value: str) -> DataFrame:
    """(as_key, as_value) of keys that stand on one row of df only; null keys never link."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(as_key)).agg(F.count("*").alias("__n"), F.first(carry).alias(as_value)).filter("__n = 1").drop("__n")


def ladder(left: DataFrame, right: DataFrame, tiers: list[tuple[str, str, str, bool]], carry: str, out: str = "linked") -> DataFrame:
    """left with `out` (carry of the linked row, or null) and link_method (name of the first tier that links, or unlinked).

    tiers: (name, key of left, key of right, whether the key must be unique on the left too). Every row of left stays once, as right sides hold unique keys.
    """
    found, methods = [], []
    for i, (name, lk, rk, both) in enumerate(tiers):
        keys = unique_keys(right, rk, carry, f"__k{i}", f"__v{i}")
        if both:
            once = left.filter(F.col(lk).isNotNull()).groupBy(F.col(lk).alias(f"__l{i}")).count().filter("count = 1").drop("count")
            keys = keys.join(small(once), F.col(f"__k{i}") == F.col(f"__l{i}"), "left_semi")
        left = left.join(small(keys), F.col(lk) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
        methods.append(F.when(F.col(f"__v{i}").isNotNull(), name))
    return left.withColumns({out: F.coalesce(*found), "link_method": F.coalesce(*methods, F.lit("unlinked"))}).drop(*[f"__v{i}" for i in range(len(tiers))])


def audit(linked: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(outcome, n): linked rows by method, the others as ambiguous on the right, ambiguous on the left, or unmatched."""
    r = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__rk")).agg(F.count("*").alias("__rn"))
    counts = linked.filter(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("__lk")).agg(F.count("*").alias("__ln"))
    x = linked.join(small(r), F.col(left_key) == F.col("__rk"), "left").join(small(counts), F.col(left_key) == F.col("__lk"), "left")
    kind = F.when(F.col("link_method") != "unlinked", F.col("link_method")).when(F.col("__rn") > 1, "ambiguous_right").when((F.col("__rn") == 1) & (F.col("__ln") > 1), "ambiguous_left").otherwise("unmatched")
    return x.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def presence(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Full outer join of two tables with one row a key: where a key stands, and whether all compared columns agree, nulls as equals."""
    a = left.select(*keys, F.struct(*compare).alias("__a"))
    b = right.select(*keys, F.struct(*compare).alias("__b"))
    both = a.join(b, keys, "full")
    where = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")
    return both.select(*keys, where.alias("side"), F.when(where == "both", F.col("__a").eqNullSafe(F.col("__b"))).alias("equal"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fingerprint(df: DataFrame) -> Column:
    """Aggregate that is the same for the same rows in any order."""
    return F.concat_ws("/", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*df.columns))), F.sum(F.pmod(F.xxhash64(F.lit(7), *df.columns), F.lit(1_000_000_007))))


def variants(df: DataFrame, rules: dict[str, Column], switches: dict[str, list[str]]) -> DataFrame:
    """df with `variant`, a row for each variant that admits it: variants name the rules that hold in them. One pass; a rule that is null fails."""
    admits = []
    for name, on in switches.items():
        ok = F.lit(True)
        for r in on:
            ok = ok & F.coalesce(rules[r], F.lit(False))
        admits.append(F.when(ok, F.lit(name)))
    return df.withColumn("variant", F.explode(F.array_compact(F.array(*admits))))


def bridge_forms(df: DataFrame, x: str, y: str) -> DataFrame:
    """(form, loo_rmse, within_one_se, selected) of y (0 to 100) from x: constant, linear and logit, each row predicted from the others by leverages. Selected is the simplest within one standard error of the best."""
    odds = F.log(F.col(y) / (100 - F.col(y)))
    s = df.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"), F.sum(y).alias("sy"), F.regr_slope(odds, F.col(x)).alias("lb"), F.regr_intercept(odds, F.col(x)).alias("la"))
    j = df.join(F.broadcast(s))  # one row
    rest = 1 - 1 / F.col("n") - (F.col(x) - F.col("mx")) * (F.col(x) - F.col("mx")) / F.col("sxx")
    logit = odds - (odds - F.col("la") - F.col("lb") * F.col(x)) / rest
    errors = {"constant": F.col(y) - (F.col("sy") - F.col(y)) / (F.col("n") - 1), "linear": (F.col(y) - F.col("a") - F.col("b") * F.col(x)) / rest, "logit": F.col(y) - 100 / (1 + F.exp(-logit))}
    j = j.select(*[e.alias(k) for k, e in errors.items()])
    one = j.agg(*[f.alias(f"{p}_{k}") for k in errors for p, f in (("m", F.avg(F.col(k) * F.col(k))), ("s", F.stddev_samp(F.col(k) * F.col(k)) / F.sqrt(F.count(k))))])
    best = F.array_min(F.array(*[F.struct(F.col(f"m_{k}").alias("m"), F.col(f"s_{k}").alias("s")) for k in errors]))
    one = one.withColumn("bar", best["m"] + best["s"])
    chosen = F.coalesce(*[F.when(F.col(f"m_{k}") <= F.col("bar"), F.lit(k)) for k in errors])
    rows = F.array(*[F.struct(F.lit(k).alias("form"), F.sqrt(f"m_{k}").alias("loo_rmse"), (F.col(f"m_{k}") <= F.col("bar")).alias("within_one_se"), (chosen == k).alias("selected")) for k in errors])
    return one.select(F.explode(rows).alias("r")).select("r.*")
