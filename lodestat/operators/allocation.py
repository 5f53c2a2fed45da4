"""Compute allocation under kappa n d <= c in a box, as columns: exact candidates, regimes, thresholds, elasticities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import columns as C

#: Published parameters (six digits) and box, cost of context, budgets and contexts of the published grid.
LAW = {"E": 1.68982, "A": 406.268, "alpha": 0.339983, "B": 409.744, "beta": 0.279888}
BOX = {"n_min": 7.054e7, "n_max": 1.1965825e10, "d_min": 1.34e8, "d_max": 2.99893e11}
ETA = 2e-4
BUDGETS, CONTEXTS = [1e19, 1e22, 1e24], [2048, 4096, 8192, 32768, 131072]


def kappa(context: Column) -> Column:
    return 6.0 + ETA * context


def grid(spark: SparkSession, budgets: list[float] = BUDGETS, contexts: list[int] = CONTEXTS) -> DataFrame:
    return spark.createDataFrame([(float(c), int(k)) for c in budgets for k in contexts], "budget double, context long")


def solve(df: DataFrame, budget: str = "budget", kappa_col: Column | None = None, p: dict[str, float] = LAW, box: dict[str, float] = BOX) -> DataFrame:
    """df with n, d, loss, saturated, regime. The optimum is one of: both ends of the feasible range, the kink at d_max, the stationary point. Null where the budget does not reach the box's least corner."""
    k = kappa(F.col("context")) if kappa_col is None else kappa_col
    c = F.col(budget)
    low, high = F.lit(box["n_min"]), F.least(F.lit(box["n_max"]), c / (k * box["d_min"]))
    kink, stationary = c / (k * box["d_max"]), C.compute_optimal(c, k, p)
    d_of = lambda n: F.least(F.lit(box["d_max"]), c / (k * n))
    inside = lambda n: F.when((n >= low) & (n <= high), n)
    cand = F.array_compact(F.array(low, high, inside(kink), F.when(c / (k * stationary) <= box["d_max"], inside(stationary))))
    best = F.array_min(F.transform(cand, lambda n: F.struct(C.law(n, d_of(n), p).alias("loss"), n.alias("n"))))
    feasible = c >= k * box["n_min"] * box["d_min"]
    df = df.withColumn("__best", F.when(feasible, best))
    n = F.col("__best.n")
    df = df.withColumns({"n": n, "d": d_of(n), "loss": F.col("__best.loss")}).drop("__best")
    saturated = C.close(k * F.col("n") * F.col("d"), c)
    at = lambda col, name: F.when(C.close(F.col(col), F.lit(box[name]), 1e-9), name.upper()[0] + name[1:])
    bounds = F.array_join(F.array_compact(F.array(at("n", "n_min"), at("n", "n_max"), at("d", "d_min"), at("d", "d_max"))), "+")
    regime = F.concat(F.when(saturated, "SATURATED:").otherwise("SLACK:"), F.when(bounds == "", "interior").otherwise(bounds))
    return df.withColumns({"saturated": saturated, "regime": F.when(F.col("n").isNotNull(), regime)})


def elasticities(regime: Column, p: dict[str, float] = LAW) -> tuple[Column, Column]:
    """Elasticities of n and d by the budget, of each regime."""
    a, b = p["alpha"], p["beta"]
    slack, nb, db = regime.startswith("SLACK"), regime.contains("N_"), regime.contains("D_")
    n = F.when(slack | (nb & db), 0.0).when(nb, 0.0).when(db, 1.0).otherwise(b / (a + b))
    d = F.when(slack | (nb & db), 0.0).when(nb, 1.0).when(db, 0.0).otherwise(a / (a + b))
    return n, d


def thresholds(contexts: DataFrame, p: dict[str, float] = LAW, box: dict[str, float] = BOX) -> DataFrame:
    """(context, kind, budget): budgets at which the stationary point meets each side of the box."""
    k = kappa(F.col("context"))
    at_n = lambda n: k * n * (p["beta"] * p["B"] * n ** p["alpha"] / (p["alpha"] * p["A"])) ** (1 / p["beta"])
    at_d = lambda d: k * d * (p["alpha"] * p["A"] * d ** p["beta"] / (p["beta"] * p["B"])) ** (1 / p["alpha"])
    rows = F.array(*[F.struct(F.lit(s).alias("kind"), (at_n if s[0] == "n" else at_d)(box[s]).alias("budget")) for s in box])
    return contexts.select("context", F.explode(rows).alias("t")).select("context", "t.*")


def cost_family(kind: Column, q: Column, gamma: Column, lam: Column) -> Column:
    """Cost of quality q: exponential, power or logarithmic."""
    return F.when(kind == "exponential", gamma * F.exp(lam * q)).when(kind == "power", gamma * F.pow(q, lam)).otherwise(gamma * F.log1p(lam * q))


def bisect(low: Column, high: Column, f, steps: int = 200) -> Column:
    """Root of f between low and high, whose signs differ, by halving inside one expression; null if they do not differ."""
    begin = F.struct(low.alias("a"), high.alias("b"))

    def step(acc: Column, _: Column) -> Column:
        m = (acc["a"] + acc["b"]) / 2
        left = F.signum(f(acc["a"])) * F.signum(f(m)) <= 0
        return F.struct(F.when(left, acc["a"]).otherwise(m).alias("a"), F.when(left, m).otherwise(acc["b"]).alias("b"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step, lambda acc: (acc["a"] + acc["b"]) / 2)
    return F.when(F.signum(f(low)) * F.signum(f(high)) <= 0, root)
