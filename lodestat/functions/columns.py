"""Column builders: list reductions, scores, classifiers, scaling laws, unit algebra. All stay inside generated code or higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# -- list-valued records --------------------------------------------------------------------------


def softmax(v: Column) -> Column:
    """Max-shifted softmax of an array."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def second_of_two(v: Column) -> Column:
    """softmax(v)[1] of two logits."""
    return 1 / (1 + F.exp(v[0] - v[1]))


def expected_level(v: Column) -> Column:
    """Sum of k * softmax(v)[k]."""
    p = softmax(v)
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(v) - 1), lambda a, k: a * k), F.lit(0.0), lambda a, b: a + b)


def argmax(v: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def require_width(v: Column, width: int) -> Column:
    """v, or an error if it has another width."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected width {width}, found "), F.size(v).cast("string"))))


def issues(field: str, v: Column, width: int) -> Column:
    """array<struct<field, kind, parts>> of what is wrong with a list field: absent, wrong width, null, NaN and infinite parts."""
    where = lambda f: F.filter(F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.when(f(v[i]), i)), lambda i: i.isNotNull())
    item = lambda kind, parts: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), parts.cast("array<int>").alias("parts"))
    inf = float("inf")
    some = F.when(v.isNull(), F.array(item("absent_field", F.array()))).when(F.size(v) != width, F.array(item("wrong_width", F.array(F.size(v)))))
    found = F.array(item("null", where(lambda x: x.isNull())), item("nan", where(F.isnan)), item("positive_infinity", where(lambda x: x == inf)), item("negative_infinity", where(lambda x: x == -inf)))
    return some.otherwise(F.filter(found, lambda s: F.size(s["parts"]) > 0))


# -- scores -----------------------------------------------------------------------------------------


def desirable(x: Column, low: float, high: float) -> Column:
    """Zero inside an interval, minus the distance outside it."""
    return -F.greatest(F.lit(float(low)) - x, F.lit(0.0), x - F.lit(float(high)))


def family_mean(families: list[list[Column]]) -> Column:
    """Mean over families of the mean within each."""
    means = [sum(f[1:], f[0]) / len(f) for f in families]
    return sum(means[1:], means[0]) / len(means)


def row_median(values: list[Column]) -> Column:
    s = F.array_sort(F.array(*values))
    n = len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def mean_pair_gap(values: list[Column]) -> Column:
    """Mean absolute difference over all pairs, from order statistics."""
    m = len(values)
    s = F.array_sort(F.array(*values))
    weighed = F.zip_with(s, F.array(*[F.lit(float(2 * i - m + 1)) for i in range(m)]), lambda x, w: x * w)
    return F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b) / (m * (m - 1) / 2)


def rescaled(raw: Column, base: Column) -> Column:
    """Score above a guessing baseline, 0 to 100."""
    return F.greatest(F.lit(0.0), (raw - base) / (1 - base)) * 100


def tri_state(positive: Column, evidence: Column) -> Column:
    """yes, no or unknown: any positive sign, else any evidence, else nothing."""
    return F.when(F.coalesce(positive, F.lit(False)), "yes").when(F.coalesce(evidence, F.lit(False)), "no").otherwise("unknown")


def first_keyword(text: Column, keywords: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first keyword, in the list's order, that the text contains."""
    out = F
    for word, label in keywords:
        out = out.when(text.contains(word), label)
    return out.otherwise(F.lit(default))


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


# -- names --------------------------------------------------------------------------------------------


def split_owner(x: Column) -> tuple[Column, Column]:
    """(owner, name) around the first slash; no slash, no owner."""
    parts = F.split(x, "/", 2)
    return F.when(F.size(parts) == 2, parts[0]), F.element_at(parts, -1)


# -- scaling laws ------------------------------------------------------------------------------------


def law(n: Column, d: Column, p: dict[str, float], q: Column | None = None) -> Column:
    """E + A n^-alpha + B (q^gamma d)^-beta."""
    eff = d if q is None else F.pow(q, F.lit(p["gamma"])) * d
    return F.lit(p["E"]) + F.lit(p["A"]) * F.pow(n, F.lit(-p["alpha"])) + F.lit(p["B"]) * F.pow(eff, F.lit(-p["beta"]))


def log_law(n: Column, d: Column, p: dict[str, float]) -> Column:
    """Logarithm of the law by a shifted sum of exponentials."""
    terms = [F.lit(p["E"]) * 0 + F.log(F.lit(p["E"])), F.log(F.lit(p["A"])) - F.lit(p["alpha"]) * F.log(n), F.log(F.lit(p["B"])) - F.lit(p["beta"]) * F.log(d)]
    m = F.greatest(*terms)
    return m + F.log(sum((F.exp(t - m) for t in terms[1:]), F.exp(terms[0] - m)))


def partials(n: Column, d: Column, q: Column, p: dict[str, float]) -> dict[str, Column]:
    """Derivatives of the law by n, d and q, and dn/dq at constant loss."""
    t = F.lit(p["B"]) * F.pow(q, F.lit(-p["gamma"] * p["beta"])) * F.pow(d, F.lit(-p["beta"]))
    ln = F.lit(-p["alpha"] * p["A"]) * F.pow(n, F.lit(-p["alpha"] - 1))
    ld, lq = -p["beta"] * t / d, -p["gamma"] * p["beta"] * t / q
    return {"dl_dn": ln, "dl_dd": ld, "dl_dq": lq, "dn_dq": -lq / ln}


def parameter_saving(n: Column, drop: Column, p: dict[str, float]) -> Column:
    """Parameters fewer by which a loss reduction could be paid."""
    return F.pow(F.pow(n, F.lit(-p["alpha"])) + drop / F.lit(p["A"]), F.lit(-1 / p["alpha"])) - n


def equivalent_capacity(n: Column, drop: Column, p: dict[str, float]) -> Column:
    """Parameters more that reduce the loss as much; null where no finite number does."""
    left = F.pow(n, F.lit(-p["alpha"])) - drop / F.lit(p["A"])
    return F.when(left > 0, F.pow(left, F.lit(-1 / p["alpha"])) - n)


def compute_optimal(c: Column, kappa: Column, p: dict[str, float]) -> Column:
    """Parameters that minimise the law under kappa n d = c."""
    return F.pow(F.lit(p["alpha"] * p["A"] / (p["beta"] * p["B"])) * F.pow(c / kappa, F.lit(p["beta"])), F.lit(1 / (p["alpha"] + p["beta"])))


def to_raw_units(p: dict[str, float], scale_n: float, scale_d: float) -> dict[str, float]:
    """Parameters of the same law over raw units; exponents and E do not change."""
    return p | {"A": p["A"] * scale_n ** p["alpha"], "B": p["B"] * scale_d ** p["beta"]}


def huber(x: Column, delta: float = 1e-3) -> Column:
    q = F.least(F.abs(x), F.lit(delta))
    return 0.5 * q * q + delta * (F.abs(x) - q)


def hash_draw(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A number in [0, n) that any engine with MD5 reproduces."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("bigint"), n)


#: Cumulative Poisson probabilities with mean 1 at 0, 1, ..., 6; more is counted as 7.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(7)]


def uniform(seed: int, replicate: Column, key: Column) -> Column:
    """A number in [0, 1) that any engine with MD5 reproduces."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson_number(u: Column) -> Column:
    """The Poisson number with mean 1 at u in [0, 1): how often a row stands in a resample."""
    out = F
    for k, p in enumerate(_POISSON):
        out = out.when(u < p, k)
    return out.otherwise(7)


def on_grid(x: Column, unit: str) -> Column:
    """Whether x is a whole multiple of unit, in decimals."""
    return x.cast("decimal(38,18)") % F.lit(unit).cast("decimal(38,18)") == 0


# -- dates, boxes, sources ---------------------------------------------------------------------------


def consistent_lag(primary: Column, lag_days: Column, most: int = 30) -> Column:
    """False only if the source is primary and the lag is known and too long."""
    return ~(F.coalesce(primary, F.lit(False)) & F.coalesce(F.abs(lag_days) > most, F.lit(False)))


def years_from(anchor: Column, when: Column) -> Column:
    return F.datediff(when.cast("date"), anchor) / F.lit(365.25)


def month_mid_days(month: Column) -> Column:
    """Days from the first of a month to its middle; may be a half."""
    return (F.dayofmonth(F.last_day(month)) - 1) / F.lit(2.0)


def inside(x: Column, low: float | Column, high: float | Column, slack: float = 0.0) -> Column:
    """Whether x is in [low, high], each end moved out by a share `slack` of its size."""
    if not slack:
        return (x >= low) & (x <= high)
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return (x >= low - slack * F.abs(low)) & (x <= high + slack * F.abs(high))


def inferred_data(method: Column, n: Column, compute: Column) -> Column:
    """Data that compute and size imply, C / 6N, where operations were counted; else null."""
    return F.when(method.contains("Operation counting") & (n > 0) & (compute > 0), compute / (6 * n))


def upward_targets(q: Column, most: float, multiples: list[float]) -> Column:
    """Multiples of q up to `most` that improve on it, each once, in order."""
    clipped = F.transform(F.array(*[F.lit(float(m)) for m in multiples]), lambda m: F.round(F.least(q * m, F.lit(most)), 9))
    return F.array_sort(F.array_distinct(F.filter(clipped, lambda x: x > q + 1e-12)))


def bound_status(v: Column, low: float, high: float, tolerance: float) -> Column:
    return F.when(v <= low + tolerance, "lower").when(v >= high - tolerance, "upper").otherwise("interior")


def half_unit(v: Column) -> Column:
    """Half a unit in the sixth significant digit."""
    return 0.5 * F.pow(F.lit(10.0), F.floor(F.log10(v * 1.0)) - 5)


def intersect(*boxes: tuple[float, float]) -> tuple[float, float]:
    """The interval that all intervals share; an error if there is none."""
    low, high = max(b[0] for b in boxes), min(b[1] for b in boxes)
    if low > high:
        raise ValueError("the intervals have nothing in common")
    return low, high


def signature(part: Column) -> Column:
    """Aggregate: the sorted parts of a group, joined. For groups with few distinct parts."""
    return F.array_join(F.array_sort(F.collect_list(part)), ";")


def power_of_ten(text: Column) -> Column:
    """The first 10^k of a text; null without one."""
    return F.pow(F.lit(10.0), F.nullif(F.regexp_extract(text, r"10\^(\d+)", 1), F.lit("")).try_cast("double"))


def parsed_interval(text: Column) -> tuple[Column, Column]:
    """Ends of the first [a, b] of a text; null without one."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"\[([0-9.]+), *([0-9.]+)\]", k), F.lit("")).try_cast("double")
    return part(1), part(2)
