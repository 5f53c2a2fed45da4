"""Exact small cases of the operators."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.operators import aggregates, allocation, core, expect, linalg, linkage, names, optim, ranks, resample
from lodestat.plans import catalog


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_average_ranks(spark):
    out = ranks.average_ranks(frame(spark, [("a", 2.0), ("a", 2.0), ("a", 4.0)], "g string, v double"), ["g"], "v").collect()
    assert sorted(r["rank"] for r in out) == [1.5, 1.5, 3.0]


def test_midrank_against_a_frozen_reference(spark):
    ref, obs = frame(spark, [("a", 1.0), ("a", 1.0)], "g string, v double"), frame(spark, [("a", 0.0), ("a", 1.0), ("a", 2.0)], "g string, v double")
    out = {r.v: r.score for r in ranks.midrank_against(ref, obs, ["g"], "v").collect()}
    assert out == {0.0: 0.0, 1.0: 0.5, 2.0: 1.0}


@pytest.mark.parametrize("bins", [0, 2, 64])
def test_prefix_sums_do_not_depend_on_bins(spark, bins, monkeypatch):
    monkeypatch.setattr(core, "SORTED_ROWS", 0 if bins else 100_000)
    bins = bins or 64
    rng = random.Random(1)
    values = sorted({rng.randrange(500) for _ in range(300)})
    out = core.prefix_sums(frame(spark, [("g", v, v % 7) for v in values], "g string, v long, w long"), ["g"], "v", "w", bins).collect()
    assert {r.v: (r["__below"], r["__upto"]) for r in out} == {v: (sum(x % 7 for x in values if x < v), sum(x % 7 for x in values if x <= v)) for v in values}


def test_spearman_is_null_for_a_constant(spark):
    rows = [(i, n, v) for i in range(5) for n, v in (("a", float(i)), ("b", float(-i)), ("c", 1.0))]
    out = {(r.a, r.b): r.rho for r in ranks.spearman_pairs(frame(spark, rows, "k int, n string, v double"), "k", "n", "v", ["a", "b", "c"]).collect()}
    assert out["a", "b"] == pytest.approx(-1) and out["a", "c"] is None and out["b", "c"] is None


def test_keep_first_is_by_order(spark):
    df = frame(spark, [(1, 3, "c"), (1, 1, "a"), (1, 2, None), (2, 5, "x")], "k int, o int, v string")
    assert sorted(map(tuple, ranks.keep_first(df, ["k"], ["o"]).collect())) == [(1, 1, "a"), (2, 5, "x")]
    assert sorted(map(tuple, ranks.keep_last(df, ["k"], ["o"]).collect())) == [(1, 3, "c"), (2, 5, "x")]


def test_names(spark):
    """Keys as unicodedata makes them: ligatures, full width, Vietnamese, combining marks, letters that do not decompose."""
    odd = ["A / B-C", "a_b c", "Yi-1.5-34B-Chat", "Yi-1.5-34B", "--", None, "", "ﬁne-tuné", "Ｆｕｌｌ Ｗｉｄｔｈ", "Tiếng Việt", "e\u0301cole", "Ørsted", "straße", "№ 5", "x²", "日本", "İstanbul"]
    df = frame(spark, [(i, x, "plain") for i, x in enumerate(odd)], "i int, x string, __bare_ string")
    got = {r.i: (r.k, r.p) for r in names.with_keys(df, {"x": "k", "__bare_": "p"}).collect()}

    def plain(x):
        low = "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).lower()
        return re.sub("[^a-z0-9]+", "_", low).strip("_") or None

    assert got == {i: (plain(x), "plain") for i, x in enumerate(odd)}
    assert got[0] == got[1] and got[7][0] == "fine_tune" and got[9][0] == "tieng_viet"


def test_ladder_leaves_ambiguous_keys_alone(spark):
    left = frame(spark, [(1, "apollo_7b"), (2, "zeus"), (3, None), (4, "hera"), (5, "hera")], "id int, k string")
    right = frame(spark, [(10, "apollo_7b"), (11, "apollo_7b"), (12, "zeus"), (13, None), (14, "hera")], "rid int, rk string")
    out = linkage.ladder(left, right, [("name", "k", "rk", True)], "rid")
    assert {r.id: (r.linked, r.link_method) for r in out.collect()} == {1: (None, "unlinked"), 2: (12, "name"), 3: (None, "unlinked"), 4: (None, "unlinked"), 5: (None, "unlinked")}
    audit = dict(linkage.audit(out, "k", right, "rk").collect())
    assert audit == {"name": 1, "ambiguous_right": 1, "ambiguous_left": 2, "unmatched": 1} and sum(audit.values()) == left.count()


def test_presence_and_same_rows(spark):
    a, b = frame(spark, [(1, None), (2, 5)], "k int, v int"), frame(spark, [(1, None), (3, 5)], "k int, v int")
    assert {(r.k, r.side, r.equal) for r in linkage.presence(a, b, ["k"], ["v"]).collect()} == {(1, "both", True), (2, "left_only", None), (3, "right_only", None)}
    assert linkage.same_rows(a, a) and not linkage.same_rows(a, b)
    assert a.agg(linkage.fingerprint(a)).first() == a.orderBy(F.desc("k")).agg(linkage.fingerprint(a)).first()


def test_lists(spark):
    df = frame(spark, [([0.0, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 3.0])], "v array<double>, two array<double>")
    r = df.select(C.expected_level(F.col("v")), C.argmax(F.col("v")), C.second_of_two(F.col("two"))).first()
    assert r[0] == pytest.approx(2.5) and r[1] == 0 and r[2] == pytest.approx(1 / (1 + math.exp(-2)))
    bad = frame(spark, [([float("nan"), None, float("inf")],), ([1.0],), (None,)], "v array<double>").select(C.issues("f", F.col("v"), 3).alias("i")).collect()
    assert [[(x.kind, x.parts) for x in r.i] for r in bad] == [[("null", [1]), ("nan", [0]), ("positive_infinity", [2])], [("wrong_width", [1])], [("absent_field", [])]]


def test_rescale_and_states(spark):
    df = spark.range(1)
    assert df.select(C.rescaled(F.lit(0.25), F.lit(0.25)), C.rescaled(F.lit(1.0), F.lit(0.0)), C.desirable(F.lit(12.0), 3, 10)).first()[:] == (0.0, 100.0, -2.0)
    assert df.select(C.tri_state(F.lit(None).cast("boolean"), F.lit(True)), C.tri_state(F.lit(True), F.lit(True)), C.tri_state(F.lit(False), F.lit(None).cast("boolean"))).first()[:] == ("no", "yes", "unknown")


def test_metrics_are_null_where_undefined(spark):
    r = aggregates.metrics(frame(spark, [("a", 1.0, 2.0), ("a", 1.0, 0.0)], "g string, o double, p double"), ["g"], "o", "p").first()
    assert r.r2 is None and r.mae == 1.0
    assert aggregates.metrics(frame(spark, [("a", 0.0, 2.0), ("a", 1.0, 0.0)], "g string, o double, p double"), ["g"], "o", "p").first().mean_relative is None


def test_ledger_adds_up(spark):
    out = {r.rule: r for r in aggregates.ledger(frame(spark, [(i, None if i == 3 else i) for i in range(10)], "i int, v int"), [("R1", F.col("v") > 1), ("R2", F.col("i") % 2 == 0)]).collect()}
    assert out["R1"].fails_alone == 3 and sum(r.removed_in_sequence for r in out.values()) == 10


def test_top_mean_counts_ties(spark):
    rows = [("m", float(v)) for v in [5, 5, 5, 4, 3]]
    r = aggregates.frontier(frame(spark, rows, "m string, v double"), "m", "v", k=4).first()
    assert r.top_mean == pytest.approx(4.75) and r.sparse


def test_exact_split_identity(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=60)
    x = 0.5 * t + rng.normal(size=60)
    rows = [("a", float(a), float(b), float(2 * b + a + rng.normal())) for a, b in zip(t, x, strict=True)]
    r = linalg.exact_split(frame(spark, rows, "grp string, t double, x double, y double"), ["grp"], "y", "x", "t").first()
    assert r.g_time == pytest.approx(r.g + r.b * r.s, abs=1e-8)


def test_ridge_recovers_a_line(spark):
    rows = [(float(p), 2 + float(p), i % 5) for i, p in enumerate(np.linspace(0, 1, 20))]
    best = linalg.ridge_cv(frame(spark, rows, "x double, y double, f int"), ["x"], ["y"], "f", [1e-8, 1.0])[0]
    assert best["alpha"] == 1e-8 and best["intercept"] == pytest.approx(2, abs=1e-6) and best["b_x"] == pytest.approx(1, abs=1e-6)


def test_leave_one_out_equals_refits(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=25), rng.normal(size=25)
    errors = [y[i] - np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), 1), x[i]) for i in range(25)]
    r = linalg.leave_one_out(frame(spark, [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double"), ["g"], "y", "x").first()
    assert r.rmse == pytest.approx(float(np.sqrt(np.mean(np.square(errors)))))


def test_quantile_line_is_optimal():
    rng = np.random.default_rng(3)
    for tau in (0.1, 0.5, 0.9):
        x, y = rng.normal(size=31), rng.normal(size=31)
        loss = lambda a, b, x=x, y=y, tau=tau: float(np.where(y - a - b * x >= 0, tau, tau - 1) @ (y - a - b * x))
        best = min(loss(y[i] - (s := (y[j] - y[i]) / (x[j] - x[i])) * x[i], s) for i in range(31) for j in range(i))
        assert loss(*optim.quantile_line(x, y, tau)) == pytest.approx(best)


def test_law_is_recovered_from_losses(spark):
    r = catalog.QUERIES["law_fit_multistart"](spark, "/root/testdata/sf0.01").first()
    assert r.starts == 108
    for name in ("A", "B", "E", "alpha", "beta"):
        assert r[name] == pytest.approx(allocation.LAW[name], rel=1e-3)


def test_allocation_meets_published_points(spark):
    out = {r.budget: r for r in allocation.solve(allocation.grid(spark, contexts=[4096])).collect()}
    published = {1e19: (2.1520643e8, 3.0114367, "SATURATED:interior"), 1e22: (4.889903e9, 2.1475143, "SATURATED:D_max"), 1e24: (1.1965825e10, 2.0933829, "SLACK:N_max+D_max")}
    for budget, (n, loss, regime) in published.items():
        assert out[budget].n == pytest.approx(n, rel=2e-5) and out[budget].loss == pytest.approx(loss, rel=2e-5) and out[budget].regime == regime
    assert allocation.solve(allocation.grid(spark, [1e10])).first().n is None


def test_cost_crossings(spark):
    got = {(r["first"], r["second"]): r.q for r in catalog.QUERIES["cost_family_crossings"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got.values()) == pytest.approx([0.0005027702573, 0.3663817962, 0.9885477189], rel=1e-9)


def test_log_law_and_saving(spark):
    n, d = F.lit(1e9), F.lit(1e10)
    r = spark.range(1).select(F.log(C.law(n, d, allocation.LAW)), C.log_law(n, d, allocation.LAW), C.equivalent_capacity(n, F.lit(1e9), allocation.LAW), C.parameter_saving(n, F.lit(0.0), allocation.LAW)).first()
    assert r[0] == pytest.approx(r[1]) and r[2] is None and abs(r[3]) < 1e-3


def test_bootstrap_repeats(spark):
    units = frame(spark, [(i, float(i)) for i in range(12)], "u int, v double")
    run = lambda f: sorted(map(tuple, resample.bootstrap(units, "u", f, ["m"], 20, 1).collect()))
    one = run(lambda p: {"m": float(p["v"].mean())})
    assert one == run(lambda p: {"m": float(p["v"].mean())}) and len(one) == 20 and len({m for _, m in one}) > 5

    def fails(p):
        raise ValueError("no fit")

    assert run(fails) == [(i, None) for i in range(20)]


def test_contracts(spark):
    good = frame(spark, [("d", 0.5, 0.4, 0.6, 3, 0.9)], "domain string, q double, low double, high double, n int, coverage double")
    assert expect.require(good, expect.quality_contract()).count() == 1
    with pytest.raises(expect.ContractError, match="interval"):
        expect.require(good.withColumn("low", F.lit(0.55)), expect.quality_contract())
    with pytest.raises(expect.ContractError):
        expect.require_columns(good, ["domain"])
    with pytest.raises(expect.ContractError):
        expect.require_unique(good.union(good), ["domain"])
    items = frame(spark, [("a", []), ("b", ["a", "x"]), ("b", [])], "id string, parents array<string>")
    assert sorted(map(tuple, expect.provenance_graph(items).collect())) == [("b", "repeated id"), ("b", "unknown parent")]


def test_draws_of_one_file_are_dealt_out(spark, monkeypatch):
    """Rows that one task read are drawn in as many tasks as their draws ask for, by the hashes that SQL has."""
    import hashlib

    monkeypatch.setattr(resample, "TASK_DRAWS", 700)
    df = spark.createDataFrame([(i % 2, i if i % 50 else None, float(i)) for i in range(200)], "g int, k int, v double").coalesce(1)
    got = resample.weighted(df, "k", 20, 42)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 6
    below = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = lambda rep, k: sum(int(hashlib.md5("|".join(["42", str(rep)] + ([str(k)] if k is not None else [])).encode()).hexdigest()[:8], 16) / 2**32 >= b for b in below)
    rows = got.collect()
    assert len(rows) == 4000 and all(r["__w"] == weight(r["__rep"], r.k) for r in rows)
