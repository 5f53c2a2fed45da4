"""Order of files, raw tokens, support of fields, provenance graphs, bridges and stateful streams on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators import bridge, provenance
from lodestat.sources import positions, rawlines, support
from lodestat.streaming import events, frontier


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_rows_keep_the_order_of_their_files(spark, tmp_path, kind):
    for i, size in enumerate((3, 500, 1, 70)):
        part = spark.range(size).select((F.col("id") + 1000 * i).alias("k")).coalesce(1)
        getattr(part.write.option("header", True), kind)(str(tmp_path / f"{i}"))
        (next((tmp_path / f"{i}").glob(f"part*.{kind}"))).rename(tmp_path / f"file{i}.{kind}")
    df = spark.read.schema("k long").option("header", True).format(kind).load(str(tmp_path / f"*.{kind}"))
    got = [(r.position, r.k) for r in positions.in_file_order(df).orderBy("position").collect()]
    assert got == list(enumerate([*range(3), *range(1000, 1500), 2000, *range(3000, 3070)]))


def test_differences_in_order_are_not_differences_in_keys(spark):
    rows = [(i, f"m{i}", float(i), None if i == 4 else "x") for i in range(8)]
    left = spark.createDataFrame(rows, "position long, model string, score double, note string")
    swapped = [(i, f"m{ {2: 3, 3: 2}.get(i, i)}", float(i) + (0.5 if i == 6 else 0), "y" if i == 7 else n) for i, _, _, n in rows]
    right = spark.createDataFrame(swapped[:-1] + [swapped[-1]], left.schema)
    one = positions.compared(left, right, "model", ["score", "note"]).first()
    assert (one.same_order, one.first_disorder, one.first_difference, one.differing_rows, one.widest) == (False, 2, 2, 2, 0.5)
    same = positions.compared(left, left, "model", ["score", "note"]).first()
    assert (same.same_order, same.first_difference, same.differing_rows, same.widest) == (True, None, 0, 0.0)
    assert positions.compared(left, left.filter("position < 5"), "model", ["score"]).first().first_disorder == 5
    with pytest.raises(ValueError, match="position 2"):
        positions.paired(left, right, "model")
    assert positions.paired(left, left.select("position", "model", F.col("score").alias("other")), "model").filter("score = other").count() == 8
    with pytest.raises(ValueError, match="repeats"):
        twice = left.withColumn("model", F.lit("m"))
        positions.paired(twice, twice.select("position", "model", F.col("score").alias("other")), "model")


def test_only_whole_vectors_of_nan_are_confirmed(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("sub", T.StringType()), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("s", T.DoubleType())])
    lines = {
        "complete": '{"id": "1", "sub": "p", "a": [1, 2], "b": [0.5], "s": 1}',
        "confirmed": '{"id": "2", "sub": "p", "a": [NaN, NaN], "b": [0.5], "s": 1}',
        "partial": '{"id": "3", "sub": "p", "a": [NaN, 1], "b": [0.5], "s": 1}',
        "not_allowed": '{"id": "4", "sub": "p", "a": [1, 2], "b": [NaN], "s": 1}',
        "unreconciled": '{"id": "5", "sub": "p", "a": [NaN, NaN], "b": [0.5], "s": NaN}',
        "infinity": '{"id": "6", "sub": "p", "a": [1, 2], "b": [0.5], "s": -Infinity}',
        "defect": '{"id": "7", "sub": "p", "a": [1, null], "b": [0.5], "s": 1}',
        "unparsed": '{"id": "8", "sub": "p", "a": [1',
        "complete ": '{"id": "NaN, \\"a\\": [NaN, NaN]", "sub": "Infinity", "a": [1, 2], "b": [0.5], "s": 1}',
        "defect ": '{"id": "9", "sub": "p", "b": [0.5], "s": 1}',
    }
    found = rawlines.confirmed(spark.createDataFrame([(k.strip(), v) for k, v in lines.items()], "want string, value string"), schema, {"a": 2, "b": 1}, ["a"]).collect()
    for r in found:
        assert r.status == r.want, r.value
    assert {r.id: r.nan_fields for r in found if r.status == "unreconciled"} == {"5": {"a": 2, "b": 0}} and next(r for r in found if r.status == "confirmed").missing == ["a"]
    again = spark.createDataFrame([("1", "p"), ("1", "p"), ("1", "q"), (None, "p"), (None, "p")], "id string, sub string")
    assert {(r.id, r.sub, r.n) for r in rawlines.repeated(again, ["id", "sub"]).collect()} == {("1", "p", 2), (None, "p", 2)}


def test_files_are_tied_to_what_is_listed(spark, tmp_path):
    text = "model_name,context\n" + "".join(f"m{i},{2048 * (1 + i % 3)}\n" for i in range(9))
    for name, content in (("good.csv", text), ("cut.csv", text[:-20]), ("torn.csv", text.replace("m4,4096", "m4,not a number")), ("short.csv", text), ("extra.csv", text), ("empty.csv", "")):
        (tmp_path / name).write_text(content)
    listed = [("good.csv", len(text), 9), ("cut.csv", len(text), 9), ("torn.csv", len(text.replace("m4,4096", "m4,not a number")), 9), ("short.csv", len(text), 10), ("gone.csv", 5, 1), ("empty.csv", 0, 0)]
    got = {r.name: r for r in support.reconciled(spark, str(tmp_path), "model_name string, context long", spark.createDataFrame(listed, "name string, bytes long, rows long")).collect()}
    assert {k: r.status for k, r in got.items()} == {"good.csv": "ok", "cut.csv": "bytes", "torn.csv": "broken", "short.csv": "rows", "extra.csv": "unlisted", "gone.csv": "missing", "empty.csv": "missing"}
    assert got["good.csv"].rows == 9 and got["torn.csv"].broken == 1
    grid = {r.value: (r.n, r.first_name) for r in support.support_grid(spark.read.csv(str(tmp_path / "good.csv"), header=True, schema="model_name string, context long"), "context", "model_name").collect()}
    assert grid == {2048: (3, "m0"), 4096: (3, "m1"), 6144: (3, "m2")}
    with pytest.raises(Exception, match="positive value and a name"):
        support.support_grid(spark.createDataFrame([(" ", 5)], "model_name string, context long"), "context", "model_name").collect()


def test_cycles_of_any_length(spark):
    rows = [("self", ["self"]), ("a", ["b"]), ("b", ["a", "root"]), ("root", []), ("leaf", ["a", "leaf2"]), ("leaf2", None), ("x", ["gone"]), ("twice", []), ("twice", ["root"]), (None, ["root"])]
    rows += [(f"c{i}", [f"c{(i + 1) % 50}"]) for i in range(50)] + [(f"d{i}", [f"d{i - 1}"] if i else []) for i in range(6)]
    items = spark.createDataFrame([(i, "derived" if i != "x" else "odd", p) for i, p in rows], "id string, kind string, parents array<string>")
    length = {r.id: r.length for r in provenance.cycles(items).collect()}
    assert length == {"self": 1, "a": 2, "b": 2} | {f"c{i}": 50 for i in range(50)}
    found = {(r.id, r.problem) for r in provenance.problems(items, ["derived"]).collect()}
    assert {f for f in found if f[1] != "own ancestor"} == {(None, "missing field"), ("x", "unknown kind"), ("x", "unknown parent"), ("twice", "repeated id")}
    depth = {r.id: r.depth for r in provenance.depths(items)[0].collect()}
    assert depth["root"] == 0 and depth["d5"] == 5 and "a" not in depth and "leaf" not in depth
    assert provenance.cycles(items.limit(0)).count() == 0


def test_groups_left_out_are_predicted_by_the_others(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(1e4 + 3 * x + rng.normal())) for g in ("a", "b", "c", None) for x in rng.normal(50, 3, 12)] + [("one", 50.0, 1e4), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "org string, x double, y double")
    errors = []
    for r in bridge.leave_group_out(df, "org", "x", "y").collect():
        rest = np.array([v[1:] for v in rows if v[0] != r.org and v[1] is not None])
        own = np.array([v[1:] for v in rows if v[0] == r.org and v[1] is not None])
        b, a = np.polyfit(rest[:, 0] - 50, rest[:, 1], 1)
        e = a + b * (own[:, 0] - 50) - own[:, 1]
        errors += e.tolist()
        assert (r.slope, r.rmse, r.mae, r.n) == pytest.approx((b, np.sqrt((e**2).mean()), np.abs(e).mean(), len(own)), rel=1e-6)
    one = bridge.block_error(bridge.leave_group_out(df, "org", "x", "y")).first()
    assert (one.n, one.rmse, one.groups) == (49, pytest.approx(np.sqrt(np.mean(np.square(errors)))), 5)
    assert bridge.leave_group_out(df.filter("org = 'a'"), "org", "x", "y").first().slope is None


def test_predictions_carry_both_errors_inside_their_support(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.5,), (None,)], "loss double")
    for form, at in (("constant", lambda v: 30.0), ("linear", lambda v: 30 - 4 * v), ("logit", lambda v: 100 / (1 + np.exp(-(30 - 4 * v) / 10)))):
        a, b = (3.0, -0.4) if form == "logit" else (30.0, -4.0)
        m, s = bridge.prediction(F.col("loss"), F.lit(0.25), form, a, b, 1.5, 1.0, 3.0)
        got = df.select("loss", m.alias("m"), s.alias("s")).collect()
        for r in got[:2]:
            slope = 0 if form == "constant" else (at(r.loss + 1e-6) - at(r.loss - 1e-6)) / 2e-6
            assert (r.m, r.s) == pytest.approx((at(r.loss), np.hypot(1.5, slope * 0.25)), rel=1e-6)
        assert got[2].m is None and got[3].s is None
    with pytest.raises(ValueError):
        bridge.prediction(F.col("loss"), F.lit(0.1), "linear", 1, 1, 0.0, 0, 1)


def test_a_stream_keeps_the_frontier_of_shuffled_and_late_rows(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, f"2024-0{1 + draw.randrange(3)}-{1 + draw.randrange(28):02d} 10:00:00", draw.randrange(9), "t", float(draw.randrange(60)) if draw.random() > 0.05 else None, json.dumps({})) for i in range(600)]
    draw.shuffle(rows)  # months come back in later files
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for i in range(4):
        df.filter(F.col("event_id") % 4 == i).coalesce(1).write.parquet(str(tmp_path / "raw" / str(i)))
        next((tmp_path / "raw" / str(i)).glob("part*.parquet")).rename(tmp_path / f"{i}.events.parquet")
    static = spark.createDataFrame([(u, f"g{u % 2}") for u in range(7)], "user_id long, grp string")
    stream = frontier.linked(events.stream(spark, str(tmp_path), files_per_trigger=1), static, "user_id")
    got = frontier.run(spark, frontier.frontier_stream(stream, 4), "kept", str(tmp_path / "checkpoint"))
    want = frontier.frontier_batch(frontier.linked(df.withColumn("ts", F.col("ts").cast("timestamp")), static, "user_id"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3 * 3 * 4
