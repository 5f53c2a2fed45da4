"""Readers, sinks and streams on files made here."""

import hashlib
import io
import json
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestat.sources import readers, sinks
from lodestat.streaming import events


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("index,x\n1,2.5\n2,3\n")
    assert readers.strict_csv(spark, str(tmp_path / "a.csv"), "index int, x double").count() == 2
    for bad in ("index,y\n1,2\n", "index,x\n1,\n", "index,x\n1,z\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            readers.strict_csv(spark, str(tmp_path / "b.csv"), "index int, x double").collect()


def test_renamed(spark):
    df = spark.createDataFrame([(1, 2)], "`Model` int, `Average ⬆` int")
    assert readers.renamed(df, {"Model": "model"}, {"Average": "average"}).columns == ["model", "average"]
    with pytest.raises(ValueError):
        readers.renamed(df, {"Model": "model"}, {"Zz": "average"})


def test_shares_and_alignment(spark):
    df = spark.createDataFrame([(1, 0.25, 0.75), (2, 0.501, 0.501)], "index int, a double, b double")
    assert [round(r.a + r.b, 12) for r in readers.shares(df, ["a", "b"]).collect()] == [1.0, 1.0]
    with pytest.raises(Exception):  # noqa: B017
        readers.shares(df.withColumn("b", F.lit(0.9)), ["a", "b"]).collect()
    assert readers.aligned(df, df.select("index", F.lit(1).alias("y")), "index").count() == 2
    with pytest.raises(ValueError):
        readers.aligned(df, df.limit(1).select("index"), "index")


@pytest.mark.parametrize("packed", [False, True])
def test_json_lines(spark, tmp_path, packed):
    rows = [json.dumps({"id": "1", "dsir_books": 1.5, "qurater": [1, 2, 3, 4]}), '{"id": "2", "dsir_books": NaN, "fineweb_edu": [NaN]}', "{broken"]
    data = "\n".join(rows) + "\n"
    if packed:
        (tmp_path / "q.jsonl.xz").write_bytes(lzma.compress(data.encode()))
        out = readers.json_lines_xz(spark, str(tmp_path / "q.jsonl.xz"))
    else:
        (tmp_path / "q.jsonl").write_text(data)
        out = readers.json_lines(spark, str(tmp_path / "q.jsonl"))
    got = {r.id: r for r in out.collect()}
    assert got["1"].qurater == [1, 2, 3, 4] and got["1"].nan_tokens == 0
    assert got["2"].nan_tokens == 2 and got["2"].dsir_books != got["2"].dsir_books
    assert got[None]["_corrupt"] == "{broken"


def test_identity(spark):
    r = spark.createDataFrame([("d", 'a"b', "1")], "d string, p string, i string").select(*readers.identity(F.col("d"), F.col("p"), F.col("i"))).first()
    assert r[0] == hashlib.sha256(json.dumps(["d", 'a"b', "1"], separators=(",", ":")).encode()).hexdigest()


def test_nested_results(spark, tmp_path):
    payload = {"results": {"bbh_a": {"acc_norm,none": 0.6, "alias": "x"}, "bbh_b": {"acc,none": 0.2}, "math_c": {"exact_match,none": 0.5}}, "group_subtasks": {"bbh": ["bbh_a", "bbh_b"], "math": ["math_c"]}, "configs": {"bbh_a": {"doc_to_choice": ["y", "n"]}, "bbh_b": {"doc_to_choice": "def f(): pass"}}}
    for d, files in {"m1": {"r_1.json": "{}", "r_2.json": json.dumps(payload), "r_3.json": "{cut"}, "m2": {"r_1.json": "nope"}}.items():
        (tmp_path / d).mkdir()
        for name, text in files.items():
            (tmp_path / d / name).write_text(text)
    latest, damaged = readers.latest_json(spark, str(tmp_path))
    assert [r.name for r in latest.collect()] == ["r_2.json"] and damaged.count() == 2
    got = {r.subtask: (r.raw, r.base, round(r.score, 6)) for r in readers.subtask_scores(latest, ["bbh", "math"], {"bbh_b": 0.1}).collect()}
    assert got == {"bbh_a": (0.6, 0.5, 20.0), "bbh_b": (0.2, 0.1, 11.111111), "math_c": (0.5, 0.0, 50.0)}


def test_docx(spark, tmp_path):
    w, m = readers._W[1:-1], readers._M[1:-1]
    xml = f'<w:document xmlns:w="{w}" xmlns:m="{m}"><w:body><w:p><w:r><w:t>cost </w:t></w:r><m:oMath><m:sSup><m:e><m:r><m:t>10</m:t></m:r></m:e><m:sup><m:r><m:t>22</m:t></m:r></m:sup></m:sSup></m:oMath></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    assert [(r.locator, r.text, r.math) for r in readers.read_docx(spark, str(tmp_path / "a.docx")).collect()] == [("p0", "cost 10^22", ["10^22"]), ("t0r0c0p0", "cell", [])]


def test_markdown_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), ("c", None)], "k string, v double")
    (tmp_path / "t.md").write_text("# title\n\n" + sinks.markdown(df))
    got = [(r.row, r.column, r.value) for r in readers.read_markdown(spark, str(tmp_path / "t.md")).collect()]
    assert got == [(0, 0, "k"), (0, 1, "v"), (1, 0, "a/b"), (1, 1, "1.5"), (2, 0, "c"), (2, 1, "undefined")]


def test_manifest(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x").write_bytes(b"abc")
    (tmp_path / "data" / "y").write_bytes(b"abd")
    (tmp_path / "m.tsv").write_text("path\tbytes\tsha256\n" + f"x\t3\t{hashlib.sha256(b'abc').hexdigest()}\n" + f"z\t3\t{hashlib.sha256(b'abc').hexdigest()}\n")
    got = dict(readers.verified_files(spark, str(tmp_path / "data"), readers.manifest(spark, str(tmp_path / "m.tsv"))).collect())
    assert got == {"x": "ok", "y": "unlisted", "z": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_json(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "bad"))


def test_streams_agree_with_batches(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = events.run_once(events.windowed(events.stream(spark, path)), "w", str(tmp_path / "w"), "complete")
    want = events.windowed(batch)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    s = events.run_once(events.sessions(events.stream(spark, path)), "s", str(tmp_path / "s"), "complete")
    assert s.agg(F.sum("n")).first()[0] == batch.count()
    once = events.run_once(events.first_seen(events.stream(spark, path), ["event_id"], "60 days"), "f", str(tmp_path / "f"))
    assert once.count() == batch.select("event_id").distinct().count()
    events.to_parquet(events.first_seen(events.stream(spark, path), ["event_id"], "60 days"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == once.count()


def test_trusted_tables(spark, tmp_path):
    from lodestat.operators.expect import ContractError
    from lodestat.sources import tables

    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    log = put("log.csv", "N_params_B,loss\n0.07,3.1\n0.07,3.0\n0.41,2.7\n")
    rows = tables.training_log(spark, log).collect()
    assert {r.model_id for r in rows} == {"0.07", "0.41"} and {r.trust for r in rows} == {"observed"}
    with pytest.raises(ContractError):
        tables.training_log(spark, put("flat.csv", "N_params_B,loss\n0.07,3.1\n0.41,2.7\n"))
    families = put("fam.csv", "family,loss\nPythia,3\nOther,2\n,1\n")
    assert tables.cross_family(spark, families).count() == 2 and tables.cross_family(spark, families, ()).count() == 3
    assert tables.graded(spark, put("g.csv", "q,loss,data_type\n0.5,3,calibrated\n")).first().trust == "mixed"
    assert tables.graded(spark, families).first().trust == "semi_synthetic" and tables.estimates(spark, families).first().trust == "estimated"
    assert tables.calibrated_log(spark, families).first().trust == "semi_synthetic" and tables.published(spark, families).first().trust == "observed"
    assert [t.count() for t in tables.bridge_tables(spark, log, families)] == [3, 3]


def test_domain_map(spark, tmp_path):
    from lodestat.operators.expect import ContractError
    from lodestat.sources import tables

    path = tmp_path / "map.csv"
    path.write_text("mixture_domain,quality_domain,mapping_type\na,x,direct\nb,(none),none\nc,y,inferred\n")
    m = tables.domain_map(spark, f"file://{path}", ["a", "b", "c"])
    assert {(r.domain, r.target) for r in m.collect()} == {("a", "x"), ("b", None), ("c", "y")}
    for bad in (["a", "b"], ["a", "b", "c", "d"]):
        with pytest.raises(ContractError):
            tables.domain_map(spark, f"file://{path}", bad)
    shares = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.2), (2, "b", 1.0)], "index int, domain string, share double")
    q = spark.createDataFrame([("x", 0.8), ("y", 0.1)], "target string, q double")
    got = {r["index"]: (r.mass, r.quality) for r in tables.mapped_quality(shares, m, q).collect()}
    assert got[1] == pytest.approx((0.7, 0.42 / 0.7)) and got[2] == (0.0, None)
    with pytest.raises(Exception, match="no quality for y"):
        tables.mapped_quality(shares, m, q.filter("target = 'x'")).collect()


def test_handoffs(spark):
    from lodestat.operators import allocation, handoff
    from lodestat.operators.expect import ContractError

    rows = spark.createDataFrame([("d", 0.5, 0.4, 0.6, 10, 0.9)], "domain string, q double, low double, high double, n long, coverage double")
    h = handoff.build("quality", rows, "observed", "0" * 64)
    assert h.columns == handoff.COLUMNS["quality"] and handoff.require_not_imputed(h, 0.8).count() == 1
    for bad in (lambda: handoff.build("law", rows, "observed", "0" * 64), lambda: handoff.build("quality", rows, "hearsay", "0" * 64), lambda: handoff.build("quality", rows, "observed", "x"), lambda: handoff.require_not_imputed(h, 0.95), lambda: handoff.require_scale(h, 1e9, 1e6, 10)):
        with pytest.raises(ContractError):
            bad()
    m = handoff.build("mixture", spark.createDataFrame([("t", "a", 0.1, "1M")], "target string, term string, value double, scope string"), "estimated", "f" * 64)
    assert handoff.require_scope(m, "1M").count() == 1
    with pytest.raises(ContractError):
        handoff.require_scope(m, "1B")
    record = handoff.allocation_records(allocation.solve(allocation.grid(spark, [1e21], [2048]))).first()
    assert record.optimum.loss > 1.6 and record.regime.startswith("SATURATED")
    reports = handoff.panel_reports(spark.createDataFrame([(1, "A", "2024-01-05"), (2, None, "2024-01-09")], "k int, s string, d string"), "k", "s", "d")
    assert {(r.column, r.present) for r in reports["schema"].collect()} == {("k", 2), ("s", 1), ("d", 2)} and reports["dates"].first().n == 2
