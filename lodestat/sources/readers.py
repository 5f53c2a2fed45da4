"""Readers: strict CSV, JSON lines (also .xz), nested JSON by directory, DOCX blocks, Markdown tables, TSV manifests. Schemas are always given."""

from __future__ import annotations

import io
import json
import lzma
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators.ranks import keep_last

SCALARS = ["dsir_books", "dsir_wiki", "dsir_math", "rps_doc_word_count", "rps_doc_num_sentences", "rps_doc_unigram_entropy", "rps_doc_frac_unique_words", "rps_doc_frac_no_alph_words", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram", "rps_lines_uppercase_letter_fraction", "rps_lines_ending_with_terminal_punctution_mark", "rps_lines_numerical_chars_fraction", "rps_doc_mean_word_length"]
LISTS = {"fineweb_edu": 1, "fluency_en": 2, "ad_en": 2, "qurater": 4, "modernbert_cleanliness": 6, "modernbert_readability": 6, "modernbert_reasoning": 6, "modernbert_professionalism": 6}
#: Columns of a quality record. Names and widths of the published format.
QUALITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("sub_path", T.StringType()), T.StructField("_source_domain", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in SCALARS], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in LISTS]])


def strict_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", non_null: bool = True) -> DataFrame:
    """CSV whose header equals the schema and whose rows are whole; blank cells are errors where non_null."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, mode="FAILFAST", enforceSchema=False, nullValue="")
    if non_null:
        df = df.select(*[F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"blank cell in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def renamed(df: DataFrame, names: dict[str, str], prefixed: dict[str, str] | None = None) -> DataFrame:
    """Columns picked and renamed; a prefix (for headers with marks that vary) must fit exactly one column."""
    picked = [F.col(f"`{old}`").alias(new) for old, new in names.items()]
    for prefix, new in (prefixed or {}).items():
        found = [c for c in df.columns if c.startswith(prefix) and c not in names]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns begin with {prefix!r}")
        picked.append(F.col(f"`{found[0]}`").alias(new))
    return df.select(*picked)


def shares(df: DataFrame, domains: list[str], tolerance: float = 0.0085, key: str = "index") -> DataFrame:
    """Rows of non-negative shares that sum to one within the tolerance, else an error; then divided by their sum."""
    total = sum((F.col(d) for d in domains[1:]), F.col(domains[0]))
    fine = F.forall(F.array(*domains), lambda x: (x >= 0) & (x < float("inf"))) & (F.abs(total - 1) <= tolerance)
    bad = F.raise_error(F.concat(F.lit("shares of row "), F.col(key).cast("string"), F.lit(" do not sum to one"))).cast("double")
    return df.select(key, *[F.when(fine, F.col(d) / total).otherwise(bad).alias(d) for d in domains])


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join; a key that is missing or repeated on a side is an error."""
    n, m, out = left.count(), right.count(), left.join(right, key)
    if not n == m == out.count() == out.select(key).distinct().count():
        raise ValueError("the tables do not pair one to one")
    return out


def json_lines(spark: SparkSession, path: str, schema: T.StructType = QUALITY, corrupt: str = "_corrupt") -> DataFrame:
    """JSON lines with line identity kept: file, parsed columns, `nan_tokens` (bare NaN and Infinity of the raw line), `_corrupt` (lines that do not parse)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return _parsed(raw, schema, corrupt)


def json_lines_xz(spark: SparkSession, path: str, schema: T.StructType = QUALITY, corrupt: str = "_corrupt") -> DataFrame:
    """The same from .xz files, which no Hadoop codec reads: a file is one task and is decompressed as a stream, never whole."""

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                chunk: list[str] = []
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8") as f:
                    for line in f:
                        chunk.append(line.rstrip("\n"))
                        if len(chunk) == 2000:
                            yield pd.DataFrame({"value": chunk, "file": name})
                            chunk = []
                if chunk:
                    yield pd.DataFrame({"value": chunk, "file": name})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "value string, file string")
    return _parsed(raw, schema, corrupt)


def _parsed(raw: DataFrame, schema: T.StructType, corrupt: str) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    j = F.from_json("value", full, {"allowNonNumericNumbers": "true", "columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"})
    return raw.select("file", F.regexp_count("value", F.lit(r"(?<![\w\"])-?(?:NaN|Infinity)(?![\w\"])")).alias("nan_tokens"), j.alias("j")).select("file", "nan_tokens", "j.*")


def identity(domain: Column, sub_path: Column, record: Column) -> tuple[Column, Column]:
    """Digests of a record and of its cluster, from compact JSON arrays."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.cast("string").alias("v"))), r'^\{"v":|\}$', "")
    text = lambda *cs: F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[quoted(c) for c in cs]), F.lit("]")), 256)
    return text(domain, sub_path, record), text(domain, sub_path)


def latest_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(latest, damaged): of each directory under path the last file, by name, that parses, as a VARIANT `payload`; and the files that do not."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    files = files.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("directory"), F.regexp_extract("file", "([^/]*)$", 1).alias("name"), "value", F.try_parse_json("value").alias("payload"))
    good = files.filter("payload is not null").select("directory", "name", "value")
    return keep_last(good, ["directory"], ["name"]).select("directory", "name", F.parse_json("value").alias("payload")), files.filter("payload is null").select("directory", "name")


def subtask_scores(payloads: DataFrame, groups: list[str], baselines: dict[str, float]) -> DataFrame:
    """(directory, dimension, subtask, raw, base, score) from result payloads: members of each group, the first numeric of acc_norm, exact_match and acc, rescaled over the guessing baseline (a known count, else the number of choices, else 0)."""
    p = payloads.select("directory", F.variant_get("payload", "$.results", "map<string,map<string,variant>>").alias("results"), F.try_variant_get("payload", "$.group_subtasks", "map<string,array<string>>").alias("groups"), F.try_variant_get("payload", "$.configs", "map<string,variant>").alias("configs"))
    long = p.select("directory", "results", "configs", F.explode(F.array(*[F.lit(g) for g in groups])).alias("dimension"))
    members = F.coalesce(F.try_element_at(F.col("groups"), F.col("dimension")), F.array(F.col("dimension")))
    long = p.select("directory", "results", "configs", "groups", F.explode(F.array(*[F.lit(g) for g in groups])).alias("dimension")).select("directory", "results", "configs", "dimension", F.explode(members).alias("subtask"))
    m = F.try_element_at(F.col("results"), F.col("subtask"))
    num = lambda k: F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "double")
    raw = F.coalesce(*[num(f"{k},none") for k in ("acc_norm", "exact_match", "acc")])
    config = F.try_element_at(F.col("configs"), F.col("subtask"))
    choices = F.size(F.try_variant_get(config, "$.doc_to_choice", "array<string>"))
    known = F.lit(None).cast("double")
    for part, base in baselines.items():
        known = F.when(F.col("subtask").contains(part), F.lit(float(base))).otherwise(known)
    base = F.coalesce(known, F.when(choices > 0, 1.0 / choices), F.lit(0.0))
    return long.select("directory", "dimension", "subtask", raw.alias("raw"), base.alias("base")).withColumn("score", F.greatest(F.lit(0.0), (F.col("raw") - F.col("base")) / (1 - F.col("base"))) * 100)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def _linear(node: ElementTree.Element) -> str:
    """Math as one line: fractions, powers and indices in ASCII."""
    kids = {k.tag: k for k in node}
    both = lambda a, b, sign: f"{_linear(kids[_M + a])}{sign}{_linear(kids[_M + b])}"
    if node.tag == _M + "f":
        return f"({both('num', 'den', ')/(')})"
    if node.tag == _M + "sSup":
        return both("e", "sup", "^")
    if node.tag == _M + "sSub":
        return both("e", "sub", "_")
    if node.tag in (_M + "t", _W + "t"):
        return node.text or ""
    return "".join(_linear(k) for k in node)


def docx_blocks(data: bytes) -> list[tuple[str, str, list[str]]]:
    """(locator, text, maths) of paragraphs and table cells in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    block = lambda at, p: out.append((at, _linear(p), [_linear(m) for m in p.iter(f"{_M}oMath")]))
    para = tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            block(f"p{para}", node)
            para += 1
        elif node.tag == f"{_W}tbl":
            for r, row in enumerate(node.iter(f"{_W}tr")):
                for c, cell in enumerate(row.iter(f"{_W}tc")):
                    for k, p in enumerate(cell.iter(f"{_W}p")):
                        block(f"t{tables}r{r}c{c}p{k}", p)
            tables += 1
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(name, *b) for name, data in zip(part["path"], part["content"], strict=True) for b in docx_blocks(data)], columns=["file", "locator", "text", "math"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, locator string, text string, math array<string>")


def markdown_cells(text: str) -> list[tuple[int, int, int, str]]:
    """(table, row, column, value) of pipe tables; separator rows are left out, row 0 is the header."""
    out, table, row, inside = [], -1, 0, False
    for line in text.splitlines():
        line = line.strip()
        if not (line.startswith("|") and line.endswith("|") and len(line) > 1):
            inside = False
            continue
        cells = [c.strip() for c in re.split(r"(?<!\\)\|", line[1:-1])]
        if not inside:
            inside, table, row = True, table + 1, 0
        if all(re.fullmatch(r":?-+:?", c) for c in cells):
            continue
        out += [(table, row, i, c) for i, c in enumerate(cells)]
        row += 1
    return out


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(name, *c) for name, text in zip(part["file"], part["value"], strict=True) for c in markdown_cells(text)], columns=["file", "table", "row", "column", "value"])

    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).mapInPandas(run, "file string, table int, row int, column int, value string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """TSV manifest: path, bytes, sha256."""
    return strict_csv(spark, path, "path string, bytes long, sha256 string", sep="\t")


def verified_files(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """(name, status): files under path against a manifest by size and digest: ok, changed, missing or unlisted."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("n"), F.sha2("content", 256).alias("digest"))
    j = there.join(listed.withColumnRenamed("path", "name"), "name", "full")
    return j.select("name", F.when(F.col("sha256").isNull(), "unlisted").when(F.col("digest").isNull(), "missing").when((F.col("digest") == F.col("sha256")) & (F.col("n") == F.col("bytes")), "ok").otherwise("changed").alias("status"))


def settings(text: str) -> dict:
    """Settings as JSON."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be an object")
    return found
