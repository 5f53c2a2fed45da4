"""Language identification by Bayesian evidence fusion.

A document's language is the class with the highest posterior of four kinds of evidence: how likely its text is under byte-trigram
models, the language that its markup or metadata declares, the suffix of its address, and how often its host, the host's domain
and the whole corpus have each language. Host priors are smoothed hierarchically and come from grouped sums over all rows. A further class,
"und", stands for text that no model explains.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import BROADCAST_ROWS, cut, join_hot, row_key, table, text_or_empty, unit_hash, without

#: Bound of the labelled sample that the text models are fitted on: documents of each declared language. Every declared language has a model.
SAMPLE = 400
#: Languages whose counts a task holds at once; likelihoods that it takes at once.
HELD, PIECE = 16, 1 << 22
BUCKETS = 1 << 16
#: Text counts as so many independent trigrams at most; trust in declarations and suffixes; strength of each level of the host prior.
MOST_TRIGRAMS, DECLARED, SUFFIX, STRENGTH = 60.0, 0.9, 0.8, 20.0
#: Spreads by which a text's mean log likelihood may lie under its language's before "und" explains it better; posterior that is kept.
SPREADS, SURE = 10.0, 0.5

#: Country suffixes with one main language of the web pages under them.
SUFFIXES = {
    "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "cz": "cs", "se": "sv", "dk": "da", "fi": "fi", "gr": "el", "tr": "tr", "hu": "hu", "ro": "ro", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh",
}


#: Letters lower-cased, bytes of other scripts as they are, all else a space.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def _codes(data: bytes, first: bool = True, last: bool = True) -> np.ndarray:
    """Hashed trigrams with at least two letters, of the letters of the data with a space at both ends, or of a piece that is not the first or last of a text."""
    b = np.frombuffer(b" " * first + data.translate(_LETTERS) + b" " * last, np.uint8)
    blank = b == 0x20
    b = b.astype(np.uint32)
    codes = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(7) & np.uint32(BUCKETS - 1)
    return codes[blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:] < 2]


class TextModel:
    """Log likelihoods of trigram buckets by language, and what a text's mean usually is."""

    def __init__(self, languages: list[str], counts: np.ndarray, usual: np.ndarray) -> None:
        self.languages = languages
        self.log_p = np.log((counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)).astype(np.float32)
        #: Mean log likelihood and its spread, over sample documents of the language.
        self.usual = usual

    def means(self, data: bytes) -> tuple[np.ndarray, int]:
        """Mean log likelihood of a text for each language, and its trigrams."""
        total, n, step = np.zeros(len(self.languages)), 0, 1 << 18
        for at in range(0, len(data), step):  # in pieces that overlap by two bytes, so that long texts need no more memory
            codes, piece = _codes(data[max(0, at - 2) : at + step], at == 0, at + step >= len(data)), max(1024, PIECE // len(self.languages))
            for k in range(0, len(codes), piece):
                total += self.log_p[:, codes[k : k + piece]].sum(axis=1, dtype=np.float64)
            n += len(codes)
        return total / max(1, n), n


def fit(docs: DataFrame, text_col: str, declared: Column, sample: int = SAMPLE) -> TextModel | None:
    """Fits on at most `sample` (in expectation) whole texts of each declared language; which ones, hashes of the texts decide."""
    rows = docs.select(declared.alias("__lang"), text_or_empty(text_col).alias("__text"))
    sizes = dict(rows.filter("__lang is not null").groupBy("__lang").count().collect())
    if not sizes:
        return None
    languages = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))]), F.col("__lang"))
    chosen = rows.filter(F.col("__lang").isin(languages) & (unit_hash(F.col("__text"), F.lit("sample")) < rate)).repartition(8, F.xxhash64("__text"))

    place = {k: i for i, k in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def rows_of() -> Iterator[pa.RecordBatch]:
            for lang, found in sorted(counts.items()):
                bucket = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang)), pa.array(bucket), pa.array(found[bucket])], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                if len(data) >= 20:
                    if place[lang] not in counts and len(counts) >= HELD:
                        yield from rows_of()
                    counts[place[lang]] = counts.get(place[lang], 0) + np.bincount(_codes(data), minlength=BUCKETS)
        yield from rows_of()

    def packed(rows: pa.Table) -> pa.Table:
        counts = np.bincount(rows.column("bucket").to_numpy(), rows.column("n").to_numpy(), BUCKETS)
        return pa.table({"lang": rows.column("lang").slice(0, 1), "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary())})

    # summed by language before they come to the driver: one row of a fixed size each
    sums = chosen.mapInArrow(counted, "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    for r in sums.groupBy("lang").applyInArrow(packed, "lang bigint, counts binary").collect():
        counts[r[0]] = np.frombuffer(bytes(r[1]), np.int64)
    model = TextModel(languages, counts, np.zeros((len(languages), 2)))
    scored = chosen.withColumn("__n", F.octet_length("__text")).filter("__n >= 200").select("__lang", F.element_at(text_scores(F.col("__text"), model), (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("__lang"))).cast("int")).alias("m"))
    usual = {r[0]: (r[1], r[2]) for r in scored.groupBy("__lang").agg(F.avg("m"), F.coalesce(F.stddev_pop("m"), F.lit(0.0))).collect()}
    floor = min((u[0] for u in usual.values()), default=-9.0)
    model.usual = np.array([usual.get(k, (floor, 0.0)) for k in languages])
    return model


def text_scores(text: Column, model: TextModel) -> Column:
    """An array with the mean log likelihood of a text for each language, then its number of trigrams. The model has a fixed size."""

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            m, n = model.means(t.encode())
            out.append([*m.tolist(), float(n)])
        return pd.Series(out)

    return scores(text)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host without dots is its own domain."""
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def _log_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum_arrays(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host: Column | None = None, *, model: TextModel | None = None) -> DataFrame:
    """One row a row of docs: __id, __key, declared, host, text_language, detected, posterior, kept.

    Null text counts as empty and has no text evidence; null or unknown declarations and hosts have none either. A text without a pair of letters,
    one that "und" explains best, or one whose best posterior is under SURE is not kept. Tables without labelled rows have one class, "und"; an empty table gives no rows. Of languages that tie
    the first by code stands. Whole texts are read, in pieces; rows that repeat are judged alike and all stay, each a vote of its host. Other columns do not matter.
    """
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(declared_col).cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})", 1)) if declared_col else F.lit("")
    declared = F.when(declared != "", declared)
    model = model or fit(docs, text_col, declared)
    host = F.lit(None).cast("string") if host is None else host
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).cast(kind).alias("__id"), row_key(id_col, text_col).alias("__key"), declared.alias("declared"), host.alias("host"), text_or_empty(text_col).alias("__text"))
    if model is None:
        return slim.select("__id", "__key", "declared", "host", *[F.lit("und").alias(c) for c in ("text_language", "detected")], F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    known = model.languages
    n, names = len(known), F.array(*[F.lit(x) for x in known])
    rows = cut(slim.select("__id", "__key", "declared", "host", text_scores(F.col("__text"), model).alias("__s")), "langid")
    size = F.element_at("__s", n + 1)
    weight = F.least(F.lit(MOST_TRIGRAMS), size)
    # "und": what the likeliest language reaches at so many spreads under its usual mean; short texts spread more
    slack = [math.fsum((m, -SPREADS * max(s, 0.05))) for m, s in model.usual.tolist()]
    und = (F.lit(min(slack)) - F.lit(15.0) / F.sqrt(F.greatest(size, F.lit(1.0)))) * weight
    text = F.transform(F.slice("__s", 1, n), lambda m: m * weight)
    said = F.transform(names, lambda k: F.when(~F.coalesce(F.col("declared").isin(known), F.lit(False)), 0.0).when(F.col("declared") == k, math.log(DECLARED)).otherwise(math.log((1 - DECLARED) / max(1, n - 1))))
    ending = F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([a-z]{2})$", 1)
    ends = [F.lit(x) for s, v in SUFFIXES.items() if v in known for x in (s, v)]
    of = F.element_at(F.create_map(*ends), ending) if ends else F.lit(None).cast("string")
    suffix = F.transform(names, lambda k: F.when(of.isNull(), 0.0).when(of == k, math.log(SUFFIX)).otherwise(math.log((1 - SUFFIX) / max(1, n - 1))))
    rows = rows.withColumns({"__text": text, "__und": und, "__said": _sum_arrays(said, suffix), "domain": domain_of(F.col("host"))})
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    # what each row looks like without its host, as one vote
    rows = rows.withColumn("__vote", best(_sum_arrays(F.col("__text"), F.col("__said"))))
    votes = cut(rows.filter(size > 0).groupBy("host", "domain", "__vote").agg(F.count("*").alias("n")), "hosts")

    def by(*cols: str) -> DataFrame:
        """cols and __h, the votes for each language."""
        sums = votes.groupBy(*cols, "__vote").agg(F.sum("n").cast("double").alias("n"))
        found = sums.groupBy(*cols).agg(F.map_from_entries(F.collect_list(F.struct("__vote", "n"))).alias("__m"))
        return found.select(*cols, F.transform(names, lambda k: F.coalesce(F.element_at("__m", k), F.lit(0.0))).alias("__h"))

    total = by().first()
    total = total and total[0]
    total = [(x or 0.0) + 1.0 for x in (total or [0.0] * n)]
    world = _log_array([x / sum(total) for x in total])
    smooth = lambda counts, above: F.zip_with(counts, above, lambda c, p: (c + p * STRENGTH) / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + STRENGTH))
    domains = by("domain").select(F.col("domain").alias("__dom"), smooth(F.col("__h"), world).alias("__pd"))
    priors = by("host", "domain").filter("host is not null").join(domains, F.col("domain") == F.col("__dom"))
    priors = cut(priors.select(F.col("host").alias("__host"), smooth(F.col("__h"), F.col("__pd")).alias("__prior"), F.aggregate("__h", F.lit(0.0), lambda a, b: a + b).alias("__votes")), "priors")
    if priors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(priors), F.col("host") == F.col("__host"), "left")
    else:  # rows without a host need no join, and those of a hot host are in no one task
        bare = rows.filter("host is null").withColumns({c: F.lit(None).cast(priors.schema[c].dataType) for c in priors.columns})
        rows = join_hot(rows.filter("host is not null"), priors, "host", "__host", "__votes", rows.count(), "left").unionByName(bare)
    prior = F.transform(F.coalesce("__prior", world), lambda p: F.log(p))
    rows = rows.withColumn("__all", _sum_arrays(F.col("__text"), F.col("__said"), prior))
    top = F.greatest(F.array_max("__all"), F.col("__und") + math.log(1e-3))
    mass = F.aggregate(F.transform("__all", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b) + F.exp(F.col("__und") + math.log(1e-3) - top)
    rows = rows.withColumn("posterior", F.exp(F.array_max("__all") - top) / mass)
    blank = size < 1
    rows = rows.withColumn("detected", F.when(blank | (F.col("__und") + math.log(1e-3) > F.array_max("__all")), "und").otherwise(best(F.col("__all"))))
    return rows.select("__id", "__key", "declared", "host", F.when(blank, "und").otherwise(best(F.col("__text"))).alias("text_language"), "detected", "posterior", ((F.col("detected") != "und") & (F.col("posterior") >= SURE)).alias("kept"))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as identify() reads them: id, text without markup, declared language, host."""
    html = text_or_empty(html_col)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>|&[A-Za-z0-9#]{1,10};", " ")
    return pages.select(F.col(id_col), bare.alias("text"), F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1).alias("lang"), url_host(text_or_empty(url_col)).alias("host"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of docs whose language is known."""
    found = identify(docs, id_col, text_col, declared_col, F.lower(F.col(host_col).cast("string")))
    return without(docs, cut(found.filter(~F.col("kept")).select("__key"), "rejected"), id_col, text_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the source is the host. A source without dots has no suffix; pages, whose addresses have, are read by language_of_pages."""
    out = identify(table(spark, sf_dir, "documents"), host=F.lower(F.col("source")))
    return out.select(F.col("__id").alias("doc_id"), "declared", "text_language", "detected", F.round("posterior", 6).alias("posterior"), "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: their text without markup, the language that the markup declares, the suffix of the address and the priors of its host."""
    out = identify(page_evidence(table(spark, sf_dir, "pages")), "page_id", host=F.col("host"))
    return out.select(F.col("__id").alias("page_id"), "declared", "host", "text_language", "detected", F.round("posterior", 6).alias("posterior"), "kept")
