"""Exact deduplication by content-defined chunk recipes.

Each document is cut where a rolling hash of the last bytes says so, so that equal texts are cut alike.
Chunks become verified identifiers: a 64-bit fingerprint stands for a chunk if every chunk that has it
also has the same SHA-256 and length; chunks that share a fingerprint without being equal get identifiers of their own
from the digest. Documents are then compared as ordered lists of identifiers, so that no document's text is
shuffled: what moves is about 40 bytes a kilobyte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import cut, join_hot, table, text_or_empty

#: Average, least and largest bytes of a chunk.
AVERAGE, LEAST, MOST = 2048, 512, 16384
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Identifiers of a list up to which a hot one is broadcast; a longer one is 128 kB of text or more a row, so that even hot ones are few for their bytes.
SHORT = 64
_SPAN = 64  # bytes that the rolling hash sees


def boundaries(data: bytes, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of data; the last is len(data)."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    marks: list[np.ndarray] = []
    step = 1 << 20
    for at in range(0, n, step):  # in pieces, so that long texts need no more memory
        low = max(0, at - _SPAN)
        h = _GEAR[np.frombuffer(data, np.uint8, min(n, at + step) - low, low)]
        for k in (1, 2, 4, 8, 16, 32):
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        hit = np.flatnonzero((h >> np.uint64(40)) % np.uint64(average) == 0) + low + 1
        marks.append(hit[hit > at])
    ends, last = [], 0
    for end in np.concatenate(marks).tolist():
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least and end < n:
            ends.append(end)
            last = end
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n]


def recipe(data: bytes, fingerprint_bits: int, average: int, least: int, most: int) -> tuple[list[int], list[bytes]]:
    """Fingerprints and SHA-256 digests of the chunks of data."""
    prints, digests, last, shift = [], [], 0, 64 - fingerprint_bits
    for end in boundaries(data, average, least, most):
        part = data[last:end]
        prints.append((xxhash.xxh64_intdigest(part) >> shift) - (1 << 63 if not shift else 0))
        digests.append(hashlib.sha256(part).digest())
        last = end
    return prints, digests


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fingerprint_bits: int = 64, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row a document: __id, __sha (of the normalised text), __size, __fp and __dg (fingerprints and digests of its chunks in order)."""
    # every run but the single space, which stands for itself
    normal = F.regexp_replace(text_or_empty(text_col), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, dgs, sizes, shas = [], [], [], []
            for value in batch.column("__text"):
                data = value.as_buffer().to_pybytes()
                fp, dg = recipe(data, fingerprint_bits, average, least, most)
                fps.append(fp)
                dgs.append(dg)
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(shas, pa.string()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(dgs, pa.list_(pa.binary()))],
                names=["__id", "__sha", "__size", "__fp", "__dg"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), normal.alias("__text")).mapInArrow(chunked, f"__id {kind}, __sha string, __size bigint, __fp array<bigint>, __dg array<binary>")


def verified(recipes: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one chunk. Digests are pre-aggregated in each task, so a hot chunk is one row there."""
    chunks = recipes.select(F.explode(F.arrays_zip("__fp", "__dg")).alias("c")).select("c.*")
    return chunks.groupBy("__fp").agg(F.min("__dg").alias("lo"), F.max("__dg").alias("hi")).filter("lo <> hi").select(F.col("__fp").alias("__bad"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a row of docs: __id, keep_id, group_size, kept, __sha.

    Texts are equal when identical after each run of white space became one space; null counts as empty. Of equal texts
    the smallest id stays, nulls last; of rows that agree in id and text exactly one stays. An empty table gives no rows.
    """
    recipes = cut(chunk_recipes(docs, id_col, text_col, **options), "recipes")
    bad = cut(verified(recipes), "collisions")
    exact = F.flatten(F.transform("__dg", lambda d: F.array(F.xxhash64(d), F.xxhash64(d, F.lit(1)))))
    if bad.isEmpty():
        rows = recipes.withColumn("__list", F.col("__fp"))
    else:
        # rare: only documents with such a chunk spell it by its digest, the others keep their lists
        hit = recipes.select("__sha", F.explode("__fp").alias("__bad")).join(bad, "__bad", "left_semi").select(F.col("__sha").alias("__hit")).distinct()
        rows = recipes.join(hit, F.col("__sha") == F.col("__hit"), "left").withColumn("__list", F.when(F.col("__hit").isNotNull(), exact).otherwise(F.col("__fp"))).drop("__hit")
        rows = rows.withColumn("__list", F.when(F.size("__list") == 0, F.col("__fp")).otherwise(F.col("__list")))
    # the ordered list is the key that is compared; the size ends it
    rows = rows.withColumn("__list", F.concat("__list", F.array("__size")))
    copies = rows.groupBy("__list", "__id").agg(F.count("*").alias("__n"), F.first("__sha").alias("__sha"))
    groups = copies.groupBy("__list").agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("group_size"), F.count("*").alias("__ids"))
    many = cut(groups.filter("group_size > 1").select(F.col("__list").alias("__key"), "keep_id", "group_size", "__ids"), "groups")
    out = join_hot(copies, many, "__list", "__key", "__ids", recipes.count(), "left", F.size("__key") <= SHORT)
    out = out.withColumns({"keep_id": F.when(F.col("__key").isNull(), F.col("__id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))})
    out = out.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return out.select("__id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), ((F.col("__nth") == 1) & F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"), "__sha")


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null counts as empty; of rows that repeat an id and text one is kept; whole texts are read, however long."""
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))


OP3_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
