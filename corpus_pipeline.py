"""The corpus pipeline: documents to shards, in five stages.

1 language  documents whose language is not known go
2 simhash   of each group of near duplicates one document stays, that with the smallest doc_id
3 leaks     documents that leak a benchmark item go
4 mix       documents are repeated or left out so that sources reach their target weights
5 shards    documents get a shard and a slot

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared folder and gives
what it reads there to the next. All but the last return the columns of documents, extra ones included, whatever their names.

In every stage null texts count as empty, null ids are ids of their own, whole texts are read however long, ties are broken by id or by hash, so that reruns agree, and an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import decontaminate, langid, mixing, sharding, simhash
from lodestat.llm.common import cut, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified. Empty texts and texts that no language explains go. Rows that repeat are judged alike and all stay."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links and whose five-word shingles are 0.8 similar one stays, the one with the smallest doc_id; of rows that repeat one, null ids last."""
    return simhash.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that leak no item of benchmark. Rows that repeat go or stay together; without items all stay."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, cut(found.select("__key"), "leaks"), "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words reach its target; a document taken twice is two rows. Documents without words are left out; a null source is a source."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot. Repeats of a document are rows of their own."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("simhash", near_duplicates),
    ("leaks", leaks),
    ("mix", mix),
    ("shards", shards),
]

#: SQL has no language models, SimHash or BM25 with windows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
