"""A frontier kept by a stream: of every month and group the k best values, whatever the order in which rows come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["month", "grp"]
_OUT = "month string, grp string, version bigint, n bigint, rank int, value double"


class Best(StatefulProcessor):
    """Keeps the k best values of a key and how many there were; each batch that brings values gives the key's frontier anew, with the next version."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "version bigint, n bigint, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, n, best = self.best.get() if self.best.exists() else (0, 0, [])
        best = list(best)
        for part in rows:
            values = part["value"].dropna()
            n += len(values)
            best = sorted([*best, *values.nlargest(self.k).tolist()], reverse=True)[: self.k]
        self.best.update((version + 1, n, best))
        yield pd.DataFrame({"month": key[0], "grp": key[1], "version": version + 1, "n": n, "rank": range(1, len(best) + 1), "value": best})

    def close(self) -> None:
        pass


def linked(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a table that does not change (columns `on`, `grp`, one row a key); rows without a link go to the group unlinked."""
    s = static.select(F.col(on).alias("__on"), "grp")
    return events.join(s, F.col(on) == F.col("__on"), "left").drop("__on").withColumn("grp", F.coalesce("grp", F.lit("unlinked")))


def frontier_stream(events: DataFrame, k: int) -> DataFrame:
    """Updates of the frontier of a stream with ts, grp and value; the session must use the RocksDB state store."""
    rows = events.select(F.date_format("ts", "yyyy-MM").alias("month"), "grp", F.col("value").cast("double").alias("value"))
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=Best(k), outputStructType=_OUT, outputMode="Update", timeMode="None")


def latest(updates: DataFrame) -> DataFrame:
    """(month, grp, n, rank, value) of the last version of each key."""
    last = updates.groupBy(*[F.col(c).alias(f"__{c}") for c in KEYS]).agg(F.max("version").alias("__version"))
    same = (F.col("month") == F.col("__month")) & (F.col("grp") == F.col("__grp")) & (F.col("version") == F.col("__version"))
    return updates.join(last, same).select(*KEYS, "n", "rank", "value")


def frontier_batch(events: DataFrame, k: int) -> DataFrame:
    """The same of a table that is all there: the stream must end there."""
    rows = events.select(F.date_format("ts", "yyyy-MM").alias("month"), "grp", F.col("value").cast("double").alias("value")).filter("value is not null")
    n = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in KEYS]).agg(F.count("*").alias("n"))
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("value")))).filter(F.col("rank") <= k)  # tasks keep k rows a key before the shuffle
    return top.join(n, (F.col("month") == F.col("__month")) & (F.col("grp") == F.col("__grp"))).select(*KEYS, "n", "rank", "value")


def run(spark: SparkSession, updates: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream of updates to the end of what is there, into a table in memory, and gives the last state. The state store is set for this run only."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        writer = updates.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True)
        q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
    finally:
        spark.conf.set(setting, before)
    return latest(spark.table(name))
