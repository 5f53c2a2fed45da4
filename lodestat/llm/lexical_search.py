"""Ranked lexical search by dual trees: for every item the documents with the highest scores, exactly.

Documents are batches in the order of the terms that weigh most in them, and a batch is a tree; so are the items. A node holds, of each term, the largest
value below it: of documents how far the term's count saturates, of items the term's weight. The product of two nodes bounds the score of any item with any document below
them, so a pair of nodes is left out, with all below it, if that is less than the weakest k-th score of the node's items. A first search of a
bounded sample gives k-th scores for all tasks to begin with: lower bounds, so that results do not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestat.llm.common import cut, table, text_or_empty, unit_hash

TOP = 50
#: Items whose trees and terms are broadcast at once, in bytes of text; more items are searched in turn.
BLOCK_BYTES = 16 << 20
#: Documents of a tree and terms that they may have together; documents or nodes below a node; items below a node.
BATCH, BATCH_TERMS, FAN, ITEM_FAN = 4096, 1 << 21, 16, 6
#: Documents, in expectation, whose scores give the first k-th scores.
SAMPLE = 8192
#: Parts of an item's candidates that are ranked apart before they meet.
SALTS = 32

_KEEP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Bytes to terms: A-Z in lower case, what is no part of a term a blank. All bytes of other characters are parts of terms.
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Rows:
    """Sparse rows: row i has the terms and values from start[i] to start[i + 1]; terms ascend in a row."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.start, self.term, self.value = start, term, value

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        start = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.term[at], self.value[at])

    def above(self, fan: int) -> Rows:
        """Rows of the largest values of each term in `fan` rows after one another."""
        of = np.repeat(np.arange(len(self)) // fan, np.diff(self.start))
        order = np.lexsort((self.term, of))
        of, term, value = of[order], self.term[order], self.value[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (term[1:] != term[:-1])]) if len(of) else np.empty(0, np.int64)
        most = np.maximum.reduceat(value, first) if len(first) else value
        return Rows(np.searchsorted(of[first], np.arange(-(-len(self) // fan) + 1)), term[first], most)

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product of each row with a dense row."""
        sums = np.r_[0, np.cumsum(dense[self.term] * self.value)]
        return sums[self.start[1:]] - sums[self.start[:-1]]


def by_weight(rows: Rows, weigh: np.ndarray, places: int = 3) -> np.ndarray:
    """An order of rows in which rows with the same heaviest terms stand together."""
    of, score = np.repeat(np.arange(len(rows)), np.diff(rows.start)), weigh[rows.term] * rows.value
    order = np.lexsort((rows.term, -score, of))
    heavy = np.full((places, len(rows)), -1, np.int64)
    size = np.diff(rows.start)
    for i in range(places):
        has = size > i
        heavy[i, has] = rows.term[order[rows.start[:-1][has] + i]]
    return np.lexsort(heavy[::-1])


def tree(rows: Rows, fan: int) -> list[Rows]:
    """Levels from the rows themselves up to one node."""
    levels = [rows]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].above(fan))
    return levels


class Items:
    """The tree of a block of items: terms with weights."""

    def __init__(self, vectors: list[dict[int, int]], n_terms: int, top: int) -> None:
        start = np.r_[0, np.cumsum([len(v) for v in vectors])].astype(np.int64)
        pairs = [p for v in vectors for p in sorted(v.items())]
        rows = Rows(start, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
        self.order = by_weight(rows, np.ones(n_terms, np.int64)) if vectors else np.empty(0, np.int64)
        self.levels, self.n_terms, self.top = tree(rows.take(self.order), ITEM_FAN) if vectors else [rows], n_terms, top
        self.weigh = np.zeros(n_terms, np.int64)
        np.maximum.at(self.weigh, rows.term, rows.value)


class Search:
    """Per item the best so far: scores, and ids of documents in their order."""

    def __init__(self, items: Items, least: np.ndarray, id_kind: pa.DataType) -> None:
        self.items, self.least, self.id_kind = items, least.copy(), id_kind  # least: a score that k documents are known to have, by place in the tree
        self.best: list[tuple[np.ndarray, pa.Array]] = [(np.empty(0, np.int64), pa.array([], id_kind))] * len(least)
        self.dense = np.zeros(items.n_terms, np.int64)
        self.compared = 0

    def add(self, rows: Rows, ids: pa.Array) -> None:
        """Compares a batch of documents, as a tree, with all items."""
        order = by_weight(rows, self.items.weigh)
        self.ids, self.docs = ids.take(pa.array(order)), tree(rows.take(order), FAN)
        if len(self.best):
            self._visit(len(self.items.levels) - 1, 0, len(self.docs) - 1, np.arange(len(self.docs[-1])))

    def _visit(self, level: int, node: int, depth: int, docs: np.ndarray) -> None:
        """An item node against nodes of one level of the documents; goes down on the side, or both, that has levels left."""
        own = self.items.levels[level]
        at = slice(own.start[node], own.start[node + 1])
        self.dense[own.term[at]] = own.value[at]
        bound = self.docs[depth].take(docs).times(self.dense)
        self.dense[own.term[at]] = 0
        self.compared += len(docs)
        span = ITEM_FAN**level
        weakest = self.least[node * span : (node + 1) * span].min()
        keep = (bound > 0) & (bound >= weakest)
        if not keep.any():
            return
        docs, bound = docs[keep], bound[keep]
        if level == 0 and depth == 0:
            self._take(node, docs, bound)
            return
        if level == 0 and depth == 1:
            # an item's documents: first those of the most promising nodes, then the nodes that the k-th score still lets through
            order = np.argsort(-bound, kind="stable")
            first = 2 * -(-self.items.top // FAN)
            self._visit(0, node, 0, self._below(docs[order[:first]], 0))
            rest = order[first:][bound[order[first:]] >= self.least[node]]
            if len(rest):
                self._visit(0, node, 0, self._below(docs[rest], 0))
            return
        if depth:
            docs = self._below(docs, depth - 1)
        if level:
            for child in range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, len(self.items.levels[level - 1]))):
                self._visit(level - 1, child, max(0, depth - 1), docs)
        else:
            self._visit(0, node, depth - 1, docs)

    def _below(self, docs: np.ndarray, depth: int) -> np.ndarray:
        docs = (docs[:, None] * FAN + np.arange(FAN)).ravel()
        return docs[docs < len(self.docs[depth])]

    def _take(self, item: int, docs: np.ndarray, score: np.ndarray) -> None:
        top, (old, ids) = self.items.top, self.best[item]
        if len(docs) > top:  # ties with the k-th stay in for now
            keep = score >= np.partition(score, len(score) - top)[len(score) - top]
            docs, score = docs[keep], score[keep]
        score, ids = np.concatenate([old, score]), pa.concat_arrays([ids, self.ids.take(pa.array(docs))])
        first = pa.table({"score": score, "id": ids}).sort_by([("score", "descending"), ("id", "ascending")]).slice(0, top)
        self.best[item] = (first["score"].to_numpy(), first["id"].combine_chunks())
        if len(first) == top:
            self.least[item] = max(self.least[item], int(self.best[item][0][-1]))

    def found(self) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
        for place, (score, ids) in enumerate(self.best):
            keep = np.flatnonzero(score >= self.least[place])
            if len(keep):
                yield int(self.items.order[place]), score[keep], ids.take(pa.array(keep))


def vectors(docs: DataFrame, vocab: list[bytes]) -> DataFrame:
    """(__id, n, term, tf): of each document, with n terms in all, the terms that are in vocab, as places there, and how often."""
    place = {t: i for i, t in enumerate(vocab)}
    sent = docs.sparkSession.sparkContext.broadcast(place)  # terms of a block of items

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            size, start, term, tf = [], [0], [], []
            for text in batch.column("__text"):
                found = terms(text.as_buffer().to_pybytes())
                size.append(len(found))
                at = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
                t, c = np.unique(at[at >= 0], return_counts=True)
                term.append(t)
                tf.append(c)
                start.append(start[-1] + len(t))
            lists = [pa.LargeListArray.from_arrays(pa.array(start, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64))).cast(pa.list_(pa.int64())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(size, pa.int64()), *lists], names=["__id", "n", "term", "tf"])

    return docs.mapInArrow(made, f"__id {docs.schema['__id'].dataType.simpleString()}, n bigint, term array<bigint>, tf array<bigint>")


def search(found: DataFrame, items: Items, least: np.ndarray, documents: int, length: int) -> DataFrame:
    """(item, __id, score): of each task the best documents of each item. found: vectors. A task holds a batch of documents and k results an item."""
    id_kind = to_arrow_type(found.schema["__id"].dataType)
    sent = found.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = sent.value
        state = Search(items, least, id_kind)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                sizes = np.concatenate([h[1] for h in held])
                rows = Rows(np.r_[0, np.cumsum(sizes)], *(np.concatenate([h[i] for h in held]) for i in (2, 3)))
                state.add(rows, pa.concat_arrays([h[0] for h in held]))
                held.clear()

        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH // 4):
                part = batch.slice(begin, BATCH // 4)
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf"))
                size = np.array([len(x) for x in part.column("term")], np.int64)
                m = np.array([50 + 50 * n * documents // max(1, length) for n in part.column("n").to_pylist()], np.int64)
                held.append((part.column("__id"), size, term, (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size))))
                if sum(len(h[1]) for h in held) >= BATCH or sum(len(h[2]) for h in held) >= BATCH_TERMS:
                    flush()
        flush()
        for item, score, ids in state.found():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), ids, pa.array(score)], names=["item", "__id", "score"])

    return found.select("__id", "n", "term", "tf").mapInArrow(run, f"item bigint, __id {found.schema['__id'].dataType.simpleString()}, score bigint")


def best(candidates: DataFrame, top: int) -> DataFrame:
    """The best `top` rows of each item with rank, in two steps, so that no task ranks all of an item's candidates."""
    order = [F.col("score").desc(), F.col("__id").asc_nulls_last()]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("__id", "score"), F.lit(SALTS)))
    for by in (["item", "salt"], ["item"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return salted.select("item", F.col("rank").cast("int").alias("rank"), "__id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE) -> DataFrame:
    """(item_id, rank, __id, score): of each row of items the `top` documents with the highest scores above 0; equal scores by ascending id, null ids last.

    Null and empty texts have no terms: such documents are found by nobody and do not count, such items find nothing. Rows that repeat are documents, or items, of their own.
    Whole texts are read. Empty tables give no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    item_kind, id_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    items = items.select(F.col(item_col).alias("__item"), F.col(item_text_col).cast("string").alias("__text")).filter("__text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("__block", F.pmod(F.xxhash64("__text", F.col("__item").cast("string")), F.lit(blocks)))
    out = spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, __id {id_kind.simpleString()}, score bigint")
    for k in range(blocks):
        rows = [(r[0], set(terms(r[1].encode()))) for r in items.filter(F.col("__block") == k).select("__item", "__text").collect()]  # at most a block
        rows = [r for r in rows if r[1]]
        if not rows:
            continue
        vocab = sorted(set().union(*(t for _, t in rows)))
        found = cut(vectors(slim, vocab), "vectors")
        documents, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r[0]: r[1] for r in found.select(F.explode("term").alias("term")).groupBy("term").count().collect()}  # terms of the block
        place = {t: i for i, t in enumerate(vocab)}
        weights = [weight(documents, df.get(i, 0)) for i in range(len(vocab))]
        block = Items([{place[t]: weights[place[t]] for t in r[1] if weights[place[t]] > 0} for r in rows], len(vocab), top)
        least = np.zeros(len(rows), np.int64)
        if documents > sample:  # a k-th score of some documents is no more than that of all
            few = found.filter(unit_hash(F.col("__id"), F.col("n"), F.lit("sample")) < sample / documents).repartition(8)
            back = {int(o): i for i, o in enumerate(block.order)}
            for r in best(search(few, block, least, documents, length), top).filter(F.col("rank") == top).collect():
                least[back[r["item"]]] = r["score"]
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"__place bigint, item_id {item_kind.simpleString()}")
        got = best(cut(search(found, block, least, documents, length), "candidates"), top).join(F.broadcast(names), F.col("item") == F.col("__place"))  # names: items of the block
        out = out.unionByName(got.select("item_id", "rank", "__id", "score"))
    return out


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 50 best documents. Null and empty texts are not found, repeated rows each; ties go by doc_id."""
    out = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("item_id", "rank", F.col("__id").alias("doc_id"), "score")


OP11_SQL = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM b JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
