"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

Test items are indexed (not the corpus); every passage of every document is a query. A score is divided by the item's score with
itself, so that one threshold fits all items: 1 means that the passage holds all words of the item. Passages are windows of
2h words at steps of h, where h is at least the length of the items in the index, so an item that was copied whole stands whole in one
passage. Items whose length differs much have indexes of their own. What is retrieved is verified on five-word shingles,
question and answer each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestat.llm.common import cut, row_key, table, text_or_empty

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; shingle length and overlap that verify it.
THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
#: Items in a block of the postings; least half window in words.
BLOCK, HALF = 4, 64
#: An index that is broadcast covers items of at most so many bytes; more items make more indexes, used in turn.
INDEX_BYTES = 16 << 20
#: Documents searched at once.
DOCS = 128

_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is what follows an answer mark, else the last sentence, else the last quarter of the words."""
    mark = re.search(r"(?is)\n\s*(?:answer|a)\s*[:.]\s*(.+)$", text)
    if mark and words(text[: mark.start()]):
        return words(text[: mark.start()]), words(mark[1])
    ends = [m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", text.rstrip())]
    if ends and words(text[: ends[-1]]) and words(text[ends[-1] :]):
        return words(text[: ends[-1]]), words(text[ends[-1] :])
    w = words(text)
    at = max(1, len(w) * 3 // 4)
    return w[:at], w[at:]


def shingles(w: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Index:
    """Inverted index of items of similar length, with the largest weight of a term overall and in each block of items."""

    def __init__(self, items: list[tuple[object, str]], half: int, df: dict[str, int], n_items: int, average: float) -> None:
        self.half, self.ids, self.parts = half, [], []
        self.vocab: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for key, text in items:
            counts = Counter(words(text))
            size = sum(counts.values())
            raw = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / average)) for t, c in counts.items()}
            own = sum(raw.values())
            at = len(self.ids)
            self.ids.append(key)
            question, answer = question_and_answer(text)
            self.parts.append((shingles(question), shingles(answer)))
            for t, v in raw.items():
                k = self.vocab.setdefault(t, len(postings))
                if k == len(postings):
                    postings.append([])
                postings[k].append((at, v / own))
        self.items = [np.array([p for p, _ in x], np.int64) for x in postings]
        self.weights = [np.array([w for _, w in x]) for x in postings]
        self.most = np.array([w.max() for w in self.weights] or [0.0])
        self.block_max = [{int(b): float(w[i // BLOCK == b].max()) for b in np.unique(i // BLOCK)} for i, w in zip(self.items, self.weights, strict=True)]
        # the same as flat arrays, for many passages at once
        self.n_blocks = -(-len(self.ids) // BLOCK)
        self.sizes = np.array([len(x) for x in self.block_max], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat_blocks = np.array([b for x in self.block_max for b in x], np.int64)
        self.flat_max = np.array([v for x in self.block_max for v in x.values()])

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least threshold for these distinct terms: block-max WAND."""
        low = threshold - 1e-9
        cursors = [[int(self.items[t][0]), 0, t] for t in terms]  # item, place in the postings, term
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= low:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_max[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < low:
                # nothing in this block up to the next cursor: go on behind the block, or where another term comes in
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
                self._advance(cursors, pivot + 1, to)
            elif cursors[0][0] == item:
                score = sum(float(self.weights[t][p]) for _, p, t in cursors[: pivot + 1])
                if score >= low:
                    out.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
        return out

    def _advance(self, cursors: list[list[int]], n: int, to: int) -> None:
        """Moves the first n cursors to items of at least `to`; drops those that end."""
        for c in cursors[:n]:
            if c[0] < to:
                own = self.items[c[2]]
                c[1] = int(np.searchsorted(own, to))
                c[0] = int(own[c[1]]) if c[1] < len(own) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def passages(self, docs: list[list[str]], threshold: float) -> list[tuple[int, int, np.ndarray]]:
        """(document, half, distinct terms) of the passages in which some block of items may reach the threshold: the first tests of block-max WAND, of a batch at once."""
        rooms = [len(w) // self.half + 2 for w in docs]  # at least one half is left empty behind each document
        ids = np.full((sum(rooms), self.half), -1, np.int32)
        flat, at = ids.reshape(-1), 0
        for w, room in zip(docs, rooms, strict=True):
            flat[at : at + len(w)] = np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int32, len(w))
            at += room * self.half
        owner = np.repeat(np.arange(len(docs)), rooms)
        first = np.cumsum(rooms) - rooms
        low, most = threshold - 1e-9, np.r_[self.most, 0.0]
        halves = most[ids].sum(axis=1)  # of repeated words each time: no less than the bound
        may = np.flatnonzero((halves[:-1] + halves[1:] >= low) & (owner[:-1] == owner[1:]))
        out, step = [], max(1, min(4096, (1 << 22) // max(1, self.n_blocks)))
        for k in range(0, len(may), step):
            rows = may[k : k + step]
            terms = np.sort(np.concatenate([ids[rows], ids[rows + 1]], axis=1), axis=1)
            new = terms >= 0
            new[:, 1:] &= terms[:, 1:] != terms[:, :-1]
            of, _ = np.nonzero(new)
            t = terms[new]
            sure = np.bincount(of, self.most[t], len(rows)) >= low
            of, t = of[sure[of]], t[sure[of]]
            size = self.sizes[t]
            place = np.repeat(self.starts[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            bound = np.bincount(np.repeat(of, size) * self.n_blocks + self.flat_blocks[place], self.flat_max[place], len(rows) * self.n_blocks)
            for i in np.flatnonzero(bound.reshape(len(rows), -1).max(axis=1, initial=0.0) >= low):
                doc = int(owner[rows[i]])
                out.append((doc, int(rows[i] - first[doc]), t[of == i]))
        return out

    def find(self, docs: list[list[str]], threshold: float, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
        """(document, item, first word of the passage, score, question and answer overlap) of the items that documents leak; the best passage of each."""
        found: dict[tuple[int, int], tuple[int, float, float, float]] = {}
        for doc, p, terms in self.passages(docs, threshold):
            got = self.wand(terms.tolist(), threshold)
            w, at, to = docs[doc], p * self.half, (p + 2) * self.half
            kinds = {len(s) for i, _ in got for part in self.parts[i] for s in part}
            here = {tuple(w[i : i + n]) for n in kinds for i in range(at, min(to, len(w)) - n + 1)}
            for item, score in got:
                q, a = (len(part & here) / len(part) if part else 1.0 for part in self.parts[item])
                if q >= overlap and a >= overlap and found.get((doc, item), (0, -1.0))[1] < score:
                    found[doc, item] = (at, score, q, a)
        return [(*k, *v) for k, v in sorted(found.items())]


def build_indexes(items: DataFrame, item_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """Indexes for one block of items after another; a block has at most index_bytes of text (or one item). Document frequencies are of all items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [words(x) for x in batch.column(0).to_pylist()]
            rows = [t for x in w for t in set(x)]
            yield pa.RecordBatch.from_arrays([pa.array([*rows, *[None] * len(w)], pa.string()), pa.array([*[1] * len(rows), *map(len, w)], pa.int64())], names=["term", "n"])

    items = items.select(F.col(item_col).alias("__item"), F.col(text_col).cast("string").alias("__text")).filter("__text is not null and trim(__text) <> ''")
    total, n_items = items.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)), F.count("*")).first()
    if not n_items:
        return
    counts = cut(items.select("__text").mapInArrow(terms, "term string, n bigint"), "terms")
    average = max(1.0, (counts.filter("term is null").agg(F.sum("n")).first()[0] or 1) / n_items)
    df = counts.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    blocks = -(-total // index_bytes)
    items = items.withColumn("__block", F.pmod(F.xxhash64("__text", F.col("__item").cast("string")), F.lit(blocks)))
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.filter(F.col("__block") == k).select("__item", "__text").collect()]
        rows = sorted(((key, text) for key, text in rows if words(text)), key=lambda r: (str(r[0]), r[1]))
        own = {t for _, text in rows for t in words(text)}
        freq = df if blocks == 1 else df.join(df.sparkSession.createDataFrame([(t,) for t in own] or [("",)], "term string"), "term", "left_semi")
        freq = {r[0]: r[1] for r in freq.collect()}
        classes: dict[int, list] = {}
        for key, text in rows:
            half = HALF
            while half < len(words(text)):
                half *= 2
            classes.setdefault(half, []).append((key, text))
        yield [Index(found, half, freq, n_items, average) for half, found in sorted(classes.items())]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(__id, __key, item_id, first_word, score, question_overlap, answer_overlap): one row for each document and item that it leaks.

    Null and empty texts leak nothing and are not leaked. Rows that repeat are each reported, as are items that repeat or tie. Whole texts are read, windows of a long one in turn. Null ids are reported
    as null. Other columns do not matter. Without items there are no rows.
    """
    id_kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"__id {id_kind.simpleString()}, __key string, item_id {item_kind.simpleString()}, first_word bigint, score double, question_overlap double, answer_overlap double"
    sc, out = docs.sparkSession.sparkContext, docs.sparkSession.createDataFrame([], schema)
    slim = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), text_or_empty(text_col).alias("__text"))
    item_arrow, names = to_arrow_type(item_kind), ["__id", "__key", "item_id", "first_word", "score", "question_overlap", "answer_overlap"]
    for indexes in build_indexes(items, item_col, item_text_col, index_bytes):
        sent = sc.broadcast(indexes)  # of at most index_bytes of item text

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, DOCS):
                    part = batch.slice(begin, DOCS)
                    docs = [words(x) for x in part.column(2).to_pylist()]
                    found = [(i, index.ids[item], *rest) for index in sent.value for i, item, *rest in index.find(docs, threshold, overlap)]
                    rows = pa.array([f[0] for f in found], pa.int64())
                    columns = [pa.array([f[j + 1] for f in found], kind) for j, kind in enumerate((item_arrow, pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *columns], names=names)

        out = out.unionByName(slim.mapInArrow(search, schema))
    return out


def op5_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak items of benchmark, with the items."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("__id").alias("doc_id"), "item_id", "first_word", F.round("score", 9).alias("score"), "question_overlap", "answer_overlap")
