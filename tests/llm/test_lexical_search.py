"""Ranked lexical search: dual trees against scores of all pairs."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestat.llm import lexical_search as s


def found(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, top):
    """Scores of all pairs by the formula."""
    counts = [(i, collections.Counter(found(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(x[2] for x in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = collections.Counter()
    for item, text in items:
        rows = []
        for i, c, size in counts:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(found(text)) if c[t])
            if score > 0:
                rows.append((-score, i is None, i, score))
        for rank, (_, _, i, score) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[:top], 1):
            out[item, rank, i, score] += 1
    return out


def world(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "naïve", "日本", "a1"]
    zipf = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, zipf, k=draw.randint(0, 40)))) for i in range(n)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w50 w51 W52"), (7, "w50 w51 W52"), (n + 1, None), (n + 2, ""), (n + 3, "\x00.,;"), (n + 4, "w3 " * 30_000), (n + 5, "x-Y_z")]
    docs += [(n + 10 + i, "w40 w41 w42 w43 copy") for i in range(150)]  # ties
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(40)]
    items += [(100, "w40 w41 w42 w43 copy"), (101, None), (102, ""), (103, "nowhere"), (104, "w3"), (104, "w3"), (None, "x y Z"), (105, "w1 " * 500 + ".W1")]
    return docs, items


@pytest.mark.parametrize(("block_bytes", "sample", "top"), [(1 << 24, 8192, 50), (400, 64, 7), (1 << 24, 100, 3)])
def test_ranked_agrees_with_all_pairs(spark, block_bytes, sample, top):
    docs, items = world(top, 700)
    frame = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, item long, score string").repartition(5)
    got = s.ranked(frame, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, rank int"), top=top, block_bytes=block_bytes, sample=sample)
    assert collections.Counter((r.item_id, r["rank"], r["__id"], r.score) for r in got.collect()) == plain(docs, items, top)


def test_ids_of_strings_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "one")], "item_id string, text string")
    assert [(r["rank"], r["__id"]) for r in s.ranked(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert s.ranked(docs.limit(0), items).count() == 0
    assert s.ranked(docs, items.limit(0)).count() == 0


def test_batches_are_pruned_whole():
    """Of documents on 30 topics an item is compared with few nodes of other topics, and known k-th scores leave out more."""
    draw = np.random.default_rng(3)
    n, topic, topics = 4096, 20, 30
    term = np.sort(np.array([draw.choice(topic, 6, replace=False) + topic * (i % topics) for i in range(n)]), axis=1)
    rows = s.Rows(np.arange(0, 6 * n + 1, 6), term.ravel(), draw.integers(1, 1000, 6 * n))
    items = s.Items([{int(t): 5 for t in draw.choice(topic, 4, replace=False) + topic * (i % topics)} for i in range(48)], topic * topics, 5)
    first = s.Search(items, np.zeros(48, np.int64), pa.int64())
    first.add(rows, pa.array(np.arange(n)))
    again = s.Search(items, first.least, pa.int64())
    again.add(rows, pa.array(np.arange(n)))
    assert again.compared < first.compared < n * 48 / 6
    for (a, ids), (b, same) in zip(first.best, again.best, strict=True):
        assert a.tolist() == b.tolist() and ids.equals(same)
    dense = np.zeros((48, topic * topics), np.int64)
    for i, o in enumerate(items.order):
        at = slice(items.levels[0].start[i], items.levels[0].start[i + 1])
        dense[i, items.levels[0].term[at]] = items.levels[0].value[at]
        scores = rows.times(dense[i])
        assert first.best[i][0].tolist() == sorted(scores[scores > 0].tolist(), reverse=True)[:5], o


def test_query_agrees_with_sql(spark):
    got = sorted(map(tuple, s.op11_dual_tree_search(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({s.OP11_SQL})").fetchall())
    assert got
