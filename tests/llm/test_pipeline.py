"""The pipeline on a small corpus with planted cases, and its edges."""

import collections
import random

import corpus_pipeline
import pytest

from lodestat.llm import registry
from lodestat.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PARTS = {"en": ["the", "ing", "tion", "and", "wh", "er"], "fr": ["eau", "é", "ment", "le", "que", "ou"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda k, n: " ".join("".join(rng.choice(PARTS[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, say("en", 30) + ". " + say("en", 10) + ".") for i in range(5)]
    rows = [(i, say("en" if i % 3 else "fr", rng.randint(60, 200)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(200)]
    copies = [(300 + i, rows[i][1], rows[i][2], "s0") for i in range(30)]
    near = [(400 + i, rows[i][1] + "\nEnd.", rows[i][2], "s1") for i in range(30)]
    leaks = [(500 + i, say("en", 80) + "\n" + items[i % 5][1] + "\n" + say("en", 80), "en", "s2") for i in range(10)]
    junk = [(600, "", "en", "s3"), (601, None, None, None), (602, "0101 ## 11", "en", "s3")]
    folder = tmp_path_factory.mktemp("sf")
    frame = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows + copies + near + leaks + junk], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, corpus):
    docs, ids = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, corpus))
        ids[name] = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert docs.columns[:5] == COLUMNS
    clean = set(range(200))
    assert clean <= set(ids["language"]) and not {600, 601, 602} & set(ids["language"])
    assert clean <= set(ids["simhash"]) and not set(range(300, 330)) & set(ids["simhash"]) and max(ids["simhash"].values()) == 1
    assert set(ids["leaks"]) == set(ids["simhash"]) - set(range(500, 510)) and clean <= set(ids["leaks"])
    assert max(ids["mix"].values()) <= 2 and set(ids["mix"]) <= set(ids["leaks"])
    assert ids["shards"] == ids["mix"]
    by = collections.defaultdict(list)
    for r in docs.select("shard", "slot").collect():
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_repeats_and_stays_whole(spark, corpus):
    one, two = (sorted(map(str, corpus_pipeline.run(spark, corpus).collect())) for _ in range(2))
    assert one == two and one


def test_extra_columns_and_empty_tables(spark, corpus):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 20").withColumns({"shard": F.lit("x"), "size": F.lit(1), "target": F.lit(None).cast("int"), "component_id": F.lit(7)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if name != "shards":
            assert out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, docs.limit(0), corpus).count() == 0


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in registry.QUERIES if k != "language_of_pages"] == [f"op{i}" for i in range(1, 14)]  # op8's operator has a query for either table
