"""URL filters: cascades are exact, rules and lists agree with a plain loop."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestat.llm import url_filter as u

PAGES = "page_id long, url string, html string"


def plain(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = lambda h, p: host != "" and (host == h or host.endswith("." + h)) and path.startswith(p)
    found = sorted([(-len(h + p), -h.count("."), h + p) for h, p, _ in rules if fits(h, p)])
    if found:
        rule = found[0][2]
        return host, path, rule, "block" if any(h + p == rule and v == "block" for h, p, v in rules) else "allow"
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("most_bits", [u.MOST_BITS, 200])
def test_judge_agrees_with_a_loop(spark, most_bits):
    draw = random.Random(5)
    labels = ["a", "b", "cc", "shop", "www", "x-y", "ORG", "com", "net"]
    urls = [None, "", "no scheme", "http://", "://a.com/x", "http://.com/", "HTTP://A.B.com?x/y", "http://a.com#/b", "http://a..com/b/", "http://a.com:80/b", "x://y://z/p", "http://ünï.com/é", "http://" + "a." * 5000 + "com/" + "p" * 20_000]
    urls += [f"http://{'.'.join(draw.choice(labels) for _ in range(draw.randint(1, 5)))}/{draw.choice(['', 'b', 'b/c', 'en/1', 'en/12?q=1'])}" for _ in range(400)]
    rules = [("com", "/", "allow"), ("a.com", "/b", "block"), ("com", "/b", "allow"), ("b.com", "", "block"), ("net", "/en/1", "block"), ("net", "/en/1", "allow"), ("shop.net", "/", "allow")]
    listed = [("org", ""), ("x-y.net", ""), ("www.org", "/b"), ("cc", "/en/"), ("not.there", "")] + [(f"h{i}.net", "") for i in range(50)]
    pages = frame(spark, [(i, x, None) for i, x in enumerate([*urls, *urls[:20]])], PAGES)
    got = u.judge(pages, frame(spark, rules + rules[:1] + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string"), frame(spark, listed, "host string, path string"), most_bits=most_bits)
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules, listed), r.url[:80]
    assert got.count() == len(urls) + 20


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = u.build(keys)
    assert keys.filter(cascade.has(F.col("key")) != F.col("listed")).count() == 0
    assert 2 <= len(cascade.levels) <= 20
    assert cascade.bits < 60_000 * 8  # a set of such keys would take some times as much


def test_all_listed_and_none_listed(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("listed"))
    assert keys.filter(u.build(keys).has(F.col("key"))).count() == 100
    none = keys.withColumn("listed", F.lit(False))
    assert none.filter(u.build(none).has(F.col("key"))).count() == 0
    assert u.build(keys.limit(0)).levels == []


def test_empty_tables_and_clashing_columns(spark):
    no_rules, no_list = frame(spark, [], "host string, path string, verdict string"), frame(spark, [], "host string, path string")
    pages = frame(spark, [(1, "http://a.com/x", "k", "r", 5)], "page_id long, url string, __keys string, __rules string, __found int")
    for rules, listed in ((no_rules, no_list), (frame(spark, [("a.com", "/", "block")], no_rules.schema), frame(spark, [("com", "")], no_list.schema))):
        for bits in (u.MOST_BITS, 1):
            row = u.judge(pages, rules, listed, most_bits=bits).first()
            assert (row["__keys"], row["__rules"], row["__found"]) == ("k", "r", 5)
    assert (row.rule, row.verdict) == ("a.com/", "block")
    assert u.judge(pages.limit(0), rules, listed).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    got = sorted(map(tuple, u.op12_url_cascade(spark, f"/root/testdata/{sf}").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    assert got == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({u.OP12_SQL})").fetchall())
    assert {r[4] for r in got} == {"allow", "block"}


def test_domains_are_listed_by_words_and_thin_pages(spark):
    long = "<p>" + "word " * 100
    rows = [(1, "http://m.free-bets.a.com/x", long), (2, "http://bets9.a.com/", long), (3, "http://thin.a.com/", "<p>x</p>"), (8, "http://open.a.com/", "<" * 50_000), (4, "http://b.com/", long), (5, "http://b.com/2", ""), (6, "http://b.com/3", long), (7, None, None)]
    found = {(r.host, r.path) for r in u.listed_domains(frame(spark, rows, PAGES)).collect()}
    assert found == {("free-bets.a.com", ""), ("thin.a.com", "")}
