"""URL filters by Bloom filter cascades: exact membership of listed keys without joins.

A key is a host, or a parent of it, with a prefix of a path. What can be looked up is known: the keys that the corpus's URLs have, the
universe. Level 1 of a cascade is a Bloom filter of the listed keys; level 2 one of the universe's other keys that level 1 lets through; level 3
one of the listed keys that level 2 lets through, and so on until nothing is let through wrongly. A key of the universe is listed if the first
level that rejects it has an even number (or none does and their number is odd). The filters are literals of a bounded size in the plan, so
that URLs are judged where they are read. Columns and SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, cut, free, table

#: Bits of filters that one pass over the URLs carries (4 MB); longer lists are dealt out by hash to parts, one pass each.
MOST_BITS = 1 << 25
#: Levels of which few keys are left use eight bits more a key, and end the sooner.
FEW_KEYS, FEW_RATE = 20_000, 1 / 512
MOST_LEVELS = 64

#: Rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words between dots and hyphens for which a domain is listed.
WORDS = ["ads", "adult", "bet", "bets", "casino", "escort", "loan", "loans", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "viagra", "warez", "xxx"]
#: A host is listed, too, if so large a share of its pages have less visible text than this.
THIN_CHARS, THIN_SHARE = 200, 0.5


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; null or no ://: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_at(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key of the host's last `labels` labels and the first `length` characters of the path; null if either has fewer."""
    has = (host != "") & (F.length(host) - F.length(F.replace(host, F.lit("."))) >= labels - 1) & (F.length(path) >= length)
    return F.when(has, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL in the shapes (labels, length of the path) that lists have, the longest first; of equals the one with more labels."""
    found = [F.struct((-F.length(k)).alias("size"), F.lit(-n).alias("labels"), k.alias("key")) for n, m in shapes for k in (key_at(host, path, n, m),)]
    return F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x["key"].isNotNull())), lambda x: x["key"]) if found else F.array().cast("array<string>")


def shapes_of(listed: DataFrame) -> list[tuple[int, int]]:
    """(labels, length of the path) that occur in listed (columns host, path): at most as many as hosts have labels times paths have lengths."""
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    return sorted((r[0], r[1]) for r in listed.filter("host <> ''").select(labels.alias("n"), F.length("path").alias("m")).distinct().collect())


# -- cascades ---------------------------------------------------------------------------------------


@dataclass
class Level:
    number: int
    part: int
    hashes: int
    bits: int
    words: str  # the filter's 64-bit words in decimal, by commas

    def places(self, key: Column) -> list[Column]:
        """A key's bits. The level comes before the key, so that keys which meet in one level part in the next."""
        return [F.pmod(F.xxhash64(F.lit(self.part), F.lit(self.number), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded once to a literal
        out = None
        for at in self.places(key):
            one = F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
            out = one if out is None else out & one
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed. Other keys get some answer."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def _filter(keys: DataFrame, number: int, part: int, n: int, rate: float) -> Level:
    """A Bloom filter of n keys with a rate of false positives. Tasks set the bits of their keys; only words of the filter come to the driver."""
    hashes = max(1, round(-math.log2(rate)))
    level = Level(number, part, hashes, 64 * max(1, math.ceil(n * hashes / math.log(2) / 64)), "")
    at = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    found = dict(words.collect())
    level.words = ",".join(str(found.get(i, 0)) for i in range(level.bits // 64))
    return level


def build(universe: DataFrame, part: int = 0) -> Cascade:
    """A cascade of universe: columns key and listed, one row a key. Every level reads only what the level before has left open."""
    left, levels = universe, []
    n = {r["listed"]: r["count"] for r in left.groupBy("listed").count().collect()}
    inside, outside = n.get(True, 0), n.get(False, 0)
    while inside:
        number = len(levels) + 1
        if number > MOST_LEVELS:
            raise RuntimeError("the cascade has not ended; are the keys distinct?")
        rate = 0.5 if levels else min(0.5, max(1e-6, inside * math.sqrt(0.5) / max(1, outside)))
        rate = min(rate, FEW_RATE) if inside <= FEW_KEYS else rate
        turn = number % 2 == 1
        level = _filter(left.filter(F.col("listed") == turn), number, part, inside, rate)
        levels.append(level)
        # open for the next level: keys of the other side that this level lets through, and against them the keys of this side
        left = cut(left.filter((F.col("listed") == turn) | level.has(F.col("key"))), "cascade")
        inside, outside = left.filter(F.col("listed") != turn).count(), inside
    return Cascade(levels)


def listed_keys(rows: DataFrame, keys: str, listed: DataFrame, name: str, most_bits: int = MOST_BITS) -> DataFrame:
    """rows with the column `name`: those of their keys (an array column) that are listed (column key), in the same order.

    The universe is all keys of rows. Null keys are not listed. If the lists need more than most_bits, keys are dealt out by hash to parts with a cascade each,
    and rows pass one part after the other.
    """
    universe = rows.select(F.explode(keys).alias("key")).distinct().select("key", F.lit(False).alias("listed"))
    known = listed.select("key").filter("key is not null").distinct().select("key", F.lit(True).alias("listed"))
    # a key that is listed and occurs is one row; listed keys that do not occur are looked up by nobody
    both = universe.unionByName(known).groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("occurs"))
    both = cut(both.filter("occurs").select("key", "listed"), "universe")
    n, every = both.filter("listed").count(), both.count()
    parts = max(1, math.ceil(n * (4 + 1.5 * math.log2(max(2.0, every / max(1, n)))) / most_bits))
    if parts == 1:
        cascade = build(both)
        return rows.withColumn(name, F.filter(keys, cascade.has))
    part_of = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    found = free(rows, "__found")
    rows = rows.withColumn(found, F.array().cast("array<string>"))
    for part in range(parts):
        cascade = build(both.filter(part_of(F.col("key")) == part), part)
        mine = F.filter(keys, _of_part(cascade, part_of, part))
        rows = cut(rows.withColumn(found, F.concat(found, mine)), "judged")
    return rows.withColumn(name, F.filter(keys, lambda k: F.array_contains(found, k))).drop(found)


def _of_part(cascade: Cascade, part_of: Callable[[Column], Column], part: int) -> Callable[[Column], Column]:
    return lambda key: (part_of(key) == part) & cascade.has(key)


# -- operators --------------------------------------------------------------------------------------


def listed_domains(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path) of domains to block: from the first label that has one of WORDS to the end of the host, and hosts most of whose pages are thin. path is empty."""
    host = url_host(F.col(url_col))
    word = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(WORDS)})(?:-[^.]*)?(?:\..*)?)$"
    thin = F.length(F.regexp_replace(F.coalesce(html_col, F.lit("")), r"<[^<>]*>", "")) < THIN_CHARS
    hosts = cut(pages.select(host.alias("host"), thin.alias("thin")).filter("host <> ''").groupBy("host").agg(F.avg(F.col("thin").cast("int")).alias("thin")), "hosts")
    named = hosts.select(F.regexp_extract("host", word, 1).alias("host")).filter("host <> ''")
    return named.unionByName(hosts.filter(F.col("thin") >= THIN_SHARE).select("host")).distinct().select("host", F.lit("").alias("path"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts with the rule's; the longest fits first, of two verdicts of one
    rule block. Where none fits the verdict is block if the host or a parent with a prefix of the path is listed (columns host, path), else allow.
    Null urls and such without :// have an empty host and path, fit no rule and are allowed. Rows that repeat are judged alike; rules that repeat count once; empty tables, rules
    or lists are allowed; other columns stay. A host's parents are looked at only in the numbers of labels that lists have, so very long urls cost what they weigh.
    """
    same = lambda df: df.filter("host is not null and path is not null and host <> ''")
    rules, listed = cut(same(rules).select("host", "path", "verdict").distinct(), "rules"), cut(same(listed).select("host", "path").distinct(), "listed")
    key = lambda df: df.select(F.concat("host", "path").alias("key"))
    out = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    keys_col, names = free(out, "__keys"), [free(out, x) for x in ("__rules", "__blocks", "__list")]
    for name, of, keys in zip(names, (rules, rules, listed), (key(rules), key(rules.filter("verdict = 'block'")), key(listed)), strict=True):
        out = out.withColumn(keys_col, keys_of(F.col("host"), F.col("path"), shapes_of(of)))
        out = listed_keys(out, keys_col, keys, name, most_bits).drop(keys_col)
    rule = F.get(names[0], F.lit(0))
    verdict = F.when(rule.isNull(), F.when(F.size(names[2]) > 0, "block").otherwise("allow")).when(F.array_contains(names[1], rule), "block").otherwise("allow")
    return out.withColumns({"verdict": verdict, "rule": rule}).drop(*names)


def op12_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. Urls that are null or without :// are allowed with an empty host; rows that repeat are judged each."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules, listed_domains(pages)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP12_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    length(regexp_replace(coalesce(html, ''), '<[^<>]*>', '', 'g')) < {THIN_CHARS} AS thin
  FROM pages
), h AS (SELECT host, avg(thin::INT) AS thin FROM u WHERE host <> '' GROUP BY host),
d AS (
  SELECT host FROM h WHERE thin >= {THIN_SHARE}
  UNION SELECT regexp_extract(host, '(?:^|\.)((?:[^.]*-)?(?:{"|".join(WORDS)})(?:-[^.]*)?(?:\..*)?)$', 1) FROM h
), r(rh, rp, rv) AS (VALUES {_VALUES}),
bad AS (SELECT DISTINCT h.host FROM h JOIN d ON d.host <> '' AND (h.host = d.host OR ends_with(h.host, '.' || d.host))),
f AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT page_id, u.host, u.path, f.rule, CASE WHEN f.rule IS NOT NULL THEN f.rv WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path LEFT JOIN bad ON u.host = bad.host
"""
