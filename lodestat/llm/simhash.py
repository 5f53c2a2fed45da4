"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within `radius` bits of each other are linked. A fingerprint is cut into so few segments that in any such
pair one segment differs by at most one bit: 4 bits over 3 segments. Each segment is indexed once for every bit of it, with that bit
replaced by a wildcard; two segments that differ by at most one bit share such a variant, so an equality join finds
every pair, and the whole fingerprints are verified. Equal fingerprints are one node, and a bucket of the index yields
links that connect what is connected in it (a spanning forest) rather than all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.llm.common import cut, join_hot, row_key, shielded, table, text_or_empty
from lodestat.llm.components import connected_components

SHINGLE, RADIUS, BITS, SEED = 4, 4, 64, 42
#: Members of a bucket that a task compares at once; larger buckets are cut finer by the bits that are left.
MOST_MEMBERS = 20_000
#: Members up to which all of a bucket are compared at once, before it is known whether it is dense.
SMALL = 256
_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SPACE = b" \t\n\x0b\x0c\r"


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is set if it is set in over half of the shingles' hashes. No words: zero."""
    words = data.translate(_UPPER).split()  # bytes.split() takes just the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 16384):  # in pieces, so that long texts need no more memory
        to = min(n, at + 16384)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * votes[k] > n))


def with_fingerprint(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns keep and __fp, a signed long."""

    kept = list(keep)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(v.as_buffer().to_pybytes(), shingle, seed) for v in batch.column("__text")], dtype=np.uint64)
            names = [*kept, "__fp"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], names=names)

    slim = docs.select(*[c.alias(k) for k, c in keep.items()], text_or_empty(text_col).alias("__text"))
    schema = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep)
    return slim.mapInArrow(made, f"{schema}, __fp bigint")


# -- the index --------------------------------------------------------------------------------------


def segments(radius: int = RADIUS, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit: two more than that in each would be over the radius."""
    n = radius // 2 + 1
    return [(bits * i // n, bits * (i + 1) // n - bits * i // n) for i in range(n)]


def variants(fp: Column, radius: int = RADIUS) -> Column:
    """An array of the index keys of a fingerprint: of each segment, each bit replaced by a wildcard. A key names its segment and wildcard."""
    keys = []
    for at, width in segments(radius):
        part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j))).bitwiseOR(F.lit((at + j + 1) << 32).cast("bigint")) for j in range(width)]
    return F.array(*keys)


def _forest(fps: np.ndarray, sketches: np.ndarray, radius: int, apart: int) -> list[tuple[int, int]]:
    """Links (places in the arrays) that connect what is near, by breadth-first search over those not reached yet."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (np.bitwise_count(fps[left] ^ fps[x]) <= radius) & (np.bitwise_count(sketches[left] ^ sketches[x]) <= apart)
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return out


def _linked(radius: int, most: int, apart: int | None) -> callable:
    """For mapInArrow over rows (key, fp) or (key, fp, sketch) sorted by key: links (a, b), with the sketches of both if there are any, and of buckets over `most` the rows themselves (key not null)."""
    sketched, apart = apart is not None, 64 if apart is None else apart

    def compare(key: np.ndarray, fp: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked rows in whole buckets, each of at most `most` rows."""
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        bucket = np.repeat(np.arange(len(first)), size)
        # small buckets: neighbours at distance 1, 2, ... of all of them at once
        left = np.flatnonzero((size[bucket] > 1) & (size[bucket] <= SMALL))
        k, f, n = bucket[left], fp[left], size[bucket[left]]
        of, a, b = [], [], []
        for d in range(1, SMALL):
            if not d & (d - 1):  # at 1, 2, 4, ... those are left out that have no neighbour so far away
                k, f, left, n = k[n > d], f[n > d], left[n > d], n[n > d]
            if len(k) <= d:
                break
            hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
            if sketched:
                hit = hit[np.bitwise_count(sk[left[hit]] ^ sk[left[hit + d]]) <= apart]
            of.append(k[hit])
            a.append(left[hit])
            b.append(left[hit + d])
        of, a, b = (np.concatenate([np.empty(0, np.int64), *y]) for y in (of, a, b))
        # large buckets, and those of which nearly all are linked, give a spanning forest
        dense = (np.bincount(of, minlength=len(first)) > 2 * size) | (size > SMALL)
        keep = ~dense[of]
        pairs = [(first[i] + x, first[i] + y) for i in np.flatnonzero(dense) for at in (slice(first[i], first[i] + size[i]),) for x, y in _forest(fp[at], sk[at], radius, apart)]
        pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return np.concatenate([a[keep], pairs[:, 0]]), np.concatenate([b[keep], pairs[:, 1]])

    def rows(f: np.ndarray, sk: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        """Rows of the places a and b; with key, rows that are passed on."""
        columns = [f[a], f[b], *([sk[a], sk[b]] if sketched else [])]
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), keys], names=["a", "b", *(["sa", "sb"] if sketched else []), "key"])

    def passed(k: np.ndarray, f: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        return rows(f, sk, np.arange(len(k)), np.arange(len(k)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)), None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            now = (k, f, batch.column(2).to_numpy().view(np.uint64) if sketched else np.zeros(len(k), np.uint64))
            if large is not None:  # the rest of a bucket that is passed on
                n = int(np.searchsorted(k, large, "right"))
                if n:
                    yield passed(*(x[:n] for x in now))
                now = tuple(x[n:] for x in now)
                if not len(now[0]):
                    continue
                large = None
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(now[0]):
                continue
            begin = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            held, now = tuple(x[begin:] for x in now), tuple(x[:begin] for x in now)
            if len(held[0]) > most:
                large = held[0][0]
                yield passed(*held)
                held = tuple(x[:0] for x in held)
            if len(now[0]):
                k = now[0]
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                size = np.diff(np.r_[first, len(k)])
                over = np.repeat(size > most, size)
                if over.any():
                    yield passed(*(x[over] for x in now))
                    now = tuple(x[~over] for x in now)
                if len(now[0]):
                    yield rows(now[1], now[2], *compare(*now))
        if len(held[0]):
            yield rows(held[1], held[2], *compare(*held))

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, most: int = MOST_MEMBERS, apart: int | None = None) -> DataFrame:
    """(a, b): links between different fingerprints of prints (column __fp) that connect all pairs within radius. With `apart` links also need sketches (column __sk) within so many bits, and name nodes by `node_of`.

    A bucket over `most` is cut again by one more segment of the bits outside its own, of which one is equal in
    any pair; after every segment has been used what is left is compared by search, which is fast among fingerprints that near.
    """
    sketch = ["__sk"] if apart is not None else []
    index = prints.select(F.explode(variants(F.col("__fp"), radius)).alias("key"), "__fp", *sketch)
    links: DataFrame | None = None
    for level in range(3):
        ordered = index.repartition("key").sortWithinPartitions("key")
        found = cut(ordered.mapInArrow(_linked(radius, most if level < 2 else 1 << 62, apart), f"a bigint, b bigint, {'sa bigint, sb bigint, ' if sketch else ''}key bigint"), "simhash")
        here = found.filter("key is null")
        here = here.select(node_of(F.col("a"), F.col("sa")).alias("a"), node_of(F.col("b"), F.col("sb")).alias("b")) if sketch else here.select("a", "b")
        links = here if links is None else links.unionByName(here)
        large = found.filter("key is not null").select("key", F.col("a").alias("__fp"), *([F.col("sa").alias("__sk")] if sketch else []))
        if level == 2 or large.isEmpty():
            return links
        # radius + 1 parts of the fingerprint, at least one of which is equal in any pair; distinct parts at each level
        n = radius + 1 + level * 3
        parts = [F.xxhash64("key", F.lit(i), F.shiftrightunsigned(F.col("__fp"), BITS * i // n).bitwiseAND(F.lit((1 << (BITS * (i + 1) // n - BITS * i // n)) - 1))) for i in range(n)]
        index = large.select(F.explode(F.array(*parts)).alias("key"), "__fp", *sketch)
    return links


def node_of(fp: Column, sketch: Column) -> Column:
    """A node of the link graph: texts that agree in fingerprint and sketch."""
    return F.xxhash64(fp, sketch)


# -- operators --------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, keep: dict[str, Column], id_name: str, text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """keep's columns, __fp, component_id (the least id_name that links reach) and __root (a fingerprint that names the component), one row a row of docs.

    Null text counts as empty and has fingerprint zero, which links like any other. Null ids reach others and are never the least.
    An empty table gives no rows.
    """
    prints = cut(with_fingerprint(docs, keep, text_col, shingle), "prints")
    nodes = cut(prints.groupBy("__fp").agg(F.min(id_name).alias("__least"), F.count("*").alias("__n")), "nodes")
    roots = cut(connected_components(near_links(nodes.select("__fp"), radius)), "roots")
    # a root's least id, then each linked fingerprint's; the others have their own
    linked = nodes.join(roots, F.col("__fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("__least").alias("__id")).select(F.col("root").alias("__named"), "__id")
    of = roots.join(least, F.col("root") == F.col("__named")).select("node", "__id", F.col("root").alias("__r"))
    named = nodes.join(of, F.col("__fp") == F.col("node"), "left").select(F.col("__fp").alias("__node"), F.coalesce("__id", "__least").alias("component_id"), F.coalesce("__r", "__fp").alias("__root"), "__n")
    return join_hot(prints, cut(named, "named"), "__fp", "__node", "__n", prints.count()).drop("__node", "__n")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts have fingerprint zero; rows that repeat have one component; ties do not arise, as the least id names a component. Whole texts are read."""
    out = near_duplicates(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Parameters of one_of_each. Over two-word shingles few edits change few bits, so that fingerprints find candidates; whether a candidate is a
#: copy is decided by the shingles of five words that both texts have, of all that either has.
COPY_SHINGLE, COPY_RADIUS = 2, 9
ALIKE_SHINGLE, ALIKE = 5, (4, 5)
#: Sketches of 64 bits, each the parity of a least hash of the five-word shingles: texts that are 0.8 similar differ in 6 of them, at most, in expectation; unlike ones in 32.
#: With links only up to so many bits, groups are what is alike, however many fingerprints are near by chance.
SKETCH_APART = 16
#: Texts of a group that one task takes in a round, the first by id; the others are compared with those of them that stay, so many a task.
HEADS = 1000
#: Parts of a group whose first texts are looked for apart.
SALTS = 64


def shingles(data: bytes, size: int = ALIKE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of a text's different shingles; a text of fewer words is one."""
    words = data.translate(_UPPER).split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(max(1, len(words) - size + 1))], dtype=np.uint64))


_FACTORS = np.random.default_rng(64).integers(1 << 32, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def sketch(found: np.ndarray) -> int:
    """64 bits of a text's different shingles: a bit differs between two texts with half the chance that their least hashes do."""
    least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):  # in pieces, so that long texts need no more memory
        h = found[at : at + 4096, None] * _FACTORS[None, :]
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=0))
    return int(np.packbits((np.bitwise_count(least) & 1).astype(np.uint8), bitorder="little").view(np.uint64)[0])


class Kept:
    """Texts that stay, by their least shingles: texts that are alike share one of the first fifth."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.index: dict[int, list[int]] = {}

    @staticmethod
    def _first(found: np.ndarray) -> list[int]:
        return found[: len(found) - -(-len(found) * ALIKE[0] // ALIKE[1]) + 1].tolist()

    def has_like(self, found: np.ndarray) -> bool:
        n = len(found)
        for i in sorted({i for h in self._first(found) for i in self.index.get(h, ())}):
            m = len(self.sets[i])
            if min(n, m) * ALIKE[1] >= max(n, m) * ALIKE[0]:
                both = len(np.intersect1d(found, self.sets[i], assume_unique=True))
                if both * ALIKE[1] >= (n + m - both) * ALIKE[0]:
                    return True
        return False

    def add(self, found: np.ndarray) -> None:
        for h in self._first(found):
            self.index.setdefault(h, []).append(len(self.sets))
        self.sets.append(found)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (__group, __none, __id, __key, __size, __text) sorted by the first four: the same, and __like: whether an earlier text of the group that stays is alike. A row that repeats another is left out."""
    group, last, kept = None, None, Kept()
    for batch in batches:
        out, like = [], []
        for i, (g, key) in enumerate(zip(batch.column("__group").to_pylist(), batch.column("__key").to_pylist(), strict=True)):
            if g != group:
                group, last, kept = g, None, Kept()
            if key == last:
                continue
            last, found = key, shingles(batch.column("__text")[i].as_buffer().to_pybytes())
            out.append(i)
            like.append(kept.has_like(found))
            if not like[-1]:
                kept.add(found)
        rows = batch.take(pa.array(out, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(like, pa.bool_())], names=[*rows.schema.names, "__like"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (__group, __part, __head, __none, __id, __key, __size, __text) sorted by group, part and heads first: the others, and __like: whether a head is alike."""
    at, kept = None, Kept()
    for batch in batches:
        out, like = [], []
        for i, (g, part, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__group", "__part", "__head")), strict=True)):
            if (g, part) != at:
                at, kept = (g, part), Kept()
            found = shingles(batch.column("__text")[i].as_buffer().to_pybytes())
            if head == 0:
                kept.add(found)
            else:
                out.append(i)
                like.append(kept.has_like(found))
        rows = batch.take(pa.array(out, pa.int64())).select(["__group", "__none", "__id", "__key", "__size", "__text"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(like, pa.bool_())], names=[*rows.schema.names, "__like"])


def _texts(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row a text that differs in words: __fp, __sk, and __none, __id and __key of its first row by id; null ids come last."""
    slim = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), text_or_empty(text_col).alias("__text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [v.as_buffer().to_pybytes() for v in batch.column("__text")]
            prints = np.array([fingerprint(x, shingle) for x in data], dtype=np.uint64)
            words = pa.array([xxhash.xxh3_128_digest(b" ".join(x.translate(_UPPER).split())) for x in data], pa.binary())
            sketches = np.array([sketch(shingles(x)) for x in data], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__key"), pa.array(prints.view(np.int64)), pa.array(sketches.view(np.int64)), words], names=["__id", "__key", "__fp", "__sk", "__words"])

    rows = slim.mapInArrow(made, f"__id {slim.schema['__id'].dataType.simpleString()}, __key string, __fp bigint, __sk bigint, __words binary")
    first = F.min(F.struct(F.col("__id").isNull().alias("__none"), "__id", "__key")).alias("__first")
    return rows.groupBy("__fp", "__sk", "__words").agg(first).select("__fp", "__sk", "__first.*")


def _first_of_groups(members: DataFrame, heads: int) -> DataFrame:
    """Keys of the first texts of each group: first of each of SALTS parts of a group, then of those, so no task sorts a group."""
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__none", "__id", "__key"))
    few = members.select("__group", "__none", "__id", "__key").distinct().withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)))
    for by in (("__group", "__salt"), ("__group",)):
        few = few.withColumn("__nth", order(*by)).filter(F.col("__nth") <= heads).drop("__nth")
    return few.select(F.col("__key").alias("__front"))


@shielded
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, radius: int = COPY_RADIUS, *, heads: int = HEADS) -> DataFrame:
    """docs without texts that are alike to one that stays with a smaller id; rows that repeat an id and text stay once. Null ids come last, by key.

    Fingerprints within radius whose sketches of five-word shingles agree, and what these link, are groups of candidates. In a group texts are taken by id, and one stays unless it is alike
    to one that stays; texts of the same words are one. Null and empty texts are one text. Of a large group a task takes the first texts by id, the others are dealt out to tasks that compare them with those
    which stay, and what is like none of them goes on to the next round: the same choice, whatever the size of a group. Whole texts are read. An empty table stays empty; other columns stay as they are.
    """
    texts = cut(_texts(docs, id_col, text_col, shingle), "texts")
    roots = connected_components(near_links(texts.select("__fp", "__sk").distinct(), radius, apart=SKETCH_APART))
    own = node_of(F.col("__fp"), F.col("__sk"))
    named = cut(texts.join(roots.hint("merge"), own == F.col("node"), "left").select(F.coalesce("root", own).alias("__group"), "__none", "__id", "__key"), "named")
    several = cut(named.groupBy("__group").agg(F.count("*").alias("__size")).filter("__size > 1").withColumnRenamed("__group", "__g"), "groups")
    members = cut(join_hot(named, several, "__group", "__g", "__size", named.count()).drop("__g"), "members")
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    columns = ["__group", "__none", "__id", "__key", "__size", "__text"]
    front = members.join(_first_of_groups(members, heads).hint("merge"), F.col("__key") == F.col("__front"), "left")
    left = keyed.select(F.col("__key").alias("__k"), text_or_empty(text_col).alias("__text")).join(front.hint("merge"), F.col("__k") == F.col("__key"))
    left = cut(left.select(*columns, F.col("__front").isNotNull().alias("__head")), "left")
    schema = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in columns) + ", __like boolean"
    gone: list[DataFrame] = []
    while True:
        first = cut(left.filter("__head").select(*columns).repartition("__group").sortWithinPartitions(*columns[:4]).mapInArrow(_greedy, schema), "first")
        gone.append(first.filter("__like").select(F.col("__key").alias("__gone")))
        rest = left.filter("not __head").select(*columns)
        if rest.isEmpty():
            break
        parts = F.ceil(F.col("__size") / heads).cast("int")
        pieces = first.filter(~F.col("__like") & (F.col("__size") > heads)).select("__group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), F.lit(0).alias("__head"), *columns[1:])
        pieces = pieces.unionByName(rest.select("__group", F.pmod(F.xxhash64("__key"), parts).cast("int").alias("__part"), F.lit(1).alias("__head"), *columns[1:]))
        found = cut(pieces.repartition("__group", "__part").sortWithinPartitions("__group", "__part", "__head").mapInArrow(_against, schema), "found")
        gone.append(found.filter("__like").select(F.col("__key").alias("__gone")))
        left = found.filter(~F.col("__like")).select(*columns)
        if left.isEmpty():
            break
        left = cut(left.join(_first_of_groups(left, heads).hint("merge"), F.col("__key") == F.col("__front"), "left").select(*columns, F.col("__front").isNotNull().alias("__head")), "left")
    dropped = gone[0]
    for one in gone[1:]:
        dropped = dropped.unionByName(one)
    stay = cut(named.select(F.col("__key").alias("__stay")).join(dropped.hint("merge"), F.col("__stay") == F.col("__gone"), "left_anti"), "stay")
    # the join leaves rows of one key in one partition, where the first of them stays
    return keyed.join(stay.hint("merge"), F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"]).drop("__key")
