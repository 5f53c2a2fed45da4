"""Removal of repeated passages by longest previous factors over suffix order.

A position whose next `length` bytes also start in a document with a smaller id has a longest previous factor of at least
`length`; the bytes that such positions cover go, and the first copy stays. In suffix order, the earlier matches of a suffix are its
previous and next smaller positions, so an array of longest previous factors needs no pairs.

A suffix order of a whole corpus does not fit one machine. Here suffixes are dealt out by content: of the 24-byte strings inside a
window of `length` bytes the one with the least hash is the window's anchor, and equal windows have equal anchors. Windows whose
anchor stands in one place only cannot repeat and go no further. The others meet in the bucket of their anchor with the text around it: there all
suffixes of at least `length` bytes are put in order to the ends of these texts, with the common prefixes of neighbours, and the array of longest previous factors is read off from
each suffix's previous and next smaller owner. Factors reach to the end of the text around their anchor; longer ones go on at the next anchor. Documents are packed into blocks that every step
reads; between the steps move three bytes an anchor, then the text around repeated anchors (distinct texts of a block once), then factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import table, text_or_empty

LENGTH, GRAM = 50, 24
#: Bytes of text in a block of documents, and bytes of text that a bucket of anchors stands for.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 1 << 20
#: Rows that are packed at once.
ROWS = 4096
_NONE = np.int64((1 << 63) - 1)  # an id after all others: null
_CHUNK = 1 << 18
_RUNS = 20_000  # runs of windows that are marked at once
_POSITION = np.uint64((1 << 24) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# -- packing ----------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Integers of eight bytes, by planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).reshape(-1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, text) to rows (block, ids, copies, sizes, text); rows that repeat are counted."""
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        block = batch.column(0).to_numpy()
        ids = batch.column(1)
        keys = np.where(np.asarray(ids.is_null()), _NONE, ids.fill_null(0).to_numpy(zero_copy_only=False))
        rows: dict[int, dict[tuple[int, bytes], int]] = {}
        for b, key, text in zip(block.tolist(), keys.tolist(), batch.column(2), strict=True):
            own, entry = rows.setdefault(b, {}), (key, text.as_buffer().to_pybytes())
            own[entry] = own.get(entry, 0) + 1
        names = ["block", "ids", "copies", "sizes", "text"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(rows), pa.int64()),
                *(pa.array([_pack(np.array(f(own), np.int64)) for own in rows.values()], pa.binary()) for f in (lambda o: [k for k, _ in o], lambda o: list(o.values()), lambda o: [len(t) for _, t in o])),
                pa.array([zstandard.compress(b"".join(t for _, t in own), 1) for own in rows.values()], pa.binary()),
            ],
            names=names,
        )


class Block:
    """The documents of a block in an order that only their ids and texts decide, as one string of bytes."""

    def __init__(self, rows: pa.Table) -> None:
        entries: dict[tuple[int, bytes], int] = {}
        for ids, copies, sizes, text in zip(*(rows.column(c).to_pylist() for c in ("ids", "copies", "sizes", "text")), strict=True):
            raw, at = zstandard.decompress(text), 0
            for key, n, size in zip(_unpack(ids).tolist(), _unpack(copies).tolist(), _unpack(sizes).tolist(), strict=True):
                entry = (key, raw[at : at + size])
                entries[entry] = entries.get(entry, 0) + n
                at += size
        order = sorted(entries)
        self.ids = np.array([k for k, _ in order], np.int64)
        self.copies = [entries[k] for k in order]
        self.sizes = np.array([len(t) for _, t in order], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = b"".join(t for _, t in order)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first window, number of windows, hash of the anchor (48 bits), document."""
        out, n, width = [], len(self.text), length - GRAM + 1
        ends = self.starts + self.sizes
        for at in range(0, max(0, n - length + 1), _CHUNK):
            b = np.frombuffer(self.text, np.uint8, min(n, at + _CHUNK + length - 1) - at, at)
            words = np.lib.stride_tricks.sliding_window_view(b, 8).copy().view(np.uint64).reshape(-1)
            h = words[: len(b) - GRAM + 1] * _C[0]
            h ^= (h >> np.uint64(29)) + words[8 : len(b) - GRAM + 9] * _C[1]
            h *= _C[2]
            h ^= (h >> np.uint64(32)) + words[16 : len(b) - GRAM + 17] * _C[3]
            h *= _C[0]
            h ^= h >> np.uint64(29)
            least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if reach < width:
                least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
            where = (least & _POSITION).astype(np.int64)
            start = np.arange(at, at + len(where))
            doc = np.searchsorted(ends, start, "right")
            good = start + length <= ends[doc]
            new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]) | (good[1:] != good[:-1])])
            size = np.diff(np.r_[new, len(where)])
            keep = good[new]
            new, size = new[keep], size[keep]
            # anchors are least hashes, so most are small; multiplied, they spread evenly over the buckets
            out.append((new + at, size, ((h[where[new]] * _C[1]) >> np.uint64(16)).astype(np.int64), doc[new]))
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ())))


# -- steps --------------------------------------------------------------------------------------------


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> 16) * buckets) >> 32  # by the highest of 48 bits, so that buckets are ranges


def _distinct(block: Block, runs: tuple, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a block, whether documents of different ids hold them, and their buckets."""
    _, _, h, doc = runs
    order = np.argsort(h, kind="stable")
    hs, ids = h[order], block.ids[doc[order]]
    first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.empty(0, np.int64)
    low, high = (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(hs) else (ids, ids)
    return hs[first], low != high, _bucket(hs[first], buckets)


def _sketch(buckets: int, length: int) -> callable:
    """Step 1, a block: its distinct anchors, to their buckets. In order; one bit more says that two ids hold it here."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        h, many, bucket = _distinct(block, block.anchors(length), buckets)
        found, at = np.unique(bucket, return_index=True)
        parts = [slice(a, b) for a, b in zip(at, [*at, len(h)][1:], strict=True)]
        data = [_pack(np.diff(np.r_[0, h[p] * 2 + many[p]])) for p in parts]
        return pa.table({"bucket": pa.array(found, pa.int64()), "block": pa.array([rows.column("block")[0].as_py()] * len(found), pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """Step 2, a bucket: to each block, a bit for each of its anchors in order: whether it repeats in another block or id."""
    lists = [np.cumsum(_unpack(d)) for d in rows.column("data").to_pylist()]
    values, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(values >> 1, kind="stable")
    h, many = values[order] >> 1, values[order] & 1
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    hot = np.repeat((size > 1) | (np.maximum.reduceat(many, first) > 0), size)
    bits = np.empty(len(h), bool)
    bits[order] = hot
    data = [np.packbits(bits[of == i]).tobytes() for i in range(len(lists))]
    return pa.table({"block": rows.column("block"), "kind": pa.array([0] * len(lists), pa.int64()), "bucket": rows.column("bucket"), "data": pa.array(data, pa.binary())})


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at start and have these sizes, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number, the first byte first."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(np.uint64).reshape(-1).byteswap(inplace=True)


class Snippets:
    """Texts around the repeated anchors of a block: distinct ones in order of bucket, with the smallest id of each, and where each run of windows has its own."""

    def __init__(self, block: Block, replies: dict[int, bytes], buckets: int, length: int) -> None:
        runs = block.anchors(length)
        start, size, h, doc = runs
        distinct, _, bucket = _distinct(block, runs, buckets)
        hot = np.zeros(len(distinct), bool)
        for b, bits in replies.items():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            hot[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        chosen = np.flatnonzero(hot[np.searchsorted(distinct, h)]) if len(h) else np.empty(0, np.int64)
        self.start, self.size, self.doc = start[chosen], size[chosen], doc[chosen]
        h, every, text = h[chosen], np.arange(len(chosen)), np.frombuffer(block.text, np.uint8)
        wide = self.size + length - 1
        rep = every
        if len(chosen):
            # equal snippets have equal keys; those of one key are compared byte by byte, and any that differ stand for themselves
            key = h.view(np.uint64) * _C[0] ^ self.size.view(np.uint64) * _C[1] ^ _words(text, self.start) * _C[2] ^ _words(text, self.start + wide - 8) * _C[3]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            rep = first[inverse]
            for k in range(0, len(rep), _RUNS):
                dup = every[k : k + _RUNS][rep[k : k + _RUNS] != every[k : k + _RUNS]]
                dup, same = dup[wide[dup] == wide[rep[dup]]], dup[wide[dup] != wide[rep[dup]]]
                rep[same] = same
                if len(dup):
                    differ = text[_flat(self.start[dup], wide[dup])] != text[_flat(self.start[rep[dup]], wide[dup])]
                    bad = dup[np.add.reduceat(differ, np.cumsum(wide[dup]) - wide[dup], dtype=np.int64) > 0]
                    rep[bad] = bad
        reps = np.flatnonzero(rep == every)
        bucket = _bucket(h[reps], buckets)
        order = np.argsort(bucket, kind="stable")
        self.reps, self.bucket = reps[order], bucket[order]
        place = np.empty(len(chosen), np.int64)
        place[self.reps] = np.arange(len(reps))
        self.of = place[rep]
        self.least = np.full(len(reps), _NONE)
        np.minimum.at(self.least, self.of, block.ids[self.doc])
        self.wide = wide[self.reps]
        self.text = text


def _texts(buckets: int, length: int) -> callable:
    """Step 3, a block with step 2's replies: its snippets, to their buckets."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "least": [], "sizes": [], "text": []}
        if docs.num_rows and replies.num_rows:
            s = Snippets(Block(docs), dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True)), buckets, length)
            found, at = np.unique(s.bucket, return_index=True)
            for b, lo, hi in zip(found.tolist(), at.tolist(), [*at.tolist(), len(s.reps)][1:], strict=True):
                out["bucket"].append(b)
                out["block"].append(docs.column("block")[0].as_py())
                out["least"].append(_pack(s.least[lo:hi]))
                out["sizes"].append(_pack(s.wide[lo:hi]))
                out["text"].append(zstandard.compress(s.text[_flat(s.start[s.reps[lo:hi]], s.wide[lo:hi])].tobytes(), 3))
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})

    return run


#: Suffixes that are put in order at once, unless more share their first eight bytes.
PART = 1 << 18


def _suffix_words(text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """_words of a text that eight bytes follow, with zeros for what lies at or past the ends."""
    past = np.clip(at + 8 - ends, 0, 8).astype(np.uint64) * np.uint64(8)
    word = _words(text, np.minimum(at, len(text) - 8))
    return np.where(past < 64, word >> np.minimum(past, np.uint64(63)) << np.minimum(past, np.uint64(63)), np.uint64(0))


def suffix_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Puts `part`, numbers of suffixes of which those between two marks of `first` share their first eight bytes, in order; returns their common prefixes.

    Stretches of equal suffixes are put in order by the next eight bytes, and so on to the ends of the suffixes, at last by their lengths. A stretch
    that agrees is not sorted again. The common prefix of each with the one before it is 0 at the marks given.
    """
    common, size = np.zeros(len(part), np.int64), ends - starts
    for step in range(8, int(size[part].max()), 8):
        live = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not len(live):
            break
        of = part[live]
        word, group = _suffix_words(text, starts[of] + step, ends[of]), np.cumsum(first[live]) - 1
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[word != word[first[live]][group]]] = True
        place = np.flatnonzero(mixed[group])
        if len(place):
            word, group = word[place], group[place]
            sub = np.lexsort((word, group))
            word, group = word[sub], group[sub]
            part[live[place]] = part[live[place[sub]]]
            new = np.flatnonzero((word[1:] != word[:-1]) & (group[1:] == group[:-1])) + 1
            differ = word[new] ^ word[new - 1]
            first[live[place[new]]] = True
            common[live[place[new]]] = step + sum((differ < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
    # equal to the end of the shorter
    live = np.flatnonzero(~(first & np.r_[first[1:], True]))
    part[live] = part[live[np.lexsort((size[part[live]], np.cumsum(first[live])))]]
    same = np.flatnonzero(~first)
    common[same] = size[part[same]]
    common[1:] = np.minimum(common[1:], np.minimum(size[part[1:]], size[part[:-1]]))
    return common


def nearest_smaller(owner: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it in suffix order that has a smaller owner; 0 where it is under `length` or none is.

    Windows of doubling width hold their smallest owner and smallest common prefix; each suffix goes back by the widest ones whose owners are
    none smaller than its own.
    """
    place = np.arange(len(owner))
    begin = np.maximum.accumulate(np.where(common < length, place, 0))
    levels = int((place - begin).max(initial=0)).bit_length()
    owners, prefixes = [owner], [common]
    for k in range(levels - 1):
        owners.append(np.minimum(owners[k][: -(1 << k)], owners[k][1 << k :]))
        prefixes.append(np.minimum(prefixes[k][: -(1 << k)], prefixes[k][1 << k :]))
    at, least = place.copy(), common.copy()
    for k in reversed(range(levels)):
        able = np.flatnonzero(at - (1 << k) >= begin)
        back = at[able] - (1 << k)
        go = owners[k][back] >= owner[able]
        able, back = able[go], back[go]
        at[able], least[able] = back, np.minimum(least[able], prefixes[k][back])
    return np.where(at > begin, least, 0)


def previous_factors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The array of longest previous factors of the suffixes text[starts:ends]: the longest prefix that a suffix shares with one of a smaller owner, 0 if under `length`.

    In suffix order the longest is shared with the previous or the next suffix of a smaller owner.
    """
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    text = np.r_[text, np.zeros(8, np.uint8)]
    head = _suffix_words(text, starts, ends)
    order = np.argsort(head, kind="stable")
    head = head[order]
    new = np.r_[True, head[1:] != head[:-1]]
    del head
    edges, at = np.r_[np.flatnonzero(new), len(order)], 0
    while at < len(order):
        k = int(np.searchsorted(edges, at + PART, "right")) - 1
        to = int(edges[k] if edges[k] > at else edges[k + 1])
        part = order[at:to]
        common = suffix_order(text, starts, ends, part, new[at:to])
        own = owner[part]
        before = nearest_smaller(own, common, length)
        after = nearest_smaller(own[::-1], np.r_[0, common[:0:-1]], length)[::-1]
        out[part] = np.maximum(before, after)
        at = to
    return out


def _factors(length: int) -> callable:
    """Step 4, a bucket: to each block, for each window of its snippets in order, by how much its longest previous factor falls short of the snippet's end; -1 for none."""

    def run(rows: pa.Table) -> pa.Table:
        texts = [zstandard.decompress(t) for t in rows.column("text").to_pylist()]
        sizes = [_unpack(s) for s in rows.column("sizes").to_pylist()]
        least = [_unpack(s) for s in rows.column("least").to_pylist()]
        size, owner = np.concatenate(sizes), np.concatenate(least)
        at, n = np.cumsum(size) - size, size - length + 1
        starts, ends = _flat(at, n), np.repeat(at + size, n)
        found = previous_factors(np.frombuffer(b"".join(texts), np.uint8), starts, ends, np.repeat(owner, n), length)
        short = np.where(found > 0, ends - starts - found, -1).astype(np.int32)
        parts = np.split(short, np.cumsum([int((s - length + 1).sum()) for s in sizes])[:-1])
        data = [zstandard.compress(p.tobytes(), 1) for p in parts]
        return pa.table({"block": rows.column("block"), "kind": pa.array([1] * len(data), pa.int64()), "bucket": rows.column("bucket"), "data": pa.array(data, pa.binary())})

    return run


def _removed(buckets: int, length: int, id_is: pa.DataType) -> callable:
    """Step 5, a block with the replies of steps 2 and 4: what goes from each document."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out: dict[str, list] = {"__id": [], "n_bytes": [], "spans": [], "kept_sha256": []}
        block = Block(docs) if docs.num_rows else None
        if block:
            covered = np.zeros(len(block.text) + 1, np.int32)
            kinds: list[dict[int, bytes]] = [{}, {}]
            for kind, bucket, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
                kinds[kind][bucket] = data
            if kinds[1]:
                s = Snippets(block, kinds[0], buckets, length)
                n = s.size[s.reps]
                first = np.cumsum(n) - n
                short = np.concatenate([np.frombuffer(zstandard.decompress(kinds[1][b]), np.int32) for b in sorted(kinds[1])])
                for at in range(0, len(s.size), _RUNS):
                    size, of = s.size[at : at + _RUNS], s.of[at : at + _RUNS]
                    flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    # the snippet's first document has the snippet's factors; for later ones of the block all of it stands in the first
                    later = np.repeat(block.ids[s.doc[at : at + _RUNS]] > s.least[of], size)
                    lack = np.where(later, 0, short[np.repeat(first[of], size) + flat])
                    hit = lack >= 0
                    begin = (np.repeat(s.start[at : at + _RUNS], size) + flat)[hit]  # each window once
                    factor = (np.repeat(size + length - 1, size) - flat - lack)[hit]
                    covered[begin] += 1
                    np.subtract.at(covered, begin + factor, 1)
            gone = np.cumsum(covered, out=covered)[:-1] > 0
            del covered
            for i, (key, n_copies) in enumerate(zip(block.ids.tolist(), block.copies, strict=True)):
                a, b = int(block.starts[i]), int(block.starts[i] + block.sizes[i])
                part, raw = gone[a:b], np.frombuffer(block.text, np.uint8, b - a, a) if b > a else np.empty(0, np.uint8)
                edge = np.flatnonzero(np.diff(np.r_[0, part.view(np.int8), 0]))
                row = (None if key == _NONE else key, b - a, [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)], hashlib.sha256(raw[~part].tobytes()).hexdigest())
                for _ in range(n_copies):
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (id_is, pa.int64(), span, pa.string()), strict=True)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row a row of docs: __id, n_bytes, spans (array<struct<start, end>> of removed bytes, maximal), kept_sha256.

    Bytes are UTF-8. Null text counts as empty. Null ids come after all others, and rows of the same id (or of null ids) take nothing from each
    other. Texts under `length` bytes stay whole. The id column holds integers. An empty table gives no rows.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    text = text_or_empty(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    slim = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("bigint").alias("block"), F.col(id_col).cast("bigint").alias("__id"), text.alias("text"))
    packed = slim.mapInArrow(_packed, "block bigint, ids binary, copies binary, sizes binary, text binary").repartition(min(blocks, 20_000), "block")
    sketch = packed.groupBy("block").applyInArrow(_sketch(buckets, length), "bucket bigint, block bigint, data binary")
    reply = "block bigint, kind bigint, bucket bigint, data binary"
    repeated = sketch.groupBy("bucket").applyInArrow(_repeated, reply)
    texts = packed.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_texts(buckets, length), "bucket bigint, block bigint, least binary, sizes binary, text binary")
    factors = texts.groupBy("bucket").applyInArrow(_factors(length), reply)
    out = packed.groupBy("block").cogroup(repeated.unionByName(factors).groupBy("block")).applyInArrow(_removed(buckets, length, pa.int64()), "__id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string")
    return out


def op7_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("__id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
