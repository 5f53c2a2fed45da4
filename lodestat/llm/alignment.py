"""Cross-tokenizer alignment: token ids of two tokenizers cut into groups where both end at the same byte.

For each text the cumulative ends of both tokenizers' tokens go into dictionaries from end to index; the ends that both have, sorted,
slice both lists of ids into groups. In a group the tokens whose ranges end together are linked; corpus-wide counts of linked pairs tell how good a link is.

A text is cut before single spaces between other characters: there no token of either tokenizer goes on, so pieces are encoded and aligned by
themselves, and pieces that return are taken from a bounded cache. Whether the vocabularies allow that is looked up when they are loaded; else whole texts are pieces.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import cut, table, text_or_empty

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a task keeps; a full cache is emptied.
CACHE = 1 << 18
#: Documents that a task aligns at once, and bytes of text after which it does not wait for more.
DOCS, DOC_BYTES = 256, 8 << 20

#: How a byte-level tokenizer cuts texts before merging; the pattern that belongs to its vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Tokenizers:
    """Both tokenizers. `a` gives ids of a text, `b` of texts; `a_bytes` and `b_bytes` are the tokens; `apart`: whether texts may be cut at single spaces."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    apart: bool


@functools.lru_cache(2)
def load(folder: str, a_name: str = BYTE_BPE, b_name: str = PIECE_BPE) -> Tokenizers:
    with open(f"{folder}/{a_name}", encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("the first tokenizer is not a plain byte-level BPE")
    chars, vocab, special = byte_of(), spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    data = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if [vocab[x + y] for x, y in pairs] != sorted(vocab[x + y] for x, y in pairs):
        raise ValueError("ids of the first tokenizer are not in the order of its merges")
    # ids in the order of merges are ranks; special tokens are left out, so that their strings are plain text
    a = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks={t: i for i, t in data.items()}, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_name}")
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    one = re.compile("<0x([0-9A-F]{2})>")
    b_bytes = [bytes([int(m[1], 16)]) if b.is_byte(i) and (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # A's pattern begins a match at any space behind another character; of B a space may only begin pieces, and it puts one space before a text and changes nothing else
    apart = all(b" " not in t.lstrip(b" ") for t in b_bytes) and b.encode("x  y", out_type=str) == [*b.encode("x", out_type=str), *b.encode(" y", out_type=str)]
    return Tokenizers(a, b, [data.get(i, b"") for i in range(max(vocab.values()) + 1)], b_bytes, apart)


def align(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where both lists of ids are cut: numbers of tokens of each up to the ends that both have. Ends ascend; no token is without bytes."""
    first, second = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(first.keys() & second.keys())
    return np.array([first[e] for e in common], np.int64), np.array([second[e] for e in common], np.int64)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _gather(flat: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat that belong to the places at, one after the other, and where each begins (and the last ends)."""
    size = start[at + 1] - start[at]
    begin = np.r_[0, np.cumsum(size)]
    return flat[np.repeat(start[at] - begin[:-1], size) + np.arange(begin[-1])], begin


class Aligner:
    """Aligned pieces. Of each it keeps numbers of tokens and groups, the groups as codes of token and separator, and links as numbers a * width + b."""

    def __init__(self, tokenizers: Tokenizers, most: int = CACHE) -> None:
        self.t, self.most, self.width = tokenizers, most, len(tokenizers.b_bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.after = 2 * len(self.a_size)  # codes of B's tokens come after A's
        self.written = [f"{i}{c}" for n, marks in ((len(self.a_size), ",|"), (self.width, ",;")) for i in range(n) for c in marks]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes = np.empty((0, 4), np.int64)  # n_a, n_b, groups, whether bytes agree
        self.codes, self.code_start = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.links, self.link_start = np.empty(0, np.int64), np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        return _CUT.split(text) if self.t.apart else [text]

    def learn(self, pieces: list[str]) -> None:
        """Encodes and aligns new pieces, all in one go: as their tokens' bytes are the pieces' bytes, ends of pieces are ends of both."""
        t = self.t
        lists = [[t.a.encode_ordinary(f" {p}") for p in pieces], t.b.encode(pieces, num_threads=1)]
        data = [f" {p}".encode() for p in pieces]
        joined = [[b"".join([own[i] for i in ids]) for ids in side] for side, own in zip(lists, (t.a_bytes, t.b_bytes), strict=True)]
        good = np.array([x == y == z for x, y, z in zip(data, *joined, strict=True)], bool)
        a, n_a = _flat([ids if ok else [] for ids, ok in zip(lists[0], good, strict=True)])
        b, n_b = _flat([ids if ok else [] for ids, ok in zip(lists[1], good, strict=True)])
        a_ends = np.cumsum(self.a_size[a])
        cut_a, cut_b = align(a_ends.tolist(), np.cumsum(self.b_size[b]).tolist())
        group_a, group_b = (np.repeat(np.arange(len(c)), np.diff(np.r_[0, c])) for c in (cut_a, cut_b))
        codes = np.empty(len(a) + len(b), np.int64)  # of each group A's tokens, then B's
        last_a, last_b = (np.isin(np.arange(1, len(x) + 1), c, assume_unique=True) for x, c in ((a, cut_a), (b, cut_b)))
        codes[np.arange(len(a)) + np.r_[0, cut_b][group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + cut_a[group_b]] = self.after + 2 * b + last_b
        of = np.searchsorted(np.cumsum(n_a), cut_a)  # the piece that a group is in
        groups = np.bincount(of, minlength=len(pieces))
        self.place.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, good], axis=1)])
        self.codes, self.code_start = np.concatenate([self.codes, codes]), np.concatenate([self.code_start, self.code_start[-1] + np.cumsum(n_a + n_b)])
        self.links, self.link_start = np.concatenate([self.links, a[cut_a - 1] * self.width + b[cut_b - 1]]), np.concatenate([self.link_start, self.link_start[-1] + np.cumsum(groups)])

    def batch(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, linked pairs, how often each) of each text."""
        cut_up = [self.pieces(x) if x else [] for x in texts]
        new = list({p: None for pieces in cut_up for p in pieces if p not in self.place})
        if len(self.place) + len(new) > self.most and self.place:
            self.clear()
            new = list({p: None for pieces in cut_up for p in pieces})
        for k in range(0, len(new), 16_384):
            self.learn(new[k : k + 16_384])
        out = []
        for pieces in cut_up:
            at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
            total = self.sizes[at].sum(axis=0)
            if not pieces or total[3] < len(at):
                out.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            codes, _ = _gather(self.codes, self.code_start, at)
            sha = hashlib.sha256()
            for k in range(0, len(codes), 1 << 20):
                part = "".join(map(self.written.__getitem__, codes[k : k + (1 << 20)].tolist()))
                sha.update((part[:-1] if k + (1 << 20) >= len(codes) else part).encode())  # without the last semicolon
            pairs, n = np.unique(_gather(self.links, self.link_start, at)[0], return_counts=True)
            out.append((int(total[0]), int(total[1]), int(total[2]), int(n.sum()), sha.hexdigest(), pairs, n))
        return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    start = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(start), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, cache: int = CACHE) -> DataFrame:
    """(__id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts): one row a row of docs; pairs are a * (size of B's vocabulary) + b, with how many links of the document hold each.

    Null and empty texts, and texts whose tokens' bytes are not a space and the text, have zeros, an empty hash and no pairs. Rows that repeat are counted each; whole texts are read;
    other columns do not matter. folder is where executors find the tokenizers' files.
    """
    slim = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    names = ["__id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(load(folder), cache)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and end < begin + DOCS and size < DOC_BYTES:
                    size += len(batch.column("__text")[end].as_buffer())
                    end += 1
                part = batch.slice(begin, end - begin)
                rows = aligner.batch(part.column("__text").to_pylist())
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *columns, pa.array([r[4] for r in rows], pa.string()), _lists([r[5] for r in rows]), _lists([r[6] for r in rows])], names=names)
                begin = end

    kind = slim.schema["__id"].dataType.simpleString()
    return slim.mapInArrow(made, f"__id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, counts array<bigint>")


def most_pairs(folder: str = TOKENIZERS) -> int:
    """A bound on the pairs that can be linked, whatever the corpus: tokens that end together are one the end of the other."""
    t = load(folder)
    tails = lambda these, of: sum(1 for x in these for i in range(len(x)) if x[i:] in of)
    return tails(t.a_bytes, set(t.b_bytes)) + tails(t.b_bytes, set(t.a_bytes))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, links): of each linked pair, how many links of the whole corpus hold it. found: rows of aligned()."""
    each = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("links"))


def links_of(found: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(a, b, links, best): corpus-wide counts of linked ids, and whether b has no pair with more."""
    width = len(load(folder).b_bytes)
    counts = pair_counts(found).select(F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"), "links")
    most = counts.groupBy(F.col("b").alias("__b")).agg(F.max("links").alias("__most"))
    return counts.join(most, F.col("b") == F.col("__b")).select("a", "b", "links", (F.col("links") == F.col("__most")).alias("best"))


def scored(found: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """found with n_best (links whose pair is the most frequent of its B id) and count_sum (counts of pairs over links), without pairs.

    Counts of pairs go to every task: there are at most most_pairs() of them, a bound of the vocabularies that does not grow with the corpus.
    """
    width = len(load(folder).b_bytes)
    rows = links_of(found, folder).select((F.col("a") * width + F.col("b")).alias("pair"), "links", "best").orderBy("pair").toArrow()
    sent = found.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "links", "best")))
    kept = [c for c in found.columns if c not in ("pairs", "counts")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = sent.value
        for batch in batches:
            pairs, counts = (batch.column(c).flatten().to_numpy() for c in ("pairs", "counts"))
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("pairs").offsets.to_numpy()))
            at = np.searchsorted(pair, pairs)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], of, counts * best[at])
            np.add.at(sums[1], of, counts * links[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in kept)
    return found.mapInArrow(made, f"{schema}, n_best bigint, count_sum bigint")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null, empty and not encodable texts have zeros and an empty hash; rows that repeat count each."""
    found = cut(aligned(table(spark, sf_dir, "documents")), "aligned")
    return scored(found).select(F.col("__id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
