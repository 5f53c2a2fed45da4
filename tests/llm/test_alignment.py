"""Cross-tokenizer alignment against whole texts encoded by the tokenizers' own libraries and a plain loop over ends."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestat.llm import alignment as m

FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(f"{m.TOKENIZERS}/{m.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{m.TOKENIZERS}/{m.PIECE_BPE}")


def plain(texts, libraries):
    """Result rows by whole texts: token bytes, ends, groups, links and their corpus-wide counts."""
    a, b = libraries
    char = m.byte_of()
    name = {i: t for t, i in a.get_vocab().items()}
    rows, count = [], collections.Counter()
    for text in texts:
        ids = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        data = [[bytes(char[c] for c in name[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]]
        if not text or any(b"".join(x) != f" {text}".encode() for x in data):
            rows.append(((), (), [], []))
            continue
        ends = []
        for x in data:
            at, own = 0, []
            for t in x:
                at += len(t)
                own.append(at)
            ends.append(own)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, ids[0][i:p])) + "|" + ",".join(map(str, ids[1][j:q])))
            links.append((ids[0][p - 1], ids[1][q - 1]))
            i, j = p, q
        rows.append((*ids, groups, links))
        count.update(links)
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(len(x), len(y), len(g), len(p), sum(count[k] == most[k[1]] for k in p), sum(count[k] for k in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, g, p in rows]


def awkward():
    draw = random.Random(2)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "\t\n x\r\n", "a b   c", "　x 　 y", "x\x1cy \x1c z", "a▁b", "don't they'll I'VE", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 \x01", "日本語 は \U0001f600\U0001f600", "é é İ", "12345 67 8.9,0", "x" * 5000, "lantern " * 20_000, "the same text", "the same text"]
    pool = ["the", "re", "lant", "ern", " ", "  ", "\n", "\t", "'s", "1", "99", ".", ",,", "ü", "ée", "日", "\U0001f600", " ", " ", "́", "ﬁ", "A", "Zed", "-", "<s>", "​", "\x85"]
    return texts + ["".join(draw.choice(pool) for _ in range(draw.randint(1, 60))) for _ in range(300)]


def test_alignment_agrees_with_whole_texts(spark, libraries):
    texts = awkward()
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pairs int, __id string").repartition(5)
    found = m.aligned(docs.drop("__id"))
    got = {r["__id"]: tuple(r[f] for f in FIELDS) for r in m.scored(found).collect()}
    for i, want in enumerate(plain(texts, libraries)):
        assert got[i] == want, repr(texts[i])[:200]
    assert m.aligned(docs).count() == len(texts)
    assert m.scored(m.aligned(docs.limit(0))).count() == 0


def test_a_small_cache_changes_nothing(libraries):
    tokenizers = m.load(m.TOKENIZERS)
    assert tokenizers.apart
    texts = [t for t in awkward() if t]
    large, small = m.Aligner(tokenizers), m.Aligner(tokenizers, 5)
    for k in range(0, len(texts), 7):
        for x, y in zip(large.batch(texts[k : k + 7]), small.batch(texts[k : k + 7]), strict=True):
            assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_cuts_stand_where_both_end():
    cut_a, cut_b = m.align([2, 3, 7, 9], [1, 3, 4, 5, 9])
    assert cut_a.tolist() == [2, 4] and cut_b.tolist() == [2, 5]
    assert [x.tolist() for x in m.align([], [])] == [[], []]


def test_links_are_bounded_by_the_vocabularies(spark):
    found = m.aligned(spark.createDataFrame([(i, t) for i, t in enumerate(awkward())], "doc_id long, text string"))
    t = m.load(m.TOKENIZERS)
    for r in m.links_of(found).collect():
        x, y = t.a_bytes[r.a], t.b_bytes[r.b]
        assert x.endswith(y) or y.endswith(x)
    assert m.most_pairs() < 500_000


def test_query_agrees_with_whole_texts(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in m.op13_token_alignment(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain([r.text for r in rows], libraries), strict=True))
