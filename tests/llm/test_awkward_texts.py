"""Long runs of one mark, columns with the operators' own names, texts chained by fingerprints, recall of near copies."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestat.llm import langid, license_scan, mixing, secrets_crf, sharding, simhash
from lodestat.llm.common import without
from lodestat.llm.components import connected_components

CLASH = ["__key", "__id", "__text", "__group", "__part", "__head", "__none", "__size", "__like", "__gone", "__bucket", "__number", "__at", "__copies", "__words", "__n_words", "__low", "__stay", "__taken", "__i", "kept0"]


@pytest.mark.parametrize("mark", list("abA0.!?=$/-_+*&^%#@~\"'`:,;()<>{}[]| \n\té"))
def test_runs_of_marks_take_time_that_grows_with_them(mark):
    text = "key a" + mark * 1_000_000 + "b x"
    began = time.process_time()
    secrets_crf.chains(text)
    secrets_crf.base_spans(text)
    assert time.process_time() - began < 5  # a tenth of a second to a second; the square would be hours


@pytest.mark.parametrize("mark", list("a0.=$ \n\"") + ["aB3 ", "key ", "中", "é9"])
def test_tagging_takes_time_that_grows_with_the_text(mark):
    words = secrets_crf.Words(secrets_crf.trained())
    took = []
    for n in (250_000, 1_000_000):
        began = time.process_time()
        words.spans(["key a" + mark * (n // len(mark)) + "b x"])
        took.append(time.process_time() - began)
    assert took[1] < 12 and took[1] < 8 * took[0] + 1


def test_words_stops_and_padding():
    words = lambda x: [x[s:e] for s, e in secrets_crf.tokens_of(x)]
    assert words("pw aGk== b64=\n end... ?! a.b.c. x==y") == ["pw", "aGk==", "b64=", "\n", "end", ".", ".", ".", "?", "!", "a.b.c", ".", "x", "=", "=", "y"]


def test_tokens_cut_by_arrays_are_those_of_the_expression():
    blanks = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    rng = random.Random(9)
    texts = ["", "=", ".", ".=", "a==", "==", "a===", "a= b", "a=b", "...=)", "é==", "x.\u2028", *[f"a{b}b={b}c.{b}." for b in blanks]]
    texts += ["".join(rng.choice(["a", "B", "é", "中", "😀", "7", "=", "=", ".", "!", "?", " ", "\n", '"', ")", ":", "-", "\x00", "\ud800", rng.choice(blanks)]) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    data = b" ".join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""])
    begin, end, full = secrets_crf.cuts(data)
    want = [t[s:e].encode("utf-8", "surrogatepass") for t in texts for s, e in secrets_crf.tokens_of(t)]
    assert [data[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)] == want and full.tobytes() == b"".join(want)


def test_scores_by_arrays_are_those_of_features(monkeypatch):
    """Short and long words of many scripts, words with a zero in them, hints whose letters only fold to ASCII, twice each."""
    field = secrets_crf.trained()
    rng = random.Random(10)
    letters = ["a", "b", "e", "B", "Z", "é", "É", "ß", "Σ", "İ", "中", "ǅ", "½", "٣", "😀", "\x00", "0", "7", "f", "-", "_", "$", ".", "/", "@", "ſ"]
    words = ["".join(rng.choice(letters[:i]) for _ in range(rng.randrange(1, 22))) for i in range(1, len(letters) + 1) for _ in range(60)]
    words += ["key", "KEY", "to\u212aen", "pa\u017f\u017fword", "db_pass", "compass", "ΑΣ", "ΑΣΑ", "a" * 14, "a" * 15, "İ" * 14, "=", ":", '"', "'", "\n", "^", "(", "pin"] * 30
    rng.shuffle(words)
    texts = [rng.choice([" ", " ", ""]).join(words[k : k + 20]) for k in range(0, len(words), 20)]
    seen = []
    monkeypatch.setattr(secrets_crf.Field, "settled", lambda self, emit: seen.append(emit.copy()) or np.full(len(emit), True))
    model = secrets_crf.Words(field)
    for _ in range(2):
        model.spans(texts)
        at = secrets_crf.AFTER
        for text in texts:
            want = [field.scores([f for _, _, f in c]) for c in secrets_crf.chains(text)]
            for scores in want:
                assert np.allclose(seen[-1][at : at + len(scores)], scores, atol=1e-9), text
                at += len(scores)
            at += secrets_crf.AFTER


def test_paths_of_many_are_the_paths_of_each():
    rng = np.random.default_rng(5)
    for n in range(1, secrets_crf.STRETCH + 1):
        field = secrets_crf.Field()
        field.move += rng.integers(-2, 3, size=(3, 3))  # whole numbers: many ties
        emit = rng.integers(-2, 3, size=(200, n, 3)).astype(float)
        assert field.paths(emit).tolist() == [field.path(e) for e in emit]


def test_tagging_costs_about_what_cutting_costs():
    """Of prose whose words are mostly new. The field took over four times the time of cutting tokens by an expression, which itself was part of it."""
    rng = random.Random(11)
    parts = ["er", "an", "the", "in", "on", "re", "st", "ion", "ou", "ment", "é", "sch", "os", "ung", "ción", "eau"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "", "", ",", "."]) for _ in range(5000)) for _ in range(40)]
    took = {"cut": [], "tag": []}
    model = secrets_crf.trained()
    for _ in range(3):
        words = secrets_crf.Words(model)
        for what, run in (("cut", lambda: [secrets_crf.tokens_of(t) for t in texts]), ("tag", lambda: words.spans(texts))):  # noqa: B023
            began = time.process_time()
            run()
            took[what].append(time.process_time() - began)
    assert min(took["tag"]) < 4 * min(took["cut"]), took


@pytest.mark.parametrize("stage", ["mixed", "sharded", "one_of_each", "scan", "without"])
def test_values_of_clashing_columns_stay(spark, stage):
    rows = [(i, f"text number {i} of a few words that say {i * 7}", "en", f"s{i % 2}", *[f"{c}-{i}" for c in CLASH]) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["doc_id", "text", "lang", "source", *CLASH]).replace("`doc_id` string", "doc_id long"))
    out = {
        "mixed": lambda: mixing.mixed(docs), "sharded": lambda: sharding.sharded(docs), "one_of_each": lambda: simhash.one_of_each(docs), "scan": lambda: license_scan.scan(docs),
        "without": lambda: without(docs, spark.createDataFrame([("none",)], "__key string"), "doc_id", "text"),
    }[stage]()
    got = out.collect()
    own = {"scan": {"__n_words"}}.get(stage, set())
    assert got and set(docs.columns) <= set(out.columns)
    for r in got:
        for c in CLASH:
            assert c in own or r[c] == f"{c}-{r.doc_id}"


def test_unlike_texts_with_near_fingerprints_make_no_group(spark):
    """20,000 fingerprints, each a bit from the next: by fingerprints one chain, by sketches no link at all."""
    rng, fp, rows = np.random.default_rng(0), 0, []
    for i in range(20_000):
        fp ^= 1 << int(rng.integers(0, 64))
        rows.append((int(np.uint64(fp).view(np.int64)), int(rng.integers(-(1 << 63), 1 << 63 - 1))))
    prints = spark.createDataFrame(rows, "__fp long, __sk long")
    whole = connected_components(simhash.near_links(prints, simhash.COPY_RADIUS).distinct()).groupBy("root").count().agg(F.max("count")).first()[0]
    sketched = connected_components(simhash.near_links(prints, simhash.COPY_RADIUS, apart=simhash.SKETCH_APART).distinct()).groupBy("root").count()
    assert whole > 15_000 and (sketched.agg(F.max("count")).first()[0] or 0) <= 8  # chance links of a few in a hundred thousand near pairs
    twice = spark.createDataFrame([r for fp, sk in rows[:3000:3] for r in ((fp, sk), (fp ^ 5, sk ^ 9))], "__fp long, __sk long")
    links = simhash.near_links(twice, simhash.COPY_RADIUS, apart=simhash.SKETCH_APART)
    pairs = {frozenset((r.a, r.b)) for r in links.collect()}
    want = {frozenset((r.a, r.b)) for r in twice.select(simhash.node_of(F.col("__fp"), F.col("__sk")).alias("a"), simhash.node_of(F.col("__fp").bitwiseXOR(5), F.col("__sk").bitwiseXOR(9)).alias("b")).collect()}
    assert len(want & pairs) == 1000


def test_sketches_tell_alike_from_unlike():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    apart = {True: [], False: []}
    for _ in range(150):
        n = rng.choice([12, 40, 200, 900])
        a = [rng.choice(words) for _ in range(n)]
        b = list(a)
        for _ in range(max(1, n // 60)):
            b[rng.randrange(n)] = rng.choice(words)
        c = [rng.choice(words) for _ in range(n)]
        sets = [simhash.shingles(" ".join(x).encode()) for x in (a, b, c)]
        both = len(np.intersect1d(sets[0], sets[1]))
        if both >= 0.8 * (len(sets[0]) + len(sets[1]) - both):
            apart[True].append((simhash.sketch(sets[0]) ^ simhash.sketch(sets[1])).bit_count())
        apart[False].append((simhash.sketch(sets[0]) ^ simhash.sketch(sets[2])).bit_count())
    assert len(apart[True]) > 60 and max(apart[True]) <= simhash.SKETCH_APART
    assert np.mean(np.array(apart[False]) <= simhash.SKETCH_APART) < 0.01 and abs(np.mean(apart[False]) - 32) < 2


def test_recall_of_near_copies_in_the_given_documents(spark):
    """All pairs of different texts that are 0.8 similar in five-word shingles, found by their shared shingles, against what the stage groups: nine of ten, at least, lose one of the two."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    sets, index, pairs = {}, {}, []
    seen = set()
    for r in sorted(rows, key=lambda r: r.doc_id):
        words = xxhash.xxh3_128_digest(b" ".join((r.text or "").encode().lower().split()))
        if words not in seen:
            seen.add(words)
            sets[r.doc_id] = simhash.shingles((r.text or "").encode())
    for d, found in sets.items():
        met: dict[int, int] = {}
        for h in found.tolist():
            for other in index.setdefault(h, []):
                met[other] = met.get(other, 0) + 1
            index[h].append(d)
        pairs += [(other, d) for other, both in met.items() if both * 5 >= (len(found) + len(sets[other]) - both) * 4]
    stay = {r.doc_id for r in simhash.one_of_each(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("doc_id").collect()}
    caught = sum(not (a in stay and b in stay) for a, b in pairs)
    assert pairs and caught >= 0.9 * len(pairs), (caught, len(pairs))


@pytest.mark.parametrize("size", [0, 1, (1 << 18) - 1, 1 << 18, (1 << 18) + 1, (1 << 18) + 2, 700_003])
def test_long_texts_have_the_trigrams_of_the_whole(size):
    data = bytes(random.Random(size).choices(b"abcde  .", k=size))
    model = langid.TextModel(["x", "y"], np.random.default_rng(1).integers(0, 50, (2, langid.BUCKETS)), np.zeros((2, 2)))
    got, n = model.means(data)
    codes = langid._codes(data)
    if size == 0:
        assert n == 0
    else:
        assert n == len(codes) and got == pytest.approx(model.log_p[:, codes].astype(float).sum(axis=1) / max(1, n), rel=1e-9)
