"""Secret scan: base patterns, and a linear-chain conditional random field.

The field tags tokens as secret begin, inside or outside, from the token's shape, the words beside it and features of its file, and
is decoded by Viterbi. Tokens are words and marks, whatever stands between them. Every token of a text is scored and may be tagged, beside a hint
word (password, key, bearer, ...) or far from any. Where the scores leave no best path but through outside, a chain is decoded in parts, which is
decoding the whole. The model is trained on generated lines (`examples`), the same each time; tests hold it against lines of that generator and
against others that were written by hand.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "api")

OUT, BEGIN, INSIDE = range(3)
WEIGHTS = 1 << 15
#: Runs between separators, with padding of base 64 behind them; separators and breaks between lines.
_RUN = re.compile(r"""[^\s"'`=:,;()<>{}\[\]|]++(?:={1,2}(?![^\s"'`,;)}\]]))?|[^\s]|\n""")
_STOPS, _ENDS = ".!?", ".!?="
#: Kinds of bytes for `cuts`: between tokens, of a word, a stop in a word, a token of its own, padding behind a word. Bytes of other code points are words', but for those of blanks.
BLANK, WORD, STOP, MARK, PAD = range(5)
_BYTES = np.array([BLANK if chr(i).isspace() and chr(i) != "\n" else MARK if chr(i) in "\n\"'`=,:;()<>{}[]|" else STOP if chr(i) in _STOPS else WORD for i in range(128)] + [WORD] * 128, np.uint8)
_CLOSES = np.isin(np.arange(256), list(b"\n\"'`,;)}]"))
_WIDE_BLANKS = re.compile(b"|".join(re.escape(chr(i).encode()) for i in range(128, 0x3001) if chr(i).isspace()))
#: Words that announce a secret, as parts of words.
_HINT = re.compile(r"(?<![a-z])(?:passw|pass(?![a-z])|passphrase|passcode|pwd|secret|token|api[_-]?key|auth|bearer|credential|private[_-]?key|access[_-]?key|signature|pin(?![a-z])|login|key(?![a-z])|otp(?![a-z]))|_(?:pass|pwd|key|token|secret|pin)(?![a-z])", re.IGNORECASE)
#: Tokens behind a hint word whose features tell how far it is.
AFTER = 8
#: Tokens scored at once.
SLICE = 1 << 16
#: Characters of short texts that are scored together.
TOGETHER = 1 << 20
#: Characters of words that are told apart by arrays.
WIDTH = 16
#: Tokens of stretches whose tags are found for many at once.
STRETCH = 8
#: Added to the score of a secret's tags after training: a missed secret costs more than a false find.
LEAN = 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# -- features -------------------------------------------------------------------------------------


class _Kinds(dict):
    """Characters by code point as far as features of shapes tell them apart, for str.translate: letters and digits by their kinds, marks as they are."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        cased = "u" if c.isupper() else "l" if c.islower() else ""
        self[point] = "d" if c.isdigit() else cased if cased and c.isascii() else {"u": "U", "l": "L"}[cased] if cased and c.isalpha() else c if cased or not c.isalpha() or c.istitle() else "o"
        return self[point]


_KINDS = _Kinds()
_ODD = frozenset("@#$%^&*!~")
_HEX_POINTS = np.isin(np.arange(128), list(b"0123456789abcdefABCDEF"))


def _class(t: str) -> str:
    """What a neighbour looks like: a short word stands for itself, others for their kinds of characters."""
    if t.isalpha():
        return t.lower() if len(t) <= 14 else f"a{min(len(t) // 6, 4)}"
    return "".join(sorted({"d" if c.isdigit() else "a" if c.isalpha() else c if c in "_-/+.@#$%&*!" else "m" for c in t})) + str(min(len(t) // 6, 4))


def _entropy(t: str) -> int:
    """Of its characters, in half bits."""
    n, some = len(t), set(t)
    if len(some) == n:
        return int(2 * math.log2(n))
    often = sorted([k for k in map(t.count, some) if k > 1] if n < 32 else [k for k in Counter(t).values() if k > 1])
    return int(2 * (math.log2(n) - sum(k * math.log2(k) for k in often) / n))


def _hexy(t: str) -> bool:
    return not t.strip("0123456789abcdefABCDEF")


def _shape(t: str) -> list[str]:
    n = len(t)
    if n == 1 and not t.isalnum():
        return [f"mark{t}"]
    digits, uppers, lowers = sum(c.isdigit() for c in t), sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    marks = n - digits - uppers - lowers
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in t]
    turns = sum(map(ne, kinds, kinds[1:]))
    hexy = _hexy(t)
    mix = f"{digits > 0}{uppers > 0}{lowers > 0}{marks > 0}"
    return [
        f"n{min(n // 4, 10)}", f"d{digits * 5 // n}", f"u{(uppers > 0) + (uppers > 2)}", f"l{(lowers > 0) + (lowers > 2)}", f"p{min(marks, 3)}", f"e{_entropy(t)}",
        f"t{min(10, turns * 10 // n)}", f"h{hexy}{n > 15}", f"mix{mix}", f"num{digits + marks == n}", f"tn{min(turns, 12)}n{min(n // 8, 5)}", f"dots{min(t.count('.'), 3)}", f"dash{min(t.count('-'), 4)}",
        f"mixn{mix}{min(n // 6, 5)}", f"cap{t[:1].isupper() and t[1:].islower()}", f"odd{not _ODD.isdisjoint(t)}", f"url{'//' in t or '@' in t and '.' in t}",
    ]


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Words (marks such as $ or / may be part of them, padding of base 64 ends them), stops behind words and separators, one each, and line breaks. A run is matched once, so time grows with the text."""
    out = []
    for span in [m.span() for m in _RUN.finditer(text, start, len(text) if end is None else end)]:
        begin, last = span
        if text[last - 1] not in _ENDS or last - begin == 1:
            out.append(span)
            continue
        run = text[begin:last].rstrip("=")  # no separator is inside a run
        last = begin + len(run)
        word = begin + len(run.rstrip(_STOPS))
        if word == last:
            out.append(span)
            continue
        if word > begin:
            out.append((begin, word))
        out += [(i, i + 1) for i in range(word, last - 1)]
        out.append((last - 1, span[1]))
    return out


def cuts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of `tokens_of` begin and end in UTF-8 that ends with a blank, and all bytes of tokens. Texts may be joined by blanks."""
    raw = np.frombuffer(data, np.uint8)
    kind = _BYTES[raw]
    if not data.isascii():
        for m in _WIDE_BLANKS.finditer(data):
            kind[m.start() : m.end()] = BLANK
    at = np.flatnonzero(raw == ord("="))
    if len(at):
        first, last = _groups(at)
        padding = (last - first < 2) & np.isin(kind[first - 1], (WORD, STOP)) & ((kind[last + 1] == BLANK) | _CLOSES[raw[last + 1]])
        kind[first[padding]] = kind[last[padding]] = PAD
    at = np.flatnonzero(kind == STOP)
    if len(at):
        first, last = _groups(at)
        kind[at[np.repeat(kind[last + 1] != WORD, last - first + 1)]] = MARK
    full = kind != BLANK
    word = (kind == WORD) | (kind == STOP)
    begin = kind == MARK
    begin[0] |= word[0]
    begin[1:] |= word[1:] & ~word[:-1]
    return np.flatnonzero(begin), np.flatnonzero(full[:-1] & (begin[1:] | ~full[1:])) + 1, raw[full]


def _groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each group of places that follow each other."""
    gap = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])]


def _hint_words(word: str) -> bool:
    return bool(_HINT.search(word))


#: Neighbours by their distance to the left, with the names of their features.
_BESIDE = {1: "l1", 2: "l2", 3: "l3", -1: "r1", -2: "r2"}
_QUOTES = "\"'`"


def _alone(word: str) -> list[str]:
    """Features that a word has wherever it stands."""
    return ["bias", *_shape(word), f"w{word.lower() if word.isalpha() and len(word) < 15 else ''}", f"is{_hint_words(word)}"]


def _sort(word: str) -> str:
    kind = "long" if len(word) >= 20 else "mid" if len(word) >= 8 else "short"
    if word.isalpha():
        return f"{kind}FalseTrueFalse"
    return f"{kind}{any(c.isdigit() for c in word)}{any(c.isalpha() for c in word)}{not word.isalnum()}"


def _behind(back: int, between: str, sort: str) -> list[str]:
    """Features of a word of that sort `back` tokens behind a hint (0: none), with what stands between."""
    return [f"hint{back}", f"hinted{back > 0}{between}", f"hk{back > 0}{sort}", f"between{between}{sort}"]


def _between(words: list[str]) -> str:
    return "".join(sorted(set("".join(w if not w[0].isalnum() else "w" for w in words))))[:6]


def features(words: list[str], spans: list[tuple[int, int]], hinted: list[bool], i: int, file: list[str]) -> list[int]:
    """Hashed features of token i: its shape, the words beside it, how far behind it a hint is and what stands between, whether it touches the token before, the file's."""
    near = lambda k: words[i + k] if 0 <= i + k < len(words) else "^"
    word = words[i]
    back = 0
    for d in range(1, min(i, AFTER) + 1):
        if words[i - d] == "\n":
            break
        if hinted[i - d]:
            back = d
            break
    sort = _sort(word)
    names = [
        *_alone(word), *_behind(back, _between(words[i - back + 1 : i]) if back else "", sort), f"touch{i > 0 and spans[i - 1][1] == spans[i][0]}", *[f"{name}{_class(near(-d))}" for d, name in _BESIDE.items()],
        f"l1k{near(-1)[0]}{sort}", f"quoted{near(-1) in _QUOTES and near(1) in _QUOTES}{back > 0}", *file,
    ]
    return [_feature(x) for x in names]


def _feature(name: str) -> int:
    return 1 + zlib.crc32(name.encode()) % (WEIGHTS - 1)


def file_features(text: str) -> list[str]:
    code = sum(text.count(c) for c in "{}();=<>") * 50 // max(1, len(text))
    low = text.lower()
    return [f"code{min(code, 3)}", f"hints{any(k in low for k in _KEYWORDS)}"]


class Chain:
    """All tokens of a text: (start, end, features) each. Features are made as they are asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, tokens_of(text)

    def __iter__(self) -> Iterator[tuple[int, int, list[int]]]:
        words = [self.text[s:e] for s, e in self.spans]
        hinted, file = [_hint_words(w) for w in words], file_features(self.text)
        for i, span in enumerate(self.spans):
            yield (*span, features(words, self.spans, hinted, i, file))


def chains(text: str) -> list[Chain]:
    """The text's chain of all its tokens; none, if it has no token."""
    whole = Chain(text)
    return [whole] if whole.spans else []


# -- the field --------------------------------------------------------------------------------------


class Field:
    """Weights of emissions (feature by tag) and transitions. A chain begins and ends beside an outside token."""

    def __init__(self) -> None:
        self.emit, self.move = np.zeros((WEIGHTS, 3)), np.zeros((3, 3))
        self.move[OUT, INSIDE] = -1e3  # inside follows begin or inside only

    def scores(self, chain: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in chain])

    def viterbi(self, chain: list[list[int]]) -> list[int]:
        """The likeliest tags."""
        return self.path(self.scores(chain))

    def path(self, emit: np.ndarray) -> list[int]:
        """The likeliest tags of tokens (at least one) with these scores."""
        move, rows = self.move.T.tolist(), emit.tolist()
        best, back = [m[OUT] + e for m, e in zip(move, rows[0], strict=True)], []
        for row in rows[1:]:
            through = [[b + m for b, m in zip(best, to, strict=True)] for to in move]
            best = [max(t) for t in through]
            back.append([t.index(b) for t, b in zip(through, best, strict=True)])
            best = [b + e for b, e in zip(best, row, strict=True)]
        ends = [b + m for b, m in zip(best, move[OUT], strict=True)]
        tags = [ends.index(max(ends))]
        for b in reversed(back):
            tags.append(b[tags[-1]])
        return tags[::-1]

    def paths(self, emit: np.ndarray) -> np.ndarray:
        """The likeliest tags of chains of one length (chains x tokens x tags), those that `path` finds."""
        best, back = self.move[OUT] + emit[:, 0], []
        for i in range(1, emit.shape[1]):
            through = best[:, :, None] + self.move
            back.append(through.argmax(axis=1))
            best = through.max(axis=1) + emit[:, i]
        tags = [(best + self.move[:, OUT]).argmax(axis=1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def settled(self, emit: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path, whatever the tags beside them: to make them so, and an inside behind them a begin, raises the score of any other path."""
        move = self.move
        follow = np.zeros(len(emit))
        follow[:-1] = emit[1:, BEGIN] - emit[1:, INSIDE]
        out = np.full(len(emit), True)
        for t in (BEGIN, INSIDE):
            before = (move[:, OUT] - move[:, t]).min()
            behind = (move[OUT, :INSIDE] - move[t, :INSIDE]).min()
            inside = move[OUT, BEGIN] - move[t, INSIDE] + (move[BEGIN] - move[INSIDE]).min() + follow
            out &= emit[:, OUT] - emit[:, t] + before + np.minimum(behind, inside) > 1e-6
        return out

    def gradient(self, feats: np.ndarray, tags: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients by emission (chains x tokens x tags) and transition, and the log likelihood, of chains filled up to one length. Forward and backward sums in logarithms."""
        emit = self.emit[feats].sum(axis=2)
        n, size, every = feats.shape[0], live.sum(axis=1).astype(np.int64), np.arange(feats.shape[0])
        fore = np.empty((n, feats.shape[1], 3))
        fore[:, 0] = self.move[OUT] + emit[:, 0]
        for i in range(1, feats.shape[1]):
            fore[:, i] = np.logaddexp.reduce(fore[:, i - 1, :, None] + self.move, axis=1) + emit[:, i]
        rear = np.empty_like(fore)
        rear[:, -1] = self.move[:, OUT]
        for i in range(feats.shape[1] - 2, -1, -1):
            rear[:, i] = np.logaddexp.reduce(self.move + (emit[:, i + 1] + rear[:, i + 1])[:, None, :], axis=2)
            rear[i + 1 == size, i] = self.move[:, OUT]
        total = np.logaddexp.reduce(fore[every, size - 1] + self.move[:, OUT], axis=1)
        single = np.exp(fore + rear - total[:, None, None]) * live[:, :, None]
        want = -single
        want[every[:, None], np.arange(feats.shape[1]), tags] += live
        move = np.zeros((3, 3))
        move[OUT] -= single[:, 0].sum(axis=0)
        move[:, OUT] -= single[every, size - 1].sum(axis=0)
        pair = np.exp(fore[:, :-1, :, None] + self.move + (emit[:, 1:] + rear[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        move -= pair.sum(axis=(0, 1))
        np.add.at(move, (OUT, tags[:, 0]), 1)
        np.add.at(move, (tags[every, size - 1], OUT), 1)
        inner = live[:, 1:] > 0
        np.add.at(move, (tags[:, :-1][inner], tags[:, 1:][inner]), 1)
        score = (np.take_along_axis(emit, tags[:, :, None], 2)[:, :, 0] * live).sum() + self.move[OUT, tags[:, 0]].sum() + self.move[tags[every, size - 1], OUT].sum() + self.move[tags[:, :-1][inner], tags[:, 1:][inner]].sum()
        return want, move, float(score - total.sum())

    def fit(self, data: list[tuple[list[list[int]], list[int]]], rounds: int = 10, rate: float = 0.25, decay: float = 1e-4, batch: int = 64) -> None:
        """Adagrad over batches of chains of about one length, in a fixed order. Feature 0 fills up and has no weight."""
        emit_sq, move_sq = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        order = np.random.default_rng(7)
        data = sorted(data, key=lambda x: len(x[1]))
        batches = []
        for at in range(0, len(data), batch):
            part = data[at : at + batch]
            longest, width = max(len(t) for _, t in part), max(len(f) for c, _ in part for f in c)
            feats, tags, live = np.zeros((len(part), longest, width), np.int64), np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest))
            for k, (chain, own) in enumerate(part):
                live[k, : len(own)], tags[k, : len(own)] = 1, own
                for i, f in enumerate(chain):
                    feats[k, i, : len(f)] = f
            batches.append((feats, tags, live))
        for _ in range(rounds):
            for k in order.permutation(len(batches)):
                feats, tags, live = batches[k]
                want, move_grad, _ = self.gradient(feats, tags, live)
                used, of = np.unique(feats, return_inverse=True)
                grad = np.stack([np.bincount(of.reshape(-1), np.repeat(want[:, :, t].reshape(-1), feats.shape[2]), len(used)) for t in range(3)], axis=1) - decay * len(feats) * self.emit[used]
                grad[used == 0] = 0
                move_grad[OUT, INSIDE] = 0
                emit_sq[used] += grad**2
                move_sq += move_grad**2
                self.emit[used] += rate * grad / np.sqrt(emit_sq[used])
                self.move += rate * move_grad / np.sqrt(move_sq)


# -- training data ----------------------------------------------------------------------------------

_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Words that generated lines are made of; texts of other languages than these come from syllables.
_COMMON = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good make world very year still see own work men day get here old between both life being under three never know same last another while us might great go come since against right came take used himself few house american use place during high without again home around small however found mrs part school thought went say general once upon war every left got does number until always away something fact though water less public put think almost hand enough far took head yet better set told nothing end why called eyes find going look asked later knew point next city room users account settings please change required field value default string null none true false empty invalid missing expired reset manager store database server service policy contact support email address phone invoice order page version file folder path name title section chapter".split()
_ANIMALS = "tiger maple horse river stone copper falcon battery staple correct dragon winter summer shadow monkey purple silver orange rocket planet guitar coffee silent garden thunder hammer anchor velvet walnut pepper castle marble cactus magnet bridge canyon desert forest island jungle lagoon meadow".split()


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """n generated texts with the spans of their secrets: keys of many forms, passwords with letters, digits and marks or letters only, numbers; as settings, in prose and headers. Half hold none but look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    run = lambda chars, k: "".join(chars[i] for i in rng.integers(len(chars), size=k))
    size = lambda a, b: int(rng.integers(a, b))
    syllables = lambda: "".join(pick(["er", "an", "the", "in", "on", "re", "st", "ion", "ou", "ment", "é", "sch", "os", "ung", "ción", "eau"]) for _ in range(size(1, 5) if rng.random() < 0.8 else size(5, 9)))
    word = lambda: pick(_COMMON) if rng.random() < 0.6 else syllables()
    cased = lambda w: pick([w, w, w.capitalize(), w.upper()])
    running = lambda k: " ".join((cased(word()) if rng.random() < 0.2 else word()) + (pick([",", ".", "?", "!", "!!", "%%%", "$$$", "###", "***", "&&&"]) if rng.random() < 0.08 else "") for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def leet() -> str:
        body = list(pick(_ANIMALS) + pick(["", pick(_ANIMALS)]))
        for _ in range(size(1, 4)):
            k = size(0, len(body))
            body[k] = {"a": "@", "s": "$", "o": "0", "e": "3", "i": "1", "l": "!"}.get(body[k], body[k].upper())
        return "".join(body) + pick(["", "!", "1", "#", str(size(1, 999)), "!x", "_" + str(size(1, 99))])

    key = [
        lambda: run("0123456789abcdef", size(24, 65)), lambda: run(_B62, size(20, 44)), lambda: run(_B62 + "+/", size(24, 60)) + pick(["", "=", "=="]), lambda: "AKIA" + run(upper + "234567", 16), lambda: pick(["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "pk_live_", "sk_test_", "npm_", "dop_v1_", "hf_", "SG."]) + run(_B62, size(20, 40)),
        lambda: "AIza" + run(_B62 + "_-", 35), lambda: "eyJ" + run(_B62, size(16, 30)) + "." + run(_B62, size(20, 40)) + "." + run(_B62 + "_-", size(20, 40)), lambda: run(_B62, size(12, 20)) + ":" + run(_B62, size(16, 30)),
    ]
    chosen = [
        lambda: run(lower + upper + digits + "!@#$%^&*", size(8, 20)), leet, leet, lambda: "".join(pick(_ANIMALS) for _ in range(size(2, 4))), lambda: pick(["-", "_", "."]).join(pick(_ANIMALS) for _ in range(size(3, 6))), lambda: run(lower, size(10, 30)), lambda: run(lower + upper, size(8, 40)),
        lambda: run(digits, size(4, 8)), lambda: run(digits, size(4, 7)), lambda: pick(_ANIMALS) + pick(["", pick(_ANIMALS)]) + str(size(1, 9999)), lambda: pick(_ANIMALS).capitalize() + str(size(10, 9999)) + pick(["", "!", "?", "#", "$"]), lambda: run(upper + digits, size(8, 20)), lambda: "-".join(run(upper + digits, 5) for _ in range(size(3, 6))), lambda: " ".join(pick(_ANIMALS) for _ in range(size(3, 7))),
    ]
    plain = [
        lambda: run(digits, size(1, 20)), lambda: f"{size(1990, 2030)}-{size(1, 13):02d}-{size(1, 29):02d}", lambda: f"{size(1, 250)}.{size(1, 250)}.{size(1, 250)}.{size(1, 250)}", lambda: f"v{size(1, 9)}.{size(0, 20)}.{size(0, 30)}-rc{size(1, 5)}", lambda: syllables() + word() + str(size(1, 2030)), lambda: f"+{size(1, 99)}-{run(digits, 3)}-{run(digits, 7)}", lambda: f"{pick(_COMMON)}-{pick(_COMMON)}-{pick(_COMMON)}-{size(1, 2030)}",
        lambda: f"{size(100, 999)}-{size(1000, 9999)}", lambda: f"{word()}.{size(1, 99):02d}@mail{size(1, 9)}.example.com", lambda: f"{word()}{size(1, 99)}@{word()}{size(1, 9)}.{pick(['org', 'net', 'com'])}", lambda: f"https://www{size(1, 9)}.{word()}.com/{word()}/{size(1, 9999)}", lambda: f"/usr/{word()}/{word()}_{word()}{size(1, 9)}/{word()}-{size(1, 9)}.{size(1, 20)}.tar.gz", lambda: f"{word()}_{size(1, 9)}/{word()}.{word()}", lambda: f"ISBN-{run(digits, 10)}", lambda: f"{run(upper[:8], 2)}-{size(1000, 99999)}-{run(upper[:3], 1)}", lambda: f"{size(1, 999)}.{run(digits, 6)}", lambda: f"{size(0, 10)}.{size(0, 10)}", lambda: f"20{run(digits, 6)}T{run(digits, 6)}Z", lambda: f"{word()}-{word()}-{size(1, 99)}-{word()}", lambda: f"{word()}_{word()}_{word()}{size(1, 99)}", lambda: f"{cased(word())}{pick(['!!', '%%%', '$$$', '###', '***'])}", lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}{size(1, 99)}",
    ]
    name = lambda: pick(["password", "passwd", "pwd", "PASSWORD", "Password", "db_password", "DB_PASS", "passphrase", "Passphrase", "pass", "secret", "client_secret", "SECRET_KEY", "token", "auth_token", "API token", "api_key", "apikey", "API key", "access key", "private key", "credential", "login", "PIN", "pin", "passcode", "session key", "otp", "OTP", "signature", "aws_secret_access_key", "key", "pin code", "pass code", "PGPASSWORD", "MYSQL_PWD", "sessionid cookie", "session token", "login", "unlock code", "cookie secret"])
    setting = lambda: name() + pick([": ", " = ", "=", ' = "', ": '", ':"', '": "', " := ", " => '", "  :  ", " -> "])
    prose = lambda: pick(["the ", "my ", "your ", "our ", "new ", "temporary ", "", "root ", "wifi "]) + name() + pick([" is ", " was ", " ", " is: ", " will be ", " (", " is now ", ", use ", " changed to ", " set to ", " of " + word() + " is ", " for the " + word() + ": ", " for " + word() + " is ", " here: ", ": ", " since then was "])
    header = lambda: pick(["Authorization: Bearer ", "authorization: Basic ", "Bearer ", "X-Auth-Token: ", "x-api-key: ", "--token ", "--password ", "-p ", "Cookie: session=", "export API_KEY=", "curl -u admin:", "postgres://user:", "ssh key "])
    #: what follows a hint without being a secret
    nothing = lambda: pick(["", "is required", "must be set", "field is empty", "null", "none", "true", "has expired", "was reset by " + word(), "of the " + word(), "manager " + word(), "policy: " + word() + " " + word(), "length: " + str(size(1, 40)), "to the " + word(), "and " + word() + " " + word(), "for " + word(), "holder", "points of the " + word(), "in " + word() + " " + str(size(1, 2030)), "s are " + word(), "not found", "<" + word() + ">", "= " + pick(["null", "None", "true", "''", '""', "input()", "os.environ", "get_" + word() + "()"]), "? " + word() + " " + word()])
    end = lambda lead: pick(['" ', '", ', '"\n']) if lead.rstrip().endswith('"') else pick(["' ", "', ", "')\n"]) if lead.endswith("'") else ") " if lead.endswith("(") else "@localhost/db " if lead.endswith("user:") else pick([" ", "\n", ". ", ", ", " ", "; ", "\n\n", "!! ", "### "])
    out = []
    for i in range(n):
        text = running(size(0, 12)) + pick([" ", "\n", " ", ". "])
        spans = []
        for _ in range(size(1, 4)):
            draw = rng.random()
            if i % 2 == 0 and draw < 0.85:
                key_like = rng.random() < 0.4
                lead = pick([setting, setting, prose, prose, header])() if not key_like or rng.random() < 0.7 else word() + " "
                body = pick(key)() if key_like else pick(chosen)()
                if (" " in body or len(body) < 8) and not any(c in lead for c in ":=\"'("):
                    body = leet()
                spans.append((len(text), len(text) + len(body)))
                text += lead
                spans[-1] = (len(text), len(text) + len(body))
                text += body + end(lead)
            elif draw < 0.5:
                text += pick(["the ", "", "a ", "your "]) + name() + pick([" ", ": ", " "]) + nothing() + pick([" ", ". ", "\n", ", "])
            else:
                text += word() + pick([" ", " ", ": ", " = ", " ("]) + pick(plain)() + pick([" ", ", ", ". ", "\n", ") "])
            text += running(size(1, 9) if rng.random() < 0.85 else size(9, 40)) + pick([" ", ". ", "\n"])
        out.append((text, spans))
    return out


def labelled(texts: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[list[list[int]], list[int]]]:
    data = []
    for text, spans in texts:
        for chain in chains(text):
            tags, open_ = [], None
            for s, e, _ in chain:
                of = next((x for x in spans if x[0] < e and s < x[1]), None)  # few, by the generator
                tags.append(OUT if of is None else INSIDE if of == open_ else BEGIN)
                open_ = of
            data.append(([f for _, _, f in chain], tags))
    return data


@lru_cache(1)
def trained(n: int = 3500, seed: int = 11, lean: float = LEAN) -> Field:
    field = Field()
    field.fit(labelled(examples(n, seed)))
    field.emit[_feature("bias"), [BEGIN, INSIDE]] += lean
    return field


class Words:
    """Scores of all tokens of texts, those that `Field.scores` has for the features of `chains`: what a word has alone and lends to those beside it is summed once a word, and arrays of these sums are added up.

    Words are kept as UTF-8 until there are `most`, then anew. Before and behind each text stand AFTER tokens of no text, number 0.
    """

    def __init__(self, field: Field, most: int = 1 << 19) -> None:
        self.field, self.most, both = field, most, (False, True)
        kinds = [f"{kind}{a}{b}{c}" for kind in ("short", "mid", "long") for a in both for b in both for c in both]
        self.sorts, self.sort_names = {k: i for i, k in enumerate(kinds)}, kinds
        files = [(f"code{c}", f"hints{h}") for c in range(4) for h in both]
        self.file_of = {f: i for i, f in enumerate(files)}
        #: by file, touching or not, quoted or not, behind a hint or not, and sort, whose features behind a hint are added where it stands
        around = [[self._sums([[*f, f"touch{t}", f"quoted{q}{h}", *([] if h else _behind(0, "", k))] for k in kinds]) for h in both] for f in files for t in both for q in both]
        self.around = np.array(around).reshape(-1, 3)
        begun = [zlib.crc32(name.encode()) for name in ("w", *_BESIDE.values())]
        #: what the name of a feature adds to the hash of the word behind it, by the word's bytes
        self.begun = np.array([[zlib.crc32(bytes(n), c) ^ zlib.crc32(bytes(n)) for c in begun] for n in range(256)])
        self.hinted = self._sums([[f"is{h}"] for h in both])
        self.points = np.full(sys.maxunicode + 1, -1, np.int32)
        self._clear()

    def _sums(self, lists: list) -> np.ndarray:
        return np.array([self.field.emit[[_feature(x) for x in names]].sum(axis=0) for names in lists])

    def _clear(self) -> None:
        self.ids, self.words, self.hints = {}, [], {}
        self.alone, self.beside = np.zeros((1024, 3)), [np.zeros((1024, 3)) for _ in _BESIDE]
        self.flags, self.sort, self.first = np.zeros((1024, 3), bool), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.firsts, self.first_names, self.pairs, self.paired = {}, [], np.zeros((1024, 3)), np.zeros(1024, bool)
        self.forms, self.form_sums, self.form_sorts, self.form_looks, self.form_short, self.alike = {}, [], [], [], [], {}
        self._learn([b"^"], True)

    def _form(self, word: str) -> int:
        """The number of all that features know of a word but its letters: looked up by kinds of characters, entropy and whether it is hexadecimal."""
        key = (word.translate(_KINDS), _entropy(word), _hexy(word))
        form = self.forms.get(key)
        if form is None:
            form = self.forms[key] = len(self.form_sums)
            self.form_sums.append(self._sums([["bias", *_shape(word)]])[0])
            self.form_sorts.append(self.sorts[_sort(word)])
            self.form_short.append(word.isalpha() and len(word) < 15)  # stands for itself
            self.form_looks.append([_feature("w"), *[_feature(name + _class(word)) for name in _BESIDE.values()]])
        return form

    def _forms(self, words: list[str], size: np.ndarray) -> np.ndarray:
        """Their forms, asked once for words of up to WIDTH characters that agree in kinds of characters, in how often these repeat, and in being hexadecimal."""
        forms = np.zeros(len(words), np.int64)
        points = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
        inside = np.arange(WIDTH) < size[:, None]
        brief = (size <= WIDTH) & ((points > 0) == inside).all(axis=1)
        for i in np.flatnonzero(~brief).tolist():
            forms[i] = self._form(words[i])
        which = np.flatnonzero(brief)
        if not len(which):
            return forms
        points = points[which]
        new = np.unique(points[self.points[points] < 0])
        self.points[new] = [ord(_KINDS[p]) if p else 0 for p in new.tolist()]
        key = np.zeros((len(which), WIDTH + 3), np.uint32)
        key[:, :WIDTH] = self.points[points]
        key[:, WIDTH] = ((points == 0) | _HEX_POINTS[np.minimum(points, 127)]).all(axis=1)
        row, repeats = np.sort(points, axis=1), np.zeros(len(which), np.uint64)
        for d in range(1, WIDTH):  # a character that stands k times has k - d pairs d places apart
            pairs = ((row[:, d:] == row[:, :-d]) & (row[:, d:] > 0)).sum(axis=1)
            if not pairs.any():
                break
            repeats |= pairs.astype(np.uint64) << np.uint64(4 * (d - 1))
        key[:, WIDTH + 1 :] = repeats.view(np.uint32).reshape(-1, 2)
        keys = pa.Array.from_buffers(pa.binary(key.shape[1] * 4), len(which), [None, pa.py_buffer(key)]).dictionary_encode()
        of, kinds = keys.indices.to_numpy(), keys.dictionary.to_pylist()
        some = np.zeros(len(kinds), np.int64)
        some[of] = which
        found = []
        for k, i in zip(kinds, some.tolist(), strict=True):
            form = self.alike.get(k)
            if form is None:
                form = self.alike[k] = self._form(words[i])
            found.append(form)
        forms[which] = np.array(found)[of]
        return forms

    def _learn(self, new: list[bytes], none: bool = False) -> None:
        at, end = len(self.words), len(self.words) + len(new)
        more = lambda x: np.concatenate([x, np.zeros_like(x)])
        while end > len(self.alone):
            self.alone, self.flags, self.sort, self.first = map(more, (self.alone, self.flags, self.sort, self.first))
            self.beside = [more(x) for x in self.beside]
        if not none:  # the mark itself may stand in a text
            self.ids.update(zip(new, range(at, end), strict=True))
        self.words += new
        words = [w.decode("utf-8", "surrogatepass") for w in new]
        size = np.fromiter(map(len, words), np.int64, len(words))
        forms = self._forms(words, size)
        looks, short = np.array(self.form_looks)[forms], np.flatnonzero(np.array(self.form_short)[forms])
        low = [words[i].lower().encode("utf-8", "surrogatepass") for i in short.tolist()]
        own = np.fromiter(map(zlib.crc32, low), np.int64, len(low))
        looks[short] = 1 + (own[:, None] ^ self.begun[np.fromiter(map(len, low), np.int64, len(low))]) % (WEIGHTS - 1)
        for c in dict.fromkeys(w[0] for w in words):
            if c not in self.firsts:
                self.firsts[c] = len(self.firsts)
                self.first_names.append(c)
        while len(self.firsts) * len(self.sorts) > len(self.paired):
            self.pairs, self.paired = more(self.pairs), more(self.paired)
        hinted, ends = np.zeros(len(new), bool), np.cumsum(size + 1)
        hinted[np.searchsorted(ends, [m.start() for m in _HINT.finditer("\n".join(words))], "right")] = True  # no hint has a line break
        self.alone[at:end] = np.array(self.form_sums)[forms] + self.field.emit[looks[:, 0]] + self.hinted[hinted.astype(np.int64)]
        for k, beside in enumerate(self.beside, 1):
            beside[at:end] = self.field.emit[looks[:, k]]
        self.flags[at:end, 0], self.flags[at:end, 1], self.flags[at:end, 2] = hinted, [none or w == "\n" for w in words], [w in _QUOTES for w in words]
        self.sort[at:end], self.first[at:end] = np.array(self.form_sorts)[forms], [self.firsts[w[0]] for w in words]

    def scores(self, ids: np.ndarray, touch: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Of all but the first AFTER tokens and the last two, which are only looked at."""
        n = len(ids)
        at = lambda x, d=0: x[AFTER - d : n - 2 - d]
        own, left = at(ids), at(ids, 1)
        sort = self.sort[own]
        pair = self.first[left] * len(self.sorts) + sort
        for p in set(pair[~self.paired[pair]].tolist()):
            self.pairs[p], self.paired[p] = self._sums([[f"l1k{self.first_names[p // len(self.sorts)]}{self.sort_names[p % len(self.sorts)]}"]])[0], True
        flags, place = self.flags[ids], np.arange(n)
        hint, end = (at(np.maximum.accumulate(np.where(flags[:, k], place, -1)), 1) for k in (0, 1))
        back = np.where(hint > end, at(place) - hint, 0)
        back[back > AFTER] = 0
        quoted = at(flags[:, 2], 1) & at(flags[:, 2], -1)
        out = self.around.take((((at(file) * 2 + at(touch)) * 2 + quoted) * 2 + (back > 0)) * len(self.sorts) + sort, axis=0)
        out += self.alone.take(own, axis=0)
        out += self.pairs.take(pair, axis=0)
        for beside, d in zip(self.beside, _BESIDE, strict=True):
            out += beside.take(at(ids, d), axis=0)
        for i in np.flatnonzero(back).tolist():
            key = (int(back[i]), _between([self.words[w].decode("utf-8", "surrogatepass") for w in ids[AFTER + i - back[i] + 1 : AFTER + i]]), int(sort[i]))
            if key not in self.hints:
                self.hints[key] = self._sums([_behind(key[0], key[1], self.sort_names[key[2]])])[0]
            out[i] += self.hints[key]
        return out

    def _number(self, begin: np.ndarray, end: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Numbers of the tokens' words, new ones learnt."""
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(full)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        numbers = list(map(self.ids.get, distinct))
        if new := [w for w, n in zip(distinct, numbers, strict=True) if n is None]:
            self._learn(new)
            numbers = list(map(self.ids.get, distinct))
        return np.array(numbers)[words.indices.to_numpy()]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans that the field tags as secrets in each text, without marks around them. The tokens of all these texts are held at once."""
        if len(self.words) > self.most:
            self._clear()
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        parts = [text.encode("utf-8", "surrogatepass") for text in texts]
        data, heads = b" ".join([*parts, b""]), np.cumsum([0, *[len(x) + 1 for x in parts]])
        begin, end, full = cuts(data) if data else (np.zeros(0, np.int64),) * 3
        if not len(begin):
            return out
        of = np.searchsorted(heads, begin, "right") - 1
        place, total = np.arange(len(begin)) + AFTER * (of + 1), len(begin) + AFTER * (len(texts) + 1)
        ids, file, touch = (np.zeros(total, np.int64) for _ in range(3))
        ids[place], file[place] = self._number(begin, end, full), np.array([self.file_of[tuple(file_features(text))] for text in texts])[of]
        touch[place[1:]] = begin[1:] == end[:-1]
        emit = np.zeros((total, 3))
        for lo in range(AFTER, total - AFTER, SLICE):
            hi = min(lo + SLICE, total - AFTER)
            seen = slice(lo - AFTER, hi + 2)
            emit[lo:hi] = self.scores(ids[seen], touch[seen], file[seen])
        emit[ids == 0] = 0
        live = np.flatnonzero((ids > 0) & ~self.field.settled(emit))
        if not len(live):
            return out
        first, last = _groups(live)
        length, tagged = last - first + 1, {}
        for n in np.unique(length[length <= STRETCH]).tolist():
            some = first[length == n]
            tags = self.field.paths(emit[some[:, None] + np.arange(n)])
            tagged |= {int(some[k]): tags[k].tolist() for k in np.flatnonzero(tags.any(axis=1))}
        tagged |= {lo: self.field.path(emit[lo : lo + n]) for lo, n in zip(first[length > STRETCH].tolist(), length[length > STRETCH].tolist(), strict=True)}
        if not any(map(any, tagged.values())):
            return out
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
        for lo in sorted(tagged):
            at = int(np.searchsorted(place, lo))
            head = begun[heads[of[at]]]
            found, before = [], OUT
            for s, e, tag in zip((begun[begin[at : at + len(tagged[lo])]] - head).tolist(), (begun[end[at : at + len(tagged[lo])]] - head).tolist(), tagged[lo], strict=True):
                if tag == BEGIN or (tag == INSIDE and before == OUT):
                    found.append((s, e))
                elif tag == INSIDE:
                    found[-1] = (found[-1][0], e)
                before = tag
            out[of[at]] += [(s, e) for s, e in found if texts[of[at]][s:e].strip()]
        return out


_kept: dict[int, Words] = {}


def _words(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Words:
    """Of the field with these weights; the tasks that a process runs one after the other share the words."""
    key = zlib.crc32(b"".join(x.tobytes() for x in model))
    if key not in _kept or any(not np.array_equal(a, b) for a, b in zip(_kept[key].model, model, strict=True)):
        field = Field()
        field.emit[model[0]], field.move = model[1], model[2]
        _kept.clear()
        _kept[key] = Words(field)
        _kept[key].model = model
    return _kept[key]


def crf_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets, without marks around them."""
    return Words(field).spans([text])[0]


def apart(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of the spans that touch no base span, both in order of start: one pass over each."""
    starts, reach, far = [b for b, _, _ in base], [], 0
    for _, _, e in base:
        far = max(far, e)
        reach.append(far)
    out = []
    for s, e in found:
        before = bisect_left(starts, e)  # base spans that begin before this one ends
        if not before or reach[before - 1] <= s:
            out.append((s, e))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row a row of docs: __id, base and more, both array<struct<start, kind, end>> with kind a place in KINDS; more holds the field's spans that touch no base span.

    Null text counts as empty. Whole texts are read, in time that grows with their length. Nothing is shuffled; the model has a fixed size and travels with the tasks.
    """
    field = field or trained()
    place = np.flatnonzero(np.abs(field.emit).sum(axis=1))
    model = (place, field.emit[place], field.move)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            base, more, at = [], [], 0
            while at < len(batch):
                texts, size = [], 0
                while at < len(batch) and size < TOGETHER:
                    texts.append(batch.column(1)[at].as_py())
                    size += len(texts[-1])
                    at += 1
                for text, tagged in zip(texts, words.spans(texts), strict=True):
                    spans = base_spans(text)
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    more.append([{"start": s, "kind": 3, "end": e} for s, e in apart(tagged, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind)], names=["__id", "base", "more"])

    slim = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    span = "array<struct<start: bigint, kind: int, end: bigint>>"
    return slim.mapInArrow(found, f"__id {docs.schema[id_col].dataType.simpleString()}, base {span}, more {span}")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(place: int, name: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == place)).cast("bigint").alias(name)


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = scan(table(spark, sf_dir, "documents"))
    counts = [_count(i, f"n_{kind}") for i, kind in enumerate(KINDS[:3])]
    return out.select(F.col("__id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))
