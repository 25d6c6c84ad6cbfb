"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail and IP addresses, card and phone numbers, with their checks (parts, Luhn,
numbers of digits); these are the base spans and always stay. The tagger reads words between white
space as shapes (letters, digits and signs in order, with a few facts such as numbers of digits)
of the word and its neighbours. It is trained on the labelled sentences of ``pii_table`` by
gradient ascent, and decoded by Viterbi in numpy, all runs of words of one length at a time. It
adds spans that don't overlap a base span, such as numbers that run into each other, spelt-out
e-mail addresses or phone numbers without a country code.

Neutral words are those that are letters or signs only but for their edges; they share two
descriptions. After training, all sequences of neutral words (at the text's edges too) are tried
against the weights: if the best path, from any state before to any state after, is outside of
entities at each word that has `margin` neutral words on both sides, such words are left out, and
the runs between them are decoded on their own, which gives the same paths. Else all words are
decoded. Whole texts are read; nothing is cut off.

Defined results: null and empty texts have no spans. Repeated rows get equal spans. Offsets count
code points, ends are exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesoup
from tidemark.llm.common import lean
from tidemark.llm.pii_table import LABELLED

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]
_LEFT = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap and pass their check, by start and kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # from the "@" outwards: the same as the leftmost match, without trying each place before it
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end(), "email"))
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_AT = re.compile(r"[(\[](at|dot)[)\]]", re.I)
_SIGNS = "!\"#$%&'*,-./:;<=>?@\\^_`{|}~"  # those that no word keeps at its edges
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _inner(word: str, first: str, last: str) -> tuple[int, int]:
    """Where a word begins and ends without the signs at its edges, but for those given."""
    lo, hi = 0, len(word)
    while lo < hi and word[lo] not in _PLAIN and word[lo] not in first:
        lo += 1
    while hi > lo and word[hi - 1] not in _PLAIN and word[hi - 1] not in last:
        hi -= 1
    return lo, hi


def _facts(word: str) -> list[str]:
    """What the model sees of a word, but for its place."""
    bare = word[slice(*_inner(word, "+([", ")]"))]
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", bare))
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = sum(c.isdecimal() for c in bare)
    out = [f"shape={short}" if len(short) < 9 else "shape=long", "any"]
    if not digits and short in ("a", ""):
        return [*out, "plain"]
    size = next(n for n in (0, 1, 2, 3, 4, 6, 7, 9, 10, 11, 13, 15, 16, 19, 10**12) if digits <= n)
    out.append(f"digits={size}")
    if short == "9":
        out.append(f"number={size}")
    mixed = digits and re.search(r"[0-9][a-f]|[a-f][0-9]", bare, re.I) and "@" not in bare
    facts = {"at": "@" in bare, "at.": bool(re.search(r"\w@[\w-]+\.\w", bare)), "spelt": bool(_AT.search(bare)), "plus": bare.startswith("+"), "round": bool(re.fullmatch(r"\([0-9]{3}\)", bare))}
    facts |= {"quad": bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", bare)), "3-4": bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", bare)), "3-3-4": bool(re.fullmatch(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", bare)), "hex": bool(mixed and len(bare) > 6), "quote": word[:1] in "\"'", "luhn": short in ("9", "9-9-9-9") and 14 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", bare))}
    return out + [k for k, v in facts.items() if v]


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.strip().split("\n"):
        words, states = [], []
        pieces, rest = [], line
        while m := re.search(r"\[(email|ip|card|phone)\|", rest):
            depth, end = 1, m.end()
            while depth:
                depth += {"[": 1, "]": -1}.get(rest[end], 0)
                end += 1
            pieces += [("", rest[: m.start()]), (m[1], rest[m.end() : end - 1])]
            rest = rest[end:]
        pieces.append(("", rest))
        glue = ""
        for kind, text in pieces:
            tail = "" if kind else re.match(r"\S*", text)[0]
            if tail and words and glue:
                words[-1] += tail
                text = text[len(tail) :]
            parts = text.split()
            words += parts
            states += [(1 + 2 * KINDS.index(kind) + (k > 0)) if kind else 0 for k in range(len(parts))]
            glue = kind
        out.append((words, states))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


EDGE, START = "", len(_STATES)
_MOST_KNOWN = 200_000


class Crf:
    """Weights of descriptions and states, and of pairs of states (the last row: before the first word).

    A word's description is its facts, its left neighbour's and its right neighbour's, so its
    scores are sums of three rows of `by_place`, kept for each kind of word that was met.
    """

    def __init__(self, rounds: int = 160) -> None:
        data = labelled()
        facts = [[["edge"], *map(_facts, w), ["edge"]] for w, _ in data]
        seen = [[[*own[k], *(f"-1:{f}" for f in own[k - 1]), *(f"+1:{f}" for f in own[k + 1])] for k in range(1, len(own) - 1)] for own in facts]
        names = sorted({f for x in seen for fs in x for f in fs})
        self.index = {f: k for k, f in enumerate(names)}
        s, n, longest = len(_STATES), len(data), max(len(w) for w, _ in data)
        self.emit, self.move = np.zeros((len(names), s)), np.zeros((s + 1, s))
        for j in range(2, s, 2):  # inside only after the begin or inside of the same kind
            self.move[[i for i in range(s + 1) if i not in (j - 1, j)], j] = -50.0
        fixed = self.move < -40
        size = np.array([len(w) for w, _ in data])
        # all sentences at once: x says which descriptions each word has, y its state; past a sentence's end both are empty
        x, y = np.zeros((n * longest, len(names))), np.zeros((n, longest, s))
        for i, (sentence, (_, states)) in enumerate(zip(seen, data, strict=True)):
            for k, fs in enumerate(sentence):
                x[i * longest + k, [self.index[f] for f in fs]] = 1
                y[i, k, states[k]] = 1
        here = np.arange(longest)[None, :] < size[:, None]
        m1, v1 = [np.zeros_like(self.emit), np.zeros_like(self.move)], [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, rounds + 1):
            e = (x @ self.emit).reshape(n, longest, s)
            fwd, bwd = np.zeros((n, longest, s)), np.zeros((n, longest, s))
            fwd[:, 0] = e[:, 0] + self.move[START]
            for k in range(1, longest):
                fwd[:, k] = _logsum(fwd[:, k - 1, :, None] + self.move[None, :s], 1) + e[:, k]
            for k in range(longest - 2, -1, -1):
                bwd[:, k] = np.where(here[:, k + 1, None], _logsum(self.move[None, :s] + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0)
            z = _logsum(fwd[np.arange(n), size - 1], 1)
            gap = np.where(here[:, :, None], y - np.exp(fwd + bwd - z[:, None, None]), 0)
            ge, gm = x.T @ gap.reshape(-1, s) - 0.02 * self.emit, np.where(fixed, 0, -0.02 * self.move)
            gm[START] += gap[:, 0].sum(0)
            pairs = np.exp(np.minimum(fwd[:, :-1, :, None] + self.move[None, None, :s] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None], 0))
            gm[:s] += (y[:, :-1, :, None] * y[:, 1:, None, :] - np.where(here[:, 1:, None, None], pairs, 0)).sum((0, 1))
            gm[fixed] = 0
            for p, g, m, v in ((self.emit, ge, m1[0], v1[0]), (self.move, gm, m1[1], v1[1])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p += 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self._forget()
        #: neutral words needed on both sides of a word that is left out; None: none is
        self.margin = next((m for m in (2, 3, 4) if self._bears_out(m)), None)

    def _forget(self) -> None:
        """Kinds of words by their facts, and kinds by word: 0 the text's edge, 1 and 2 neutral words."""
        self.kinds: dict[tuple[str, ...], int] = {}
        self.known: dict[str, int] = {}
        self.by_place = np.zeros((3, 0, len(_STATES)))
        for facts in (["edge"], _facts("a"), _facts("-")):
            self._kind(facts)
        self.known[EDGE] = 0

    def _kind(self, facts: list[str]) -> int:
        key = tuple(facts)
        if key not in self.kinds:
            self.kinds[key] = k = len(self.kinds)
            if k >= self.by_place.shape[1]:
                self.by_place = np.concatenate((self.by_place, np.zeros((3, k + 64, len(_STATES)))), 1)
            for place, sign in enumerate(("", "-1:", "+1:")):
                self.by_place[place, k] = self.emit[[self.index[sign + f] for f in facts if sign + f in self.index]].sum(0)
        return self.kinds[key]

    def kinds_of(self, words: list[str]) -> np.ndarray:
        """Each word's kind. Words met are kept, up to a bound of memory."""
        if len(self.known) > _MOST_KNOWN:
            self.known = {EDGE: 0}
        known = self.known
        for w in {w for w in words if w not in known}:
            core = w.strip(_SIGNS)
            known[w] = 1 if core.isascii() and core.isalpha() else self._kind(_facts(w))  # letters between signs need no facts
        return np.array([known[w] for w in words], np.int64)

    def scores(self, kinds: np.ndarray) -> np.ndarray:
        """Scores of states along the last axis but the first and the last, which are neighbours only."""
        return self.by_place[0, kinds[..., 1:-1]] + self.by_place[1, kinds[..., :-2]] + self.by_place[2, kinds[..., 2:]]

    def _outside(self, kinds: tuple[int, ...], at: int) -> bool:
        """Whether the best path is outside of entities at a place, whatever is before and after these words (an edge: nothing).

        kinds: the words' with a neighbour on each side.
        """
        s = len(_STATES)
        e = self.scores(np.array(kinds))
        before = self.move[START:] if kinds[0] == 0 else self.move[:s]
        for k in range(at):
            before = (before + e[k])[:, :, None] + self.move[None, :s]
            before = before.max(1)
        after = np.zeros((s, 1)) if kinds[-1] == 0 else self.move[:s]
        for k in range(len(e) - 1, at, -1):
            after = (self.move[:s, :, None] + (e[k][:, None] + after)[None]).max(1)
        through = before[:, :, None] + e[at][None, :, None] + after[None]
        return bool((through[:, 0] > through[:, 1:].max(1) + 1e-9).all())

    def _bears_out(self, margin: int) -> bool:
        some = lambda n: itertools.product((1, 2), repeat=n)
        inside = all(self._outside(x, margin - 1) for x in some(2 * margin + 1))
        begin = all(self._outside((0, *x), k) for k in range(margin) for x in some(k + 1 + margin))
        return inside and begin and all(self._outside((*x, 0), margin - 1) for k in range(margin) for x in some(k + 1 + margin))

    def decode(self, runs: list[np.ndarray], ends: list[bool]) -> list[np.ndarray]:
        """States of each run of kinds but its first and last: Viterbi, all runs of one length together.

        Before a run is the text's edge or a word outside of entities; after it too (ends: whether it is the edge).
        """
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        by = defaultdict(list)
        for k, r in enumerate(runs):
            if len(r) > 2:
                by[len(r)].append(k)
        s = len(_STATES)
        for n, which in by.items():
            most = max(1, 4_000_000 // (n * s))
            for lo in range(0, len(which), most):
                part = which[lo : lo + most]
                kinds = np.stack([runs[k] for k in part])
                e = self.scores(kinds)
                best, back = e[:, 0] + self.move[np.where(kinds[:, 0] == 0, START, 0)], []
                for k in range(1, n - 2):
                    step = best[:, :, None] + self.move[None, :s]
                    back.append(step.argmax(1).astype(np.int8))
                    best = step.max(1) + e[:, k]
                best = best + np.where(np.array([ends[k] for k in part])[:, None], 0, self.move[None, :s, 0])
                state = best.argmax(1)
                path = [state]
                for b in reversed(back):
                    state = b[np.arange(len(part)), state]
                    path.append(state)
                for k, row in zip(part, np.stack(path[::-1], 1), strict=True):
                    out[k] = row
        return out


@functools.cache
def model() -> Crf:
    return Crf()


_WORD = re.compile(r"\S+")


def tagged_spans(texts: list[str], skip: bool = True, crf: Crf | None = None) -> list[list[Span]]:
    """What the tagger marks in each text. skip: without words that the weights show to be outside of entities."""
    crf = crf or model()
    runs, ends, places = [], [], []
    margin = crf.margin if skip else None
    for n, text in enumerate(texts):
        words = text.split()
        kinds = crf.kinds_of([EDGE, *words, EDGE])
        lo, hi = np.zeros(1, int), np.full(1, len(words))
        if margin is not None and len(words) > 2 * margin:
            hot = np.flatnonzero(kinds[1:-1] > 2)
            if not len(hot):
                continue
            far = np.flatnonzero(np.diff(hot) > 2 * margin + 1)
            lo, hi = np.maximum(hot[np.append(0, far + 1)] - margin, 0), np.minimum(hot[np.append(far, len(hot) - 1)] + margin + 1, len(words))
        if len(words):
            places.append((n, len(runs), lo, words))
            runs += [kinds[a : b + 2] for a, b in zip(lo, hi, strict=True)]
            ends += (hi == len(words)).tolist()
    states = crf.decode(runs, ends)
    out: list[list[Span]] = [[] for _ in texts]
    for n, at, lo, words in places:
        found = [(int(a) + int(k), s) for a, s in zip(lo, states[at : at + len(lo)], strict=True) for k in np.flatnonzero(s)]
        if not found:
            continue
        span = [(m.start(), m.end()) for m in _WORD.finditer(texts[n])]
        state = {k: int(s[k - a]) for a, s in zip(lo.tolist(), states[at : at + len(lo)], strict=True) for k in range(a, a + len(s)) if s[k - a]}
        for k, _ in found:
            if not state[k] % 2:
                continue
            end = k + 1
            while state.get(end) == state[k] + 1:
                end += 1
            start = span[k][0] + _inner(words[k], "+(", "")[0]
            stop = span[end - 1][0] + _inner(words[end - 1], "", ")")[1]
            if start < stop:
                out[n].append((start, stop, KINDS[state[k] // 2]))
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, end, kind, base) by start and kind, for every row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
    crf = model()  # trained here; its weights go with the task

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            spans: list[list[dict]] = []
            for lo in range(0, len(column), 500):
                texts = [x or "" for x in column.slice(lo, 500).to_pylist()]
                for text, added in zip(texts, tagged_spans(texts, crf=crf), strict=True):
                    base = base_spans(text)
                    free = _apart(added, base)
                    both = sorted([(*s, True) for s in base] + [(*s, False) for s in free], key=lambda s: (s[0], KINDS.index(s[2])))
                    spans.append([dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return lean(docs).select("doc_id", "text").mapInArrow(bytesoup.trimmed(tag), "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")


def _apart(added: list[Span], base: list[Span]) -> list[Span]:
    """The added spans that overlap no base span; both are in order of their starts."""
    out, reach, k = [], 0, 0  # reach: the furthest end of base spans that begin before the added one's end
    for s in added:
        while k < len(base) and base[k][0] < s[1]:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s[0]:
            out.append(s)
    return out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, all spans as one string and their number."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
