"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel: two strings are as similar as the three-letter subsequences that they share, each weighed
by `DECAY` to the power of what it spans; steps of up to `STEP` places leave room for two inserted
characters between any two letters ("id-i.ot", "i d i o t"). A string's own weight sets it to
length one. Strings are words between white space; runs of single characters count as one word.

Nyström: words are described by their kernel values with landmark words, whitened by the
landmarks' own kernel. As a machine's score is then linear in the kernel values, landmarks and
weights fold into one table of weights for letter triples, and each different word is scored once.

Training, on labelled sentences (lines, cut at sentence ends; a sentence has its document's label): a
support vector machine (squared hinge) over many instances. A sentence stands or falls by its
words, so the machine is to score some word of each toxic sentence above 1 and all words of a clean
sentence below -1. Labels of sentences are noisy, as a toxic document has harmless sentences too:
toxic are those with a word whose log-likelihood ratio of document counts exceeds the highest one
of the share `TRIM` of clean documents; other sentences of toxic documents are left out. Clean
sentences are all used, by their highest word under the machine, in `ROUNDS` rounds that each add
what the last machine scored highest. Gapped forms (characters between all letters, or one
inserted) of words of either class are added as sentences of their own. Near copies of a training
document are left out. Landmarks: a quarter words of toxic sentences, a quarter gapped forms of
them, a quarter the hardest words of clean sentences, a quarter others of these.

Document: the highest word score, sums over positive word scores and the number of words go
through a logistic regression, which gives the score.

Training data: at most about `most_rows` labelled documents of at most `most_bytes` bytes, chosen
by a hash of the id among labelled rows outside the held-out fold (crc32 of the id as text, modulo
5, is 0) -- a documented bound; only the ids are broadcast, the texts of the sample go to one
task, which sends the weights to the driver. Scoring takes every whole text. Nothing but the text is an input of a score.

Defined results: null and empty texts get the score of a text without words. Repeated rows get
equal scores. A null id is not held out. Several labels of one id count as toxic if one is. Without labels of both
kinds each score is the share of toxic ones (0 without any). Extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesoup
from tidemark.llm.common import lean

DECAY, STEP, FOLDS = 0.7, 3, 5
LANDMARKS, ROUNDS, COST, SHARE, TRIM = 256, 3, 30.0, 0.1, 0.97
#: Symbols: 0 white space, 1-26 letters, 27 digits, 28 other ASCII, 29-60 other letters by their last byte (case-blind for Latin), 61 dropped.
_SYMBOL = np.full(256, 28, np.int32)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:192] = 29 + (np.arange(128, 192) & 31)
_SYMBOL[192:] = 61
_N = 61
_LETTER = np.array([k not in (0, 28) for k in range(_N + 1)])
_STEPS = [(a, a + b, np.float32(DECAY ** (a + b))) for a in range(1, STEP + 1) for b in range(1, STEP + 1)]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, word starts and ends, and where each row's words begin."""
    symbol = _SYMBOL[data]
    keep = symbol != 61
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    symbol, offs = symbol[keep], at[offs]
    full = symbol != 0
    starts, ends, first = bytesoup.word_spans(full.view(np.uint8), offs, np.array([False, True]))
    if len(starts):
        # white space between two words of one character is part of the word
        single = (ends - starts) == 1
        joined = np.zeros(len(starts), bool)
        joined[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
        joined[first[:-1][first[:-1] < len(starts)]] = False
        head = np.flatnonzero(~joined)
        ends = ends[np.append(head[1:], len(joined)) - 1]
        starts = starts[head]
        first = np.searchsorted(head, first)
    return symbol, starts, ends, first


def _gathered(symbol: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words one after another, and each one's word."""
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
    return symbol[np.repeat(starts - begin, size) + np.arange(size.sum())], np.repeat(np.arange(len(size)), size)


def triples(symbol: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
    """For each pair of steps: places where a triple of letters in one word begins, the triple, its weight."""
    letter = _LETTER[symbol]
    for a, b, weight in _STEPS:
        n = len(symbol) - b
        if n <= 0:
            continue
        at = np.flatnonzero(letter[:n] & letter[a : a + n] & letter[b:] & (word[:n] == word[b:]))
        yield at, (symbol[at] * _N + symbol[at + a]) * _N + symbol[at + b], weight


def weighed(symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, triples, weights: each word's triples once, with the sum of their weights over all places, by word and triple."""
    parts = [(word[at] * _N**3 + t, np.full(len(at), w)) for at, t, w in triples(symbol, word)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order].astype(float)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(weights, at) if len(at) else np.zeros(0)
    return keys[at] // _N**3, keys[at] % _N**3, total


def word_scores(symbol: np.ndarray, word: np.ndarray, count: int, table: np.ndarray) -> np.ndarray:
    """The table's weights summed over each word's triples, over the word's own length in the kernel."""
    which, triple, weight = weighed(symbol, word)
    own = np.bincount(which, weight**2, count)
    return np.bincount(which, table[triple] * weight, count) / np.sqrt(np.maximum(own, 1e-12))


_VALUE = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, _N + 1, dtype=np.uint64)
_MOST_KNOWN = 1_000_000


class Scores:
    """Scores of words by their hashes; each different word is scored once. Words met are kept up to a bound of memory."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.hashes, self.scores = table, np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, symbol: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes, first, back = np.unique(bytesoup.span_hashes(_VALUE[symbol], starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes))
        out[known] = self.scores[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = word_scores(*_gathered(symbol, starts[first[new]], ends[first[new]]), len(new), self.table)
            if len(self.hashes) + len(new) > _MOST_KNOWN:
                self.hashes, self.scores = hashes, out
            else:
                every = np.concatenate((self.hashes, hashes[new]))
                order = np.argsort(every)
                self.hashes, self.scores = every[order], np.concatenate((self.scores, out[new]))[order]
        return out[back]


def features(data: np.ndarray, offs: np.ndarray, score_of: Scores, bias: float) -> np.ndarray:
    """Row by row: highest word score, sum and number of positive scores, number of words (logarithms of these three)."""
    symbol, starts, ends, first = words(data, offs)
    score = score_of(symbol, starts, ends) + bias
    out = np.zeros((len(offs) - 1, 4))
    out[:, 0] = -2.0
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        up = np.maximum(score, 0)
        out[full, 0] = np.maximum(np.maximum.reduceat(score, at), -2.0)
        out[full, 1] = np.log1p(np.add.reduceat(up, at))
        out[full, 2] = np.log1p(np.add.reduceat((score > 0).astype(float), at))
        out[full, 3] = np.log1p(np.diff(first)[full])
    return out


class Lexicon:
    """Kernel vectors of a list of words, each set to length one."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        offs = np.concatenate(([0], np.cumsum(sizes)))
        offs[-1] -= len(texts) > 0
        symbol, starts, ends, first = words(np.frombuffer(b"\n".join(texts), np.uint8), offs)
        which, self.triple, value = weighed(*_gathered(symbol, starts, ends))
        self.row = np.repeat(np.arange(len(texts)), np.diff(first))[which]
        own = np.bincount(self.row, value**2, len(texts))
        self.value = value / np.sqrt(np.maximum(own, 1e-12))[self.row]
        self.count = len(texts)

    def kernel(self, other: Lexicon) -> np.ndarray:
        """Kernel values of all of these with all of the other's."""
        columns = np.unique(other.triple)
        right = np.zeros((len(columns) + 1, other.count), np.float32)  # the last: a triple that the other hasn't
        np.add.at(right, (np.searchsorted(columns, other.triple), other.row), other.value)
        place = np.minimum(np.searchsorted(columns, self.triple), max(0, len(columns) - 1))
        known = np.flatnonzero(columns[place] == self.triple) if len(columns) else np.zeros(0, np.int64)
        out = np.zeros((self.count, other.count))
        for lo in range(0, len(known), 20_000):
            part = known[lo : lo + 20_000]
            rows, at = np.unique(self.row[part], return_index=True)  # by row, as weighed() gives them
            out[rows] += np.add.reduceat(right[place[part]] * self.value[part, None].astype(np.float32), at)
        return out


def machine(x: np.ndarray, y: np.ndarray, cost: float, share: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss; share: the upper class's part of the cost. Newton steps."""
    each = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y < 0).sum())) * cost * len(y)
    w, ridge = np.zeros(x.shape[1] + 1), np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    for turn in range(rounds):
        left, right = ridge.copy(), np.zeros(len(w))
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        for lo in range(0, len(active), 4096):  # by blocks, as the rows are many
            part = active[lo : lo + 4096]
            xa = np.hstack([x[part], np.ones((len(part), 1))])
            left += (xa * each[part, None]).T @ xa
            right += (each[part] * y[part]) @ xa
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new if turn else new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w)) * ridge * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(keep + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (p - y) + keep @ w)
        w -= step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _distinct(texts: list[bytes]) -> list[int]:
    """Places of texts that aren't near copies of one before: by two least hashes of word triples."""
    seen, out = set(), []
    for k, text in enumerate(texts):
        data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts, ends, first = bytesoup.word_spans(data, offs)
        g, _ = bytesoup.grams(bytesoup.word_hashes(data, starts, ends), first, 3)
        own = {(s, int((g * np.uint64(m)).min())) for s, m in enumerate((1, 0x9E3779B97F4A7C15))} if len(g) else set()
        if not own & seen:
            out.append(k)
        seen |= own
    return out


_SENTENCE = re.compile(rb"[^\n]*?(?:[.!?]+(?=\s)|\n|\Z)")


def sentences(text: bytes) -> list[bytes]:
    """A text's lines, cut after full stops, exclamation and question marks before white space; none is empty."""
    return [s for m in _SENTENCE.finditer(text) if (s := m[0].strip())]


def _gapped(found: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """The words with characters between all letters, and with one inserted somewhere."""
    out = []
    for w in found:
        if w.isascii() and len(w) > 2:
            sign = b"-.*_ "[rng.integers(5) :][:1]
            at = int(rng.integers(1, len(w)))
            out += [sign.join(w[k : k + 1] for k in range(len(w))), w[:at] + b"-.*'_xq"[rng.integers(7) :][:1] + w[at:]]
    return out


class _Labelled:
    """Labelled sentences as lists of words: places among all different words; each sentence's document and label."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray) -> None:
        place: dict[bytes, int] = {}
        own, of_doc, size = [], [], []
        for k, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            found = sentences(raw[raw < 192].tobytes().lower())  # bytes that begin a letter outside ASCII say nothing, as in words()
            data = b"".join(found)
            _, starts, ends, first = words(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int64))
            for i in range(len(found)):
                these = {data[a:b].strip(b"!?.,;:*#$%&|\"'()") for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)} - {b""}
                if these:
                    own += [place.setdefault(w, len(place)) for w in sorted(these)]
                    of_doc.append(k)
                    size.append(len(these))
        self.words, self.word = list(place), np.array(own, np.int64)
        self.doc, self.first = np.array(of_doc, np.int64), np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        self.toxic = np.asarray(toxic)[self.doc] > 0
        self.sentence = np.repeat(np.arange(len(self.doc)), size)

    def documents(self) -> np.ndarray:
        """How many clean and how many toxic documents hold each word."""
        pairs = np.divmod(np.unique(self.doc[self.sentence] * len(self.words) + self.word), len(self.words))
        toxic = np.zeros(self.doc.max() + 1, bool)
        toxic[self.doc] = self.toxic
        return np.stack([np.bincount(pairs[1][toxic[pairs[0]] == side], minlength=len(self.words)) for side in (False, True)])

    def best(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's word of the highest score (of equals the first), and that score."""
        s = score[self.word]
        top = np.maximum.reduceat(s, self.first[:-1])
        hit = np.flatnonzero(s == top[self.sentence])
        _, at = np.unique(self.sentence[hit], return_index=True)
        return self.word[hit[at]], top


class Model:
    """Weights of letter triples and bias for words; weights, scale and bias for documents."""

    def __init__(self, table: np.ndarray, bias: float, doc: np.ndarray, base: float) -> None:
        self.table, self.bias, self.doc, self.base = table, bias, doc, base
        self.score_of = Scores(table)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not len(self.doc):
            return np.full(len(offs) - 1, self.base)
        x = features(data, offs, self.score_of, self.bias) @ self.doc[:-1] + self.doc[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _whitened(lex: Lexicon) -> np.ndarray:
    """Nyström: what turns kernel values with the landmarks into coordinates whose products are the kernel."""
    values, vectors = np.linalg.eigh(lex.kernel(lex))
    big = values > 1e-4 * values.max(initial=0)
    return vectors[:, big] / np.sqrt(values[big])


def _projected(found: list[bytes], table: np.ndarray) -> np.ndarray:
    lex = Lexicon(found)
    return np.bincount(lex.row, table[lex.triple] * lex.value, lex.count)


def _apart(up: np.ndarray, down: np.ndarray, n_up: int, n_down: int) -> np.ndarray:
    """Log-likelihood ratios of words' document counts against one rate for both classes; below 0 for words rarer in toxic ones."""
    rate = (up + down) / (n_up + n_down)
    part = lambda n, of: np.where(n > 0, n * np.log(np.maximum(n, 1) / (of * rate)), 0)
    return np.where(up * n_down > down * n_up, 2, -2) * (part(up, n_up) + part(down, n_down))


def train(texts: list[bytes], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """The model by the labelled sentences of these documents, as the module's docstring tells."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    none = Model(np.zeros(0), 0.0, np.zeros(0), base)
    if len(set(toxic.tolist())) < 2:
        return none
    keep = _distinct(texts)
    rng = np.random.Generator(np.random.PCG64(seed))
    told = _Labelled([texts[k] for k in keep], toxic[keep])
    if not told.toxic.any() or told.toxic.all():
        return none
    down, up = told.documents()
    n_up, n_down = len(set(told.doc[told.toxic])), len(set(told.doc[~told.toxic]))
    past, score = np.zeros(0, np.int64), _apart(up, down, n_up, n_down)
    for turn in range(1, rounds + 1):
        best, top = told.best(score)
        if turn == 1:
            doc_top = np.full(len(keep), -np.inf)
            np.maximum.at(doc_top, told.doc, top)
            usual = np.quantile(doc_top[np.unique(told.doc[~told.toxic])], TRIM)
            bar = min(usual, top[told.toxic].max() - 1e-9)  # few documents: what is highest
            a, n_a = np.unique(told.word[told.toxic[told.sentence] & (score[told.word] > bar)], return_counts=True)
        past = b = np.unique(np.concatenate((past, best[~told.toxic])))
        shapes = [told.words[k] for k in a], [told.words[k] for k in b]
        more = [_gapped(part, rng) for part in shapes]
        some = lambda found, n: [found[k] for k in rng.permutation(len(found))[:n]]
        hardest = [told.words[k] for k in b[np.argsort(-score[b], kind="stable")]]
        marks = [told.words[k] for k in a[np.argsort(-n_a, kind="stable")]]
        quarter = landmarks // 4
        lex = Lexicon(marks[:quarter] + some(more[0], quarter) + hardest[:quarter] + some([*shapes[1], *more[1]], quarter))
        white = _whitened(lex)
        y = np.repeat([1.0, -1.0], [len(a) + len(more[0]), len(b) + len(more[1])])
        shown = [*shapes[0], *more[0], *shapes[1], *more[1]]
        x = np.concatenate([Lexicon(shown[k : k + 5_000]).kernel(lex) @ white for k in range(0, len(shown), 5_000)])
        w = machine(x, y, COST, SHARE)
        alpha, bias = white @ w[:-1], float(w[-1])
        table = np.bincount(lex.triple, lex.value * alpha[lex.row], _N**3)
        score = np.concatenate([_projected(told.words[k : k + 5_000], table) for k in range(0, len(told.words), 5_000)]) + bias
    # whole documents, and each one's most suspicious sentence as a short document
    score_of = Scores(table)
    documents = [*texts, *_suspicious(texts, score_of, bias)]
    doc = logistic(_features(documents, score_of, bias), np.concatenate((toxic, toxic)).astype(float))
    return Model(table.astype(np.float32), bias, doc, base)


def _features(texts: list[bytes], score_of: Scores, bias: float) -> np.ndarray:
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.concatenate([features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], score_of, bias) for a, b in bytesoup.chunks(offs)])


def _suspicious(texts: list[bytes], score_of: Scores, bias: float) -> list[bytes]:
    """Of each text, the sentence with the highest word score (of equals the first)."""
    found = [(s, k) for k, text in enumerate(texts) for s in sentences(text) or [text]]
    top = _features([s for s, _ in found], score_of, bias)[:, 0]
    first: dict[int, int] = {}
    for i in np.argsort(-top, kind="stable"):
        first.setdefault(found[i][1], i)
    return [found[first[k]][0] for k in range(len(texts))]


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model trained on all rows, which the sample's bound keeps few."""
    rows = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    rows.sort()
    texts, toxic = [r[1].encode() for r in rows], np.array([r[2] for r in rows], int)
    del rows
    m = train(texts, toxic)
    row = {"weights": m.table.astype(np.float32).tobytes(), "bias": m.bias, "doc": m.doc.astype(np.float64).tobytes(), "base": m.base}
    yield pa.RecordBatch.from_pylist([row])


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 5000, most_bytes: int = 20_000) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. Trains in one task on the sample that the module's docstring describes."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    half = most_rows * 3 // 10
    take = {k: min(1.0, (half if k else most_rows - half) / max(1, counts.get(k, 0))) for k in (0, 1)}
    share = F.when(F.col("toxic") == 1, F.lit(take[1])).otherwise(F.lit(take[0]))
    sample = known.where(F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) * F.lit(2.0**-53) < share)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(sample), "doc_id")
    made = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(bytesoup.trimmed(_trainer), "weights binary, bias double, doc binary, base double").collect()
    model = Model(np.frombuffer(made[0]["weights"], np.float32), made[0]["bias"], np.frombuffer(made[0]["doc"]).copy(), made[0]["base"]) if made else train([], np.zeros(0, int))
    if len(model.doc) and take[1] > 0 and take[0] > 0:
        # the sample holds more toxic rows than the labels do: set the odds right
        model.doc[-1] += np.log(take[0] / take[1])
    return model


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = bytesoup.buffers(batch.column("text"))
            parts = [model.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in bytesoup.chunks(offs)]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"], scores], [*[n for n in batch.schema.names if n != "text"], "score"])

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    out = lean(docs).select("doc_id", "text").mapInArrow(bytesoup.trimmed(_scorer(model)), "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = bytesoup.buffers(batch.column("text"))
            parts = [model.scores(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in bytesoup.chunks(offs)]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) < 0.5))

    return lean(docs).mapInArrow(bytesoup.trimmed(keep), docs.schema)
