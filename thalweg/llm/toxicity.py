"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear support vector machine.

Two words are compared by the letter triples that both contain in order, with gaps of any
length: a triple that spans d letters counts DECAY ** (d - 3). The kernel of two words is the
sum over such triples divided by both words' own sums to the power SCALE, and what is nearly
alike counts for more: it is multiplied by 1 + SHARP cosine ** SHARP_POWER. Products and sums
of kernels and such scalings are kernels again. An insult with letters put in keeps all its
triples, one with letters left out or swapped near each other many.

Landmarks are strings of the labelled sentences: words, and beginnings of words, that are
commoner in toxic ones (as many as the evidence tells apart from chance, up to LANDMARKS less
ORDINARY; those that are only a little commoner up to WEAK), and ordinary words that begin as
they do, or else the commonest. A word's Nystrom features are its kernel values with the
landmarks times the inverse root of the landmarks' own kernel matrix. Two linear machines
are trained on them by subgradient and gradient steps in numpy: one reads a sentence by its
most toxic word (a support vector machine over multiple instances, so one disguised insult is
enough), the other by the largest value of any word for each landmark, so that several weak
words add up. A logistic curve of both margins, each held within bounds, weighted back to the
share of toxic rows, gives the score. Toxic rows are learned from a second time with their
landmarks disguised by letters put in or left out.

Letters are folded (case and accents do not count), signs inside a word are dropped, and
letters written one by one ("i d i o t") are read as one word too. Letters of every script are
compared as what they are. A word of one or two letters is read with a sign at both ends. A
word of more than WORD letters is read in overlapping windows, so no part of a text is left out.

Defined cases: a null or empty text, and one without any word like a landmark, gets the score
of no likeness; labels that are null, and repeated labels but the highest, are ignored;
without labels of both kinds every score is the share of toxic labels (0 without any);
repeated rows are scored each; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_thread, small_batches

DECAY = 0.9
WORD = 24
#: Bounds of the landmarks: all, ordinary words, and strings less than LIFT times as common in toxic rows.
LANDMARKS, ORDINARY, WEAK = 256, 96, 64
LIFT = 8.0
#: Share of false ones among the strings taken as commoner in toxic rows (Benjamini and Hochberg).
FALSE = 0.05
#: Power of both words' own sums that a kernel value is divided by: 0.5 would count letters put in as heavily as others, 0 not at all.
SCALE = 0.15
#: How much more near likeness counts.
SHARP, SHARP_POWER = 10.0, 10
#: Share of a landmark's own kernel value that is added to it before the root is taken.
RIDGE = 1e-4
#: Pairs of words and landmarks that are compared at once.
COLUMNS = 2048
#: Kernel values of less than this are taken as 0, and so are those of words that lack more than a quarter of a
#: landmark's letters (or more than one of a shorter one's).
FLOOR = 1.2
#: Bound of the training sample: labelled rows of each kind, and characters of a row in it.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
CACHE_WORDS = 600_000

_SINGLES = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def fold(word: str) -> str:
    """A word's letters in lower case without accents."""
    word = word.lower().strip(_SIGNS)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def windows(word: str) -> list[str]:
    """What is read of a folded word: itself, with signs at its ends if it is short, or overlapping windows."""
    if 0 < len(word) < 3:
        return [f"<{word}>"]
    if len(word) <= WORD:
        return [word]
    return [word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)]


def _letters(words: list[str]) -> np.ndarray:
    """Words as rows of code points, 0 behind the end."""
    width = max(max(map(len, words), default=0), 3)
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype="<u4").reshape(-1, width).astype(np.int32)


def triples(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over common triples of each column of a with that of b (letters by words; b may have a single column).

    What fills up columns of b must not be a letter of a. one and two hold what pairs of first
    letters, and of first two, before each place count.
    """
    one = np.zeros((len(b), a.shape[1]), dtype=np.float32)
    two, three = one.copy(), np.zeros(a.shape[1], dtype=np.float32)
    decay = np.float32(DECAY)
    # What a place of b adds counts from the next one on, less with each place.
    behind = np.tril(DECAY ** np.maximum(np.subtract.outer(np.arange(len(b)), np.arange(len(b))) - 1, 0), -1).astype(np.float32)
    for letter in a:
        same = (b == letter).astype(np.float32)
        hit = one * same
        one *= decay
        one += behind @ same
        same *= two
        three += np.einsum("jp->p", same)
        two *= decay
        two += behind @ hit
    return three


def _own(a: np.ndarray) -> np.ndarray:
    return np.maximum(triples(a, np.where(a > 0, a, -1)), 1e-9)


def _scaled(sums: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The kernel from the sum over common triples and the product of both words' own."""
    return sums / both**SCALE * (1 + SHARP * (sums / np.sqrt(both)) ** SHARP_POWER)


class Kernel:
    """Kernel values of words with landmarks, and the inverse root of the landmarks' own matrix."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = _letters(landmarks)
        self.table, self.letters = letters, [r[r > 0] for r in letters]
        self.sizes = np.array([len(r) for r in self.letters])
        self.alphabet = np.unique(letters[letters > 0])
        self.counts = np.stack([(r[:, None] == self.alphabet).sum(axis=0) for r in self.letters]).astype(np.float32)
        self.need = np.array([len(r) - max(1, len(r) // 4) for r in self.letters])
        self.own = _own(letters.T)
        gram = np.stack([self._value(letters.T, self.own, k) for k in range(len(landmarks))])
        self.diagonal = gram.diagonal().copy()
        value, vector = np.linalg.eigh((gram + gram.T) / 2 + RIDGE * np.diag(self.diagonal))
        self.root = vector / np.sqrt(np.maximum(value, 1e-9)) @ vector.T

    def _value(self, words: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        return _scaled(triples(words, self.letters[k][:, None]), own * self.own[k])

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and value of all pairs of FLOOR or more, by word; words are what windows() gives."""
        out = []
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo in range(0, len(order), 16384):
            at = np.array(order[lo : lo + 16384])
            a = _letters([words[i] for i in at])
            place = np.searchsorted(self.alphabet, a)
            known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == a
            has = np.zeros((len(at), len(self.alphabet) + 1), dtype=np.float32)
            has[np.arange(len(at))[:, None], np.where(known, place, len(self.alphabet))] = 1
            enough = has[:, :-1] @ self.counts.T >= self.need
            some = np.flatnonzero(enough.any(axis=1))
            at, a, enough = at[some], np.ascontiguousarray(a[some].T), enough[some]
            size = (a > 0).sum(axis=0)
            near, mark = np.nonzero(enough)
            alike, back = np.unique(near, return_inverse=True)
            own = np.zeros(len(alike), dtype=np.float32)
            for c in range(0, len(alike), COLUMNS):
                some = alike[c : c + COLUMNS]
                own[c : c + COLUMNS] = _own(a[: size[some].max(), some])
            # Pairs with landmarks of one length together, shorter words first.
            for n in np.unique(self.sizes[mark]):
                of = np.flatnonzero(self.sizes[mark] == n)
                of = of[np.argsort(near[of], kind="stable")]
                for c in range(0, len(of), COLUMNS):
                    some = of[c : c + COLUMNS]
                    letters = self.table[mark[some], :n].T
                    sums = triples(a[: size[near[some]].max(), near[some]], letters)
                    got = _scaled(sums, own[back[some]] * self.own[mark[some]])
                    high = got >= FLOOR
                    out.append((at[near[some][high]], mark[some][high], got[high]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        rows, marks, values = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(rows, kind="stable")
        return rows[order], marks[order], values[order].astype(np.float32)


def words_of(text: str | None) -> set[str]:
    """The words of a text, and runs of single signs as words too."""
    words = set(text.split()) if text else set()
    if text and (runs := _SINGLES.findall(text)):
        words |= {r.replace(" ", "") for r in runs}
    return words


class Reader:
    """Kernel values of the words of texts, remembered."""

    def __init__(self, kernel: Kernel, cache_words: int = CACHE_WORDS):
        self.kernel, self.limit = kernel, cache_words
        self._restart()

    def _restart(self) -> None:
        self.of: dict[str, tuple[int, ...]] = {}  # what is read of a word and is like some landmark
        self.first = np.zeros(1, dtype=np.int64)
        self.marks, self.values = np.zeros(0, np.int16), np.zeros(0, np.float32)

    def _learn(self, words: list[str]) -> None:
        parts = {w: windows(fold(w)) for w in words}
        flat = sorted({p for ps in parts.values() for p in ps if p})
        rows, marks, values = self.kernel.pairs(flat)
        alike, count = np.unique(rows, return_counts=True)
        place = {flat[i]: len(self.first) - 1 + k for k, i in enumerate(alike)}
        for w, ps in parts.items():
            self.of[w] = tuple(place[p] for p in ps if p in place)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])
        self.marks, self.values = np.concatenate([self.marks, marks.astype(np.int16)]), np.concatenate([self.values, values])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Which text, ascending, and which word, for every word of the texts that is like some landmark."""
        if len(self.of) >= self.limit:
            self._restart()
        found: list[np.ndarray] = []
        for lo in range(0, len(texts), 256):
            lists = [words_of(t) for t in texts[lo : lo + 256]]
            self._learn([w for w in set().union(*lists) if w not in self.of])
            found += [np.array(sorted({i for w in ws for i in self.of[w]}), dtype=np.int64) for ws in lists]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return owner, np.concatenate([np.zeros(0, dtype=np.int64), *found])

    def _spread(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values of each word, and how many each has."""
        n = self.first[word + 1] - self.first[word]
        return np.arange(n.sum()) + np.repeat(self.first[word] - (np.cumsum(n) - n), n), n

    def pooled(self, texts: int, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The largest kernel value of each text's words for each landmark."""
        marks = len(self.kernel.landmarks)
        out = np.zeros(texts * marks, dtype=np.float32)
        for lo in range(0, len(word), 1 << 17):
            at, n = self._spread(word[lo : lo + (1 << 17)])
            np.maximum.at(out, np.repeat(owner[lo : lo + (1 << 17)] * marks, n) + self.marks[at], self.values[at])
        return out.reshape(texts, marks)

    def margins(self, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        # Words of a text are mostly those of others too, so each is weighed once.
        single, of = np.unique(word, return_inverse=True)
        at, n = self._spread(single)
        return np.bincount(np.repeat(np.arange(len(single)), n), self.values[at] * weight[self.marks[at]], len(single))[of]


class Model:
    """Weights of the landmarks for words and for texts, and the curve from both margins to a score."""

    #: Bounds of the margins of the highest word and of the text.
    WORD, TEXT = (-1.0, 1.5), (-2.0, 2.0)

    def __init__(self, kernel: Kernel | None, word: np.ndarray, text: np.ndarray, bias: float, curve: np.ndarray):
        self.kernel, self.word, self.text, self.bias, self.curve = kernel, word, text, bias, curve

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "reader"}

    def margins(self, reader: Reader, n: int, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Two margins of each text; that of a text without likeness is -1 by its words."""
        top = np.zeros(n)
        np.maximum.at(top, owner, reader.margins(word, self.word))
        text = reader.pooled(n, owner, word) @ self.text + self.bias
        return np.stack([np.clip(top - 1, *self.WORD), np.clip(text, *self.TEXT)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        both = np.zeros((len(texts), 2))
        if self.kernel is not None:
            if not hasattr(self, "reader"):
                self.reader = Reader(self.kernel)
            both = self.margins(self.reader, len(texts), *self.reader.words(texts))
        return 1 / (1 + np.exp(-np.clip(both @ self.curve[:2] + self.curve[2], -50, 50)))


def choose_landmarks(texts: list[str], toxic: np.ndarray, n: int = LANDMARKS, ordinary: int = ORDINARY) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that tell toxic rows best, then ordinary words that begin as they do, or the commonest."""
    # Copies of a text are no evidence of their own.
    single = list(dict.fromkeys(zip(texts, toxic.tolist())))
    texts, toxic = [t for t, _ in single], np.array([y for _, y in single], dtype=np.int64)
    rows = [Counter(), Counter()]  # of either kind, by string
    whole: set[str] = set()
    for t, y in zip(texts, toxic.tolist()):
        words = {p for w in words_of(t) for p in windows(fold(w)) if p}
        whole |= words
        rows[y].update({w[:k] for w in words for k in range(4, min(len(w), 9) + 1)} | words)
    seen = lambda w: (rows[0][w], rows[1][w])
    nt, nn = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    share = nt / (nt + nn)

    def evidence(c: tuple[int, int]) -> float:
        """Log-likelihood ratio for being commoner in toxic rows, 0 if it is not."""
        both = c[0] + c[1]
        if c[1] <= share * both:
            return 0.0
        return 2 * (c[1] * np.log(c[1] / (share * both)) + (c[0] * np.log(c[0] / ((1 - share) * both)) if c[0] else 0))

    # Only strings of some rows are tested, whatever their kind, so the bound follows the sample and their number.
    tested = [(round(float(evidence(c)), 6), len(w), w) for w in {*rows[0], *rows[1]} if sum(c := seen(w)) >= 4]
    chance = np.sort([erfc((r[0] / 2) ** 0.5) / 2 for r in tested])
    passed = np.flatnonzero(chance <= FALSE * np.arange(1, len(chance) + 1) / max(1, len(chance)))
    bound = chance[passed[-1]] if len(passed) else -1.0
    ranked = sorted((r for r in tested if r[0] > 0 and erfc((r[0] / 2) ** 0.5) / 2 <= bound), reverse=True)
    strong = {w for _, _, w in ranked if seen(w)[1] / nt >= LIFT * seen(w)[0] / nn}
    chosen: list[str] = []
    for some, most in ((strong, n - ordinary), ({r[2] for r in ranked} - strong, min(WEAK, n - ordinary))):
        for _, _, w in ranked:
            if len(chosen) >= most:
                break
            # A longer or shorter form of what was chosen adds nothing if it stands in nearly the same rows.
            if w not in some or any((w.startswith(c) or c.startswith(w)) and 0.8 <= seen(w)[1] / seen(c)[1] <= 1.25 for c in chosen):
                continue
            longer = [v for _, _, v in ranked if v.startswith(w) and seen(v)[1] >= 0.8 * seen(w)[1]]
            chosen.append(max(longer, key=len))
    beginnings = {c[:4] for c in chosen}
    plain = [w for w in whole if len(w) >= 4 and seen(w)[1] / nt < 2 * seen(w)[0] / nn and w not in chosen]
    return chosen, sorted(plain, key=lambda w: (w[:4] not in beginnings, -seen(w)[0], w))[:ordinary]


def disguised(texts: list[str], insults: list[str], rng: np.random.Generator) -> list[str]:
    """Each text with one of its words that hold an insult, written with letters put in or left out, and without the others."""
    look = re.compile("|".join(map(re.escape, sorted(insults, key=len, reverse=True))) or "(?!)")
    held: dict[str, bool] = {}
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    def change(m: re.Match) -> str:
        w, kind = m[0], rng.integers(0, 4)
        if kind == 0:
            return "".join(c + letters(1) for c in w[:-1]) + w[-1]
        if kind == 1 and len(w) > 4:
            k = rng.integers(0, len(w))
            return w[:k] + w[k + 1 :]
        n = int(rng.integers(1, 5))
        for k in [int(rng.integers(1, len(w)))] * n if kind == 2 else rng.integers(1, len(w), n):
            w = w[:k] + letters(1) + w[k:]
        return w

    out = []
    for text in texts:
        words = text.split()
        for w in words:
            if w not in held:
                held[w] = look.search(fold(w)) is not None
        hits = [i for i, w in enumerate(words) if held[w]]
        only = hits[rng.integers(0, len(hits))] if hits else -1
        out.append(" ".join(look.sub(change, fold(w)) if i == only else w for i, w in enumerate(words) if i == only or not held[w]))
    return out


def train(texts: list[str], toxic: np.ndarray, rate: tuple[float, float] = (1.0, 1.0), seed: int = 0) -> Model:
    """rate: the shares of rows of kind 0 and 1 that were drawn into the sample."""
    weight = 1 / np.array(rate)[toxic] if len(toxic) else np.zeros(0)
    if len(set(toxic.tolist())) < 2:
        p = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-9, 1 - 1e-9))
        return Model(None, np.zeros(0), np.zeros(0), 0.0, np.array([0.0, 0.0, np.log(p / (1 - p))]))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, toxic, weight = [texts[i] for i in order], toxic[order], weight[order]
    held = len(texts) // 4
    insults, ordinary = choose_landmarks(texts[held:], toxic[held:])
    landmarks = insults + ordinary
    if not landmarks or len(set(toxic[held:].tolist())) < 2 or len(set(toxic[:held].tolist())) < 2:
        held = 0
        insults, ordinary = choose_landmarks(texts, toxic)
        landmarks = insults + ordinary or ["none"]
    kernel = Kernel(landmarks)
    ones = [i for i in np.flatnonzero(toxic) if texts[i]]
    texts = texts + disguised([texts[i] for i in ones], insults, rng)
    toxic = np.concatenate([toxic, np.ones(len(ones), toxic.dtype)])
    part = np.concatenate([np.arange(len(weight)), ones]) < held
    # A toxic row and its disguised copy share the row's weight.
    weight = np.concatenate([weight, weight[ones]])
    weight[toxic == 1] /= 2
    reader = Reader(kernel, len(texts) + (1 << 62))
    owner, word = reader.words(texts)
    y = 2.0 * toxic - 1
    by_word = _word_machine(reader, owner, word, y, ~part, len(insults))
    x = reader.pooled(len(texts), owner, word) @ kernel.root
    size = max(1e-6, float(np.median(np.linalg.norm(x[toxic == 1], axis=1))))
    by_text, bias = _text_machine(x[~part] / size, y[~part], rng)
    model = Model(kernel, by_word.astype(np.float32), (kernel.root @ by_text / size).astype(np.float32), bias, np.zeros(3))
    part = part if held else slice(None)
    model.curve = _logistic(model.margins(reader, len(texts), owner, word)[part], toxic[part], weight[part])
    return model


def _word_machine(reader: Reader, owner: np.ndarray, word: np.ndarray, y: np.ndarray, used: np.ndarray, insults: int, cost: float = 1e-5, steps: int = 150) -> np.ndarray:
    """Weights of the landmarks by the squared hinge loss of each text's highest word, and a small square penalty.

    The margin is that word's less 1, so that a text without any likeness is at -1. Steps are
    full gradients in the Nystrom features, scaled by their running squares.
    """
    root, n = reader.kernel.root, len(reader.first) - 1
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(reader.first))
    each = np.where(y > 0, 0.5 / max(1, (used & (y > 0)).sum()), 0.5 / max(1, (used & (y < 0)).sum())) * used
    # The last word, of margin 0, is in every text.
    owner, word = np.concatenate([owner, np.arange(len(y))]), np.concatenate([word, np.full(len(y), n)])
    order = np.argsort(owner, kind="stable")
    owner, word = owner[order].astype(np.int32), word[order].astype(np.int32)
    starts = np.searchsorted(owner, np.arange(len(y)))
    u = np.linalg.solve(root, (np.arange(len(root)) < insults) * 2.0 / reader.kernel.diagonal)
    mean, square, total = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u))
    for step in range(steps):
        weight = root @ u
        margin = np.append(np.bincount(rows, reader.values * weight[reader.marks], n), 0.0)[word]
        top = np.maximum.reduceat(margin, starts)
        at = np.flatnonzero(margin == top[owner])
        best = word[at[np.searchsorted(owner[at], np.arange(len(y)))]]
        push = np.bincount(best, 2 * each * y * np.maximum(0.0, 1 - y * (top - 1)), n + 1)[:-1]
        grad = 2 * cost * u - root @ np.bincount(reader.marks, reader.values * push[rows], len(root))
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        u = u - 0.1 * (1 - step / steps) * mean / (1 - 0.9 ** (step + 1)) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-6)
        if step >= steps - 50:
            total += u / 50
    return root @ total


def _text_machine(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, cost: float = 1e-4, epochs: int = 40) -> tuple[np.ndarray, float]:
    """Hinge loss and a small square penalty, by averaged stochastic subgradient steps in batches."""
    each = np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum()))
    z = np.hstack([x, np.ones((len(x), 1))])
    w, mean, steps = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(order), 32):
            at = order[lo : lo + 32]
            rate = 0.5 / (1 + 0.01 * steps) ** 0.5
            short = y[at] * (z[at] @ w) < 1
            back = cost * w - ((each[at] * y[at] * short)[:, None] * z[at]).mean(axis=0)
            w = w - rate * back
            steps += 1
            if epoch >= epochs // 2:
                mean += (w - mean) / (steps - (epochs // 2) * -(-len(z) // 32))
    return mean[:-1], float(mean[-1])


def _logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and shift of a weighted logistic curve, by Newton steps with a small penalty."""
    z = np.hstack([margins, np.ones((len(margins), 1))])
    beta, penalty = np.array([1.0, 1.0, 0.0]), np.array([0.05, 0.05, 1e-6])
    weight = weight / weight.mean()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * [1, 1, 0] * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(np.maximum(beta[:2], 0.0), beta[2])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on at most about `rows` labelled rows of each kind, drawn by a hash, for which `usable` holds."""
    kinds = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in kinds.groupBy("toxic").count().collect()}
    rates = {k: min(1.0, rows / max(1, counts.get(k, 0))) for k in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(rates[1] * (1 << 30))).otherwise(int(rates[0] * (1 << 30)))
    # About 2 x rows ids, so small enough to broadcast.
    drawn = kinds.where(draw < limit)
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(drawn), "doc_id").select("text", "toxic").collect()
    toxic = np.array([r["toxic"] for r in found], dtype=np.int64)
    return train([r["text"] for r in found], toxic, (max(rates[0], 1e-9), max(rates[1], 1e-9)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document; the model is some MB whatever the corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        m = shared.value
        for text in batches:
            yield pd.Series(m.score([None if t is None or t != t else t for t in text]).astype(np.float64))

    out = docs.select("doc_id", judge("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
