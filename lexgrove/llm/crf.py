"""Linear-chain conditional random field over words, in numpy.

Words are scored by hashed features: affixes, character n-grams, shape and a lexicon (the word itself and the label it
was seen with most). Transitions are learned with them by gradient ascent on the log-likelihood; forward-backward runs over all
sequences of a batch at once, in time-major order, so a long text costs one small step per word and no more memory.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Sequence

import numpy as np

from lexgrove.llm.common import worker_held

FEATURES = 1 << 16
# Words whose scores a worker keeps, in two generations: what is asked for again outlives the older one.
MEMO_WORDS = 360_000
# Words of texts that are looked up, and worked on, at once, and new words that are scored at once.
WORDS_ASKED = 250_000
WORDS_AT_ONCE = 200_000
WORDS_SCORED = 10_000
_EDGE = ".,;:!?\"'()[]{}<>|*#-–—_/\\«»¿¡…“”‘’&%$@+=~^`§"


def bare(piece: bytes) -> str:
    """A piece between blanks, lower-cased and without punctuation at its ends."""
    return piece.decode("utf-8", "replace").lower().strip(_EDGE)


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed feature numbers of a word; feature 0 is on for every word."""
    if not has_letter(word):
        return [0, 1]
    raw = [f"w{word}"]
    if word in lexicon:
        raw.append(f"l{lexicon[word]}")
    framed = f"^{word}$"
    for n in (1, 2, 3, 4, 5):
        if n <= len(word):
            raw += [f"p{word[:n]}", f"s{word[-n:]}"]
    for n in (2, 3):
        raw += [framed[i : i + n] for i in range(len(framed) - n + 1)]
    if not word.isascii():
        raw.append("x")
    if not word.isalpha():
        raw.append("m")
    return [0, *(2 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (FEATURES - 2) for f in raw)]


class Packed:
    """Time-major layout of sequences laid end to end: step t holds the sequences longer than t, longest first."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        order = np.argsort(-self.sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        n = int(self.sizes.sum())
        longest = int(self.sizes.max(initial=0))
        first = np.cumsum(self.sizes) - self.sizes
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        step = np.arange(n) - first[owner]
        self.active = np.bincount(step, minlength=longest) if n else np.empty(0, np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        self.place = self.offset[step] + rank[owner]
        self.owner = owner


def forward_backward(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Marginals of each word (in the order given), expected transitions if ``pairs``, and the sum of log normalisers.

    All arrays have the precision of ``scores``.
    """
    kind = scores.dtype
    lay = Packed(sizes)
    n, labels = scores.shape
    if n == 0:
        return np.empty((0, labels)), (np.zeros((labels, labels)) if pairs else None), 0.0
    top = scores.max(axis=1, keepdims=True)
    e = np.empty((n, labels), kind)
    e[lay.place] = np.exp(scores - top)
    move, first = np.exp(trans).astype(kind), np.exp(start).astype(kind)
    alpha, scale = np.empty((n, labels), kind), np.empty((n, 1), kind)
    off, act = lay.offset, lay.active
    before: np.ndarray | None = None
    for t in range(len(act)):
        a, b = off[t], off[t + 1]
        now = (first if before is None else before[: act[t]] @ move) * e[a:b]
        c = now.sum(axis=1, keepdims=True)
        now /= c
        alpha[a:b], scale[a:b] = now, c
        before = now
    log_z = float(np.log(scale).sum(dtype=np.float64) + top.sum(dtype=np.float64))
    beta = np.ones((n, labels), kind)
    for t in range(len(act) - 2, -1, -1):
        a, b, k = off[t], off[t + 1], act[t + 1]
        nxt = slice(off[t + 1], off[t + 2])
        beta[a : a + k] = (e[nxt] * beta[nxt] / scale[nxt]) @ move.T
    counts = None
    if pairs:
        counts = np.zeros((labels, labels))
        for t in range(len(act) - 1):
            k = act[t + 1]
            nxt = slice(off[t + 1], off[t + 2])
            counts += alpha[off[t] : off[t] + k].T @ (e[nxt] * beta[nxt] / scale[nxt])
        counts *= move
    del e, scale
    alpha *= beta
    del beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[lay.place], counts, log_z


class WordScores(dict):
    """piece (bytes) -> number; label scores and the letter mark of each number in arrays."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf, self.new = crf, []
        self.scores, self.letters = np.empty((0, crf.labels), np.float32), np.empty(0, bool)
        self.older: dict[bytes, int] = {}
        self.older_scores, self.older_letters = self.scores, self.letters

    def __missing__(self, piece: bytes) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def learn(self) -> None:
        if not self.new:
            return
        n, before = len(self.new), len(self.scores)
        known = np.fromiter((self.older.get(p, -1) for p in self.new), np.int64, n)
        was = known >= 0
        # Pieces that differ in case or punctuation are one word.
        number: dict[str, int] = {}
        place = np.fromiter((number.setdefault(bare(self.new[i]), len(number)) for i in np.flatnonzero(~was)), np.int64, n - int(was.sum()))
        scores, letters = np.empty((before + n, self.crf.labels), np.float32), np.empty(before + n, bool)
        scores[:before], letters[:before] = self.scores, self.letters
        new_scores, new_letters = scores[before:], letters[before:]
        new_scores[was], new_letters[was] = self.older_scores[known[was]], self.older_letters[known[was]]
        if number:
            words = list(number)
            new_scores[~was] = self.crf.score(words).astype(np.float32)[place]
            new_letters[~was] = np.array([has_letter(w) for w in words], bool)[place]
        self.scores, self.letters, self.new = scores, letters, []

    def restart_if_full(self) -> None:
        if len(self) >= MEMO_WORDS // 2:
            self.older, self.older_scores, self.older_letters = dict(self), self.scores, self.letters
            self.clear()
            self.scores, self.letters = self.scores[:0].copy(), self.letters[:0].copy()


class Crf:
    def __init__(self, labels: int, lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((FEATURES, labels))
        self.trans, self.start = np.zeros((labels, labels)), np.zeros(labels)

    def _flat(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = array("i"), array("q")
        for w in words:
            flat.extend(word_features(w, self.lexicon))
            ends.append(len(flat))
        return np.frombuffer(flat, np.int32), np.concatenate([[0], np.frombuffer(ends, np.int64)[:-1]])

    def score(self, words: Sequence[str]) -> np.ndarray:
        if not len(words):
            return np.empty((0, self.labels))
        out = []
        for i in range(0, len(words), WORDS_SCORED):
            flat, at = self._flat(words[i : i + WORDS_SCORED])
            out.append(np.add.reduceat(self.weights[flat], at, axis=0))
        return np.concatenate(out)

    def fit(self, sequences: list[list[str]], tags: list[np.ndarray], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Gradient ascent with per-weight step sizes. Tags are label numbers of every word."""
        number: dict[str, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for s in sequences for w in s), np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        keep = sizes > 0
        sizes = sizes[keep]
        if not len(words):
            return self
        tag = np.concatenate([t for t, k in zip(tags, keep) if k]).astype(np.int64)
        flat, at = self._flat(list(number))
        row = np.repeat(np.arange(len(number)), np.diff([*at, len(flat)]))
        gold = np.zeros((len(words), self.labels))
        gold[np.arange(len(words)), tag] = 1
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(words), bool)
        inner[first] = False
        gold_moves = np.zeros((self.labels, self.labels))
        np.add.at(gold_moves, (tag[np.flatnonzero(inner) - 1], tag[inner]), 1)
        squares = [np.full_like(x, 1e-6) for x in (self.weights, self.trans, self.start)]
        n = len(words)
        for _ in range(rounds):
            by_word = np.add.reduceat(self.weights[flat], at, axis=0)
            gamma, moves, _ = forward_backward(by_word[words], sizes, self.start, self.trans, pairs=True)
            rest = gold - gamma
            per_word = np.stack([np.bincount(words, rest[:, s], minlength=len(number)) for s in range(self.labels)], axis=1)
            slope_w = np.stack([np.bincount(flat, per_word[row, s], minlength=FEATURES) for s in range(self.labels)], axis=1)
            slopes = (slope_w / n - decay * self.weights, (gold_moves - moves) / n - decay * self.trans, rest[first].sum(axis=0) / n - decay * self.start)
            for x, g, q in zip((self.weights, self.trans, self.start), slopes, squares):
                q += g * g
                x += rate * g / np.sqrt(q)
        return self

    def key(self) -> str:
        return hashlib.sha256(self.weights.tobytes() + self.trans.tobytes() + self.start.tobytes() + repr(sorted(self.lexicon.items())).encode()).hexdigest()


def table_of(crf: Crf, key: str) -> WordScores:
    """The worker's word memory of this model."""
    table = worker_held("words", key, lambda: WordScores(crf))
    table.restart_if_full()
    return table


def asked(crf: Crf, key: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of every piece, letter mark of every piece, pieces per text); the worker's memory is kept short after every ``WORDS_ASKED``."""
    scores, letters, sizes = [np.empty((0, crf.labels), np.float32)], [np.empty(0, bool)], np.empty(len(texts), np.int64)
    numbers: list[np.ndarray] = []
    held = 0
    table = table_of(crf, key)
    for i, text in enumerate(texts):
        numbers.append(table.numbers(text.split()))
        sizes[i] = len(numbers[-1])
        held += len(numbers[-1])
        if held >= WORDS_ASKED or i == len(texts) - 1:
            table.learn()
            every = np.concatenate(numbers)
            scores.append(table.scores[every])
            letters.append(table.letters[every])
            numbers, held = [], 0
            table = table_of(crf, key)
    return np.concatenate(scores), np.concatenate(letters), sizes


def marginals(crf: Crf, key: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of every piece, letter mark of every piece, pieces per text) of whole texts laid end to end."""
    gamma, letters, sizes = asked(crf, key, texts)
    ends = np.cumsum(sizes)
    # A bounded number of words, or one longer text, is worked on at once, longest texts first: each step costs by its longest text.
    group: list[int] = []
    held = 0
    for i in [*np.argsort(-sizes, kind="stable").tolist(), None]:
        if group and (i is None or held + sizes[i] > WORDS_AT_ONCE):
            group.sort()
            # The marginals take the place of the scores.
            found = forward_backward(np.concatenate([gamma[ends[k] - sizes[k] : ends[k]] for k in group]), sizes[group], crf.start, crf.trans)[0]
            at = 0
            for k in group:
                gamma[ends[k] - sizes[k] : ends[k]] = found[at : at + sizes[k]]
                at += sizes[k]
            group, held = [], 0
        if i is not None:
            group.append(i)
            held += sizes[i]
    return gamma, letters, sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the rows of each text, one column at a time."""
    total, ends = np.zeros(len(values) + 1), np.cumsum(sizes)
    out = np.empty((len(sizes), values.shape[1]))
    for k in range(values.shape[1]):
        np.cumsum(values[:, k], dtype=np.float64, out=total[1:])
        out[:, k] = total[ends] - total[ends - sizes]
    return out
