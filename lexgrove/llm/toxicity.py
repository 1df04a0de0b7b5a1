"""Toxicity of whole texts: a conditional random field tags toxic spans, marginals make the document score.

Only documents are labelled, so the words of the sample are labelled from them: a word of a toxic document is toxic when
it, or one of its beginnings of 4 to 6 letters, occurs in toxic documents far more often than in others. The field learns these tags
from affixes, n-grams, lexicon and neighbours, so it also finds forms that the sample does not hold. Its expected
number of toxic words, the largest marginal and the share of toxic words enter a logistic regression on the document labels.

The fit uses a bounded sample: at most ``SAMPLE_ROWS`` rows of each label, and of these the first ``SAMPLE_CHARS`` characters.
Scoring reads whole texts. Nulls: null and empty texts are scored by the regression with no toxic word; rows with a null
doc_id are scored and never held out. Documents with several labels count once for each. Without labels the score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import held_out, python_batches, utf8
from lexgrove.llm.crf import Crf, bare, has_letter, marginals, sums
from lexgrove.llm.language_crf import sample

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6000
STRETCH = 60
# A word is toxic when its share among toxic documents is this many times that among others, and when chance
# would hardly do so: this log-likelihood ratio, a million to one, as some hundred thousand words are tried.
RATIO = 8.0
LEAST_G2 = 28.0
SPAN_AT = 0.5
_PIECE = re.compile(rb"\S+")


def _grams(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def toxic_words(rows: list[tuple[int, list[str]]]) -> set[str]:
    """Words and beginnings (with ``*``) that mark toxic documents."""
    seen = (Counter(), Counter())
    docs = [0, 0]
    for label, words in rows:
        docs[label] += 1
        seen[label].update({g for w in set(words) if has_letter(w) for g in _grams(w)})
    out = set()
    if not all(docs):
        return out
    share = docs[1] / sum(docs)
    for g, n in seen[1].items():
        m = seen[0][g]
        rate, other = (n + 0.5) / (docs[1] + 1), (m + 0.5) / (docs[0] + 1)
        own = n / (n + m)
        g2 = 2 * (n * np.log(own / share) + (m * np.log((1 - own) / (1 - share)) if m else 0.0))
        if rate / other >= RATIO and g2 >= LEAST_G2:
            out.add(g)
    return out


def _features(gamma: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    p = gamma[:, 1:2] * letters[:, None] if gamma.shape[1] > 1 else np.zeros((len(letters), 1))
    count = sums(p, sizes)[:, 0]
    words = sums(letters[:, None].astype(float), sizes)[:, 0]
    # Largest marginal of each text; texts without a word have none.
    filled = sizes > 0
    most = np.zeros(len(sizes))
    if filled.any():
        most[filled] = np.maximum.reduceat(p[:, 0], (np.cumsum(sizes) - sizes)[filled])
    return np.stack([np.ones(len(sizes)), np.log1p(np.maximum(count, 0)), most, np.sqrt(np.maximum(count, 0) / np.maximum(words, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


class ToxicModel:
    def __init__(self, crf: Crf, weights: np.ndarray):
        self.crf, self.weights, self.key = crf, weights, crf.key()

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gamma, letters, sizes = marginals(self.crf, self.key, texts)
        x = _features(gamma, letters, sizes) if len(sizes) else np.empty((0, 4))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), gamma, sizes


def fit_toxicity(rows: list[tuple[str, str]], rounds: int = 25) -> ToxicModel:
    """``rows``: (label 0 or 1 as text, text)."""
    once: dict[str, str] = {}  # equal words are one string in memory
    docs = [(int(float(label) > 0), [once.setdefault(w, w) for w in map(bare, text.encode().split())]) for label, text in rows]
    marked = toxic_words(docs)
    sequences, tags = [], []
    for label, words in docs:
        tag = np.array([int(label and any(g in marked for g in _grams(w))) for w in words], np.int64)
        for i in range(0, len(words), STRETCH):
            # Stretches without a toxic word are plenty; a fifth of them is enough to learn from.
            if tag[i : i + STRETCH].any() or (i // STRETCH) % 5 == 0:
                sequences.append(words[i : i + STRETCH])
                tags.append(tag[i : i + STRETCH])
    crf = Crf(2, {w: 1 for w in marked}).fit(sequences, tags, rounds)
    model = ToxicModel(crf, np.zeros(4))
    if rows:
        gamma, letters, sizes = marginals(crf, model.key, [t.encode() for _, t in rows])
        model.weights = _logistic(_features(gamma, letters, sizes), np.array([d[0] for d in docs], float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, keep: list[Column], spans: bool = False) -> DataFrame:
    """``keep`` columns with score; with ``spans`` also the byte ranges [start, end) of the words tagged toxic."""
    python_batches(docs.sparkSession)
    base = docs.select(*keep, utf8().alias("_t"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    columns = base.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(columns)).to_pylist()
            score, gamma, sizes = model.scores(texts)
            arrays = [*b.columns[:-1], pa.array(score, pa.float64())]
            if spans:
                first = np.cumsum(sizes) - sizes
                found = []
                for text, at, n in zip(texts, first.tolist(), sizes.tolist()):
                    hot = set(np.flatnonzero(gamma[at : at + n, 1] >= SPAN_AT).tolist()) if n else set()
                    found.append([[m.start(), m.end()] for i, m in enumerate(_PIECE.finditer(text)) if i in hot] if hot else [])
                arrays.append(pa.array(found, pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", *["spans"] * spans])

    return base.mapInArrow(work, f"{kept}, score double" + ", spans array<array<long>>" * spans)


def judge(docs: DataFrame, labels: DataFrame, spans: bool = False, rows: int = SAMPLE_ROWS, at: float = 0.7) -> DataFrame:
    """Fit on labelled rows that are not held out, score all: doc_id, held_out, score, predicted."""
    marks = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label"))
    model = fit_toxicity(sample(docs, marks, rows, SAMPLE_CHARS, 2))
    out = score_toxicity(docs, model, [F.col("doc_id"), held_out().alias("held_out")], spans)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= at).cast("int").alias("predicted"), *["spans"] * spans)
