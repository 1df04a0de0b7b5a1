"""Language of whole texts by a conditional random field over their words.

The model labels every word with a language; forward-backward marginals are summed over the words that have a letter. The
largest share names the language, and the share is the score. Training texts are cut into stretches, and stretches of different
languages are put together, so that transitions are learned from code-switched sequences.

The fit uses a bounded sample: at most ``SAMPLE_ROWS`` rows of each of the ``MAX_LANGUAGES`` most frequent languages, the rows
with the smallest hashes of their ids, and of these the first ``SAMPLE_CHARS`` characters. Prediction reads whole
texts. Nulls: a null text, and one without a letter, is ``und`` with score 0; rows with a null doc_id are predicted, and are never
held out. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import give_back, held_out, python_batches, utf8
from lexgrove.llm.crf import Crf, bare, has_letter, marginals, sums

UNKNOWN = "und"
SAMPLE_ROWS = 250
SAMPLE_CHARS = 6000
MAX_LANGUAGES = 64
STRETCH = 40
LEXICON = 2000


def sample(docs: DataFrame, labelled: DataFrame, rows: int, chars: int, classes: int) -> list[tuple[str, str]]:
    """(label, head of text): per label the ``rows`` ids of ``labelled`` (id, label) with the smallest hashes.

    Ids are chosen from the narrow table first; the texts of at most ``rows * classes`` ids are then read by a broadcast of these.
    """
    known = labelled.where("id is not null and label is not null").select("id", F.col("label").cast("string").alias("label")).distinct()
    frequent = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(classes)
    order = [F.xxhash64("id", F.lit(7)), F.col("id")]
    wanted = [(r.label, i.id) for r in frequent.collect() for i in known.where(F.col("label") == r.label).select("id").orderBy(*order).limit(rows).collect()]
    if not wanted:
        return []
    picked = docs.sparkSession.createDataFrame(wanted, "label string, id long")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.substring("text", 1, chars).alias("t"))
    got = texts.join(F.broadcast(picked), "id").select("label", "id", "t").distinct().limit(2 * rows * classes).collect()
    return [(r.label, r.t) for r in sorted(got, key=lambda r: (r.label, r.id, r.t))]


def fit_languages(rows: list[tuple[str, str]], rounds: int = 25) -> tuple[Crf, list[str]]:
    names = sorted({label for label, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    seen: dict[str, Counter] = {}
    pieces: list[list[list[str]]] = [[] for _ in names]
    once: dict[str, str] = {}  # equal words are one string in memory
    for label, text in rows:
        words = [once.setdefault(w, w) for w in map(bare, text.encode().split()) if w]
        for w in words:
            seen.setdefault(w, Counter())[number[label]] += 1
        pieces[number[label]] += [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)]
    often = sorted(seen, key=lambda w: (-sum(seen[w].values()), w))[: LEXICON * len(names)]
    lexicon = {w: max(seen[w], key=lambda s: (seen[w][s], -s)) for w in often if has_letter(w) and max(seen[w].values()) >= 3}
    # Every third stretch is followed by one of the next language.
    sequences, tags = [], []
    for s, own in enumerate(pieces):
        other = pieces[(s + 1) % len(names)]
        for i, words in enumerate(own):
            more = other[i % len(other)] if i % 3 == 0 and other and len(names) > 1 else []
            sequences.append(words + more)
            tags.append(np.array([s] * len(words) + [(s + 1) % len(names)] * len(more), np.int64))
    return Crf(len(names), lexicon).fit(sequences, tags, rounds), names


def fit_documents(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Crf, list[str]]:
    """Fit on the rows with a language that are not held out."""
    labelled = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("label"))
    return fit_languages(sample(docs, labelled, rows, SAMPLE_CHARS, MAX_LANGUAGES))


def predict_languages(docs: DataFrame, crf: Crf, names: list[str], keep: list[Column]) -> DataFrame:
    """``keep`` columns with lang_pred and score of each whole text."""
    python_batches(docs.sparkSession)
    base = docs.select(*keep, utf8().alias("_t"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    columns, key = base.columns[:-1], crf.key()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            if names:
                gamma, letters, sizes = marginals(crf, key, b.column(len(columns)).to_pylist())
                gamma *= letters[:, None]
                mass = sums(gamma, sizes)
                del gamma
                whole = mass.sum(axis=1)
                best = mass.argmax(axis=1)
                lang = [names[i] if w > 0 else UNKNOWN for i, w in zip(best, whole)]
                score = np.clip(mass.max(axis=1) / np.maximum(whole, 1e-300), 0, 1) if len(mass) else []
            else:
                lang, score = [UNKNOWN] * len(b), np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])
        # An idle worker lies beside the stages that follow.
        give_back()

    return base.mapInArrow(work, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame, keep: list[Column] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    crf, names = fit_documents(docs, rows)
    return predict_languages(docs, crf, names, keep or [F.col("doc_id"), held_out().alias("held_out")])
