"""Ranked lexical search over classes of documents that no item can tell apart.

An item sees of a document only how often it holds the item's terms, and its length as the coarse number m. So documents
are cut down to the terms of the item set (the vocabulary), and documents with the same term frequencies and the same m
form one class: grouped by a hash and by the frequencies themselves, so that a collision of the hash joins nothing. Each
class is scored once for all items. The first ``TOP`` classes of an item, by score and smallest doc_id, hold its first
``TOP`` documents; only these classes are expanded, by ascending doc_id.

Texts are read once: a task turns its texts into bags over the vocabulary, which are written as a table. Statistics, classes
and members come from that table. A class that a third of all documents belong to is reduced before the shuffle. Items
are taken in blocks of ``BLOCK``, whose vocabulary is broadcast; scores and places are exact 64-bit integers.

Null and empty texts have no terms, count for neither N nor L and are never found. Repeated rows are documents of their
own; a null doc_id sorts first and is reported as null. Items that repeat in id and text count once; a null or empty
item finds nothing. Other columns are not read. Empty tables give an empty table.
"""

from __future__ import annotations

import math
import re
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import byte_batches, id_back, id_key, stored
from lexgrove.scale import top_per_group

TOP = 20
# Items whose terms make one vocabulary.
BLOCK = 256
# Cells of the term x class matrix that a task fills at once.
CELLS = 4_000_000
RESULT = "item_id long, rank int, doc_id long, score long"
_BREAKS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
# Lower-cases A-Z and turns every byte that is part of no term into a blank.
_FOLD = bytes(32 if _BREAKS.match(bytes([b])) else b for b in range(256)).translate(bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order and with repeats."""
    return (text or "").encode().translate(_FOLD).split()


def _bags(batches, vocabulary):
    ids = vocabulary.value
    for batch in batches:
        sizes, bags = [], []
        for text in batch.column("text").to_pylist():
            found = terms(text)
            held: dict[int, int] = {}
            for i in map(ids.get, found):
                if i is not None:
                    held[i] = held.get(i, 0) + 1
            order = sorted(held)
            sizes.append(len(found))
            bags.append(np.array([order, [held[i] for i in order]], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc", "n", "bag"])


def _frequencies(batches, size):
    total = np.zeros(size, np.int64)
    for batch in batches:
        for bag in batch.column("bag").to_pylist():
            total[np.frombuffer(bag, "<u4", len(bag) // 8)] += 1
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])


def _best(scores, firsts, classes):
    order = np.lexsort((firsts, -scores))[:TOP]
    return scores[order], firsts[order], classes[order]


def _score_classes(batches, weights, items):
    """The ``TOP`` best classes of each item in this partition, a stretch of classes at a time."""
    weights, items = weights.value, items.value
    none = np.empty(0, np.int64)
    best = [(none, none, none)] * len(items)
    step = max(16, CELLS // max(1, len(weights)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            bags = [np.frombuffer(b, "<u4").astype(np.int64).reshape(2, -1) for b in part.column("bag").to_pylist()]
            ids, tf = np.concatenate(bags, axis=1)
            column = np.repeat(np.arange(len(bags)), [b.shape[1] for b in bags])
            m = part.column("m").to_numpy()[column]
            gains = np.zeros((len(weights), len(bags)), np.int64)
            gains[ids, column] = weights[ids] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            firsts, classes = part.column("first").to_numpy(), part.column("class").to_numpy()
            for j, (own, repeats) in enumerate(items):
                scores = repeats @ gains[own]
                least = best[j][0][-1] if len(best[j][0]) == TOP else 1
                hit = np.flatnonzero(scores >= least)
                if len(hit):
                    best[j] = _best(*(np.concatenate(x) for x in zip(best[j], (scores[hit], firsts[hit], classes[hit]))))
    number = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
    columns = [np.concatenate([b[k] for b in best]) if best else none for k in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (number, *columns)], names=["item", "score", "first", "class"])


def _rank_block(docs: DataFrame, block: list) -> DataFrame:
    spark = docs.sparkSession
    asked = [terms(r.text) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set(reduce(add, asked, []))))}
    rows = docs.select(id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    bags = rows.mapInArrow(partial(_bags, vocabulary=spark.sparkContext.broadcast(vocabulary)), "doc long, n long, bag binary")
    bags = stored(bags.where("n > 0"), "bags")
    total = bags.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    # At most one row per term of the block.
    df = dict(bags.mapInArrow(partial(_frequencies, size=len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    wanted = [np.unique([vocabulary[t] for t in a], return_counts=True) if a else (np.empty(0, np.int64),) * 2 for a in asked]
    wide = "decimal(38,0)"
    m = 75 + F.expr(f"(cast(n as {wide}) * cast({25 * total.n} as {wide})) div cast({max(1, total.l)} as {wide})")
    bags = bags.where(F.length("bag") > 0).select("doc", m.cast("long").alias("m"), "bag").withColumn("h", F.xxhash64("bag", "m"))
    classes = bags.groupBy("h", "m", "bag").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    share = spark.sparkContext.broadcast
    scored = classes.select("class", "m", "bag", "first").mapInArrow(partial(_score_classes, weights=share(weights), items=share(wanted)), "item long, score long, first long, class long")
    leading = stored(top_per_group(scored, ["item"], [F.desc("score"), F.asc("first")], TOP).select("item", "score", "class"), "leading")
    # At most TOP classes an item of the block.
    opened = classes.join(F.broadcast(leading.select("class").distinct()), "class").select("class", "h", "m", "bag")
    members = bags.join(F.broadcast(opened), ["h", "m", "bag"]).select("class", "doc")
    members = top_per_group(members, ["class"], [F.asc("doc")], TOP, "place").drop("place")
    ranked = top_per_group(leading.join(members, "class"), ["item"], [F.desc("score"), F.asc("doc")], TOP)
    ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", id_back("doc").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best documents of every item, best first, equal scores by doc_id."""
    spark = docs.sparkSession
    byte_batches(spark)
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    out, held = [], []
    for row in asked.orderBy("item_id", "text").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = [*out, stored(_rank_block(docs, held), "ranked")], []
    if held:
        out.append(_rank_block(docs, held))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], RESULT)
