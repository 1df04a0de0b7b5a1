"""Collocations from a weighted de Bruijn graph: nodes are phrases of ``WIDEST`` - 1 words, edges phrases of ``WIDEST``.

1. **Links.** Pairs of neighbouring words are counted by a hash of ``CELL_BITS``. A phrase that holds a pair with fewer than
   ``least`` occurrences has fewer itself, so pieces are cut there: no word is lost, and no phrase that can be reported or is
   part of one is touched. Tasks know the frequent pairs from a bitmap of 2^``LINK_BITS`` bits; pairs that share a bit with a
   frequent one are not cut, which costs time and changes no row.
2. **Edges.** Every word occurrence begins one phrase: the ``WIDEST`` words from it on, or as many as its piece still has.
   The long ones are edges, the short ones piece ends. They are added up in a batch, then by Spark.
3. **Flow.** A node occurs as often as edges leave it plus pieces end on it; a shorter phrase as often as the next longer
   ones that begin with it plus the pieces that end on it. So all counts come from the edges, without a look at the text.
4. **Unary paths.** A node with one edge in, one out and equal flow (no piece begins or ends there) only passes on. Chains of
   such nodes are joined by pointer doubling, in as many rounds as the length of the longest chain has binary digits, and kept as one text with one weight;
   all phrases inside it have that weight. A path holds no more words than the longest piece.
5. **Scores** of the candidates from the counts of their parts, in decimals; candidates that a longer one explains go.

A piece lies between the marks ``.,;:!?`` and line ends, a word between blanks and tabs; A-Z are lower-cased. A null text is
empty, a null language ``und``. Repeated rows count each time; ties go by count, then by phrase in byte order. Other columns
and ids are not read; an empty table gives an empty one.

Joins are hinted to merge: Spark goes by the size of compressed files, also behind an explode, and would broadcast tables that
a driver cannot hold.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import byte_batches, stored
from lexgrove.scale import dimension_join, top_per_group

LEAST = 30
TOP = 2000
WIDEST = 4
# A longer candidate explains a shorter one from this share of its occurrences on, in per cent.
EXPLAINED = 80
SCALE = 2_000_000
CELL_BITS = 40
# 16 MB; sparse up to some 10^7 different frequent pairs.
LINK_BITS = 27
# Spark's bitmaps have 32,768 bits.
BITMAP_BITS = 15
# Words that are numbered at once.
STRETCH = 1_000_000
NO_LANG = "und"
# Marks become a full stop, tabs a blank; a full stop is part of no word.
_FOLD = bytes.maketrans(b",;:!?\x0a\x0b\x0c\x0d\x09ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * 9 + b" abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, ``.`` between pieces."""
    return (text or "").encode().translate(_FOLD).replace(b".", b" . ").split()


def _stretches(batches):
    """(language, numbers of the words, the words by number): 0 is a mark; texts of one language together."""
    for batch in batches:
        by_lang: dict[str, list[str | None]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(NO_LANG if lang is None else lang, []).append(text)
        for lang, texts in by_lang.items():
            held: list[bytes] = [b"."]
            for k, text in enumerate(texts):
                held += tokens(text)
                held.append(b".")
                if len(held) > STRETCH or k == len(texts) - 1:
                    numbers: dict[bytes, int] = {b".": 0}
                    free = count(1)
                    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(free)) for w in held), np.int64, len(held))
                    yield lang, ids, list(numbers)
                    held = [b"."]


def _cells(lang: str, ids: np.ndarray, words: list[bytes]) -> np.ndarray:
    """The cell of each pair of neighbours; pairs at a mark get one too, which nobody looks at."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[ids]
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] + (hashes[1:] >> np.uint64(29)))
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _count_links(batches):
    for lang, ids, words in _stretches(batches):
        inside = (ids[:-1] > 0) & (ids[1:] > 0)
        cells, times = np.unique(_cells(lang, ids, words)[inside], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times)], names=["cell", "n"])


def frequent_links(docs: DataFrame, least: int = LEAST, bits: int = LINK_BITS) -> bytes:
    """A bitmap of the cells, cut to ``bits``, that hold pairs with ``least`` occurrences: its size does not depend on the input."""
    counted = docs.mapInArrow(_count_links, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.shiftright("cell", CELL_BITS - bits)
    parts = counted.groupBy(F.shiftright(place, BITMAP_BITS).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))).alias("map"))
    held = np.zeros((max(1, 1 << bits >> BITMAP_BITS), 1 << BITMAP_BITS >> 3), np.uint8)
    for r in parts.collect():
        held[r.part] = np.frombuffer(r.map, np.uint8)
    return held.tobytes()


def _phrases(batches, links, bits):
    """Each phrase that begins at a word, with its number of words and how often it does so in this stretch."""
    held = np.frombuffer(links.value, np.uint8)
    for lang, ids, words in _stretches(batches):
        place = _cells(lang, ids, words) >> (CELL_BITS - bits)
        linked = (ids[:-1] > 0) & (ids[1:] > 0) & ((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0)
        linked = np.concatenate([linked, np.zeros(WIDEST, bool)])
        size = (ids > 0).astype(np.int64)
        for k in range(1, WIDEST):
            size += (size == k) & linked[k - 1 : k - 1 + len(ids)]
        text = [w.decode() for w in words]
        for k in range(1, WIDEST + 1):
            at = np.flatnonzero(size == k)
            if not len(at):
                continue
            # Numbers of ever longer phrases; those of one stretch stay far below 2^31.
            code = ids[at]
            for j in range(1, k):
                code = np.unique(code, return_inverse=True)[1] * len(words) + ids[at + j]
            _, first, times = np.unique(code, return_index=True, return_counts=True)
            grams = [" ".join(text[i] for i in ids[p : p + k]) for p in at[first]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams, pa.string()), pa.array(np.full(len(grams), k), pa.int32()), pa.array(times, pa.int64())], names=["lang", "phrase", "k", "n"])


def edges(docs: DataFrame, links: bytes, bits: int = LINK_BITS) -> DataFrame:
    """(lang, phrase, k, n): for k = ``WIDEST`` the edges, for smaller k the ends of pieces."""
    held = docs.sparkSession.sparkContext.broadcast(links)
    found = docs.mapInArrow(partial(_phrases, links=held, bits=bits), "lang string, phrase string, k int, n long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def head(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def tail(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def shorter(longer: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """Counts of the phrases of k words: what flows on into longer ones, and the pieces that end on them."""
    flow = longer.select("lang", head(F.col("phrase"), k).alias("phrase"), "n").union(ends.where(F.col("k") == k).select("lang", "phrase", "n"))
    return flow.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def nodes(table: DataFrame) -> DataFrame:
    """(lang, phrase, n, passes): the nodes with their counts; ``passes`` marks those that only pass on."""
    k = WIDEST - 1
    longest = table.where(F.col("k") == WIDEST)
    zero = F.lit(0).cast("long")
    leaving = longest.select("lang", head(F.col("phrase"), k).alias("phrase"), F.col("n").alias("out"), zero.alias("into"), zero.alias("end"))
    coming = longest.select("lang", tail(F.col("phrase"), k).alias("phrase"), zero.alias("out"), F.col("n").alias("into"), zero.alias("end"))
    ending = table.where(F.col("k") == k).select("lang", "phrase", zero.alias("out"), zero.alias("into"), F.col("n").alias("end"))
    some = lambda c: F.count_if(F.col(c) > 0)
    flow = leaving.union(coming).union(ending).groupBy("lang", "phrase").agg(
        F.sum("out").alias("out"), F.sum("into").alias("into"), F.sum("end").alias("end"), some("out").alias("outs"), some("into").alias("ins"),
    )
    passes = (F.col("outs") == 1) & (F.col("ins") == 1) & (F.col("out") == F.col("into")) & (F.col("end") == 0)
    return flow.select("lang", "phrase", (F.col("out") + F.col("end")).alias("n"), passes.alias("passes"))


def unary_paths(table: DataFrame, at: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, path, n): the edges with ``least`` occurrences, joined where a node only passes on.

    An edge behind such a node weighs as much as the one before it, so lighter edges never belong to a path. No path is
    closed: a piece would have to begin or end on it.
    """
    k = WIDEST - 1
    heavy = table.where((F.col("k") == WIDEST) & (F.col("n") >= least)).select("lang", "phrase", "n")
    through = at.where(F.col("passes") & (F.col("n") >= least)).select("lang", F.col("phrase").alias("node"))
    # The edge before each edge, where there is exactly one and nothing else goes through the node.
    before = heavy.select("lang", tail(F.col("phrase"), k).alias("node"), F.col("phrase").alias("up")).join(through.hint("merge"), ["lang", "node"])
    chain = heavy.withColumn("node", head(F.col("phrase"), k)).join(before.hint("merge"), ["lang", "node"], "left")
    chain = stored(chain.select("lang", "phrase", "n", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("far"), F.lit(None).cast("string").alias("root")), "chain")
    still = F.col("up").isNotNull()
    while chain.where(still).limit(1).count():
        # ``up`` is an edge further ahead in the same chain, ``root`` the first of the chain once it is known. Edges that have
        # arrived are not joined: without ``up`` they would all meet in one task.
        further = chain.select("lang", F.col("phrase").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("root").alias("root2"))
        step = chain.where(still).join(further.hint("merge"), ["lang", "up"])
        known = F.coalesce("root", "root2", F.when(F.col("up2").isNull(), F.col("up")))
        moved = step.select("lang", "phrase", "n", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), known.alias("root"))
        chain = stored(moved.union(chain.where(~still)), "chain")
    root = F.coalesce("root", "phrase")
    last = F.substring_index("phrase", " ", -1)
    parts = chain.groupBy("lang", root.alias("root")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("far", last.alias("last")))).alias("on"))
    rest = F.transform(F.slice("on", F.lit(2), F.size("on")), lambda s: s["last"])
    return parts.select("lang", F.array_join(F.concat(F.array("root"), rest), " ").alias("path"), "n")


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = LINK_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``WIDEST`` words with ``least`` occurrences, and (lang, n) of all words."""
    spark = docs.sparkSession
    byte_batches(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table = stored(edges(rows, frequent_links(rows, least, bits), bits), "edges")
    at = stored(nodes(table), "nodes")
    paths = stored(unary_paths(table, at, least), "paths")
    w = F.split("path", " ")
    slide = lambda k, skip: F.transform(F.sequence(F.lit(1 + skip), F.size("w") - (k - 1) - skip), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    opened = paths.select("lang", "n", w.alias("w"))
    counts = [opened.select("lang", F.explode(slide(WIDEST, 0)).alias("phrase"), F.lit(WIDEST).alias("k"), F.col("n").alias("f"))]
    # Nodes inside a path have its weight; the others have their flow.
    inner = opened.where(F.size("w") > WIDEST).select("lang", F.explode(slide(WIDEST - 1, 1)).alias("phrase"), F.lit(WIDEST - 1).alias("k"), F.col("n").alias("f"))
    counts.append(inner)
    heavy = lambda df, k: df.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("f"))
    counts.append(heavy(at.join(inner.select("lang", "phrase").hint("merge"), ["lang", "phrase"], "left_anti"), WIDEST - 1))
    level = at.select("lang", "phrase", "n")
    for k in range(WIDEST - 2, 0, -1):
        level = stored(shorter(level, table, k), f"level-{k}")
        counts.append(heavy(level, k))
    return stored(reduce(DataFrame.union, counts), "counts"), table.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, explained: int = EXPLAINED, bits: int = LINK_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by their weakest cut."""
    counts, total = phrase_counts(docs, least, bits)
    found = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = dimension_join(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "phrase")
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    cuts = cuts.withColumns({"top": wide("a") * F.lit(SCALE).cast("decimal(10,0)"), "both": wide("l") + wide("r")}).withColumn("score", F.expr("top div both"))
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # The most frequent candidate around each shorter one.
    inside = lambda k: F.expr(f"transform(sequence(1, k - {k - 1}), i -> array_join(slice(split(phrase, ' '), i, {k}), ' '))")
    parts = [found.where(F.col("k") > k).select("lang", F.explode(inside(k)).alias("phrase"), F.col("a").alias("around")) for k in range(2, WIDEST)]
    around = reduce(DataFrame.union, parts).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    share = lambda c, by: F.coalesce(wide(c), F.lit(0)) * F.lit(by).cast("decimal(3,0)")
    kept = scored.join(around.hint("merge"), ["lang", "phrase"], "left").where(share("around", 100) < share("a", explained))
    ranked = top_per_group(kept, ["lang"], [F.desc("c.score"), F.desc("a"), F.asc("phrase")], top)
    # One row per language.
    n = total.select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", "c.score")
