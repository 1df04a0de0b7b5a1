"""Benchmark decontamination by spaced seeds that no accepted copy lacks; DataFrame functions only.

Texts are lower-cased and cut at white space. A document is contaminated by an item when, in some window of ``WINDOW``
item words (the whole item, if shorter), at least ``LEAST`` of the words are equal at the same distance, or at two
neighbouring distances, one left and one right of a single added or dropped word, which counts as an unequal one.

Seeds are spaced: a mask names the word positions that are hashed, the positions between them may hold any word. Each
item length has one mask (``SEED_OF``) that fits somewhere on the equal words of every accepted pattern of substitutions,
and wholly left or right of an added or dropped word. Lengths of which an accepted copy may be left with two pairs of
words (5), or with nothing changed (4 and fewer), take the words without a space. Hashes of documents and items are
joined; every hit fixes a distance, on which (and beside which) the words of document and item are compared one by one.

Null or empty texts on either side match nothing; repeated rows are compared alike and reported once; rows with a null
doc_id or item_id take part and are reported with null. Items of one to four words match as a whole only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import id_back, id_key, stored
from lexgrove.scale import fits

# Fewest words of an item.
SPAN = 1
# Hashed positions of each mask, and the mask of items of 1, 2, ... WINDOW words; a test enumerates all accepted patterns.
MASKS = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 2), (0, 1, 3), (0, 1, 3, 4))
SEED_OF = (0, 1, 2, 3, 1, 4, 4, 5, 5, 5, 5, 6, 6)
WINDOW = 13
LEAST = 0.8
# Broadcast bounds: seeds of 16 bytes, document keys of 16 bytes.
MAX_SEEDS = 1_000_000
MAX_DOCS = 1_000_000


def words(text: str = "text") -> Column:
    return F.split(F.btrim(F.lower(F.col(text)), F.lit(" \t\n\r\f\u000b")), "\\s+")


def _windows(rows: DataFrame, keys: list[str], masks: list[int]) -> DataFrame:
    """One row per place of each of ``masks``: the mask's number m, the place and the hash of the words under it."""
    each = []
    for m in masks:
        n = F.size("w") - MASKS[m][-1]
        names = [f"w{o}" for o in MASKS[m]]
        parts = [F.slice("w", o + 1, n).alias(name) for o, name in zip(MASKS[m], names)]
        opened = rows.where(n >= 1).select(*keys, F.inline(F.arrays_zip(*parts, F.sequence(F.lit(0), n - 1).alias("at"))).alias(*names, "at"))
        each.append(opened.select(*keys, "at", F.lit(m).alias("m"), F.xxhash64(*names).alias("h")))
    return reduce(DataFrame.union, each)


def _bounded(side: DataFrame, most: int) -> DataFrame:
    """Broadcast behind a count; a larger side is shuffled."""
    return F.broadcast(side) if fits(side, most) else side


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _bent(start: Column, step: int) -> Column:
    """Most equal words of a window when words right of one place are compared ``step`` further on, less one."""

    def on(s: Column, j: Column) -> Column:
        here, beside = F.get("eq", start + j), F.get("after" if step > 0 else "before", start + j)
        bent = F.greatest(s["b"], s["a"]) + beside if step > 0 else F.greatest(s["b"] + beside, s["a"])
        return F.struct((s["a"] + here).alias("a"), bent.alias("b"))

    best = F.aggregate(F.sequence(F.lit(0), F.col("wide") - 1), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), on)["b"]
    return best - 1 if step > 0 else best


def _places(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, row, item, at, n_words, n_equal, similarity): all places; ``row`` tells texts under one id apart."""
    items = benchmark.select(id_key("item_id").alias("item"), words().alias("w")).where((F.size("w") >= SPAN) & (F.get("w", F.lit(0)) != "")).distinct()
    mask = F.get(F.array(*[F.lit(m) for m in SEED_OF]), F.least(F.size("w"), F.lit(WINDOW)) - 1)
    items = stored(items.select("item", "w", F.xxhash64("item", "w").alias("key"), mask.alias("mask")), "items")
    masks = sorted(r.mask for r in items.select("mask").distinct().collect()) or [0]
    seeds = stored(_windows(items, ["item", "key", "mask"], masks).where("m = mask").drop("mask").distinct(), "seeds")
    rows = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("row"), F.col("text").alias("text"))
    marks = _bounded(seeds.select("m", "h").distinct(), MAX_SEEDS)
    # First pass: which documents share any seed. Only their texts are looked at again.
    touched = stored(_windows(rows.select("doc", "row", words().alias("w")), ["doc", "row"], masks).join(marks, ["m", "h"], "left_semi").select("doc", "row").distinct(), "touched")
    again = stored(rows.join(_bounded(touched, MAX_DOCS), ["doc", "row"], "left_semi").select("doc", "row", words().alias("w")).dropDuplicates(["doc", "row"]), "touched-texts")
    hits = _windows(again, ["doc", "row"], masks).join(_bounded(seeds.select("m", "h", "item", "key", F.col("at").alias("j")), MAX_SEEDS), ["m", "h"])
    places = hits.select("doc", "row", "item", "key", (F.col("at") - F.col("j")).alias("hit")).distinct()
    both = places.join(again, ["doc", "row"]).join(_bounded(items.select("item", "key", F.col("w").alias("v")), MAX_SEEDS // 10), ["item", "key"])
    wide = F.least(F.size("v"), F.lit(WINDOW))
    # The stretch of the document around the item; -2 to 2 words beside the hit are all that is compared.
    reach = F.transform(F.sequence(F.lit(-2), F.size("v") + 1), lambda j: F.get("w", F.col("hit") + j))
    equal = lambda shift: F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda j: F.coalesce(F.get("c", j + shift + 2) == F.get("v", j), F.lit(False)).cast("int"))
    # ``inline`` keeps what was computed; filters beyond it do not compute it again.
    once = lambda **c: F.inline(F.array(F.struct(*[x.alias(name) for name, x in c.items()])))
    both = both.select("doc", "row", "item", "hit", F.size("v").alias("n_words"), wide.alias("wide"), "v", once(c=reach))
    # Words equal at any of the five distances: where they are too few, no window can reach LEAST.
    some = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda j: F.coalesce(F.array_contains(F.slice("c", j + 1, 5), F.get("v", j)), F.lit(False)).cast("int"))
    both = both.where(_total(some) >= F.col("wide") * LEAST - 1e-9)
    both = both.select("doc", "row", "item", "hit", "n_words", "wide", once(**{f"e{k + 2}": equal(k) for k in range(-2, 3)}))
    # The hit may lie right of an added or dropped word, so its neighbours are looked at as left sides as well.
    sides = F.array(*[F.struct((F.col("hit") + k - 2).alias("at"), F.col(f"e{k - 1}").alias("before"), F.col(f"e{k}").alias("eq"), F.col(f"e{k + 1}").alias("after")) for k in (1, 2, 3)])
    both = both.select("doc", "row", "item", "n_words", "wide", F.inline(sides))
    window = lambda s: F.greatest(_total(F.slice("eq", s, F.col("wide"))), _bent(s - 1, 1), _bent(s - 1, -1))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_words") - F.col("wide") + 1), window))
    scored = both.select("doc", "row", "item", "at", "n_words", _total(F.col("eq")).alias("n_equal"), (best / F.col("wide")).alias("similarity"))
    return scored.where(F.col("similarity") >= LEAST)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, n_words, n_equal, similarity): the best place of each item in each contaminated document.

    ``at`` is the word position in the document at which the item would begin (below 0 when its head is cut off),
    ``n_equal`` the equal words over the whole item at this distance and ``similarity`` the share of equal words in the best window.
    """
    top = _places(docs, benchmark).groupBy("doc", "item").agg(F.max(F.struct("similarity", "n_equal", (-F.col("at")).alias("back"), "n_words")).alias("t"))
    return top.select(
        id_back("doc").alias("doc_id"), id_back("item").alias("item_id"), (-F.col("t.back")).cast("long").alias("at"), F.col("t.n_words").cast("long").alias("n_words"),
        F.col("t.n_equal").cast("long").alias("n_equal"), F.col("t.similarity").alias("similarity"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns as given.

    Rows go by id and text, so a clean text under a missing or repeated id stays.
    """
    found = stored(_places(docs, benchmark).select(F.col("doc").alias("id"), "row").distinct(), "contaminated")
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), id_key().alias("id"), F.xxhash64("text").alias("row"))
    return keyed.join(_bounded(found, MAX_DOCS), ["id", "row"], "left_anti").select("whole.*")
