"""SimHash near-duplicate groups with pigeonring candidate filtering.

``fingerprints``     64-bit SimHash of word shingles, whole texts
``linked_groups``    exact components under Hamming distance 2 (contract query: 3 words)
``similar_groups``   components of texts with word-shingle similarity 0.8 or more (pipeline stage: 5 words)

Pigeonring: the 64 bits are cut into ``SEGMENTS`` segments in a ring. Two fingerprints within ``radius``
bits have a starting segment from which every chain of l segments differs by at most l * radius / SEGMENTS
bits. The longest chains whose budget is below one bit must be equal, so they are the join keys; the longer
chains prune what the keys bring together before the full Hamming check.

Keys that many different fingerprints share are not paired: each of their fingerprints emits itself and its
64 neighbours at one bit, and fingerprints that emit a common value are within two bits (and the other way
round). At most 65 fingerprints meet in one such value, so no group grows with the data.

Nulls: a null text is empty. Texts without a word have fingerprint 0. Rows with a null doc_id take part;
they are named by null and never name a group that has another id. Repeated rows come back as often as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import NO_ID, drop_held, id_back, id_key, python_batches, stored, utf8
from lexgrove.llm.components import components
from lexgrove.scale import fits, salted_lookup

SEGMENTS = 5
SEED = 42
# Keys with more different fingerprints than this are linked through neighbours instead of pairs; texts of such keys by their rarest shingles.
PAIR_LIMIT = 48
# Shingles hashed and counted at once, so that one very long text stays within bounded memory.
BLOCK = 1 << 18
HOT_ROWS = 100_000
RADIUS = 2
SLOTS = 128
# Sketches below this are no candidates: a pair at 0.8 falls below by chance about once in 10^7 (standard error 0.035).
LOOSE = 0.6
BLOCKS = 8
# Members of one component under one shingle are kept in so many lists.
CELLS = 16
# Shingles whose counts order the prefixes: the most frequent ones, 8 bytes each; any order gives the same pairs.
FREQUENT = 100_000
# Texts named by a broadcast, 24 bytes each.
MAX_NODES = 1_000_000
ORDERS = [2 * xxhash.xxh32_intdigest(f"order {i}") + 1 for i in range(2 * BLOCKS)]


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; fewer words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[i:] for i in range(min(size, len(words)))))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64)


def simhash64(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(id, fp): ``id`` is the doc_id, or the smallest long for a null one; ``fp`` the 64 bits as a long."""
    python_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            fps = [simhash64(shingle_hashes(t.as_py(), size)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(id_key().alias("id"), utf8().alias("t")).mapInArrow(work, "id long, fp long")


def _segments(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def chain_ok(diff: Column, start: Column, radius: int, parts: int) -> Column:
    """True when every chain from segment ``start`` of the XOR ``diff`` stays within its share of ``radius``."""
    counts = [F.bit_count(_cut(diff, first, width)) for first, width in _segments(parts)]
    passed = F.lit(False)
    for s in range(parts):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, parts + 1):
            total = total + counts[(s + length - 1) % parts]
            ok = ok & (total * parts <= length * radius)
        passed = passed | ((start == s) & ok)
    return passed


def linked_edges(fps: DataFrame, parts: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of the links at ``RADIUS`` bits among the distinct ``fps`` (fp)."""
    exact = -(-parts // RADIUS) - 1
    segments = _segments(parts)
    keys = []
    for s in range(parts):
        chain = [segments[(s + j) % parts] for j in range(exact)]
        keys.append(F.struct(F.lit(s).alias("s"), F.concat_ws(":", *[_cut(F.col("fp"), a, w).cast("string") for a, w in chain]).alias("k")))
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    shared = keyed.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stored(keyed.join(shared, ["s", "k"]), "ring-keys")
    few = sized.where(F.col("n") <= pair_limit)
    other = few.select("s", "k", F.col("fp").alias("fp2"))
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    pairs = few.join(other, ["s", "k"]).where(F.col("fp") < F.col("fp2"))
    pairs = pairs.where(chain_ok(diff, F.col("s"), RADIUS, parts)).where(F.bit_count(diff) <= RADIUS).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    crowded = sized.where(F.col("n") > pair_limit).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    meet = crowded.select("fp", F.explode(around).alias("v")).groupBy("v").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    near = meet.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(near)


def linked_groups(docs: DataFrame, size: int = 3, parts: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id among the documents reachable by links."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    each = prints.groupBy("fp").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(linked_edges(each.select("fp"), parts, pair_limit))
    member = each.join(roots, each.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = member.join(named, "root").select("fp", "n", "component_id")
    out = salted_lookup(prints, by_print, ["fp"], "id", "n", hot_rows=HOT_ROWS)
    return out.select(id_back("id").alias("doc_id"), "fp", "component_id")


# --- similarity 0.8 on word shingles ---------------------------------------------------------


def sketch(hashes: np.ndarray) -> bytes:
    """Least hash of each of ``SLOTS`` classes, 16 bits of it; 0 for a class without a shingle."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes % SLOTS).astype(np.int64), hashes // SLOTS)
    filled = least != np.iinfo(np.uint64).max
    return np.where(filled, least % np.uint64(65535) + np.uint64(1), 0).astype("<u2").tobytes()


def sketch_similarity(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: equal classes by classes that either text fills."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    either = (x != 0) | (y != 0)
    return float(((x == y) & either).sum() / max(1, either.sum()))


def _block_keys(hashes: np.ndarray) -> list[int]:
    """Two least hashes under two of ``2 * BLOCKS`` orders make one key."""
    least = [int((hashes * np.uint64(m)).min()) for m in ORDERS]
    return [xxhash.xxh64_intdigest(f"{i}:{least[2 * i]}:{least[2 * i + 1]}") >> 1 for i in range(BLOCKS)]


def shingle_sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, row, same, fp, sketch, keys) of every row; ``same`` is equal for texts of equal words."""
    python_batches(docs.sparkSession)
    schema = "id long, row long, same binary, fp long, sketch binary, keys array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            out = []
            for value in b.column(2):
                text = value.as_py()
                hashes = shingle_hashes(text, size)
                same = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
                out.append((same, simhash64(hashes), sketch(hashes), _block_keys(hashes) if len(hashes) else []))
            same, fps, sketches, keys = zip(*out) if out else ((), (), (), ())
            arrays = [pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["id", "row", "same", "fp", "sketch", "keys"])

    return docs.select(id_key().alias("id"), F.xxhash64(utf8()).alias("row"), utf8().alias("t")).mapInArrow(work, schema)


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            keep = [sketch_similarity(x.as_py(), y.as_py()) >= least for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(work, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, h): the distinct shingle hashes of the texts that ``nodes`` (id, row, node) names."""
    python_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])

    named = F.broadcast(nodes) if fits(nodes, MAX_NODES) else nodes
    texts = docs.select(id_key().alias("id"), F.xxhash64(utf8()).alias("row"), utf8().alias("t")).join(named, ["id", "row"])
    return texts.select("node", "t").mapInArrow(work, "node long, h array<long>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have Jaccard similarity ``least`` or more, counted exactly."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b").join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
    counted = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    return counted.where(F.col("common") / (F.col("n") - F.col("common")) >= least).select("a", "b")


def _prefixes(sets: DataFrame, frequent: np.ndarray, least: float) -> DataFrame:
    """(node, root, n, rest, h): the first n - ceil(least * n) + 1 shingles of each set, those of ``frequent`` last.

    ``rest`` is how many shingles of the set come no earlier than ``h``.
    """
    by_value = np.argsort(frequent, kind="stable")
    values = frequent[by_value]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            sizes, rests, cut = [], [], []
            for h in (x.values.to_numpy() for x in b.column(2)):
                place = np.full(len(h), -1, np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    place = np.where(values[at] == h, by_value[at], -1)
                first = np.lexsort((h, place))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]
                cut.append(h[first])
                rests.append(np.arange(len(h), len(h) - len(first), -1))
                sizes.append(np.full(len(first), len(h)))
            opened = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
            columns = [b.column(0).take(pa.array(opened)), b.column(1).take(pa.array(opened)), flat(sizes), flat(rests), flat(cut)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "n", "rest", "h"])

    return sets.select("node", "root", "h").mapInArrow(work, "node long, root long, n long, rest long, h long")


def _crowd_pairs(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b) in different components of ``roots`` (node, root) that may reach ``least`` among ``sets``; none is missed.

    Prefix filter: with all shingles in one order, two texts that reach ``least`` share one of the first
    n - ceil(least * n) + 1 of each. The order puts the ``FREQUENT`` most frequent shingles last, the most frequent at
    the very end, so that passages of many texts are seldom among the first. Members of a component meet its other
    members nowhere. At a common shingle the rest of the shorter list must still be long enough.
    """
    counts = sets.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    often = counts.orderBy(F.col("m").desc(), "h").limit(FREQUENT).select("h").toArrow().column(0).to_numpy()
    keys = _prefixes(sets.join(roots, "node"), often[::-1].copy(), least).select("h", "root", F.struct("node", "rest", "n").alias("t"))
    cells = stored(keys.groupBy("h", "root", F.pmod(F.xxhash64("t.node"), F.lit(CELLS)).alias("cell")).agg(F.collect_list("t").alias("x")), "crowd-cells")
    mixed = cells.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    cells = cells.join(mixed, "h", "left_semi").select("h", "root", "x")
    other = cells.select("h", F.col("root").alias("root2"), F.col("x").alias("y"))
    met = cells.join(other, "h").where("root < root2").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    enough = F.least("x.rest", "y.rest") >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-6
    return met.where(enough).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id, row, keep): ``row`` tells rows of one id apart, ``keep`` marks the first document of each group.

    Texts of equal words are one. Other texts meet where they share one of ``BLOCKS`` keys of two least shingle
    hashes each (at similarity 0.8 a pair shares none with probability 0.0003). Keys of more than ``pair_limit``
    texts compare each text with six that stand out by id or fingerprint, which links a group of near copies in
    proportion to its size; where that leaves several components under a key, ``_crowd_pairs`` finds every pair
    between them. Pairs pass a loose check of sketches, then their common shingles are counted. Fingerprints only
    pick stand-outs: they count repeats, so texts of equal shingles may have distant ones.
    """
    rows = stored(shingle_sketches(docs, size), "sketches")
    texts = stored(rows.groupBy("same").agg(F.min(F.struct("id", "row", "fp", "sketch", "keys")).alias("t")).select("same", "t.*").withColumn("node", F.xxhash64("same")), "sketched-texts")
    keyed = texts.select("node", "fp", F.explode("keys").alias("k"))
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    stand = {"p0": F.min("node"), "p1": F.max("node"), "p2": F.min_by("node", "fp"), "p3": F.max_by("node", "fp"), "p4": F.min_by("node", turned), "p5": F.max_by("node", turned)}
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in stand.items()]).where("n > 1")
    sized = stored(keyed.join(shared, "k"), "sketch-keys")
    few = sized.where(F.col("n") <= pair_limit).select("k", "node")
    other = few.select("k", F.col("node").alias("node2"))
    pairs = few.join(other, "k").where("node < node2").select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    stars = sized.where(F.col("n") > pair_limit).select(F.col("node").alias("a"), F.explode(F.array(*stand)).alias("b")).where("a <> b").distinct()
    shape = texts.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    shape2 = texts.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    candidates = pairs.union(stars).distinct().join(shape, "a").join(shape2, "b").select("a", "b", "sa", "sb")
    likely = stored(_verified(candidates, LOOSE * least / 0.8), "likely-pairs")
    met = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(shingle_sets(docs, texts.join(met, "node", "left_semi").select("id", "row", "node"), size), "shingle-sets")
    edges = stored(_similar(likely, sets, least), "similar-pairs")
    roots = components(edges)
    rooted = lambda r: texts.join(r.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    apart = sized.where(F.col("n") > pair_limit).select("k", "node").join(rooted(roots).select("node", "root"), "node")
    mixed = apart.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    crowd = stored(apart.join(mixed, "k", "left_semi").select("node", "root").distinct(), "crowd")
    if not crowd.isEmpty():
        sets = stored(shingle_sets(docs, texts.join(crowd.select("node"), "node", "left_semi").select("id", "row", "node"), size), "crowd-sets")
        met = stored(_crowd_pairs(sets, crowd, least), "crowd-pairs")
        sketched = met.join(shape, "a").join(shape2, "b").select("a", "b", "sa", "sb")
        likely = stored(_verified(sketched, LOOSE * least / 0.8), "likely-crowd-pairs")
        roots = components(edges.union(_similar(likely, sets, least)))
    grouped = rooted(roots).select("same", "id", "row", "root")
    first = grouped.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"))
    chosen = first.select("first.*").withColumn("keep", F.lit(True))
    return rows.select("id", "row").distinct().join(chosen, ["id", "row"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def near_dedup(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with the first document of each group only; columns as given. Of rows that share id and text one stays."""
    gone = similar_groups(docs, size, least).where("not keep").select("id", "row")
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), id_key().alias("id"), F.xxhash64(utf8()).alias("row"))
    kept = keyed.join(gone, ["id", "row"], "left_anti")
    # Texts of such rows alone are brought together, reduced before the shuffle.
    again = stored(keyed.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "row"), "repeated-rows")
    if again.isEmpty():
        return kept.select("whole.*")
    one = kept.join(again, ["id", "row"], "left_semi").groupBy("id", "row").agg(F.min_by("whole", F.xxhash64(F.to_json("whole"))).alias("whole"))
    return kept.join(again, ["id", "row"], "left_anti").select("whole.*").union(one.select("whole.*"))
