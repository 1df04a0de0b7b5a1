"""Exact removal of repeated substrings by a range-partitioned sparse suffix array.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the
same document). Suffixes are sorted only where they can matter:

1. Every window of ``length`` bytes has an anchor, the least hash among its ``ANCHOR``-byte strings. Equal windows have
   the same anchor at the same place, so only suffixes that begin at anchors are needed. One pass counts anchor hashes by
   hash range; the ranges that occur twice are marked in a bitmap of fixed size (``FILTER_BITS``). A marked anchor is only
   a candidate: a full bitmap makes more work and changes no result.
2. A second pass emits the suffix at each candidate anchor with the bytes before it that windows can reach. Equal ones
   of a task are combined at once. Splitters sampled from the first pass deal the suffixes out by their leading
   bytes into ranges of bounded size; the leading ``ANCHOR`` bytes decide, so no group of equal windows crosses a
   boundary, and ranges that splitters alone leave too large are cut again by anchor hash.
3. Each range is sorted by multikey quicksort on 8-byte keys, once by what follows the anchor and once by what precedes
   it. Common prefix lengths of neighbours cut both orders into classes for every place of the window, and in each class all
   but the earliest window are repeated.
4. Anchors of ``HOT`` and more occurrences would fill one range: their windows are compared one by one by a 128-bit
   hash, dealt out by it.

Nulls: a null text is empty; a null doc_id sorts first. Fully repeated rows are one document, so they do not remove each
other; of two rows with one doc_id and other texts the order is by a hash of the text. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import id_back, id_key, python_batches, utf8

LENGTH = 100
ANCHOR = 51
FILTER_BITS = 28
HOT_BITS = 24
HASH_BITS = 40
HOT = 20_000
# Anchors of one range; splitters that go to every task.
RANGE_ROWS = 500_000
MAX_SPLITTERS = 20_000
SAMPLES_PER_TASK = 256
# Bytes looked at together, anchors held before they are handed on, suffixes held for combining.
CHUNK = 1 << 19
HELD = 1 << 21
COMBINED = 150_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


_UP = _powers(_BASE, CHUNK + 1024)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1024)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``anchor``-byte string; never 0."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
        h = (total[anchor:] - total[:-anchor]) * _DOWN[: n - anchor + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _stirred(h: np.ndarray) -> np.ndarray:
    """Least hashes are small ones; mixed again they are spread over all values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def anchors(data: bytes, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of documents laid end to end; windows do not cross ``ends``."""
    raw = np.frombuffer(data, np.uint8)
    n, span = len(raw), length - anchor + 1
    inside = np.ones(n, bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1) : e] = False
    places, hashes = [], []
    for s in range(0, n, CHUNK):
        low, high = max(0, s - span), min(n, s + CHUNK + length + span)
        if high - low < length:
            break
        part = raw[low:high]
        h = anchor_hashes(part, anchor)
        least = _sliding(h, span, np.minimum)
        least[~inside[low : low + len(least)]] = 0
        edge = np.zeros(span - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == h)
        chosen = chosen[(chosen + low >= s) & (chosen + low < s + CHUNK)]
        places.append(chosen + low)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), _stirred(np.concatenate(hashes))


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of about ``CHUNK`` bytes."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(b.column(column)):
        texts.append(t.as_py())
        held += len(texts[-1])
        if held >= CHUNK:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


# --- first pass ------------------------------------------------------------------------------


def _count_anchors(docs: DataFrame, length: int, anchor: int, ranges_log2: int) -> DataFrame:
    """(part, h, c, samples): per task and hash range the distinct hashes with counts; samples of leading bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        samples: dict[int, bytes] = {}

        def out() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (values >> np.uint64(HASH_BITS - ranges_log2)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << ranges_log2) + 1))
            five = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :5])
            two = np.minimum(counts, 65535).astype("<u2")
            rows = [i for i in range(1 << ranges_log2) if cut[i] < cut[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([five[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([two[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()), pa.nulls(len(rows), pa.binary())],
                names=["part", "h", "c", "sample"],
            )

        for b in batches:
            for _, texts in _batches(b, 0):
                data = b"".join(texts)
                at, h = anchors(data, np.cumsum([len(t) for t in texts]), length, anchor)
                held.append(h >> np.uint64(64 - HASH_BITS))
                # The leading bytes with the least hashes are a random sample of the distinct ones.
                if len(h):
                    for j in np.argsort(h)[:8].tolist():
                        samples[int(h[j])] = data[at[j] : at[j] + anchor]
                if sum(map(len, held)) >= HELD:
                    yield from out()
                    held = []
        if sum(map(len, held)):
            yield from out()
        best = [samples[k] for k in sorted(samples)[:SAMPLES_PER_TASK]]
        n = len(best)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(best, pa.binary())], names=["part", "h", "c", "sample"])

    return docs.select("t").mapInArrow(work, "part int, h binary, c binary, sample binary")


def _mark_repeated(pdf: pd.DataFrame, ranges_log2: int, hot: int) -> pd.DataFrame:
    """Bitmap slices of one hash range: repeated anchors, hot anchors; and the number of anchors. Splitter samples pass through."""
    part = int(pdf["part"].iloc[0])
    if part < 0:
        own = pdf["sample"].tolist()
        return pd.DataFrame({"part": part, "bits": None, "hot": None, "n": 0, "sample": own})
    five = np.frombuffer(b"".join(pdf["h"]), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    values = wide.view("<u8").ravel()
    counts = np.frombuffer(b"".join(pdf["c"]), "<u2").astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    total = np.add.reduceat(counts, first)
    values = values[first]
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def bitmap(chosen: np.ndarray, bits: int) -> bytes:
        own = np.zeros(1 << (bits - ranges_log2), bool)
        slot = chosen >> np.uint64(HASH_BITS - bits)
        own[(slot - np.uint64(part << (bits - ranges_log2))).astype(np.int64)] = True
        return squeeze(np.packbits(own, bitorder="little").tobytes())

    return pd.DataFrame({"part": [part], "bits": [bitmap(values[total > 1], FILTER_BITS)], "hot": [bitmap(values[total >= hot], HOT_BITS)], "n": [int(total.sum())], "sample": [None]})


# --- sorting a range -------------------------------------------------------------------------


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Stable order of equally long byte strings: quicksort by 8 bytes at a time, going on only inside ties."""
    m, width = rows.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.zeros(m, np.int64)
    for j in range(keys.shape[1]):
        now = keys[order, j]
        fresh = np.ones(m, bool)
        fresh[1:] = (group[1:] != group[:-1]) | (now[1:] != now[:-1])
        group = np.cumsum(fresh) - 1
        if j + 1 == keys.shape[1]:
            break
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        order[at] = own[np.lexsort((keys[own, j + 1], group[at]))]
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each string in ``order`` and the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 65536):
        e = min(len(order), s + 65536)
        differ = rows[order[s:e]] != rows[order[s - 1 : e - 1]]
        out[s:e] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _best_neighbour(lcp: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def repeated_windows(doc: np.ndarray, row: np.ndarray, at: np.ndarray, left: np.ndarray, context: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, end): what the repeated windows around each anchor cover. ``context`` has ``left`` bytes before it."""
    m, span = len(doc), length - anchor
    after, before = np.zeros((m, length), np.uint8), np.zeros((m, span), np.uint8)
    right = np.array([len(c) for c in context], np.int64) - left
    for i, c in enumerate(context):
        k = int(left[i])
        after[i, : len(c) - k] = np.frombuffer(c, np.uint8, offset=k)
        if k:
            before[i, :k] = np.frombuffer(c, np.uint8, count=k)[::-1]
    by_after, by_before = multikey_sort(after), multikey_sort(before)
    lcp_a, lcp_b = common_prefix(after, by_after), common_prefix(before, by_before)
    most_a, most_b = np.minimum(_best_neighbour(lcp_a, by_after), right), np.minimum(_best_neighbour(lcp_b, by_before), left)
    earliest = np.lexsort((at, row, doc))
    live = earliest[(most_a + most_b)[earliest] >= length]
    low, high = np.full(m, length, np.int64), np.full(m, -1, np.int64)
    class_a, class_b = np.empty(m, np.int64), np.empty(m, np.int64)
    for k in range(span + 1):
        own = live[(most_a[live] >= length - k) & (most_b[live] >= k)]
        if len(own) < 2:
            continue
        class_a[by_after] = np.cumsum(lcp_a < length - k)
        class_b[by_before] = np.cumsum(lcp_b < k) if k else 0
        first = np.unique(class_a[own] * (m + 1) + class_b[own], return_index=True)[1]
        again = np.ones(len(own), bool)
        again[first] = False
        hit = own[again]
        low[hit] = np.minimum(low[hit], k)
        high[hit] = k
    found = np.flatnonzero(high >= 0)
    return found, at[found] - high[found], at[found] - low[found] + length


# --- second pass -----------------------------------------------------------------------------

CONTEXT, WINDOW, SPAN = 0, 1, 2
_ROWS = "kind int, part int, sub int, id long, row long, at long, n long, data binary"


class _Combiner:
    """Rows of one task: first places of contexts and windows, and the spans that are repeated for certain."""

    def __init__(self, splitters: list[bytes], subs: int, parts: int, length: int, anchor: int):
        self.splitters, self.subs, self.parts, self.length, self.anchor = splitters, subs, parts, length, anchor
        self.contexts: dict[bytes, tuple[int, int, int]] = {}
        self.windows: dict[bytes, tuple[int, int, int]] = {}
        self.spans: list[tuple[int, int, int, int]] = []

    def _first(self, seen: dict[bytes, tuple[int, int, int]], key: bytes, own: tuple[int, int, int], before: int, size: int) -> None:
        """Keep the earliest place of ``key``; the other one's bytes [at - before, at - before + size) are repeated."""
        other = seen.get(key)
        if other is None:
            seen[key] = own
        elif other != own:
            late = max(other, own)
            seen[key] = min(other, own)
            start = late[2] - before
            last = self.spans[-1] if self.spans else None
            if last and last[:2] == late[:2] and last[2] <= start <= last[3]:
                self.spans[-1] = (*last[:3], max(last[3], start + size))
            else:
                self.spans.append((*late[:2], start, start + size))

    def context(self, data: bytes, start: int, end: int, at: int, doc: tuple[int, int]) -> None:
        low, high = max(start, at - self.length + self.anchor), min(end, at + self.length)
        self._first(self.contexts, bytes([at - low]) + data[low:high], (*doc, at - start), at - low, high - low)

    def hot(self, data: bytes, start: int, end: int, at: int, doc: tuple[int, int]) -> None:
        for p in range(max(start, at - self.length + self.anchor), min(at, end - self.length) + 1):
            self._first(self.windows, xxhash.xxh3_128_digest(data[p : p + self.length]), (*doc, p - start), 0, self.length)

    def full(self) -> bool:
        return len(self.contexts) + len(self.windows) + len(self.spans) >= COMBINED

    def batch(self) -> pa.RecordBatch:
        rows: list[tuple] = []
        for key, (i, r, at) in self.contexts.items():
            lead = key[1 + key[0] : 1 + key[0] + self.anchor]
            rows.append((CONTEXT, bisect_right(self.splitters, lead), xxhash.xxh32_intdigest(lead) % self.subs, i, r, at, key[0], key[1:]))
        for key, (i, r, at) in self.windows.items():
            rows.append((WINDOW, int.from_bytes(key[:4]) % self.parts, int.from_bytes(key[4:8]) % self.subs, i, r, at, 0, key))
        for i, r, start, end in self.spans:
            rows.append((SPAN, i % self.parts, 0, i, r, start, end, None))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        self.contexts, self.windows, self.spans = {}, {}, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "part", "sub", "id", "row", "at", "n", "data"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, row, start, end): repeated byte spans; they may overlap. ``docs`` has id, row, t (bytes)."""
    if not 0 < anchor <= length < 256:
        raise ValueError("0 < anchor <= length < 256")
    spark = docs.sparkSession
    splits = docs.rdd.getNumPartitions()
    ranges_log2 = min(16, max(4, (splits - 1).bit_length()))
    counted = _count_anchors(docs, length, anchor, ranges_log2)
    marks = counted.withColumn("part", F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("sample"), F.lit(16)).cast("int")).otherwise(F.col("part")))
    marked = marks.groupBy("part").applyInPandas(lambda pdf: _mark_repeated(pdf, ranges_log2, hot), "part int, bits binary, hot binary, n long, sample binary")
    open_ = zstandard.ZstdDecompressor().decompress
    repeated, crowded, total, samples = np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.zeros(1 << (HOT_BITS - 3), np.uint8), 0, []
    # Bitmap slices of a fixed total size, and samples limited below.
    for r in marked.toLocalIterator():
        if r.part < 0:
            samples.append(r.sample)
            continue
        size, hot_size = len(repeated) >> ranges_log2, len(crowded) >> ranges_log2
        repeated[r.part * size : (r.part + 1) * size] = np.frombuffer(open_(bytes(r.bits)), np.uint8)
        crowded[r.part * hot_size : (r.part + 1) * hot_size] = np.frombuffer(open_(bytes(r.hot)), np.uint8)
        total += r.n
    parts = max(1, min(MAX_SPLITTERS, len(samples), total // range_rows))
    subs = max(1, -(-total // (range_rows * parts)))
    samples = sorted(map(bytes, samples))
    splitters = [samples[i * len(samples) // parts] for i in range(1, parts)]
    shared = spark.sparkContext.broadcast((repeated, crowded))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = shared.value
        out = _Combiner(splitters, subs, parts, length, anchor)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, texts in _batches(b, 2):
                data = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                at, h = anchors(data, ends, length, anchor)
                slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                kept = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                at, h = at[kept], h[kept]
                slot = (h >> np.uint64(64 - HOT_BITS)).astype(np.int64)
                is_hot = (hot_bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool).tolist()
                owner = np.searchsorted(ends, at, side="right").tolist()
                bounds = [0, *ends.tolist()]
                for p, o, crowd in zip(at.tolist(), owner, is_hot):
                    doc = (ids[first + o], rows[first + o])
                    (out.hot if crowd else out.context)(data, bounds[o], bounds[o + 1], p, doc)
                if out.full():
                    yield out.batch()
        yield out.batch()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        if kind == SPAN:
            return pd.DataFrame({"id": pdf["id"], "row": pdf["row"], "start": pdf["at"], "end": pdf["n"]})
        pdf = pdf.drop_duplicates(["id", "row", "at", "data"] if kind == WINDOW else ["id", "row", "at"]).reset_index(drop=True)
        i, r, at = (pdf[c].to_numpy(np.int64) for c in ("id", "row", "at"))
        if kind == WINDOW:
            order = pdf.sort_values(["id", "row", "at"]).index
            late = pdf.loc[order][pdf.loc[order].duplicated("data")]
            return pd.DataFrame({"id": late["id"], "row": late["row"], "start": late["at"], "end": late["at"] + length})
        found, start, end = repeated_windows(i, r, at, pdf["n"].to_numpy(np.int64), pdf["data"].tolist(), length, anchor)
        return pd.DataFrame({"id": i[found], "row": r[found], "start": start, "end": end})

    return docs.mapInArrow(emit, _ROWS).groupBy("kind", "part", "sub").applyInPandas(compare, "id long, row long, start long, end long")


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, range_rows: int = RANGE_ROWS, text_out: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; with ``text_out`` also the kept bytes and the spans."""
    python_batches(docs.sparkSession)
    base = docs.select(id_key().alias("id"), F.xxhash64(utf8()).alias("row"), utf8().alias("t"))
    spans = repeated_spans(base, length, anchor, hot, range_rows).groupBy("id", "row").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))
    joined = base.join(spans, ["id", "row"], "left").select("id", "t", "s", "e")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, counts, hashes, kept_out, spans_out = [], [], [], [], [], []
            for t, s, e in zip(b.column(1), b.column(2), b.column(3)):
                text = t.as_py()
                gone = merged(s.as_py(), e.as_py()) if s.is_valid else []
                at, kept = 0, []
                for a, z in gone:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                left = b"".join(kept)
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                counts.append(len(gone))
                hashes.append(hashlib.sha256(left).hexdigest())
                if text_out:
                    kept_out.append(left)
                    spans_out.append([list(x) for x in gone])
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())]
            if text_out:
                arrays += [pa.array(kept_out, pa.binary()), pa.array(spans_out, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] * text_out)])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * text_out
    return joined.mapInArrow(cut, schema).withColumn("id", id_back("id")).withColumnRenamed("id", "doc_id")
