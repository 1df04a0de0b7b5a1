"""Token ids of a corpus as wavelet-matrix shards.

Documents are encoded in ascending doc_id order and cut into shards. A shard is one file: a header, the doc_ids and
token counts, and for each bit of an id, highest first, the plane of that bit over the ids as they stand when sorted
stably by the bits before, with counts of ones at every 512 bits. Planes are compressed one by one. ``WaveletShard``
answers token access, counts (rank), the place of the kth occurrence (select) and ranges from the file alone.
Shards are stored as binary rows of a table in the shared folder, so Spark's writer commits each exactly once.

Encoding is by the tokenizers library. White space ends every token of this tokenizer, and so does the end of a word before
punctuation; texts are cut there and the ids of each piece are kept in a bounded memory of the worker. Plain words go to the
library's BPE model directly, everything else through its whole pipeline.

Nulls: a null text is empty and holds the end id only; a null doc_id sorts first. Rows of equal doc_id come
in the order of their texts' hashes and count one after the other. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import id_back, id_key, python_batches, scratch, utf8, worker_held

MAGIC = b"WAVSHRD1"
END_ID = 2
SHARD_TOKENS = 1 << 20
# Bytes of text encoded at once, as whole documents; a longer document goes alone.
STEP_BYTES = 3_000_000
# Ranges of ids that go to one task, if that leaves each core enough tasks.
RANGES_PER_TASK = 8
TASKS_PER_CORE = 4
RANK_BITS = 512
# Ids of a plane moved at once.
STRETCH = 1 << 15
# Pieces whose ids a worker keeps, in two halves: when the later is full, it becomes the earlier one, and pieces that come again
# move to the new one.
MEMO_ENTRIES = 600_000


# --- shard file ------------------------------------------------------------------------------


def build_shard(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """File of the ``ids`` (all documents one after the other)."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    blocks = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(counts.astype("<u4").tobytes())]
    for k in range(bits - 1, -1, -1):
        ones = (now & (1 << k)) != 0
        plane = np.packbits(ones, bitorder="little")
        blocks += [squeeze(plane.tobytes()), squeeze(_rank_table(plane).tobytes())]
        if k:
            now = _parted(now, ones)
    head = MAGIC + struct.pack("<QQII", len(ids), len(doc_ids), bits, len(blocks))
    return head + struct.pack(f"<{len(blocks)}Q", *map(len, blocks)) + b"".join(blocks)


def _parted(now: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``now`` where ``ones`` is false, then where it is true. By stretches, so that temporary arrays stay in the cache."""
    out = np.empty_like(now)
    low, high = 0, len(now) - np.count_nonzero(ones)
    for i in range(0, len(now), STRETCH):
        part, mask = now[i : i + STRETCH], ones[i : i + STRETCH]
        for_high, for_low = part.compress(mask), part.compress(~mask)
        out[low : low + len(for_low)] = for_low
        out[high : high + len(for_high)] = for_high
        low, high = low + len(for_low), high + len(for_high)
    return out


def _joined(now: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """What ``_parted`` made ``now`` of, with ``zeros`` values where ``ones`` is false."""
    out = np.empty_like(now)
    low, high = 0, zeros
    for i in range(0, len(now), STRETCH):
        part, mask = out[i : i + STRETCH], ones[i : i + STRETCH]
        to_high, to_low = np.flatnonzero(mask), np.flatnonzero(~mask)
        part[to_high] = now[high : high + len(to_high)]
        part[to_low] = now[low : low + len(to_low)]
        low, high = low + len(to_low), high + len(to_high)
    return out


def _rank_table(plane: np.ndarray) -> np.ndarray:
    """Ones before each stretch of ``RANK_BITS`` bits."""
    step = RANK_BITS // 8
    padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
    padded[: len(plane)] = plane
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


class WaveletShard:
    """Reads one shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, docs, self.bits, blocks = struct.unpack_from("<QQII", data, 8)
        sizes = struct.unpack_from(f"<{blocks}Q", data, 32)
        at, parts = 32 + 8 * blocks, []
        open_ = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            parts.append(open_(data[at : at + size]))
            at += size
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.counts = np.frombuffer(parts[1], "<u4")
        self.planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
        self.ranks = [np.frombuffer(p, "<u4") for p in parts[3::2]]
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]
        assert len(self.doc_ids) == docs

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest bit up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[self.bits - 1 - k]
            # A one takes the next value after the zeros, a zero the next before.
            now[zeros:] |= now.dtype.type(1 << k)
            now = _joined(now, ones, zeros)
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, plane = i // RANK_BITS, self.planes[level]
        ones = int(self.ranks[level][block])
        first = block * RANK_BITS // 8
        ones += int(np.bitwise_count(plane[first : i // 8]).sum())
        if i % 8:
            ones += (int(plane[i // 8]) & ((1 << i % 8) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``i`` ids stand after the last plane."""
        first = 0
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, i)
            if token >> (self.bits - 1 - level) & 1:
                first, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, i = first - a, i - b
        return first, i

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` among the first ``i`` ids (all, if None)."""
        if token >> self.bits:
            return 0
        first, last = self._range(token, self.n if i is None else i)
        return last - first

    def select(self, token: int, k: int) -> int:
        """Position of the kth occurrence of ``token``, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._range(token, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            nth = at - self.zeros[level] if bit else at
            low, high = 0, self.n
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                if (ones if bit else mid + 1 - ones) > nth:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at


# --- encoder ---------------------------------------------------------------------------------

# Words of the letters A to Z and À to ÿ (without × and ÷), as UTF-8, and the same bytes in lower case.
_WORD = re.compile(rb"(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
_LETTER, _MARK, _BLANK, _LEAD, _TRAIL = 1, 2, 3, 4, 5


def _byte_kind(b: int) -> int:
    """ASCII letter, punctuation or blank, first and second byte of the letters À to ÿ (without × and ÷)."""
    one = bytes([b])
    if b < 128:
        return _LETTER if one.isalpha() else _BLANK if one.isspace() else _MARK if b > 32 and b != 127 and not one.isdigit() else 0
    return _LEAD if b == 0xC3 else _TRAIL if b < 0xC0 and b not in (0x97, 0xB7) else 0


_KINDS = bytes(map(_byte_kind, range(256)))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _listed(values: pa.Array) -> list[bytes]:
    """``to_pylist``, which makes an object of Arrow's for each value on the way and takes ten times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes batches of texts and remembers the ids of their pieces; the pieces that are new in a batch are encoded together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        letters = _byte_letters()
        # Bytes of words that the byte-level alphabet does not write as the character of their own number.
        self.spelled = [(chr(b), letters[b]) for b in [0xC3, *range(0x9F, 0xC0)] if letters[b] != chr(b)]
        # The same model over words that are already lower-cased and spelled in the byte-level alphabet.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or b"(?!)")
        self.memory: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}

    def _whole(self, pieces: list[str]) -> list[bytes]:
        """Pieces through the library's whole pipeline."""
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))]

    def _lower(self, text: bytes) -> bytes:
        """``text`` with A-Z lower-cased, unless that may change ids: by combining marks (U+0300 to U+036F) or by making a special token."""
        lower = text.lower()
        return text if b"\xcc" in text or b"\xcd" in text or self.special.search(lower) else lower

    def _pieces(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of all texts with the blanks after them, and where each text begins and the last one ends among them.

        A piece ends before a blank, and after a word before ASCII punctuation, but not inside special tokens.
        """
        data = b"\n".join([*map(self._lower, texts), b""])
        kind = np.frombuffer(data.translate(_KINDS), np.uint8)
        blank, word = kind == _BLANK, kind == _LETTER
        word[1:] |= (kind[:-1] == _LEAD) & (kind[1:] == _TRAIL)
        begins = np.ones(len(data), bool)
        begins[1:] = blank[:-1] & ~blank[1:] | word[:-1] & (kind[1:] == _MARK)
        for inside in self.special.finditer(data):
            begins[inside.start() + 1 : inside.end()] = False
        at = np.append(np.flatnonzero(begins), len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        # The first piece may hold the blanks before it alone; it counts with the first text.
        cuts = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return pieces.dictionary_encode(), cuts

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode new pieces."""
        words, odd = [], []
        for piece in fresh:
            (words if piece.isalpha() or _WORD.fullmatch(piece) else odd).append(piece)
        if words:
            line = b" ".join(words).translate(_LOWER).decode("latin-1")
            for byte, letter in self.spelled:
                line = line.replace(byte, letter)
            ids = np.array(array("H", self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids), "<u2")
            cut = np.append(0, 2 * np.flatnonzero(self.ends_word[ids]) + 2)
            self.memory.update(zip(words, _listed(pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(ids)])), strict=True))
        if odd:
            self.memory.update(zip(odd, self._whole([piece.decode("utf-8", "replace") for piece in odd]), strict=True))

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their counts; ``end_id`` follows every text."""
        if len(self.memory) >= MEMO_ENTRIES // 2:
            self.earlier, self.memory = self.memory, {}
        if not texts:
            return np.empty(0, "<u2"), np.empty(0, np.int64)
        pieces, cuts = self._pieces(texts)
        distinct = list(map(bytes.strip, _listed(pieces.dictionary)))
        fresh = set(distinct).difference(self.memory)
        again = [piece for piece in fresh if piece in self.earlier]
        self.memory.update(zip(again, map(self.earlier.__getitem__, again)))
        self._learn(list(fresh.difference(again)))
        ids = pa.array(list(map(self.memory.__getitem__, distinct)), pa.large_binary()).take(pieces.indices)
        _, places, flat = ids.buffers()
        cuts = np.frombuffer(places, np.int64)[cuts] // 2
        out = np.frombuffer(flat or b"", "<u2", cuts[-1])
        if end_id is None:
            return out, np.diff(cuts)
        return np.insert(out, cuts[1:], end_id), np.diff(cuts) + 1


def encoder_of(path: str) -> Encoder:
    return worker_held("encoder", path, lambda: Encoder(path))


# --- Spark -----------------------------------------------------------------------------------


def _steps(parts: list[int], sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of rows of one part each, of up to ``STEP_BYTES`` bytes or one row."""
    first = held = 0
    for i, (part, size) in enumerate(zip(parts, sizes, strict=True)):
        if i > first and (part != parts[first] or held + size > STEP_BYTES):
            yield first, i
            first, held = i, 0
        held += size
    if parts:
        yield first, len(parts)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards (part, seq, first_id, n_docs, n_tokens, shard) below ``folder``.

    A part is one range of ids. Several ranges go to one task and its file, as every file costs its executor processes that
    are charged with all its memory while they start; a shard never crosses ranges, which need not be neighbours.
    """
    spark = docs.sparkSession
    python_batches(spark)
    keyed = docs.select(id_key().alias("id"), utf8().alias("t"), F.xxhash64(utf8()).alias("h"))
    # Texts of one id are ordered among themselves, so one id may fill several ranges.
    ranges = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "t").select("id", "t", F.spark_partition_id().alias("part"))
    rows = ranges.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // RANGES_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, seq = -1, 0
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            sizes = np.concatenate(counts)
            data = build_shard(np.concatenate(ids), np.array(doc_ids, np.int64), sizes, 16)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "first_id": [doc_ids[0]], "n_docs": [len(doc_ids)], "n_tokens": [int(sizes.sum())], "shard": [data]}, schema=_SHARD_ARROW,
            )

        for b in batches:
            keys, texts, parts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for i, z in _steps(parts.tolist(), list(map(len, texts))):
                if parts[i] != part:
                    if doc_ids:
                        yield shard()
                    part, seq, held, doc_ids, ids, counts = int(parts[i]), 0, 0, [], [], []
                got, sizes = encoder.encode(texts[i:z], end_id)
                ends, at = np.cumsum(sizes), 0
                while i < z:
                    # A shard ends with the document that fills it.
                    n = min(int(np.searchsorted(ends, at + shard_tokens - held)) + 1, len(ends))
                    ids.append(got[at : ends[n - 1]])
                    counts.append(sizes[:n])
                    doc_ids += keys[i : i + n]
                    held += int(ends[n - 1]) - at
                    at, i, sizes, ends = int(ends[n - 1]), i + n, sizes[n:], ends[n:]
                    if held >= shard_tokens:
                        yield shard()
                        seq, held, doc_ids, ids, counts = seq + 1, 0, [], [], []
        if doc_ids:
            yield shard()

    rows.mapInArrow(work, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(folder)


SHARD_SCHEMA = "part int, seq int, first_id long, n_docs long, n_tokens long, shard binary"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary())])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    sizes = shards.select("part", "seq", "first_id", "n_tokens")
    parts = sizes.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_tokens").alias("all"))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of ids
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    schema = "part int, seq int, id long, at long, n_tokens long, ids_crc32 long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column(0), b.column(1), b.column(2)):
                shard = WaveletShard(data.as_py())
                ids, counts = shard.ids(), shard.counts.astype(np.int64)
                at = np.cumsum(counts) - counts
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a : a + c]) for a, c in zip(at.tolist(), counts.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), pa.array(shard.doc_ids), pa.array(at), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "id", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "seq", "shard").mapInArrow(work, schema)
    start = F.col("part_start") + F.col("shard_start") + F.col("at")
    return docs.join(starts, ["part", "seq"]).select(id_back("id").alias("doc_id"), start.cast("long").alias("start"), "n_tokens", "ids_crc32")


def corpus_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` to ``folder`` (a new one in the shared folder by default) and read them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-shards")
    write_shards(docs, tokenizer, folder, shard_tokens)
    return read_documents(spark, folder)
