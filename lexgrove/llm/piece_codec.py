"""Exact BPE encoding of SentencePiece models by backtracking, and decoding.

A merge-type encoding is the only sequence of tokens in which every two neighbours are compatible: merging their
joined text again gives the same two tokens. Each unit (a word with the space marks before it) is encoded by
trying the longest token at each place, found by one Aho-Corasick pass, and shorter ones where a neighbour is not
compatible; a bitfield marks places from which no encoding goes on. Where the longest matches, one after another, cover
the unit and are all compatible, they are its encoding and nothing has to be taken back. Two tokens are compatible if
no merge over their border comes before the merges that made them, which are taken back from the last one. Characters outside the vocabulary end a stretch
and become byte tokens. Runs of several space marks, whose merges have equal scores, are merged one by one.

Nulls: a null or empty text has no tokens and decodes to the empty text. Malformed UTF-8 is read with U+FFFD in place
of the bad bytes. Repeated rows come back as often as given.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import python_batches, utf8, worker_held

MARK = "▁"
# Units and token pairs whose result a worker keeps, in two generations: what is asked for again outlives the older one.
MEMO_ENTRIES = 300_000
MEMO_PAIRS = 400_000
TEXTS_AT_ONCE = 500
# Longer units are not kept.
MEMO_BYTES = 64
_UNITS = re.compile(rb" +[^ ]*")


class PieceCodec(dict):
    """Encoder and decoder; as a dict: unit without its first space mark (UTF-8, marks as spaces) -> ids as 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.id = {self.text[i]: i for i in range(n) if i not in special}
        self.score = {self.text[i]: sp.get_score(i) for i in self.id.values()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("pieces that go on after a space mark need whole texts")
        self.chars = {p for p in self.id if len(p) == 1}
        self.older: dict[bytes, bytes] = {}
        self.merged: dict[int, bool] = {}
        self.merged_before: dict[int, bool] = {}
        # The place of a token's last merge among all merges (0: a single character), and what it merged.
        self.order, self.left, self.right = [0] * n, [0] * n, [0] * n
        whole: list[int] = []
        for p, i in self.id.items():
            last: list[str] = []
            if self.merge(p, last) == [i]:
                whole.append(i)
                if last:
                    self.left[i], self.right[i] = self.id[last[0]], self.id[last[1]]
        # Equal scores, and parts merged after their whole, have no such order: these tokens are compared by merging.
        place = {score: k for k, score in enumerate(sorted(set(self.score.values()), reverse=True), 1)}
        shared = Counter(self.score[self.text[i]] for i in whole if self.left[i])
        self.place = {p: place[score] for p, score in self.score.items() if len(p) > 1}
        self.unordered: set[int] = set()
        for i in sorted(whole, key=lambda i: len(self.text[i])):
            if len(self.text[i]) > 1:
                a, b = self.left[i], self.right[i]
                self.order[i] = self.place[self.text[i]]
                if shared[self.score[self.text[i]]] > 1 or max(self.order[a], self.order[b]) >= self.order[i] or a in self.unordered or b in self.unordered:
                    self.unordered.add(i)
        self.length = [len(t) for t in self.text]
        self.tokens = ahocorasick.Automaton()
        for i in whole:
            self.tokens.add_word(self.text[i], i)
        self.tokens.make_automaton()
        kept = {self.text[i]: i for i in whole}
        # The longest shorter token that a token begins with.
        self.shorter = {i: next((kept[self.text[i][:k]] for k in range(self.length[i] - 1, 0, -1) if self.text[i][:k] in kept), None) for i in whole}
        self.decimal = [str(i).encode() for i in range(n)]
        self.piece = [t.replace(MARK, " ").encode() for t in self.text]
        for value, i in self.bytes.items():
            self.piece[i] = bytes([value])

    # -- merging

    def merge(self, text: str, last: list[str] | None = None) -> list[int]:
        """Ids of ``text`` by merging: best score first, then leftmost. All characters are in the vocabulary. ``last`` gets the parts of the last merge."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts):
                joined = parts[a] + parts[b]
                if joined in self.score:
                    heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or b >= len(parts) or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            if last is not None:
                last[:] = parts[a], parts[b]
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] < len(parts):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.id[p] for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        pair = a * self.size + b
        found = self.merged.get(pair)
        if found is None:
            found = self.merged_before.get(pair)
            if found is None:
                found = self.uncrossed(a, b)
            if len(self.merged) >= MEMO_PAIRS // 2:
                self.merged_before, self.merged = self.merged, {}
            self.merged[pair] = found
        return found

    def uncrossed(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` and ``b`` all come before any over their border; equal merges go from left to right."""
        if a in self.unordered or b in self.unordered:
            return self.merge(self.text[a] + self.text[b]) == [a, b]
        text, order, place = self.text, self.order, self.place
        latest = len(text) + 1
        while True:
            crossing = place.get(text[a] + text[b])
            if crossing is not None and crossing < latest:
                return False
            if order[a] > order[b]:
                latest, a = order[a], self.right[a]
            elif order[b]:
                latest, b = order[b] + 1, self.left[b]
            else:
                return True

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch of known characters without runs of space marks."""
        n, size, length, shorter, known = len(text), self.size, self.length, self.shorter, self.merged.get
        out: list[int] = []
        at = 0
        # The longest matches from left to right, as far as neighbours are compatible: often the whole text.
        for end, i in self.tokens.iter_long(text):
            if end + 1 - length[i] != at:
                break
            if out:
                fits = known(out[-1] * size + i)
                if not (self.compatible(out[-1], i) if fits is None else fits):
                    break
            out.append(i)
            at = end + 1
        if at == n:
            return out
        # Matches come by their ends: the last one of a place is the longest.
        longest = {end + 1 - length[i]: i for end, i in self.tokens.iter(text)}
        open_ = bytearray(b"\x01") * (n + 1)
        token = longest[at]
        while True:
            end = at + length[token]
            if open_[end]:
                fits = True
                if out:
                    fits = self.merged.get(out[-1] * size + token)
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    continue
            token = shorter[token]
            while token is None:
                open_[at] = 0
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def unit(self, text: str) -> list[int]:
        """Ids of one unit, space marks included."""
        if text[1:2] != MARK and self.chars.issuperset(text):
            return self.backtrack(text)
        out: list[int] = []
        merge = self.merge if text.startswith(MARK * 2) else None
        stretch = ""
        for c in [*text, None]:
            if c in self.chars:
                stretch += c
                continue
            if stretch:
                out += merge(stretch) if merge and stretch.startswith(MARK * 2) else self.backtrack(stretch)
                stretch = ""
            if c is not None:
                out += [self.bytes[b] for b in c.encode()]
        return out

    # -- texts

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def __missing__(self, unit: bytes) -> bytes:
        out = self.older.get(unit)
        if out is None:
            out = self.packed(self.unit(MARK + unit.decode().replace(" ", MARK)))
        if len(unit) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[unit] = out
        return out

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole UTF-8 text."""
        if not text:
            return np.empty(0, "<u2")
        text = text.replace(MARK.encode(), b" ")
        if b"  " in text or text[0] == 32 or text[-1] == 32:
            units = [u[1:] for u in _UNITS.findall(b" " + text)]
        else:
            units = text.split(b" ")
        return np.frombuffer(b"".join(map(self.__getitem__, units)), "<u2")

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of ``ids``, without the space that encoding puts before a text."""
        joined = b"".join(map(self.piece.__getitem__, ids))
        if ids and self.piece[ids[0]][:1] == b" " and ids[0] not in self.bytes.values():
            joined = joined[1:]
        return joined


def codec_of(path: str) -> PieceCodec:
    return worker_held("codec", path, lambda: PieceCodec(path))


def valid_utf8(text: bytes) -> bytes:
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def round_trip(docs: DataFrame, model: str, keep: list[Column], ids_out: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 of each text; with ``ids_out`` also ids and decoded."""
    python_batches(docs.sparkSession, TEXTS_AT_ONCE)
    base = docs.select(*keep, utf8().alias("_t"))
    names = base.columns[:-1]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    schema = f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids_out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for b in batches:
            counts, hashes, texts, all_ids, decoded = [], [], [], [], []
            for t in b.column(len(names)):
                own = codec.encode(valid_utf8(t.as_py()))
                ids = own.tolist()
                back = codec.decode(ids)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(b",".join(map(codec.decimal.__getitem__, ids))).hexdigest())
                texts.append(hashlib.sha256(back).hexdigest())
                if ids_out:
                    all_ids.append(own.astype(np.int32))
                    decoded.append(back.decode("utf-8", "replace"))
            arrays = [*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            if ids_out:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                values = np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)
                arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] * ids_out)])

    return base.mapInArrow(work, schema)
