"""URL filter over a sorted digest array.

A list of keys (``host/path`` prefixes) becomes files of sorted 64-bit xxhash digests with the full strings beside them,
cut by digest range. Tasks memory-map the files, probe them with one vectorised binary search per batch, and compare the
stored string of every digest found, so that a collision never decides.

A key fits the host it names and all its subdomains, if the path begins with the key's path. Probes of a URL are every
suffix of its host with every prefix of its path up to a ``/``; a key path must therefore end with ``/``. Among
rules the longest key wins; where no rule fits, the URL is blocked if any listed key fits, else allowed.

Nulls and strings without ``://`` have empty host and path; they are allowed. Keys are compared in UTF-8. An empty list
or table gives files without keys or an empty result. Repeated keys: block wins over allow, a rule over a listing.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import python_batches, scratch

MAGIC = b"DIGEST01"
ALLOW, BLOCK, LISTED = 0, 1, 2
VERDICTS = {ALLOW: "allow", BLOCK: "block", LISTED: "block"}
# Keys in one file: 8 bytes of digest, 9 of place and kind, and the string each.
FILE_KEYS = 4_000_000
# The seed of Spark's xxhash64, which deals keys out to files.
SEED = 42


def write_digest_file(path: str, keys: list[str], kinds: list[int]) -> None:
    """One file: magic, count, sorted digests, string offsets, kinds, strings. Written aside and renamed."""
    raw = [k.encode() for k in keys]
    digests = np.array([xxhash.xxh64_intdigest(k, SEED) for k in raw], np.uint64)
    order = np.lexsort((np.array(kinds, np.uint8), digests)) if raw else np.empty(0, np.int64)
    offsets = np.zeros(len(raw) + 1, np.uint64)
    offsets[1:] = np.cumsum([len(raw[i]) for i in order])
    system, place = fs.FileSystem.from_uri(path)
    aside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(MAGIC + struct.pack("<Q", len(raw)))
        out.write(digests[order].tobytes())
        out.write(offsets.tobytes())
        out.write(np.array(kinds, np.uint8)[order].tobytes())
        out.write(b"".join(raw[i] for i in order))
    system.move(aside, place)


class DigestFile:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        if not isinstance(system, fs.LocalFileSystem):
            local = os.path.join(tempfile.mkdtemp(), "digests")
            with system.open_input_stream(place) as src, open(local, "wb") as dst:
                while chunk := src.read(1 << 22):
                    dst.write(chunk)
            place = local
        data = np.memmap(place, np.uint8, "r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is not a digest file")
        n = int(data[8:16].view("<u8")[0])
        self.digests = data[16 : 16 + 8 * n].view("<u8")
        self.offsets = data[16 + 8 * n : 24 + 16 * n].view("<u8")
        self.kinds = data[24 + 16 * n : 24 + 17 * n]
        self.strings = data[24 + 17 * n :]
        #: Bytes of the longest key; no longer string needs to be looked up.
        self.longest = int(np.diff(self.offsets).max()) if n else 0

    def probe(self, digests: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Kind of each key, -1 where it is not listed: LISTED, or the strictest rule of equal keys."""
        found = np.full(len(keys), -1, np.int8)
        at = np.searchsorted(self.digests, digests)
        end = len(self.digests)
        hit = np.flatnonzero((at < end) & (np.asarray(self.digests[np.minimum(at, max(end - 1, 0))]) == digests)) if end else []
        for i in hit:
            p = int(at[i])
            while p < end and self.digests[p] == digests[i]:
                if self.strings[int(self.offsets[p]) : int(self.offsets[p + 1])].tobytes() == keys[i]:
                    kind = int(self.kinds[p])
                    if found[i] < 0 or found[i] == LISTED or kind == BLOCK:
                        found[i] = kind if kind != LISTED or found[i] < 0 else found[i]
                p += 1
        return found


@lru_cache(maxsize=64)
def _opened(path: str) -> DigestFile:
    return DigestFile(path)


def build_digests(keys: DataFrame, folder: str | None = None, file_keys: int = FILE_KEYS) -> list[str]:
    """Write the (key, kind) rows as digest files in a shared folder; returns their paths in digest order."""
    spark = keys.sparkSession
    folder = folder or scratch(spark, "digests")
    system, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(place)
    base = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    rows = keys.where("key is not null").select(F.col("key").cast("string").alias("key"), F.col("kind").cast("int").alias("kind")).distinct()
    files = max(1, -(-rows.count() // file_keys))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"{base}/{int(pdf['part'].iloc[0]):06d}.digests"
        write_digest_file(path, pdf["key"].tolist(), pdf["kind"].tolist())
        return pd.DataFrame({"path": [path]})

    # The top bits of the unsigned digest pick the file, so files are in digest order.
    digest = F.xxhash64("key")
    part = F.floor(F.shiftrightunsigned(digest, 33) * F.lit(files) / F.lit(1 << 31)).cast("int")
    made = rows.withColumn("part", part).groupBy("part").applyInPandas(work, "path string").collect()
    return sorted(r.path for r in made)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty without one."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].translate(_LOWER)
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def probes(host: str, path: str, most: int) -> list[str]:
    """Every host suffix with every path prefix that ends with ``/``, as far as a key of at most ``most`` bytes can be equal to it."""
    names, at = [host] if len(host) <= most else [], host.rfind(".")
    while at >= 0 and len(host) - at - 1 <= most:
        names.append(host[at + 1 :])
        at = host.rfind(".", 0, at)
    heads, at = [], path.find("/", 0, most)
    while at >= 0:
        heads.append(path[: at + 1])
        at = path.find("/", at + 1, most)
    return [n + h for n in names for h in heads if len(n) + len(h) <= most]


def judge_urls(pages: DataFrame, files: list[str], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict and the listed key that fits, if any."""
    python_batches(pages.sparkSession, 10_000)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max((_opened(f).longest for f in files), default=0)
        for pdf in batches:
            parts = [split_url(u) for u in pdf["_url"]]
            tried: list[str] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(parts):
                own = probes(host, path, most)
                tried += own
                owner += [i] * len(own)
            raw = [t.encode() for t in tried]
            digests = np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(SEED)), np.uint64, len(raw))
            kinds = np.full(len(raw), -1, np.int8)
            for f in files:
                got = _opened(f).probe(digests, raw)
                kinds = np.where(got >= 0, got, kinds)
            rule: list[str | None] = [None] * len(parts)
            listed: list[str | None] = [None] * len(parts)
            verdict = ["allow"] * len(parts)
            for j in np.flatnonzero(kinds >= 0):
                i, best = owner[j], rule if kinds[j] != LISTED else listed
                if best[i] is None or len(tried[j]) > len(best[i]):
                    best[i] = tried[j]
                    if best is rule:
                        verdict[i] = VERDICTS[int(kinds[j])]
            for i in range(len(parts)):
                if rule[i] is None and listed[i] is not None:
                    verdict[i] = "block"
            out = pdf.drop(columns="_url")
            yield out.assign(host=[p[0] for p in parts], path=[p[1] for p in parts], rule=rule, verdict=verdict, listed=listed)

    base = pages.select(*keep, F.col(url).cast("string").alias("_url"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_url")
    return base.mapInPandas(work, f"{kept}, host string, path string, rule string, verdict string, listed string")
