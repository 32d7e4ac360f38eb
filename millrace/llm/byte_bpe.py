"""Byte-level BPE encoding and decoding by a rank file (operator 7), in two tiers.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: a
key's bucket names the displacement that sends its keys to free slots); a
pre-token that is itself in the vocabulary is one id. Tier two merges the
remaining pre-tokens with a heap of neighbouring pairs over doubly linked bytes,
O(n log n) in the pre-token's length. Results of both are kept by pre-token in
a bounded memo per worker.

Defined results: null text counts as empty: no ids, digests of nothing. Rows
that repeat a doc_id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, spread

#: Pre-tokens that a worker remembers; it starts afresh when they are reached.
MEMO = 1 << 19
_LONGEST_KEPT = 64
_GONE = -1


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys to 0..n-1, with a check of the key itself."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.slot_of: list[int] = [0] * n
        found: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, (b, _) in enumerate(hashes):
            found[b].append(i)
        free = np.ones(n, bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(found[b])):
            if len(found[b]) < 2:
                break
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in found[b]]
                if len(set(at)) == len(at) and free[at].all():
                    break
                d += 1
            self.shift[b] = d
            free[at] = False
            for i, s in zip(found[b], at, strict=True):
                self._put(keys, i, s)
        # a bucket of one key names a free slot itself
        rest = iter(np.flatnonzero(free).tolist())
        for b in range(self.buckets):
            if len(found[b]) == 1:
                s = next(rest)
                self.shift[b] = -1 - s
                self._put(keys, found[b][0], s)

    def _put(self, keys: list[bytes], i: int, s: int) -> None:
        self.keys[s] = keys[i]
        self.slot_of[i] = s

    def _hash(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.buckets, h & 0xFFFFFFFFFFFFFFFF

    def _slot(self, h: tuple[int, int], d: int) -> int:
        return ((h[1] ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 32 & 0xFFFFFFFF) % self.n if d >= 0 else -1 - d

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.n:
            return -1
        h = self._hash(key)
        s = self._slot(h, self.shift[h[0]])
        return s if self.keys[s] == key else -1


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.ids = [0] * len(keys)
        for k, s in zip(keys, self.hash.slot_of, strict=True):
            self.ids[s] = ranks[k]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte_id = [ranks[bytes([c])] for c in range(256)]
        # ids of two parts that make a token: the token's id, which is its rank
        self.pairs = {ranks[k[:i]] << 20 | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self)

    def rank(self, piece: bytes) -> int:
        s = self.hash.find(piece)
        return -1 if s < 0 else self.ids[s]

    def pre_token(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over linked parts."""
        n, pair, push = len(piece), self.pairs.get, heapq.heappush
        ids = [self.byte_id[c] for c in piece]
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << 32 | i for i, r in enumerate(map(pair, [a << 20 | b for a, b in zip(ids, ids[1:])])) if r is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = nxt[i]
            if j >= n or pair(ids[i] << 20 | ids[j]) != r:  # one of the two has been merged meanwhile
                continue
            ids[i], ids[j], k, p = r, _GONE, nxt[j], prev[i]
            nxt[i] = k
            if k < n:
                prev[k] = i
                if (s := pair(r << 20 | ids[k])) is not None:
                    push(heap, s << 32 | i)
            if p >= 0 and (s := pair(ids[p] << 20 | r)) is not None:
                push(heap, s << 32 | p)
        return [i for i in ids if i != _GONE]

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.pre_token(word.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def load(ranks_path: str, pattern: str) -> ByteBPE:
    if (ranks_path, pattern) not in _LOADED:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[ranks_path, pattern] = ByteBPE(ranks, pattern)
    return _LOADED[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    return _run(docs, ranks_path, pattern, id_col, text_col, "doc_id long, ids array<long>", lambda bpe, raw: (np.frombuffer(raw, "<u4").astype(np.int64),))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the digest of the ids decoded again."""
    return _run(docs, ranks_path, pattern, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                lambda bpe, raw: (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(raw)).hexdigest()))


def _run(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    ship(docs.sparkSession)
    width = schema.count(",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [row(bpe, bpe.encode(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows]) for k in range(width))], [x.split()[0] for x in schema.split(", ")])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
