"""Sequence packing by the length histogram (operator 6): shortest-pack-first.

Plan
  1. One Arrow pass encodes each whole text, appends the end id, cuts full
     pieces of ``SIZE`` ids and keeps only digests and the tail's length.
  2. The histogram of tail lengths, at most ``SIZE - 1`` numbers, goes to the
     driver. Lengths are placed longest first, each into the open pattern with
     the most room (the shortest pack); patterns carry counts, so the work
     depends on the number of distinct lengths, not of documents.
  3. Tails get a rank within their length, counted in two steps over salted
     keys, so that one very common length is no hot task. A broadcast table of
     pattern slots, bounded by the histogram, turns (length, rank) into
     (sequence, offset).

Defined results: null text counts as empty, one end id; rows that repeat a
doc_id, or have none, are packed as rows of their own; an empty table gives none.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ship, spread, staged

SIZE = 1024
END_ID = 0
SALTS = 64

_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """The rank file's byte-level BPE; same vocabulary, so same ids, as its JSON form."""
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_path]


def plain_encoder(json_path: str):
    """Ids by ``tokenizers`` from the JSON at its defaults, add_special_tokens=False: an added token that a text spells out is one id.

    Texts without one take the rank file beside the JSON, which has the same merges and is faster."""
    if json_path not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[json_path] = Tokenizer.from_file(json_path)
    whole, fast = _ENCODERS[json_path], encoder(json_path.removesuffix(".json") + ".tiktoken").encode_ordinary
    added = [a.content for a in whole.get_added_tokens_decoder().values()]
    return lambda text: whole.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else fast(text)


def _cut(json_path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = plain_encoder(json_path)
        part, at, full_before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                text = text or ""
                ids = np.append(np.asarray(encode(text), "<u4"), np.array([END_ID], "<u4"))
                n, tail = len(ids), len(ids) % size
                raw, cut = ids.tobytes(), 4 * size
                full = [zlib.crc32(raw[k * cut : (k + 1) * cut]) for k in range(n // size)]
                for c, v in zip(cols, (part, at, n, full, full_before, tail, zlib.crc32(raw[len(raw) - 4 * tail :]) if tail else 0), strict=True):
                    c.append(v)
                at += 1
                full_before += len(full)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["doc_id", "part", "at", "doc_tokens", "full", "full_before", "tail", "tail_crc"])

    return run


def pack_histogram(hist: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold each length as often as ``hist`` says, none longer than ``size``."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(hist, reverse=True):
        left = hist[length]
        taken: list[tuple[int, int, tuple[int, ...]]] = []
        while left:
            most = max(room, default=-1)
            if most < length:
                taken.append((size - length, left, (length,)))
                break
            count, lengths = room[most].pop()
            if not room[most]:
                del room[most]
            # as many of this length in one pack as fit and as are needed
            each = max(1, min(most // length, left // count))
            use = min(count, left // each)
            if use < count:
                room.setdefault(most, []).append((count - use, lengths))
            taken.append((most - each * length, use, lengths + (length,) * each))
            left -= each * use
        for space, count, lengths in taken:
            room.setdefault(space, []).append((count, lengths))
    return [p for space in sorted(room) for p in room[space]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, end rank, first sequence, offset)``; ranks and sequences count from 0."""
    out, used, seq = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, rank + count, seq, offset))
            used[length] = rank + count
            offset += length
        seq += count
    return out


def pack(docs: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = staged(spread(docs).mapInArrow(_cut(json_path, size), "doc_id long, part int, at long, doc_tokens long, full array<long>, full_before long, tail int, tail_crc long"), "pieces")
    # full pieces are sequences of their own, numbered through the partitions
    parts = cut.groupBy("part").agg(F.sum(F.size("full")).alias("n"))
    base = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    n_full = cut.agg(F.coalesce(F.sum(F.size("full")), F.lit(0))).first()[0]
    full = (cut.where(F.size("full") > 0).join(base, "part")
            .select("doc_id", "doc_tokens", (F.col("base") + F.col("full_before")).alias("seq"), F.posexplode("full").alias("k", "ids_crc32"))
            .select("doc_id", (F.col("k").cast("long") * size).alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens",
                    (F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    tails = cut.where("tail > 0").select("doc_id", "doc_tokens", "tail", "tail_crc", "part", "at", F.pmod(F.xxhash64("part", "at"), F.lit(SALTS)).alias("salt"))
    by_salt = tails.groupBy("tail", "salt").agg(F.count("*").alias("n"))
    first = by_salt.select("tail", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    hist = {r["tail"]: r["n"] for r in by_salt.groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # at most size - 1 rows
    table = spark.createDataFrame(slots(pack_histogram(hist, size)), "tail int, lo long, hi long, seq long, off long")
    table = table.groupBy("tail").agg(F.collect_list(F.struct("lo", "hi", "seq", "off")).alias("slots"))
    ranked = (tails.withColumn("r", F.row_number().over(Window.partitionBy("tail", "salt").orderBy("part", "at")) - 1)
              .join(F.broadcast(first), ["tail", "salt"])  # at most SALTS * (size - 1) rows
              .withColumn("rank", F.col("r") + F.col("first"))
              .join(F.broadcast(table), "tail")
              .withColumn("s", F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]))
    tail = ranked.select("doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").cast("long").alias("length"), F.col("tail_crc").alias("ids_crc32"),
                         "doc_tokens", (F.lit(n_full) + F.col("s.seq") + F.col("rank") - F.col("s.lo")).alias("sequence_id"), F.col("s.off").alias("offset"))
    return full.unionByName(tail)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
