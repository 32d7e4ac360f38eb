"""Near-duplicate detection over bottom-k sketches (operator 1).

Plan
  1. One Arrow pass turns each text into its set of 5-word shingle hashes and
     keeps the set's size n, a 128-bit fingerprint and its k smallest hashes (one
     hash function): the bottom-k sketch, with k = n - need + SHARED, where need is
     the least overlap a set of n can have with one it is linked to. Among the
     smallest hashes, a linked pair then shares SHARED retained values for certain
     (or need, if that is less): no link rests on chance.
  2. Rows with the same set collapse into a class. Links join classes, so it does
     not matter which doc_ids its rows have. Exact copies never meet again.
  3. Retained values of the classes form inverted lists. Because a linked pair
     shares so many, each class may leave out all but one of them: values are
     listed rarest first, common passages make no lists, and the rarest shared
     value is listed by both.
  4. Lists become groups of at most about ``2 * BLOCK`` classes: equal lists once,
     long lists cut in blocks by hash that meet pairwise, and only there: pairs
     within a block are its own group's. A pair belongs to the list of its
     smallest common listed value alone. In a group the union of the beginnings of
     two sketches, up to the smaller of their ends, shows how many elements each
     set has that the other lacks; a pair that shows too many is out. Only classes
     of pairs that stay get their full sets, which confirm. A group emits a spanning forest
     of its links, so output is linear in its classes.
  5. Star contraction gives the components.

Values, counts and lists are joined on tables of their own, so that a value that
very many classes hold is split over tasks.

Defined results: null or wordless texts have an empty set and stay alone; rows
with a null doc_id get a null component and kept = false; rows that repeat a
doc_id with another text are documents of their own, linked by their texts alone;
rows that repeat both have the same result. Very long texts are read whole. An
empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import components, drop_shuffles, may_match, ship, spread, staged, unstage
from .shingles import shingle_set

#: Retained values that a linked pair shares for certain, where its sets are as large.
SHARED = 32
BLOCK = 1536
BROADCAST_BYTES = 32 << 20
#: Of a class's retained and listed values, so many of the smallest go with it into its groups. With fewer a pair is ruled out
#: less often there, or found in more than one list; none is lost.
SHOWN, TOLD = 48, 16


def retained(n: int, percent: int) -> int:
    """How many of a set's ``n`` values its sketch holds."""
    need = -(-percent * n // 100)
    return n - need + min(SHARED, need)


def left_out(n: Column, percent: int) -> Column:
    """How many retained values a class of ``n`` need not list: one less than it shares with any class it is linked to."""
    need = lambda x: F.ceil(x * percent / F.lit(100))
    return F.least(F.lit(SHARED).cast("long"), need(need(n))) - 1


def _finger(s: np.ndarray) -> tuple[int, int, int]:
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))).view(np.int64)) if len(s) else 0


def _set_of(text: pa.Scalar) -> np.ndarray:
    return shingle_set(text.as_buffer().to_pybytes()) if text.is_valid else np.empty(0, np.uint64)


def sketch_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            marks, vals, offs = [], [], [0]
            for t in b.column("text"):
                s = _set_of(t)
                marks.append(_finger(s))
                vals.append(s[: retained(len(s), percent)])
                offs.append(offs[-1] + len(vals[-1]))
            flat = np.concatenate(vals) if vals else np.empty(0, np.uint64)
            row = part + at + np.arange(b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), b.column("doc_id"), b.column("t1"), b.column("t2"), *(pa.array([m[k] for m in marks], pa.int64()) for k in range(3)),
                 pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64)))],
                ["row", "doc_id", "t1", "t2", "n_shingles", "f1", "f2", "sketch"])

    return run


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            sets = [_set_of(t) for t in part.column("text")]
            marks, offs = [_finger(s) for s in sets], np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([m[k] for m in marks], pa.int64()) for k in range(3)), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                ["doc_id", "n_shingles", "f1", "f2", "shingles"])


#: Rows of a strip of a group's overlap matrix; a matrix is never held whole.
STRIP = 384


def _strips(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sizes of the intersections of STRIP sets with all) from incidence columns that two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = cnt[col] > 1
    owner, code = owner[keep], (np.cumsum(cnt > 1) - 1)[col[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(256, (1 << 21) // n)
    cuts = [(at, *np.searchsorted(code, (at, at + width))) for at in range(0, int(code[-1]) + 1 if len(code) else 0, width)]
    for i in range(0, n, STRIP):
        out = np.zeros((min(STRIP, n - i), n), np.float32)
        for at, a, b in cuts:
            x = np.zeros((n, width), np.float32)
            x[owner[a:b], code[a:b] - at] = 1
            out += x[i : i + STRIP] @ x.T
        yield i, out


def candidates(v: int, n: np.ndarray, low: list[np.ndarray], listed: list[np.ndarray], block: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the classes in any pair that list ``v`` has to verify.

    ``low``: beginnings of sketches; ``listed``: values that are listed; ``block``: of two
    blocks that meet, only pairs across count. A pair belongs to the list of its smallest
    common listed value alone, and stays if the union of the sketches does not rule it out.
    """
    used = np.zeros(len(n), bool)
    if len(n) == 2:
        least = -(-percent * int(n.sum()) // (100 + percent))
        if n.min() < least or (len(np.intersect1d(*listed, assume_unique=True)) > 1 and np.intersect1d(*listed, assume_unique=True).view(np.int64).min() < v):
            return np.empty(0, np.int64)
        a, b = low
        end = min(s[-1] if len(s) < k else np.uint64(np.iinfo(np.uint64).max) for s, k in zip(low, n, strict=True))
        both = len(np.intersect1d(a, b, assume_unique=True))
        seen = [int(np.searchsorted(s, end, "right")) for s in low]
        return np.arange(2) if all(x - both <= k - least for x, k in zip(seen, n, strict=True)) else np.empty(0, np.int64)
    smaller = [s[s.view(np.int64) < v] for s in listed]
    # up to its end a sketch holds all of its set
    end = np.array([s[-1] if len(s) < k else np.iinfo(np.uint64).max for s, k in zip(low, n, strict=True)], np.uint64)
    place, across = np.arange(len(n)), block.min() != block.max()
    for (i, both), (_, before) in zip(_strips(low), _strips(smaller), strict=True):
        r = slice(i, i + len(both))
        maybe = (before == 0) & (place[None, :] > place[r, None])
        if across:
            maybe &= block[r, None] != block[None, :]
        # the least overlap of a link; what the sketches show of one set beyond it must not exceed what it leaves
        least = -(-percent * (n[r, None] + n[None, :]) // (100 + percent))
        maybe &= (n[r, None] >= least) & (n[None, :] >= least)
        mine = np.array([np.searchsorted(s, end, "right") for s in low[r]])
        theirs = np.array([np.searchsorted(s, end[r], "right") for s in low]).T
        maybe &= (mine - both <= n[r, None] - least) & (theirs - both <= n[None, :] - least)
        used[r] |= maybe.any(1)
        used |= maybe.any(0)
    return np.flatnonzero(used)


def links(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least ``percent`` / 100, on full sets; of two blocks, of pairs across."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        if 100 * min(n) < percent * max(n):
            return []
        i = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * i >= percent * (n.sum() - i) else []
    root, across = np.arange(len(sets)), block.min() != block.max()
    out = []
    for i, strip in _strips(sets):
        inter = np.rint(strip).astype(np.int64)
        ok = 100 * inter >= percent * (n[i : i + len(strip), None] + n[None, :] - inter)
        if across:
            ok &= block[i : i + len(strip), None] != block[None, :]
        for a, b in zip(*np.nonzero(ok), strict=True):
            a += i
            ra, rb = root[a], root[b]
            if b > a and ra != rb:
                root[root == rb] = ra
                out.append((int(ids[a]), int(ids[b])))
    return out


def _by_group(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[tuple | None]:
    """(gid, rows of the other columns) of each group of batches sorted by gid and class; None after each batch."""
    gid, rows = None, []
    for b in batches:
        g, d = b.column("gid").to_numpy(zero_copy_only=False), b.column("cls").to_numpy()
        parts = [(b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy().view(np.uint64)) for c in lists]
        more = [b.column(c).to_numpy() for c in b.schema.names if c not in ("gid", "cls", *lists)]
        for i in range(b.num_rows):
            if g[i] != gid:
                if len(rows) > 1:
                    yield gid, list(zip(*rows, strict=True))
                gid, rows = g[i], []
            if not rows or rows[-1][0] != d[i]:
                rows.append((d[i], *(flat[off[i] : off[i + 1]].copy() for off, flat in parts), *(m[i] for m in more)))
        yield None
    if len(rows) > 1:
        yield gid, list(zip(*rows, strict=True))
    yield None


def _filter_groups(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for got in _by_group(batches, "sketch", "vs"):
            if got is None:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], ["gid", "cls", "block"])
                out = []
                continue
            gid, (cls, low, listed, v, n, block) = got
            used = candidates(int(v[0]), np.array(n, np.int64), low, listed, np.array(block), percent)
            out += [(gid, cls[i], block[i]) for i in used]

    return run


def _group_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for got in _by_group(batches, "shingles"):
            if got is None:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
                out = []
                continue
            cls, sets, block = got[1]
            out += links(np.array(cls), sets, np.array(block), percent)

    return run


_CLASS = ("n_shingles", "f1", "f2")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and 128 bits that stand for the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, class and component_id of every row of ``_texts``."""
    ship(docs.sparkSession)
    base = staged(spread(docs).mapInArrow(sketch_batches(percent), "row long, doc_id long, t1 long, t2 long, n_shingles long, f1 long, f2 long, sketch array<long>"), "sketches")
    one = base.where("doc_id is not null and n_shingles > 0")
    # a class is named by one of its rows, that with the smallest doc_id; sketches stay where they are if the names, a bit a row, fit in a broadcast
    first = one.groupBy(*_CLASS).agg(F.min(F.struct("doc_id", "row")).alias("r")).select("r.row")
    names = staged(first.groupBy(F.shiftright("row", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 63 as int)))").alias("bits")), "names")
    few = names.count() * 16 <= BROADCAST_BYTES
    named_by = (one.withColumn("word", F.shiftright("row", 6)).join(F.broadcast(names) if few else names.hint("merge"), "word")
                .where("shiftrightunsigned(bits, cast(row & 63 as int)) & 1 = 1"))
    reps = staged(named_by.select(F.col("row").alias("cls"), "doc_id", *_CLASS, "sketch"), "classes")
    # sketches are dropped from disk as soon as no later step reads them
    out = staged(base.drop("sketch"), "rows")
    named = staged(reps.drop("sketch"), "named")
    unstage(base, names)
    entries = reps.select("cls", "n_shingles", F.explode("sketch").alias("v"))
    shared = staged(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    drop_shuffles(docs.sparkSession)
    # rarest first; values that one class alone holds come before all others and need no list
    # written, so that shuffles by value and by class do not lie on disk at once
    common = staged(entries.join(shared, "v").select("cls", "n_shingles", "df", "v"), "common")
    unstage(shared)
    drop_shuffles(docs.sparkSession)
    listed = (common.groupBy("cls", "n_shingles")
              .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
              .withColumn("left", F.size("vs") - left_out(F.col("n_shingles"), percent))
              .where("left > 0")
              .select("cls", "n_shingles", F.transform(F.slice("vs", F.lit(1), F.col("left").cast("int")), lambda e: e["v"]).alias("vs")))
    listed = staged(listed, "lists")
    unstage(common)
    drop_shuffles(docs.sparkSession)
    # no more than the beginnings of sketches travels
    shown = may_match(reps.select("cls", F.slice("sketch", 1, SHOWN).alias("sketch")), listed, "cls")
    marked = staged(shown.join(listed.select("cls", "n_shingles", F.slice(F.array_sort("vs"), 1, TOLD).alias("vs")), "cls").select("cls", "n_shingles", "sketch", "vs"), "marked")
    unstage(reps)
    drop_shuffles(docs.sparkSession)
    lists = listed.select("cls", "n_shingles", F.explode("vs").alias("v"))
    counts = staged(lists.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int")), "counts")
    # in a list, a class whose set is not nearly as large as that of any other has nobody to meet
    n_at = lambda i: F.get(F.col("ids"), i)["n_shingles"]
    near = lambda a, b: F.coalesce(100 * a >= percent * b, F.lit(False))
    meets = F.filter("ids", lambda x, i: near(n_at(i - 1), x["n_shingles"]) | near(x["n_shingles"], n_at(i + 1)))
    short = (lists.join(counts.where("parts = 1").select("v"), "v").groupBy("v").agg(F.sort_array(F.collect_set(F.struct("n_shingles", "cls"))).alias("ids"))
             .select("v", meets.alias("ids")).where("size(ids) > 1").groupBy("ids").agg(F.min("v").alias("v"))
             .select(F.concat_ws(":", "v", F.lit("a")).alias("gid"), "v", F.explode("ids.cls").alias("cls"), F.lit(0).alias("block")))
    # long lists: blocks by hash, each of which meets each
    long = (lists.join(counts.where("parts > 1"), "v")
            .select("v", "cls", F.pmod(F.xxhash64("cls"), F.col("parts").cast("long")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
            .select(F.concat_ws(":", "v", F.least("block", "o"), F.greatest("block", "o")).alias("gid"), "v", "cls", "block"))
    groups = (short.unionByName(long).join(marked, "cls").select("gid", "cls", "v", "n_shingles", "block", "sketch", "vs")
              .repartition("gid").sortWithinPartitions("gid", "cls"))
    groups = staged(groups.mapInArrow(_filter_groups(percent), "gid string, cls long, block int"), "groups")
    unstage(listed, marked, counts)
    drop_shuffles(docs.sparkSession)
    need = staged(groups.select("cls").distinct().join(named, "cls"), "wanted")
    sets = (may_match(docs.where("doc_id is not null").select("doc_id", "text"), need, "doc_id").join(need.select("doc_id").distinct(), "doc_id", "left_semi")
            .mapInArrow(set_batches, "doc_id long, n_shingles long, f1 long, f2 long, shingles array<long>").join(need, ["doc_id", *_CLASS]).select("cls", "shingles"))
    # sets travel once where the list of who meets whom is small enough to go to them
    met = F.broadcast(groups) if groups.count() * 64 <= BROADCAST_BYTES else groups
    edges = (sets.join(met, "cls").select("gid", "cls", "block", "shingles").repartition("gid")
             .sortWithinPartitions("gid", "cls").mapInArrow(_group_links(percent), "a long, b long"))
    comp = components(edges)  # without the smallest node of each
    comp = staged(comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct()), "components")
    unstage(groups, need)
    least = comp.join(named.select(F.col("cls").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    classes = (named.join(comp.join(least, "component").select(F.col("node").alias("cls"), "component", "smallest"), "cls", "left")
               .select(*_CLASS, F.coalesce("component", "cls").alias("component"), F.coalesce("smallest", "doc_id").alias("component_id")))
    alone = out.where("doc_id is null or n_shingles = 0").select("doc_id", "t1", "t2", "n_shingles", F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
    return (out.where("doc_id is not null and n_shingles > 0").join(classes, list(_CLASS))
            .select("doc_id", "t1", "t2", "n_shingles", "component", "component_id").unionByName(alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return (_linked(_texts(docs, id_col, text_col), percent)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of each group of near-duplicates one row with its
    smallest doc_id. Rows without a doc_id all stay; of wordless rows those that repeat doc_id and text stay once."""
    linked = _linked(_texts(docs, "doc_id", "text"), percent).where("doc_id is not null and doc_id = component_id")
    stay = staged(linked.groupBy("component").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("s"), F.count("*").alias("k"))
                  .groupBy("s").agg(F.sum("k").alias("k")).select(*(F.col(f"s.{c}").alias(f"__{c}") for c in ("doc_id", "t1", "t2")), F.col("k").alias("__k")), "kept")
    keys = ["__doc_id", "__t1", "__t2"]
    text = F.col("text").cast("string")
    found = docs.select("*", F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")).join(stay, keys)
    # only rows that may repeat are dealt out to be compared
    return (found.where("__k = 1").select(docs.columns).unionByName(found.where("__k > 1").dropDuplicates(keys).select(docs.columns))
            .unionByName(docs.where("doc_id is null")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
