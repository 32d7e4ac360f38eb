"""Exact top-k search by a two-sided Voronoi kNN join on inner products (operator 2).

Plan
  1. Components become floor(SCALE * x). Rows chosen by a hash of the vector are the
     pivots (a bounded sample; they only steer the work), about half the root of the
     number of rows and at most PIVOTS.
  2. Data and queries join the group of their nearest pivot. A data group's summary:
     rows, largest distance r from its pivot p, largest norm, and the K + 1 rows of
     largest norm. A query group's: the same distance, R.
  3. Bounds. For x of a data group, q.x <= min(q.p + |q| r, |q| max |x|). Summary
     rows give each query K scores that its answer reaches at least; the least of
     them over a query group and the group's bound, p.p' + |p'| r + R (|p| + r), rule
     out data groups for all of its queries at once, the query's own for it.
  4. Every data row is sent once: to a block of its group, cut by a hash of the row,
     so neither a large group nor a common vector is one task. Queries are
     replicated, to the blocks of the groups that they cannot rule out. Where more
     than QUERIES ask for a group, its blocks are cut by query, too.
  5. A block scores its queries by a matrix product and keeps K per query; the K
     best over blocks are the answer.

Sums stay exact: products are summed in float64 where 2**53 bounds them, else
as Python integers.

Defined results: null vectors, and vectors with a null, non-finite or no
component, take no part, nor do rows without an id; other lengths than the
query's never meet (they have no inner product). Repeated rows are rows of their
own, as data and as queries, so a query id that repeats has K answers for each of
its rows; a query skips every row with its own id. Ties go to the smaller id, rows
that tie in both are all there. An empty table, or one without queries, gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ship, staged, unstage

SCALE = 1024
PIVOTS = 256
K = 10
#: Data rows of one block of a group, about, and most queries of one.
BLOCK = 8192
QUERIES = 16384
_EXACT = 2.0**53


def _vectors(col: pa.ListArray, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel()).cast(kind))


def _nearest(pivots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its nearest pivot and the distance."""
    near = ((pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)).argmin(1)
    return near.astype(np.int32), np.sqrt(((x - pivots[near]) ** 2).sum(1))


def _assign(pivots: np.ndarray, kind: pa.DataType):
    """Data rows with their group, distance and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _vectors(part.column("v"), pivots.shape[1])
                near, dist = _nearest(pivots, x)
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(x, kind), pa.array(near), pa.array(dist), pa.array(np.sqrt((x**2).sum(1)))], ["id", "v", "grp", "dist", "norm"])

    return run


def _above(x: np.ndarray) -> np.ndarray:
    """Bounds, a little wider than rounding could make them."""
    return x + np.abs(x) * 1e-9 + 1e-6


def _ask(pivots: np.ndarray, radius: np.ndarray, norms: np.ndarray, top: np.ndarray, top_ids: np.ndarray, k: int, kind: pa.DataType):
    """Queries with the data groups that they cannot rule out. ``radius``, ``norms``: of each data group, -1 where it has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        there, size = radius >= 0, np.sqrt((pivots**2).sum(1))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                q, ids = _vectors(part.column("v"), pivots.shape[1]), part.column("id").to_numpy()
                near, dist = _nearest(pivots, q)
                sure = q @ top.T
                sure[ids[:, None] == top_ids[None, :]] = -np.inf
                sure = np.partition(sure, -k, axis=1)[:, -k] if len(top) >= k else np.full(len(q), -np.inf)
                sure -= np.abs(np.where(np.isfinite(sure), sure, 0)) * 1e-9 + 1e-6
                own = np.zeros((len(q), len(pivots)), bool)
                for g in np.unique(near):
                    of = np.flatnonzero(near == g)
                    # groups that no query of this one can need
                    far = dist[of].max()
                    some = there & (_above(np.minimum(pivots @ pivots[g] + size[g] * radius + far * (size + radius), (size[g] + far) * norms)) >= sure[of].min())
                    n = np.sqrt((q[of] ** 2).sum(1))[:, None]
                    own[np.ix_(of, some)] = _above(np.minimum(q[of] @ pivots[some].T + n * radius[some], n * norms[some])) >= sure[of][:, None]
                r, g = np.nonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(q))), part.column("id"), _lists(q, kind), pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(q) + 1)), pa.int32()), pa.array(g.astype(np.int32)))], ["row", "id", "v", "grps"])
                row += len(q)

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < _EXACT:
        return q @ x.T
    return np.array([[int(a) for a in r] for r in q], object) @ np.array([[int(a) for a in r] for r in x], object).T


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, and of all that tie with the last of them, highest first."""
    if row.dtype == object or len(row) <= k:
        return np.argsort(-row, kind="stable")
    at = np.flatnonzero(row >= -np.partition(-row, k - 1)[k - 1])
    return at[np.argsort(-row[at], kind="stable")]


def _solve(k: int, dim: int):
    """Batches sorted by block, the block's queries first: each query's k best of the block."""

    def best(q: list, rows: list) -> Iterator[pa.RecordBatch]:
        if not q or not rows:
            return
        ids = np.concatenate([r[0] for r in rows])
        order = np.argsort(ids, kind="stable")
        x, ids = np.concatenate([r[1] for r in rows])[order], ids[order]
        number, qid, qv = (np.concatenate([r[c] for r in q]) for c in (2, 0, 1))
        for at in range(0, len(qid), 256):
            out: tuple[list, list, list] = ([], [], [])
            for n, own, row in zip(number[at : at + 256], qid[at : at + 256], _products(qv[at : at + 256], x), strict=True):
                pick = [j for j in _best(row, k + np.searchsorted(ids, own, "right") - np.searchsorted(ids, own)) if ids[j] != own][:k]
                out[0].extend([n] * len(pick))
                out[1].extend(ids[pick].tolist())
                out[2].extend(int(row[j]) for j in pick)
            of = dict(zip(number[at : at + 256].tolist(), qid[at : at + 256].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(n) for n in out[0]], pa.int64()), pa.array([of[int(n)] for n in out[0]], pa.int64()), *(pa.array(o, pa.int64()) for o in out[1:])], ["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, q, rows = None, [], []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("grp", "blk", "part")], 1)
            is_q, ids, number = b.column("is_q").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), b.column("row").to_numpy()
            x = _vectors(b.column("v"), dim)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (is_q[1:] != is_q[:-1])) + 1 if len(ids) else []
            for i, j in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if i == j:
                    continue
                new = tuple(keys[i]) != block
                if new or sum(len(r[0]) for r in rows) >= 4 * BLOCK:
                    yield from best(q, rows)
                    rows = []
                    if new:
                        block, q = tuple(keys[i]), []
                (q if is_q[i] else rows).append((ids[i:j], x[i:j], number[i:j]))
        yield from best(q, rows)

    return run


def asked(rows: DataFrame, wanted: DataFrame, dim: int, k: int, n_pivots: int, kind: str) -> tuple[DataFrame, DataFrame, dict[int, int]] | None:
    """(data with groups, queries with the groups that they need, rows of each group) for vectors of ``dim`` components."""
    pivots = np.array([r["v"] for r in rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(4 * n_pivots).collect()])
    pivots = np.unique(pivots, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:n_pivots]]
    arrow = pa.int32() if kind == "int" else pa.float64()
    data = staged(rows.select("id", "v").mapInArrow(_assign(pivots, arrow), f"id long, v array<{kind}>, grp int, dist double, norm double"), "assigned")
    radius, norms, n = np.full(len(pivots), -1.0), np.zeros(len(pivots)), {}
    for r in data.groupBy("grp").agg(F.max("dist").alias("r"), F.max("norm").alias("m"), F.count("*").alias("n")).collect():  # a row a pivot
        radius[r["grp"]], norms[r["grp"]], n[r["grp"]] = r["r"], r["m"], r["n"]
    w = Window.partitionBy("grp").orderBy(F.desc("norm"), "id")
    tops = data.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).select("id", "v").collect()  # k + 1 rows a pivot
    top, top_ids = np.array([r["v"] for r in tops], np.float64).reshape(-1, dim), np.array([r["id"] for r in tops], np.int64)
    q = staged(wanted.select("id", "v").mapInArrow(_ask(pivots, radius, norms, top, top_ids, k, arrow), f"row long, id long, v array<{kind}>, grps array<int>"), "queries")
    return data, q, n


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, n_pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products over ``vectors``, ties to the smaller id: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    parts = []

    def clean(df: DataFrame) -> DataFrame:
        # from 2**52 on a double is a whole number, and floor() would not hold it
        v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
        fine = F.forall(F.col(vec_col).cast("array<double>"), lambda x: F.coalesce((x - x) == 0, F.lit(False)))
        return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(F.col(vec_col)) > 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    rows = staged(clean(vectors), "vectors")
    wanted = staged(clean(queries), "asked")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).orderBy("d").collect()  # one length in any sound table
    for dim, n_rows, largest in lengths:
        own, of = rows.where(F.size("v") == dim), wanted.where(F.size("v") == dim)
        n_queries = of.count()
        if not n_queries:
            continue
        kind = "int" if largest < 2**31 else "double"
        data, q, n = asked(own, of, dim, k, max(4, min(n_pivots, int(n_rows**0.5 / 2))), kind)
        n_asked = dict(q.select(F.explode("grps").alias("g")).groupBy("g").agg(F.count("*")).collect())  # a row a pivot
        of_group = lambda values: F.create_map(*[F.lit(int(x)) for g, v in sorted(values.items()) for x in (g, v)])[F.col("grp")]
        blocks, cuts = of_group({g: -(-m // BLOCK) for g, m in n.items()}), of_group({g: -(-n_asked.get(g, 0) // QUERIES) for g in n})
        # rows of groups that no query asks for go nowhere
        sent = (data.withColumn("part", cuts).where("part > 0").withColumn("blk", F.pmod(F.xxhash64("id", "v"), blocks.cast("long")).cast("int"))
                .select("grp", "blk", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("part"), F.lit(False).alias("is_q"), F.lit(0).cast("long").alias("row"), "id", "v"))
        want = (q.select("row", "id", "v", F.explode("grps").alias("grp")).withColumn("part", F.pmod(F.xxhash64("row"), cuts.cast("long")).cast("int"))
                .select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"), "part", F.lit(True).alias("is_q"), "row", "id", "v"))
        both = sent.unionByName(want).repartition("grp", "blk", "part").sortWithinPartitions("grp", "blk", "part", F.desc("is_q"))
        parts.append(both.mapInArrow(_solve(k, dim), "row long, query_id long, vec_id long, score long").withColumn("dim", F.lit(dim)))
    unstage(rows, wanted)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    w = Window.partitionBy("dim", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 10
"""
