"""Corpus operators: sampling, splitting, merging, repairing, filtering by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.numbers import BUCKETS, bucket, seeded

from .groups import positions


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` that are not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def pass_rates(df: DataFrame, *key: str, correct: str = "correct") -> DataFrame:
    n = F.sum(F.col(correct).cast("int"))
    return df.groupBy(*key).agg(F.count("*").cast("int").alias("k"), n.alias("a1_correct_count"), (n / F.count("*")).alias("a1_pass_rate"))


def with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("difficulty_bucket", bucket(F.col("a1_pass_rate"), F.col("k")))


def drop_extremes(data: DataFrame, difficulty: DataFrame, key: str, drop: tuple[str, ...] = ("trivial", "brick_wall")) -> DataFrame:
    """Rows whose bucket is worth training on; rows without one stay."""
    bad = difficulty.where(F.col("difficulty_bucket").isin(*drop)).select(key)
    return data.join(bad, key, "left_anti")


def bucket_table(df: DataFrame) -> DataFrame:
    """All buckets in order, zeros included, with their share in percent."""
    dim = df.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "pos int, difficulty_bucket string")
    counts = df.groupBy("difficulty_bucket").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return (F.broadcast(dim).join(counts, "difficulty_bucket", "left").crossJoin(F.broadcast(total))
            .select("pos", "difficulty_bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 1).alias("share")))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0).join(df.groupBy(row).agg(F.count("*").alias("total")), row)


def manifest(df: DataFrame, corpus: str, task: str) -> DataFrame:
    """Counts by corpus and task, and by corpus alone (null task)."""
    return df.groupingSets([[corpus, task], [corpus]], corpus, task).agg(F.count("*").alias("n"))


def stratified(df: DataFrame, stratum: str, key: str, per: int, total: int, seed: int = 42) -> DataFrame:
    """``per`` rows of each stratum in seeded order, then the next ones of any stratum until there are ``total``."""
    h = seeded(F.col(key), seed)
    ranked = df.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    # a top-n by (beyond its stratum's share, seeded order)
    return ranked.withColumn("_late", F.col("_r") > per).orderBy("_late", "_h", key).limit(total).drop("_h", "_r", "_late")


def quota(df: DataFrame, cls: str, order: Column, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each class by order, up to its quota."""
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(cls)), F.lit(0))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def prefix_split(df: DataFrame, group: list[str], key: str, train: int, val: int, test: int, seed: int = 42) -> DataFrame:
    """Seeded order per group: the first rows train, the next val, the next test, the rest none. The filter on the rank
    limits groups before the shuffle."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(seeded(F.col(key), seed), key))
    top = df.withColumn("_r", r).where(F.col("_r") <= train + val + test)
    return top.withColumn("split", F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")).drop("_r")


def seeded_rank(df: DataFrame, key: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """The place from 1 of each row in the seeded order of distinct keys, without a global sort: rows are ranked within
    65,536 ranges of the hash, and the ranges' counts, a table of that many rows, are summed up."""
    h = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = h.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_p").orderBy("_h", key)
    return h.join(F.broadcast(before), "_p").withColumn(out, F.row_number().over(w) + F.col("_before")).drop("_h", "_p", "_before")


def entity_split(df: DataFrame, entity: str, seed: int = 42, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Splits that share no entity: seeded order over distinct entities, cut at the shares rounded down."""
    ent = df.select(entity).distinct()
    n = ent.agg(F.count("*").alias("n"))
    r, n_train, n_val = F.col("rank"), F.floor(F.col("n") * shares[0]), F.floor(F.col("n") * shares[1])
    cut = seeded_rank(ent, entity, seed).crossJoin(F.broadcast(n)).select(entity, F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test").alias("split"))
    return df.join(cut, entity)


def holdout_tail(df: DataFrame, order: str, share: float) -> DataFrame:
    """Adds is_val: the last max(1, int(n * share)) rows by ``order``."""
    n = df.count()
    return positions(df, order, "_at").withColumn("is_val", F.col("_at") >= n - max(1, int(n * share))).drop("_at")


def shard(df: DataFrame, pos: str, n_rows: int, processes: int) -> DataFrame:
    """Contiguous shards of equal size; what does not fill one goes."""
    size = n_rows // processes
    return df.withColumn("shard", F.floor(F.col(pos) / max(size, 1)).cast("int")).where(F.col("shard") < (processes if size else 0))


def adjacent_pairs(df: DataFrame, group: str, key: str, member: str, seed: int = 42, once: bool = False) -> DataFrame:
    """Rows 1-2, 3-4, ... of each group in seeded order; pairs of one member go. ``once``: a member is used only in its first pair."""
    w = Window.partitionBy(group).orderBy(seeded(F.col(key), seed), key)
    r = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("pair", F.floor(F.col("_r") / 2))
    out = (r.groupBy(group, "pair").agg(F.max_by(F.struct(key, member), -F.col("_r")).alias("a"), F.max_by(F.struct(key, member), F.col("_r")).alias("b"), F.count("*").alias("n"))
           .where((F.col("n") == 2) & (F.col(f"a.{member}") != F.col(f"b.{member}"))).select(group, "pair", F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.col(f"a.{member}").alias("a_member"), F.col(f"b.{member}").alias("b_member")))
    if once:
        used = out.select(group, "pair", F.explode(F.array("a_member", "b_member")).alias("m"))
        first = used.withColumn("f", F.min("pair").over(Window.partitionBy(group, "m"))).where("f = pair").groupBy(group, "pair").agg(F.count("*").alias("c")).where("c = 2").drop("c")
        out = out.join(first, [group, "pair"], "left_semi")
    return out


def all_members_kept(pairs: DataFrame, key: str, members: list[str], kept: DataFrame, id_col: str) -> DataFrame:
    """Pairs or triples of which every member is kept."""
    lost = pairs.select(key, F.explode(F.array(*members)).alias(id_col)).join(kept.select(id_col).distinct(), id_col, "left_anti").select(key).distinct()
    return pairs.join(lost, key, "left_anti")


def repair(df: DataFrame, source: DataFrame, path: str, value: str, split: Column, pattern: str = r"_(train|val|test)_(\d{5,})\.png$") -> DataFrame:
    """Labels looked up by the number in a file name: adds ``fixed`` and ``status`` (same, updated, missing).
    Numbers are padded to five digits, so those from 100,000 on have more.
    ``source``: split, idx, value."""
    s, i = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    keyed = df.withColumns({"_split": F.when(s == split, s), "_idx": F.when(i != "", i.cast("long"))})
    src = source.select(F.col("split").alias("_split"), F.col("idx").alias("_idx"), F.col("value").alias("_new"))
    out = keyed.join(src, ["_split", "_idx"], "left")
    return out.withColumns({"fixed": F.coalesce("_new", value), "status": F.when(F.col("_new").isNull(), "missing").when(F.col("_new") == F.col(value), "same").otherwise("updated")}).drop("_split", "_idx", "_new")


def mode_smallest(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    return df.groupBy(*group, value).agg(F.count("*").alias("n")).groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(*group, F.col("x.v").alias("mode"), (-F.col("x.m")).alias("n"))
