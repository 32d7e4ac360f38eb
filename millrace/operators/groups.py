"""Group-relative advantages and rollout metrics.

Windows over one group share their partitioning, so a plan needs one exchange
for all of them; batch-wide moments are keyed by a batch column, never global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def advantage(reward: Column, *group: str, plain: bool = False) -> Column:
    """(r - mean) / (std + 1e-8) in a group, 0 where the group does not vary; ``plain``: r - mean."""
    w = Window.partitionBy(*group)
    centred = reward - F.avg(reward).over(w)
    if plain:
        return centred
    # equal rewards have a standard deviation of rounding noise, but no range
    varies = F.max(reward).over(w) - F.min(reward).over(w) > 1e-9
    return F.when(varies, centred / (F.stddev_samp(reward).over(w) + 1e-8)).otherwise(0.0)


def block_of(position: Column, k: int) -> Column:
    """Blocks of k by position; the last may be short and is a group of its own."""
    return F.floor(position / k)


def component_advantage(df: DataFrame, weights: dict[str, float], group: list[str], batch: list[str], out: str = "advantage") -> DataFrame:
    """Each component standardised in its group, weighted and summed, then standardised in the batch."""
    w, b = Window.partitionBy(*group), Window.partitionBy(*batch)
    total = F.lit(0.0)
    for name, weight in weights.items():
        std = F.coalesce(F.stddev_samp(name).over(w), F.lit(0.0))
        total = total + weight * F.when(std > 1e-8, (F.col(name) - F.avg(name).over(w)) / (std + 1e-8)).otherwise(0.0)
    df = df.withColumn("_x", total)
    std = F.coalesce(F.stddev_samp("_x").over(b), F.lit(0.0))
    centred = F.col("_x") - F.avg("_x").over(b)
    return df.withColumn(out, F.when(std > 1e-8, centred / (std + 1e-8)).otherwise(centred)).drop("_x")


def turn_advantages(df: DataFrame, group: list[str], weights=None, plain: bool = False) -> DataFrame:
    """Rewards and advantages of the two answers on their own."""
    from .rewards import ResponseWeights

    w = weights or ResponseWeights()
    df = df.withColumns({"a1_reward": F.col("a1_correctness") * w.a1_correctness + F.col("a1_format") * w.a1_format,
                         "a2_reward": F.col("a2_correctness") * w.a2_correctness + F.col("a2_format") * w.a2_format + F.col("no_regression") * w.no_regression})
    return df.withColumns({"a1_advantage": advantage(F.col("a1_reward"), *group, plain=plain), "a2_advantage": advantage(F.col("a2_reward"), *group, plain=plain)})


def group_spread(df: DataFrame, group: list[str], rewards: list[str], k: int) -> DataFrame:
    """Per group: its size, per reward the standard deviation and the mean absolute advantage, and whether it is kept:
    it has k rows and the advantages of all rewards together do not vanish."""
    w = Window.partitionBy(*group)
    parts = {}
    for r in rewards:
        std = F.stddev_samp(r).over(w)
        parts[f"_{r}"] = F.when(std < 1e-6, 0.0).otherwise(F.abs((F.col(r) - F.avg(r).over(w)) / (std + 1e-6)))
    out = df.withColumns(parts).groupBy(*group).agg(F.count("*").alias("n"), *[F.stddev_samp(r).alias(f"{r}_std") for r in rewards], *[F.avg(f"_{r}").alias(f"{r}_spread") for r in rewards])
    total = sum((F.col(f"{r}_spread") for r in rewards[1:]), F.col(f"{rewards[0]}_spread"))
    return out.withColumn("kept", (F.col("n") == k) & F.coalesce(total > 1e-4, F.lit(False)))


def keep_varied(df: DataFrame, group: list[str], rewards: list[str], k: int) -> DataFrame:
    """Rows of the groups that ``group_spread`` keeps."""
    return df.join(group_spread(df, group, rewards, k).where("kept").select(*group), group, "left_semi")


def zero_std_share(df: DataFrame, group: list[str], reward: str) -> DataFrame:
    stds = df.groupBy(*group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return stds.agg(F.avg((F.col("s") < 1e-4).cast("int")).alias("zero_std_share"), F.count("*").alias("n_groups"))


def rate(c: Column) -> Column:
    return F.avg(c.cast("int"))


def transition_metrics(df: DataFrame, *by: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Over boolean a1_correct and a2_correct: accuracies and the four transition rates, all over all rows."""
    a1, a2 = F.col("a1_correct"), F.col("a2_correct")
    aggs = [F.count("*").alias("total_trajectories"), rate(a1).alias("a1_accuracy"), rate(a2).alias("a2_accuracy"), rate(a1 & a2).alias("rr_rate"), rate(a1 & ~a2).alias("rw_rate"),
            rate(~a1 & a2).alias("wr_rate"), rate(~a1 & ~a2).alias("ww_rate"), *(c.alias(n) for n, c in (extra or {}).items())]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def violations(component: str) -> Column:
    """Share of rows whose format component is 0, that is whose tags are missing."""
    return F.avg(F.when(F.col(component) == 0.0, 1.0).otherwise(0.0))


def reflection_metrics(df: DataFrame, *by: str, response: str = "total", feedback: str = "fb_total", a2_format: str = "a2_format", fb_format: str = "fb_format") -> DataFrame:
    """Transition metrics with reward means and format-violation rates."""
    return transition_metrics(df, *by, extra={"response_reward_mean": F.avg(response), "feedback_reward_mean": F.avg(feedback),
                                              "a2_format_violation_rate": violations(a2_format), "fb_format_violation_rate": violations(fb_format)})


def baseline_metrics(df: DataFrame, *by: str, reward: str = "total", a1_format: str = "a1_format") -> DataFrame:
    """The same keys for answers of one turn; NaN where a second turn would be needed."""
    nan = F.lit(float("nan"))
    undefined = ("a2_accuracy", "rr_rate", "rw_rate", "wr_rate", "ww_rate", "a2_format_violation_rate", "fb_format_violation_rate")
    aggs = [F.count("*").alias("total_trajectories"), rate(F.col("a1_correct")).alias("a1_accuracy"), F.avg(reward).alias("response_reward_mean"), violations(a1_format).alias("a1_format_violation_rate")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs).where("total_trajectories > 0")
    return out.select("*", F.lit(0.0).alias("feedback_reward_mean"), *[nan.alias(c) for c in undefined])


def critic_metrics(df: DataFrame, *by: str, reward: str = "total", feedback: str = "f1") -> DataFrame:
    """Metrics of a critic's pairs: a second answer that can't be told (null) counts in no transition, but in the total."""
    a1, a2 = F.col("a1_correct"), F.col("a2_correct")
    both = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    aggs = [F.count("*").alias("total_pairs"), F.avg(reward).alias("reward_mean"), both(a1 & a2).alias("rr_rate"), both(a1 & ~a2).alias("rw_rate"), both(~a1 & a2).alias("wr_rate"), both(~a1 & ~a2).alias("ww_rate"),
            F.avg(F.size(F.filter(F.split(F.coalesce(F.col(feedback), F.lit("")), r"\s+"), lambda w: w != ""))).alias("feedback_length_mean")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs).where("total_pairs > 0")


def keyed(wide: DataFrame, prefix: str, *by: str) -> DataFrame:
    """Long form: by, metric (prefix/name), value."""
    names = [c for c in wide.columns if c not in by]
    doubles = wide.select(*by, *[F.col(c).cast("double").alias(f"{prefix}/{c}") for c in names])
    return doubles.unpivot(list(by), [f"{prefix}/{c}" for c in names], "metric", "value")


def rekeyed(long: DataFrame, prefix: str) -> DataFrame:
    """Metrics under another prefix: sr/x becomes prefix/x."""
    return long.withColumn("metric", F.concat(F.lit(prefix + "/"), F.substring_index("metric", "/", -1)))


def batch_diagnostics(df: DataFrame, *by: str, reward: str, advantages: dict[str, str]) -> DataFrame:
    """Per batch: standard deviation of the reward, and of each advantage (name: column) the mean size and how many vanish."""
    aggs = [F.stddev_samp(reward).alias("reward_std")]
    for name, c in advantages.items():
        aggs += [F.avg(F.abs(c)).alias(f"{name}_abs_mean"), F.count_if(F.col(c) == 0).alias(f"{name}_zeros")]
    return df.groupBy(*by).agg(*aggs)


def token_diagnostics(df: DataFrame, *by: str, new: str, old: str, entropy: str, clip: float = 0.2) -> DataFrame:
    """Clip fraction and entropy over all tokens (ratios of sums). ``new``, ``old``: log-probabilities of each token, ``entropy``: its entropy."""
    ratio = F.zip_with(new, old, lambda a, b: F.exp(a - b))
    clipped = F.size(F.filter(ratio, lambda r: (r < 1 - clip) | (r > 1 + clip)))
    total = lambda x: F.aggregate(F.col(x), F.lit(0.0), lambda s, e: s + F.coalesce(e, F.lit(0.0)))
    tokens = F.sum(F.size(new))
    aggs = [(F.sum(clipped) / F.greatest(tokens, F.lit(1))).alias("clip_fraction"), F.coalesce(F.sum(total(entropy)) / F.nullif(F.sum(F.size(entropy)), F.lit(0)), F.lit(0.0)).alias("entropy")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def completion_length(ids: Column | None = None, whole: Column | None = None, prompt: Column | None = None) -> Column:
    """Tokens of a completion: of its ids where they are kept (none: 0), else of the whole without the prompt."""
    if ids is None:
        return whole - prompt
    return F.coalesce(F.when(ids.isNotNull(), F.size(ids)), F.lit(0)) if whole is None else F.coalesce(F.when(ids.isNotNull(), F.size(ids)), whole - prompt)


def positions(df: DataFrame, order: str, out: str = "position", *ties: str) -> DataFrame:
    """The place from 0 of each row by a numeric column, without a global sort: rows are ranked within 65,536 equal ranges of
    its values, and the ranges' counts, a table of that many rows, are summed up. Nulls come first."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    part = F.coalesce(F.floor((F.col(order) - lo) / F.lit(max(float(hi) - float(lo), 1e-300)) * 65535), F.lit(-1))
    d = df.withColumn("_p", part)
    counts = d.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(before), "_p").withColumn(out, F.row_number().over(Window.partitionBy("_p").orderBy(order, *ties)) - 1 + F.col("_before")).drop("_p", "_before")


def windowed_trend(df: DataFrame, order: str, value: str, windows: int = 10) -> DataFrame:
    """w, mean: the mean in each of ``windows`` equal stretches of the order."""
    n = df.count()
    return positions(df, order).select(F.floor(F.col("position") * windows / max(n, 1)).cast("int").alias("w"), value).groupBy("w").agg(F.avg(value).alias("mean"))


def early_late(df: DataFrame, order: str, value: str, share: float = 0.1) -> DataFrame:
    """delta: the mean of the first share of rows less that of the last."""
    n = df.count()
    m = max(1, int(n * share + 1e-9))
    p = positions(df, order)
    return p.agg((F.avg(F.when(F.col("position") < m, F.col(value))) - F.avg(F.when(F.col("position") >= n - m, F.col(value)))).alias("delta"))


def resume_offset(df: DataFrame, position: str, step: int, batch: int) -> DataFrame:
    """Rows that a run stopped after ``step`` batches has not seen."""
    return df.where(F.col(position) >= step * batch)


def component_means(df: DataFrame, components: list[str]) -> DataFrame:
    """Long form: component, mean."""
    return df.agg(*[F.avg(c).alias(c) for c in components]).unpivot([], components, "component", "mean")


def across_ranks(df: DataFrame, rank: str, metrics: list[str], total: str) -> DataFrame:
    """Per-rank means combined as ranks do it: sums of ``total``, plain means of the rest."""
    per = df.groupBy(rank).agg(F.sum(total).alias(total), *[F.avg(m).alias(m) for m in metrics])
    return per.agg(F.sum(total).alias(total), *[F.avg(m).alias(m) for m in metrics])


def smoothed(df: DataFrame, key: list[str], order: str, value: str, rate_: float = 0.05, out: str = "ema") -> DataFrame:
    """Exponential moving average per key, seeded by the first value.

    The recursion is folded in one pass over each key's ordered values; a row of a
    long series holds its place in it, so results are the same at any size.
    """
    w = Window.partitionBy(*key).orderBy(order)
    n = F.row_number().over(w) - 1
    # x_0 (1-a)^n + sum a (1-a)^(n-i) x_i, by blocks of BLOCK rows so that no power under- or overflows
    df = df.withColumn("_n", n).withColumn("_b", F.floor(F.col("_n") / BLOCK)).withColumn("_i", F.col("_n") % BLOCK)
    q = 1 - rate_
    x = F.when(F.col("_n") == 0, F.col(value)).otherwise(rate_ * F.col(value))
    inner = Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_s", F.sum(x * F.pow(F.lit(1 / q), F.col("_i"))).over(inner) * F.pow(F.lit(q), F.col("_i")))
    ends = df.groupBy(*key, "_b").agg(F.max_by("_s", "_i").alias("_e"), F.count("*").alias("_c"))
    if not key:
        ends = ends.withColumn("_all", F.lit(1))
    k2 = key or ["_all"]
    # blocks are folded in order; a block's carry is what stood at the end of the one before
    fold = ends.groupBy(*k2).agg(F.sort_array(F.collect_list(F.struct("_b", "_e", "_c"))).alias("e"))
    carry = F.aggregate("e", F.struct(F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("all")),
                        lambda a, x: F.struct((a["v"] * F.pow(F.lit(q), x["_c"]) + x["_e"]).alias("v"), F.concat(a["all"], F.array(a["v"])).alias("all")), lambda a: a["all"])
    fold = fold.select(*k2, F.posexplode(carry).alias("_b", "_carry")).withColumn("_b", F.col("_b").cast("long"))
    df = (df if key else df.withColumn("_all", F.lit(1))).join(fold, [*k2, "_b"])
    return df.withColumn(out, F.col("_s") + F.col("_carry") * F.pow(F.lit(q), F.col("_i") + 1)).drop("_n", "_b", "_i", "_s", "_carry", "_all")


BLOCK = 4096


def priority_draws(entries: DataFrame, n: int, key: str, priority: str, power: float = 1.0, seed: int = 42) -> DataFrame:
    """n draws with replacement, by weight |priority|**power + 1e-6: draw, key. The buffer is bounded by its eviction."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    e = entries.withColumn("_w", F.pow(F.abs(priority), F.lit(power)) + 1e-6).withColumn("_hi", F.sum("_w").over(w)).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = e.agg(F.max("_hi").alias("_t"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    draws = entries.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_u", u).join(F.broadcast(total)).withColumn("_x", F.col("_u") * F.col("_t"))
    return draws.join(F.broadcast(e), (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))).select("draw", key)


def last_rows(df: DataFrame, order: str, most: int) -> DataFrame:
    """The last ``most`` rows by arrival, as a bounded buffer keeps them; a top-n, so partitions send no more than that."""
    return df.orderBy(F.desc(order)).limit(most)


def early_stop(df: DataFrame, order: str, value: str, patience: int = 5, min_delta: float = 0.01, mode: str = "min") -> DataFrame:
    """Validation points with the best so far, the count of points since it, and whether to stop. Evaluations are few: one fold."""
    better = (lambda x, best: x < best - min_delta) if mode == "min" else (lambda x, best: x > best + min_delta)
    seq = df.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.array().cast("array<struct<o:bigint,x:double,best:double,bad:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        up = a["best"].isNull() | better(p["x"], a["best"])
        best, bad = F.when(up, p["x"]).otherwise(a["best"]), F.when(up, 0).otherwise(a["bad"] + 1)
        return F.struct(best.alias("best"), bad.alias("bad"), F.concat(a["out"], F.array(F.struct(p["o"].cast("bigint").alias("o"), p["x"].alias("x"), best.alias("best"), bad.alias("bad")))).alias("out"))

    return (seq.select(F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("p"))
            .select(F.col("p.o").alias(order), F.col("p.x").alias(value), F.col("p.best").alias("best"), F.col("p.bad").alias("since_best"), (F.col("p.bad") >= patience).alias("stop")))
