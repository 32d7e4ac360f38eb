"""Quality rules with risk-controlled cutoffs (operator 5), with DataFrame functions only.

Each rule rejects a text whose feature exceeds a cutoff. The cutoffs of all rules
form one sequence of steps, fixed in advance and mildest first, one rule tighter
with every step; a text's ``step`` is the first one that rejects it. Per stratum
(language) the strictest step is taken for which the labelled good texts prove
that all rules together reject at most a share ``alpha`` of good texts: the exact
binomial probability of seeing so few rejections, were the true share ``alpha``,
must not exceed ``delta`` over the number of strata and the pooled one
(Bonferroni). Steps are tested in their order until one fails, which needs no
further correction. A stratum with too few labels to prove anything, even without
a rejection, takes the step that all strata pooled prove: its guarantee holds for
the pooled texts only. A stratum whose labels speak against a step keeps to them.

Good texts that the base rules reject say nothing of the cutoffs and do not
count. The sequence is fixed in advance, so all labelled texts serve as holdout.

Defined results: null text: no words, base_failed; null language: a stratum ''.
Several labels of a doc_id: good only if all say so; null labels do not count.
Rows that repeat a doc_id are judged as rows of their own. Without labels only
the base rules act. Very long texts are judged whole; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import spread, staged

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rule: feature and cutoffs, mildest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.12, 0.08, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.65, 0.5, 0.4)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.8, 0.6, 0.45, 0.35, 0.25)),
}
#: (step, rule, cutoff), mildest first.
STEPS = [(i + 1, r, c) for i, (r, c) in enumerate((r, cs[k]) for k in range(max(len(cs) for _, cs in RULES.values())) for r, (_, cs) in RULES.items() if k < len(cs))]
ALPHA = 0.02
DELTA = 0.05
BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: The first step that rejects a text, in SQL of Spark and DuckDB alike.
STEP = f"least({', '.join('CASE ' + ' '.join(f'WHEN {f} > {c} THEN {k}' for k, q, c in STEPS if q == r) + f' ELSE {len(STEPS) + 1} END' for r, (f, _) in RULES.items())})"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", row: Column | None = None) -> DataFrame:
    """doc_id, stratum and the counts of every row, and ``row`` if given."""
    extra = [] if row is None else [row.alias("row")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, WS, "")
    chars = F.char_length(bare)
    words = F.filter(F.split(F.translate(text, WS, " " * len(WS)), " "), lambda w: w != "")
    df = spread(docs).select(*extra, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("stratum"), chars.alias("word_chars"),
                     (chars - F.char_length(F.translate(bare, SYMBOLS, ""))).alias("n_symbols"),
                     (chars - F.char_length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
                     F.filter(F.split(text, "\n"), lambda x: F.translate(x, WS, "") != "").alias("lines"), words.alias("w"))
    # hashes of the 3-word windows; only texts in which one comes twice get their places sorted
    df = df.withColumn("h", F.expr("CASE WHEN size(w) > 3 THEN transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) END"))
    df = df.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END"))
    df = df.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].x = x.x) OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].x = x.x)), x -> x.i))"))
    covered = F.expr("coalesce(aggregate(p, struct(0L AS n, -3L AS last), (a, i) -> struct(a.n + least(3L, i - a.last) AS n, cast(i AS bigint) AS last), a -> a.n), 0L)")
    return df.select(*(["row"] if extra else []), "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"), F.col("n_capitals").cast("long"),
                     F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"))


def binomial_cdf(n: Column, x: Column, p: float) -> Column:
    """P(Binomial(n, p) <= x), term by term; 1 where x is above the mean, which proves nothing."""
    step = lambda a, j: F.struct((a["sum"] + F.exp(a["log"])).alias("sum"), (a["log"] + F.log((n - j) / (j + 1)) + F.log(F.lit(p / (1 - p)))).alias("log"))
    cdf = F.aggregate(F.sequence(F.lit(0).cast("long"), x), F.struct(F.lit(0.0).alias("sum"), (n * F.log(F.lit(1 - p))).alias("log")), step, lambda a: a["sum"])
    return F.when(x > n * p, F.lit(1.0)).otherwise(cdf)


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum of ``feats``, and the pooled one (null): good texts ``n``, and ``chosen``, the last step proven (0: none)."""
    good = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
            .where("quality = 1").select("doc_id"))
    # rejections of good texts by stratum and step: a small table
    seen = staged(feats.where(f"doc_id is not null AND NOT {BASE}").select("doc_id", "stratum", F.expr(STEP).alias("step")).join(good, "doc_id")
                  .groupBy("stratum", "step").agg(F.count("*").alias("c")), "counts")
    both = seen.unionByName(seen.groupBy("step").agg(F.sum("c").alias("c")).withColumn("stratum", F.lit(None).cast("string")))
    m = seen.select("stratum").distinct().count() + 1
    n = F.sum("c").alias("n")
    x = [F.coalesce(F.sum(F.when(F.col("step") <= k, F.col("c"))), F.lit(0)).alias(f"x{k}") for k, _, _ in STEPS]
    sums = both.groupBy("stratum").agg(n, *x)
    proven = [binomial_cdf(F.col("n"), F.col(f"x{k}"), alpha) <= delta / m for k, _, _ in STEPS]
    chosen, passed = F.lit(0), F.lit(True)
    for k, ok in enumerate(proven):
        passed = passed & ok
        chosen = chosen + passed.cast("int")
    return sums.select("stratum", "n", chosen.alias("chosen"), (F.pow(F.lit(1 - alpha), F.col("n")) > delta / m).alias("too_few"))


def verdict(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``feats`` with base_failed and kept. ``cuts``: as of ``cutoffs``."""
    pooled = cuts.where("stratum is null").select(F.col("chosen").alias("pooled"))
    pooled = (pooled.first() or [0])[0]
    step = F.when(F.coalesce("too_few", F.lit(True)), F.lit(pooled)).otherwise(F.col("chosen"))
    return (feats.join(cuts.where("stratum is not null"), "stratum", "left").withColumn("base_failed", F.expr(BASE))
            .withColumn("kept", ~F.expr(BASE) & (F.expr(STEP) > step)))


def judge(docs: DataFrame, labels: DataFrame, **cols: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    feats = staged(features(docs, **cols), "features")
    cuts = staged(cutoffs(feats, labels), "cutoffs")  # a row per stratum; its size is known, so Spark chooses the join
    return verdict(feats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def screen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    feats = staged(features(docs, row=F.struct(*docs.columns)), "features")
    cuts = staged(cutoffs(feats.drop("row"), labels), "cutoffs")
    return verdict(feats, cuts).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _oracle() -> str:
    """The same in DuckDB: list functions for the counts, lgamma for the binomial terms."""
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 3)),
d AS (SELECT row, i, count(*) OVER (PARTITION BY row, tri) AS c FROM g),
v AS (SELECT row, count(DISTINCT i + o) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS s(o) WHERE c > 1 GROUP BY row),
b AS (SELECT row, doc_id, stratum, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    len(text) - len(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN v USING (row)),
s AS (SELECT *, {BASE} AS base_failed, {STEP} AS step FROM b),
good AS (SELECT s.* FROM s JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) l USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT stratum, k, count(*) AS n, count(*) FILTER (step <= k) AS x FROM good, range(1, {len(STEPS) + 1}) AS r(k) GROUP BY stratum, k
    UNION ALL SELECT NULL, k, count(*), count(*) FILTER (step <= k) FROM good, range(1, {len(STEPS) + 1}) AS r(k) GROUP BY k),
risk AS (SELECT *, (SELECT count(DISTINCT stratum) FROM good) + 1 AS m, CASE WHEN x > n * {ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, x + 1),
    lambda j: exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) END AS p FROM cells),
chosen AS (SELECT stratum, count(*) FILTER (ok) AS step, any_value(pow(1 - {ALPHA}, n) > {DELTA} / m) AS too_few
    FROM (SELECT *, bool_and(p <= {DELTA} / m) OVER (PARTITION BY stratum ORDER BY k) AS ok FROM risk) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND s.step > CASE WHEN coalesce(c.too_few, true) THEN coalesce((SELECT step FROM chosen WHERE stratum IS NULL), 0) ELSE c.step END AS kept
FROM s LEFT JOIN chosen c ON c.stratum = s.stratum
"""


OP5_SQL = _oracle()
