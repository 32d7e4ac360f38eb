"""URL filters (operator 9), with DataFrame functions only.

A rule is (host, path, verdict). It fits its host and all subdomains, where the
url's path starts with the rule's. Each url expands into the expressions that
some rule could equal: host suffixes with as many labels, and path prefixes of
such a length, as the rules have (a shape). Expressions join the rules on the
first four bytes of their SHA-256, then the full digest confirms, and the longest
rule wins (of equal text, block). Urls that no rule fits get ``default``.

Up to BROADCAST_RULES rules of at most SHAPES shapes are sent to the urls: one
join a shape, each with at most one row a short prefix, so a url stays one row and
nothing is shuffled. Beyond, a url's expressions become rows, meet the rules by a
shuffle, and the best is taken by row.

The rule table's shapes (label count, path length) are collected: they are few
whatever the number of rules.

Defined results: null url, or one without ``://``: host and path empty, no rule.
Rules' hosts are lower-cased as urls' are; rules without a host, path or verdict do
not count; without rules all urls get ``default``. Rows that repeat are judged as
rows of their own, very long urls whole; other columns are ignored. An empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_RULES, SHAPES = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. ``rules``: host, path, verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    labels = F.size(F.split("host", r"\."))
    shapes = sorted((r[0], r[1]) for r in rules.select(labels, F.char_length("path")).distinct().collect())
    digest = _digest(F.col("host"), F.col("path"))
    by_hash = (rules.select(F.substring(digest, 1, 8).alias("short"), digest.alias("digest"), F.concat("host", "path").alias("rule"), "verdict")
               .groupBy("short", "digest", "rule").agg(F.max("verdict").alias("verdict")))  # 'block' > 'allow'
    host, path = host_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    n_labels = F.size(F.split("host", r"\."))
    made = [F.when((n_labels >= k) & (F.char_length("path") >= m), _digest(F.substring_index("host", ".", -k), F.substring("path", 1, m))) for k, m in shapes]
    order = lambda r: F.struct(F.char_length(r["rule"]).alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))
    if len(shapes) <= SHAPES and rules.count() <= BROADCAST_RULES:
        of_short = F.broadcast(by_hash.groupBy("short").agg(F.collect_list(F.struct("digest", "rule", "verdict")).alias("rules")))
        best = rows.drop("row").withColumn("best", F.lit(None).cast("struct<n:int,verdict:string,rule:string>"))
        for d in made:
            fits = F.array_max(F.transform(F.filter("rules", lambda r: r["digest"] == F.col("digest")), order))
            best = best.withColumn("digest", d).join(of_short, F.substring("digest", 1, 8) == F.col("short"), "left").withColumn("best", F.greatest("best", fits)).drop("digest", "short", "rules")
    else:
        tried = rows.withColumn("digest", F.explode_outer(F.filter(F.array(*made), lambda x: x.isNotNull()))).withColumn("short", F.substring("digest", 1, 8))
        r = by_hash.alias("r")
        found = tried.alias("t").join(F.broadcast(r) if rules.count() <= BROADCAST_RULES else r, F.col("t.short") == F.col("r.short"), "left")
        fits = F.when(F.col("t.digest") == F.col("r.digest"), F.struct(F.char_length("r.rule").alias("n"), F.col("r.verdict").alias("verdict"), F.col("r.rule").alias("rule")))
        best = found.groupBy("t.row").agg(F.first("t.page_id").alias("page_id"), F.first("t.host").alias("host"), F.first("t.path").alias("path"), F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP9_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS row FROM pages),
f AS (SELECT p.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (row)
"""
