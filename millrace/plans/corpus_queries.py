"""Queries over corpora: sources, filters, joins, splits, dedup, smoothing, streams; with DuckDB oracles where SQL can say it."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions import numbers as N, text as T
from millrace.operators import corpus as C, dedup as X, groups as G, records as RC
from millrace.sources import files as S
from millrace.sources.views import MESSAGES, messages, rollouts, table
from millrace.streaming import trajectories as ST

from . import duck as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; it goes when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()  # one machine: any folder of it is shared
    path = f"{base.rstrip('/')}/millrace-{name}-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


h42 = lambda c: f"md5(concat('42:', CAST({c} AS VARCHAR)))"
docs = lambda spark, d: table(spark, d, "documents")
emb = lambda spark, d: table(spark, d, "embeddings")

# ---- sources and sinks -----------------------------------------------------------
SMALL = "doc_id long, lang string, text string"


@query("s1_jsonl_tolerant", "SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n FROM documents WHERE doc_id % 50 <> 7")
def _s1(spark, d):
    path = scratch(spark, "s1")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    docs(spark, d).select(F.when(F.col("doc_id") % 50 == 7, F.lit("{broken")).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl_tolerant(spark, path, SMALL).select("doc_id", "lang", F.length("text").alias("n"))


@query("s2_jsonl_strict", "SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n FROM documents")
def _s2(spark, d):
    path = scratch(spark, "s2")
    S.write_jsonl(docs(spark, d).select("doc_id", "lang", "text"), path)
    return S.read_jsonl_strict(spark, path, SMALL).select("doc_id", "lang", F.length("text").alias("n"))


@query("s3_profile_scan", D.SR + "SELECT sample_index, traj, a1 FROM sr")
def _s3(spark, d):
    path = scratch(spark, "s3")
    S.write_jsonl(rollouts(spark, d).select("sample_index", "traj", "a1"), path)
    return S.read_jsonl_strict(spark, path, "sample_index long, traj long, a1 string")


@query("s5_s6_jsonl_append", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _s5(spark, d):
    path = scratch(spark, "s5")
    for k in range(3):
        S.write_jsonl(docs(spark, d).where(F.col("doc_id") % 3 == k).select("doc_id", "source"), path, "append")
    return S.read_jsonl_strict(spark, path, "doc_id long, source string").groupBy("source").agg(F.count("*").alias("n"))


@query("s7_trajectory_log", D.SR + "SELECT CAST(sample_index % 4 AS INTEGER) AS rank, count(*) AS n FROM sr GROUP BY 1")
def _s7(spark, d):
    path = scratch(spark, "s7")
    S.write_jsonl(rollouts(spark, d).withColumn("rank", F.col("sample_index") % 4), path, "append", by="rank")
    return spark.read.json(path).groupBy("rank").agg(F.count("*").alias("n")).select(F.col("rank").cast("int").alias("rank"), "n")


@query("s8_tsv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents")
def _s8(spark, d):
    path = scratch(spark, "s8")
    S.write_tsv(docs(spark, d).select("doc_id", "lang", "text"), path)
    return S.read_tsv(spark, path, ["doc_id", "lang", "nothing"])


query("s9_csv_coerced", "SELECT event_id, value FROM events WHERE event_id % 9 <> 4")(
    lambda spark, d: S.coerced(table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 4, F.lit("x")).otherwise(F.col("value").cast("string")).alias("value")), ["value"]))
query("s10_csv_aliases", "SELECT CAST(doc_id AS VARCHAR) AS ref, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS name FROM documents")(
    lambda spark, d: S.aliased(docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("")).alias("ref_path"), "source"), {"ref": ["none", "doc_id"], "name": ["ref_path", "source"]}))


@query("s11_annotations", "SELECT l_orderkey % 97 AS id, CASE WHEN l_orderkey % 97 = 5 THEN 'object' ELSE 'kind' END AS name, count(*) AS n FROM lineitem WHERE l_orderkey % 97 < 40 AND l_orderkey % 97 <> 11 GROUP BY ALL")
def _s11(spark, d):
    path = scratch(spark, "s11")
    li = table(spark, d, "lineitem").where("l_orderkey % 97 < 40")
    ann = li.select(F.struct((F.col("l_orderkey") % 97).alias("image_id"), (F.col("l_orderkey") % 97).alias("category_id")).alias("a")).agg(F.collect_list("a").alias("annotations"))
    ids = spark.range(40).where("id <> 11").agg(F.collect_list(F.struct("id", F.lit("f").alias("file_name"), F.lit(10).alias("width"), F.lit(10).alias("height"))).alias("images"))
    cats = spark.range(40).where("id <> 5").agg(F.collect_list(F.struct("id", F.lit("kind").alias("name"))).alias("categories"))
    ann.crossJoin(ids).crossJoin(cats).write.json(path)  # one annotation file is one document
    return S.annotations(spark, path).groupBy(F.col("image_id").alias("id"), "name").agg(F.count("*").alias("n"))




@query("s12_small_files", "WITH f AS (SELECT name FROM (SELECT DISTINCT concat('d', doc_id % 97, '.json') AS name FROM documents WHERE doc_id % 97 % 4 <> 3) ORDER BY md5('42:' || name), name LIMIT 60) SELECT doc_id, lang FROM documents JOIN f ON concat('d', doc_id % 97, '.json') = f.name")
def _s12(spark, d):
    path = scratch(spark, "s12")
    files = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id") % 97, F.lit(".json")).alias("name"), F.struct("doc_id", "lang").alias("r"))
    there = files.where("r.doc_id % 97 % 4 <> 3")  # every fourth file listed is missing
    there.groupBy("name").agg(F.to_json(F.collect_list("r")).alias("value")).repartition(4).write.partitionBy("name").text(f"{path}-parts")
    fs, to = S.fs_path(spark, path)
    fs.mkdirs(to)
    for s in fs.listStatus(S.fs_path(spark, f"{path}-parts")[1]):  # at most 97, laid out as a folder of files
        name = s.getPath().getName()
        if name.startswith("name="):
            part = next(f.getPath() for f in fs.listStatus(s.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, S.fs_path(spark, f"{path}/{name[5:]}")[1])
    return S.small_files(spark, path, files.select("name"), "name", "doc_id long, lang string", 60).select("doc_id", "lang")


query("s13_image_cells", "SELECT doc_id, CAST(unnest([0, 2]) AS INTEGER) AS pos FROM documents")(
    lambda spark, d: S.image_cells(docs(spark, d).select("doc_id", F.lit(b"a").alias("image"), F.lit(None).cast("binary").alias("image_1"), F.lit(b"b").alias("image_2")), "doc_id").select("doc_id", "pos"))
query("s18_image_size", "SELECT doc_id, CAST(16 AS BIGINT) AS w, 256 + doc_id % 2 AS h FROM documents WHERE doc_id % 3 <> 0")(
    lambda spark, d: (lambda b: docs(spark, d).select("doc_id", *[x.alias(n) for n, x in zip("wh", S.image_size(b), strict=True)]).where("w is not null"))(
        F.unhex(F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("FFD8FFE000104A46")).otherwise(F.lit("89504E470D0A1A0A")), F.lit("0000000D49484452"), F.lit("00000010"), F.lpad(F.hex(256 + F.col("doc_id") % 2), 8, "0")))))


@query("s20_manifest", "WITH c AS (SELECT source AS corpus, lang AS task, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY corpus, split) AS BIGINT) AS total FROM c")
def _s20(spark, d):
    path = scratch(spark, "s20")
    S.write_manifest(docs(spark, d).groupBy(F.col("source").alias("corpus"), F.col("lang").alias("task"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n")), path)
    m = spark.read.schema("corpus string, tasks array<string>, totals map<string,long>, per_task map<string,map<string,long>>").json(path)
    return (m.select("corpus", "totals", F.explode("per_task").alias("task", "splits")).select("corpus", "task", "totals", F.explode("splits").alias("split", "n"))
            .select("corpus", "task", "split", "n", F.col("totals")[F.col("split")].alias("total")))


query("s21_base64", "SELECT doc_id, base64(encode(lang)) AS b, lang AS back FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", S.base64_text(F.col("lang").cast("binary")).alias("b"), S.base64_bytes(S.base64_text(F.col("lang").cast("binary"))).cast("string").alias("back")))
query("s19_markdown", "SELECT '| lang | n |' AS head, count(DISTINCT lang) AS n FROM documents")(
    lambda spark, d: (lambda m: spark.createDataFrame([(m[0], len(m) - 2)], "head string, n long"))(S.markdown(docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))).split("\n")))

# ---- filters ----------------------------------------------------------------------
query("p18_messages", MESSAGES)(messages)
query("f1_format_dispatch", MESSAGES.replace("SELECT conv_id", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'messages' ELSE 'flat' END AS format"))(
    lambda spark, d: messages(spark, d).withColumn("_m", F.lit(1)).withColumn("_q", F.when(F.col("conv_id") % 3 != 0, F.col("question"))).withColumn("format", F.when(F.col("_m").isNotNull() & F.col("_q").isNull(), "messages").otherwise("flat")).drop("_m", "_q"))
query("f2_has_image", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")(lambda spark, d: docs(spark, d).withColumn("p", T.image_path(F.when(F.col("doc_id") % 4 != 0, F.lit("x.png")), F.array().cast("array<string>"), "/b")).where("p <> ''").select("doc_id"))
query("f3_clean_question", r"SELECT conv_id, turn, regexp_replace(replace(concat(' <image>', text), '<image>', ''), '^\s+|\s+$', '', 'g') AS q FROM conversations")(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.clean_question(F.concat(F.lit(" <image>"), F.col("text"))).alias("q")))
query("f4_requested", D.SR + "SELECT sample_index, traj FROM sr WHERE sample_index IN (1, 5, 8)")(lambda spark, d: rollouts(spark, d).where(F.col("sample_index").isin(1, 5, 8)).select("sample_index", "traj"))
query("f5_count_range", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_linenumber END AS INTEGER) AS c FROM lineitem WHERE CAST(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE l_linenumber END AS INTEGER) BETWEEN 2 AND 10")(
    lambda spark, d: S.count_of(table(spark, d, "lineitem").withColumn("count", F.when(F.col("l_linenumber") == 1, F.lit("many")).otherwise(F.col("l_linenumber").cast("string"))).withColumn("number", F.col("l_quantity").cast("int")), ["count", "number"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("count_").alias("c")))
query("f6_valid_boxes", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_quantity * 10) / 1000.0 BETWEEN 0.15 AND 0.5 AND (l_extendedprice / 2000) / (l_quantity * 10) >= 0.06")(
    lambda spark, d: S.valid_boxes(table(spark, d, "lineitem").withColumns({"bbox": F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(10.0)), "width": F.lit(50), "height": F.lit(20), "iscrowd": F.lit(0), "area": F.col("l_extendedprice") / 2000}), fill=0.06).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
query("f7_seeded_prefix", f"SELECT event_id FROM events ORDER BY {h42('event_id')}, event_id LIMIT 500")(lambda spark, d: table(spark, d, "events").orderBy(N.seeded(F.col("event_id")), "event_id").limit(500).select("event_id"))
query("f8_keypoints", "SELECT vec_id, len(list_filter(range(1, 33), lambda i: embedding[i] >= 0 AND embedding[i + 32] >= 0)) AS n FROM embeddings WHERE len(list_filter(range(1, 33), lambda i: embedding[i] >= 0 AND embedding[i + 32] >= 0)) >= 4")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.size(F.filter(F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: (a >= 0) & (b >= 0)), lambda x: x)).cast("long").alias("n")).where("n >= 4"))
_PTS = "list_transform(range(1, 6), lambda k: {'x': floor((CAST(embedding[2 * k] AS DOUBLE) + 0.3) * 1000), 'y': floor((CAST(embedding[2 * k + 1] AS DOUBLE) + 0.3) * 1000)})"
query("f9_distractors", f"""WITH RECURSIVE p AS (SELECT vec_id, {_PTS} AS ps FROM embeddings), r AS (SELECT vec_id, ps, 1 AS i, [ps[1]] AS kept FROM p
UNION ALL SELECT vec_id, ps, i + 1, CASE WHEN len(kept) <= 3 AND ps[i + 1].x BETWEEN 30 AND 570 AND ps[i + 1].y BETWEEN 30 AND 570 AND len(list_filter(kept, lambda k: sqrt((k.x - ps[i + 1].x) * (k.x - ps[i + 1].x) + (k.y - ps[i + 1].y) * (k.y - ps[i + 1].y)) < 80)) = 0 THEN list_append(kept, ps[i + 1]) ELSE kept END FROM r WHERE i < 5)
SELECT vec_id, len(kept) - 1 AS n, coalesce(list_sum(list_transform(kept[2:], lambda k: k.x)), 0) AS xs FROM r WHERE i = 5""")(
    lambda spark, d: (lambda pts: emb(spark, d).select("vec_id", pts.alias("ps")).select("vec_id", RC.apart(F.slice("ps", 2, 4), F.col("ps")[0], F.lit(600.0), F.lit(600.0), 30.0, 80.0).alias("k"))
                      .select("vec_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0.0), lambda a, p: a + p["x"]).alias("xs")))(
        F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct(F.floor((F.get("embedding", 2 * k - 1).cast("double") + 0.3) * 1000).cast("double").alias("x"), F.floor((F.get("embedding", 2 * k).cast("double") + 0.3) * 1000).cast("double").alias("y")))))
_DRAW = lambda what, n, lo, hi: f"({lo} + CAST(floor(CAST(('0x' || substr(md5('{what}:' || p_partkey || ':' || {n}), 1, 8)) AS BIGINT) / 4294967296.0 * ({hi} - ({lo}) + 1)) AS BIGINT))"
query("f10_patches", f"""WITH c AS (SELECT p_partkey, 410 + p_partkey % 300 AS iw, 200 + p_partkey % 170 AS ih, {_DRAW('h', 0, 170, 230)} AS h FROM part),
v AS (SELECT *, {_DRAW('x', 0, 0, 'iw - 400')} AS x, {_DRAW('y', 0, 0, 'ih - h')} AS y, 60 AS pw, 40 AS ph FROM c WHERE iw >= 420 AND ih >= h + 20),
t AS (SELECT *, x + 300 AS gx, y + h // 2 AS gy FROM v), s AS (SELECT t.*, n, {_DRAW('dx', 'n', 0, 'iw - pw')} AS dx, {_DRAW('dy', 'n', 0, 'ih - ph')} AS dy FROM t, range(50) AS r(n)),
g AS (SELECT p_partkey, arg_min(dx, n) AS dx, arg_min(dy, n) AS dy FROM s WHERE dx < x + 400 AND x < dx + pw AND dy < y + h AND y < dy + ph AND NOT (dx < gx + pw AND gx < dx + pw AND dy < gy + ph AND gy < dy + ph)
  AND sqrt((dx - gx) * (dx - gx) + (dy - gy) * (dy - gy)) >= 0.5 * least(400, h) GROUP BY 1)
SELECT t.p_partkey, t.x, t.y, t.h, coalesce(g.dx, -1) AS dx, coalesce(g.dy, -1) AS dy FROM t LEFT JOIN g USING (p_partkey)""")(
    lambda spark, d: (table(spark, d, "part").select("p_partkey", (410 + F.col("p_partkey") % 300).alias("iw"), (200 + F.col("p_partkey") % 170).alias("ih"))
                      .withColumn("c", RC.canvas(F.col("p_partkey"), F.col("iw"), F.col("ih"))).where("c is not null")
                      .withColumn("g", F.struct((F.col("c.x") + 300).alias("x"), (F.col("c.y") + F.floor(F.col("c.h") / 2)).alias("y"), F.lit(60).cast("long").alias("w"), F.lit(40).cast("long").alias("h")))
                      .withColumn("o", RC.other_patch(F.col("p_partkey"), F.col("iw"), F.col("ih"), F.col("g"), F.col("c")))
                      .select("p_partkey", "c.x", "c.y", "c.h", F.coalesce("o.x", F.lit(-1)).alias("dx"), F.coalesce("o.y", F.lit(-1)).alias("dy"))))
query("f9_margin", "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND sqrt(power(CAST(embedding[1] AS DOUBLE) - embedding[3], 2) + power(CAST(embedding[2] AS DOUBLE) - embedding[4], 2)) >= 0.15")(
    lambda spark, d: (lambda e: table(spark, d, "embeddings").where(e(0).between(-0.1, 0.1) & (F.sqrt(F.pow(e(0) - e(2), F.lit(2)) + F.pow(e(1) - e(3), F.lit(2))) >= 0.15)).select("vec_id"))(lambda i: F.col("embedding")[i].cast("double")))


@query("f10_rejection_sampling", """WITH t AS (SELECT part.p_partkey, i, (p_partkey * 31 + i * 17) % 41 - 20 AS dx, (p_partkey * 13 + i * 29) % 41 - 20 AS dy FROM part, range(100) r(i)),
u AS (SELECT *, greatest(0, 50 - abs(dx)) * greatest(0, 50 - abs(dy)) AS inter FROM t), v AS (SELECT *, inter / CAST(5000 - inter AS DOUBLE) AS iou FROM u)
SELECT p_partkey, CAST(min(i) AS INTEGER) AS try, arg_min(dx, i) AS dx, arg_min(dy, i) AS dy FROM v WHERE iou BETWEEN 0.2 AND 0.5 GROUP BY 1""")
def _f10(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    t = t.withColumns({"dx": (F.col("p_partkey") * 31 + F.col("i") * 17) % 41 - 20, "dy": (F.col("p_partkey") * 13 + F.col("i") * 29) % 41 - 20})
    box = lambda x, y: (x, y, F.lit(50), F.lit(50))
    return t.where(N.iou(box(F.lit(0), F.lit(0)), box(F.col("dx"), F.col("dy"))).between(0.2, 0.5)).groupBy("p_partkey").agg(F.min("i").alias("try"), F.min_by("dx", "i").alias("dx"), F.min_by("dy", "i").alias("dy"))


query("f11_quota", f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 25 WHEN 'de' THEN 10 ELSE 0 END")(
    lambda spark, d: C.quota(docs(spark, d), "lang", F.col("doc_id"), {"en": 25, "de": 10}).select("doc_id", "lang"))
query("f13_near_ties", "SELECT c_custkey FROM customer WHERE NOT (abs(c_acctbal - 5000) / 5000 < 0.10)")(lambda spark, d: table(spark, d, "customer").where(~(F.abs(F.col("c_acctbal") - 5000) / 5000 < 0.10)).select("c_custkey"))
query("f16_special_tokens", "SELECT vec_id, list_filter(range(64), lambda i: i % 10 NOT IN (0, 3)) AS ids FROM embeddings")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.transform(N.drop_ids(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i), F.col("embedding"), [k for k in range(64) if k % 10 in (0, 3)])[0], lambda x: x.cast("long")).alias("ids")))
query("f17_successful_fetch", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")(lambda spark, d: docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").where("quality is not null").select("doc_id", "quality"))

# ---- joins and set operations -------------------------------------------------------
query("j2_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda spark, d: C.resume(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id"))
query("j3_dimension_joins", "SELECT c_custkey, n_name, coalesce(r_name, 'object') AS region FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")(
    lambda spark, d: table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region").where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", F.coalesce("r_name", F.lit("object")).alias("region")))
query("j4_repair_labels", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'same' END AS status, CASE WHEN doc_id % 10 <> 0 AND doc_id % 7 = 0 THEN 99 ELSE 1 END AS fixed FROM documents")(
    lambda spark, d: C.repair(docs(spark, d).select("doc_id", F.format_string("counting_%s_%05d.png", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train"), F.col("doc_id")).alias("path"), F.lit(1).alias("value")),
                              docs(spark, d).select(F.lit("train").alias("split"), F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 7 == 0, 99).otherwise(1).alias("value")), "path", "value", F.lit("train")).select("doc_id", "status", "fixed"))

# Images for the dedup tests: a vector of 64 components is a thumbnail of 8 x 8 pixels, its signs are the signature. Held-out
# images are those of every fifth row with some pixels turned, so pairs lie on both sides of each threshold.
_IMAGES = """
WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
h AS (SELECT vec_id, list_transform(v, lambda x, k: CASE WHEN ((k - 1) * 7 + vec_id) % 23 = 0 THEN -x * (vec_id % 3) / 2 ELSE x END) AS v FROM i WHERE vec_id % 5 = 0),
both_ AS (SELECT 0 AS held, * FROM i UNION ALL SELECT 1, * FROM h),
parts AS (SELECT held, vec_id, v, false AS blurred, v AS u FROM both_ UNION ALL SELECT held, vec_id, v, true, list_transform(range(1, 65), lambda k: (v[greatest(k - 1, 1)] + v[k] + v[least(k + 1, 64)]) / 3) FROM both_),
img AS (SELECT *, CAST(list_sum(list_transform(range(1, 61), lambda k: CASE WHEN u[k] > 0 THEN CAST(1 AS BIGINT) << CAST(k - 1 AS BIGINT) ELSE 0 END)) AS BIGINT) AS sig FROM parts),
near AS (SELECT a.blurred, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.sig, b.sig)) AS distance, a.u AS x, b.u AS y, a.v AS xv, b.v AS yv
  FROM img a JOIN img b ON a.held = 0 AND b.held = 1 AND a.blurred = b.blurred AND bit_count(xor(a.sig, b.sig)) < 8),
cells AS (SELECT blurred, a, b, w, x[(w // 2 + k // 7) * 8 + w % 2 + k % 7 + 1] * 400 + 128 AS p, y[(w // 2 + k // 7) * 8 + w % 2 + k % 7 + 1] * 400 + 128 AS q FROM near, range(4) AS ws(w), range(49) AS ks(k)),
wins AS (SELECT blurred, a, b, avg(p) AS m, avg(q) AS n, var_samp(p) + var_samp(q) AS v, covar_samp(p, q) AS c FROM cells GROUP BY blurred, a, b, w),
ssim AS (SELECT blurred, a, b, avg((2 * m * n + 6.5025) * (2 * c + 58.5225) / ((m * m + n * n + 6.5025) * (v + 58.5225))) AS s FROM wins GROUP BY blurred, a, b),
alike AS (SELECT blurred, a, b FROM ssim WHERE s > 0.95),
cos AS (SELECT i.vec_id, max(list_cosine_similarity(i.v, h.v)) AS c FROM i, h GROUP BY 1)
"""


def images(spark, d):
    """(candidates, held-out): vec_id, v, sig, thumb, blur_sig, blur_thumb."""
    def looks(df):
        blur = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.get("v", F.greatest(k - 1, F.lit(0))) + F.get("v", k) + F.get("v", F.least(k + 1, F.lit(63)))) / 3)
        sig = lambda c: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c)[k] > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(60)])
        thumb = lambda c: F.transform(c, lambda x: x * 400 + 128)
        return df.withColumn("blur", blur).select("vec_id", "v", sig("v").alias("sig"), thumb("v").alias("thumb"), sig("blur").alias("blur_sig"), thumb("blur").alias("blur_thumb"))
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = F.transform("v", lambda x, k: F.when((k * 7 + F.col("vec_id")) % 23 == 0, -x * (F.col("vec_id") % 3) / 2).otherwise(x))
    return looks(e), looks(e.where("vec_id % 5 = 0").select("vec_id", turned.alias("v")))


@query("j5_perceptual_dedup", _IMAGES + "SELECT i.vec_id, count(n.b) AS links, coalesce(CAST(min(n.distance) AS INTEGER), -1) AS nearest, count(l.b) = 0 AS kept FROM i LEFT JOIN near n ON n.a = i.vec_id AND NOT n.blurred LEFT JOIN alike l ON l.a = n.a AND l.b = n.b AND NOT l.blurred GROUP BY 1")
def _j5(spark, d):
    c, h = images(spark, d)
    return X.signature_links(c, h, "vec_id", "sig").na.fill({"nearest": -1}).join(X.perceptual_keep(c, h, "vec_id", "sig", "thumb"), "vec_id")


_VOTES = ", ".join(f"sum(((h >> {b}) & 1) * 2 - 1) AS v{b}" for b in range(60))
_BITS = " + ".join(f"CASE WHEN v{b} > 0 THEN CAST({1 << b} AS BIGINT) ELSE 0 END" for b in range(60))


@query("j5_near_signatures", f"WITH w AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 15)) AS BIGINT) AS h FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents)), v AS (SELECT doc_id, {_VOTES} FROM w GROUP BY 1), s AS (SELECT doc_id, {_BITS} AS sig FROM v) "
       "SELECT a.doc_id, count(b.doc_id) AS links, coalesce(CAST(min(bit_count(xor(a.sig, b.sig))) AS INTEGER), -1) AS nearest FROM s a LEFT JOIN s b ON b.doc_id % 5 = 0 AND bit_count(xor(a.sig, b.sig)) < 8 WHERE a.doc_id % 5 <> 0 GROUP BY 1")
def _j5s(spark, d):
    path = scratch(spark, "j5")  # read three times
    X.signature(docs(spark, d), "doc_id", "text").write.parquet(path)
    s = spark.read.parquet(path)
    return X.signature_links(s.where("doc_id % 5 <> 0"), s.where("doc_id % 5 = 0"), "doc_id", "sig").na.fill({"nearest": -1})


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
query("j6_max_cosine", f"SELECT a.vec_id, round(max({_COS}), 5) AS max_sim, max({_COS}) < 0.4 AS kept FROM embeddings a, embeddings b WHERE b.vec_id % 5 = 0 GROUP BY 1")(
    lambda spark, d: (lambda e: X.cosine_keep(e, e.where("vec_id % 5 = 0"), "vec_id", "embedding", 0.4).select("vec_id", F.round("max_sim", 5).alias("max_sim"), "kept"))(table(spark, d, "embeddings")))


@query("j7_swapped_pairs", _IMAGES + """, n AS (SELECT l.a, l.b FROM alike l JOIN near n ON NOT l.blurred AND NOT n.blurred AND l.a = n.a AND l.b = n.b AND list_cosine_similarity(n.xv, n.yv) >= 0.95),
hp AS (SELECT vec_id AS hid, CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 5 END AS s, CASE WHEN vec_id % 2 = 0 THEN vec_id + 5 ELSE vec_id END AS t FROM i WHERE vec_id % 5 = 0)
SELECT DISTINCT c.vec_id AS pid FROM i c JOIN n p ON p.a = c.vec_id JOIN n q ON q.a = c.vec_id + 5 JOIN hp ON (hp.s = p.b AND hp.t = q.b) OR (hp.s = q.b AND hp.t = p.b)""")
def _j7(spark, d):
    c, h = images(spark, d)
    odd = F.col("vec_id") % 2 == 1
    held = h.select(F.col("vec_id").alias("hid"), F.when(odd, F.col("vec_id") + 5).otherwise(F.col("vec_id")).alias("s"), F.when(odd, F.col("vec_id")).otherwise(F.col("vec_id") + 5).alias("t"))
    return X.swapped_pairs(c.select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("s"), (F.col("vec_id") + 5).alias("t")), held, X.alike_members(c, h, "vec_id", "v", "sig", "thumb"))


query("j8_all_members", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 3 <> 0")(
    lambda spark, d: (lambda p: C.all_members_kept(p.withColumn("k", F.struct("l_orderkey", "l_partkey", "l_suppkey")), "k", ["l_partkey", "l_suppkey"], p.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("m")).where("m % 3 <> 0"), "m").drop("k"))(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()))
query("j9_adjacent_pairs", f"WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {h42('doc_id')}, doc_id) - 1 AS r FROM documents) SELECT a.lang, a.r // 2 AS pair, a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.lang = b.lang AND a.r % 2 = 0 AND b.r = a.r + 1 AND a.source <> b.source")(
    lambda spark, d: C.adjacent_pairs(docs(spark, d), "lang", "doc_id", "source").select("lang", "pair", "a", "b"))
query("j11_index_pairs", "SELECT i, j FROM range(1, 7) a(i), range(1, 7) b(j) WHERE j - i >= 2")(lambda spark, d: spark.range(1, 7).select(F.col("id").alias("i"), F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")), lambda j: j - F.col("id") >= 2)).alias("j")))
query("u1_merge_corpora", f"SELECT doc_id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY {h42('doc_id')}, doc_id) AS INTEGER) AS pos FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM documents)")(
    lambda spark, d: (lambda x: x.where("doc_id % 2 = 0").withColumn("split", F.lit("train")).unionByName(x.where("doc_id % 2 = 1").withColumn("split", F.lit("val")), allowMissingColumns=True))(docs(spark, d).select("doc_id"))
    .withColumn("pos", F.row_number().over(Window.partitionBy("split").orderBy(N.seeded(F.col("doc_id")), "doc_id"))))


@query("u2_composite_dedup", _IMAGES + "SELECT i.vec_id, NOT (cos.c >= 0.95 AND count(l.b) > 0) AS kept FROM i JOIN cos USING (vec_id) LEFT JOIN alike l ON l.a = i.vec_id GROUP BY i.vec_id, cos.c")
def _u2(spark, d):
    c, h = images(spark, d)
    return X.composite_keep(c, h, "vec_id", "v", "sig", "thumb", ("blur_sig", "blur_thumb"))


query("u3_entity_split", f"WITH e AS (SELECT l_suppkey, row_number() OVER (ORDER BY {h42('l_suppkey')}, l_suppkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT lineitem.l_suppkey) AS e FROM lineitem JOIN e USING (l_suppkey) GROUP BY 1")(
    lambda spark, d: C.entity_split(table(spark, d, "lineitem"), "l_suppkey").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("e")))
query("u4_bag_union", "SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 10 = 0")(lambda spark, d: (lambda e: e.unionAll(e.where("event_id % 10 = 0")))(table(spark, d, "events").select("event_id")))
query("u5_token_sets", r"WITH t AS (SELECT sample_index, traj, list_distinct(string_split(a1, ' ')) AS p, list_distinct(string_split(a2, ' ')) AS g FROM sr) SELECT sample_index, traj, len(list_filter(p, lambda x: list_contains(g, x))) AS both_, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS only_ FROM t".replace("WITH t", D.SR.strip() + ", t", 1))(
    lambda spark, d: (lambda p, g: rollouts(spark, d).select("sample_index", "traj", F.size(F.array_intersect(p, g)).cast("long").alias("both_"), F.size(F.array_except(p, g)).cast("long").alias("only_")))(F.split("a1", " "), F.split("a2", " ")))
query("x_contaminated", "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text))")(lambda spark, d: X.contaminated(docs(spark, d), table(spark, d, "benchmark"), "doc_id", "text", "text"))
query("x_contaminated_short", "WITH s AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 1, 1 + item_id % 4), ' ') AS t FROM benchmark) SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM s WHERE contains(documents.text, s.t))")(
    lambda spark, d: X.contaminated(docs(spark, d), table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), F.lit(1), (1 + F.col("item_id") % 4).cast("int")), " ").alias("t")), "doc_id", "text", "t"))

# ---- aggregates -----------------------------------------------------------------------
query("a3_shares", "SELECT lang, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS share FROM documents GROUP BY 1")(
    lambda spark, d: (lambda x: x.groupBy("lang").agg(F.count("*").alias("c")).crossJoin(F.broadcast(x.agg(F.count("*").alias("t")))).select("lang", F.round(100.0 * F.col("c") / F.greatest("t", F.lit(1)), 1).alias("share")))(docs(spark, d)))
query("a5_distribution", "SELECT CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1")(lambda spark, d: table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n")).orderBy("q"))
query("a16_mode_smallest", "SELECT l_suppkey, arg_min(l_linenumber, -n * 1000 + l_linenumber) AS mode, max(n) AS n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")(lambda spark, d: C.mode_smallest(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber"))
query("a17_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")(
    lambda spark, d: table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("l_extendedprice", F.lit(0.95)), 4).alias("p95")))
query("a21_distinct_first_seen", "SELECT lang, min(doc_id) AS first_seen FROM documents GROUP BY 1")(lambda spark, d: docs(spark, d).groupBy("lang").agg(F.min("doc_id").alias("first_seen")))

# ---- order, splits, windows --------------------------------------------------------------
query("t2_prefix_split", f"SELECT doc_id, CASE WHEN r <= 50 THEN 'train' WHEN r <= 60 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {h42('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 75")(
    lambda spark, d: C.prefix_split(docs(spark, d), ["lang"], "doc_id", 50, 10, 15).select("doc_id", "split"))
query("t3_max_lines", "SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 40)")(lambda spark, d: (lambda p: (docs(spark, d).coalesce(1).select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value")).write.text(p), S.read_jsonl_tolerant(spark, p, SMALL, 40).agg(F.count("*").alias("n")))[1])(scratch(spark, "t3")))
query("t4_holdout_tail", "SELECT event_id, event_id >= (SELECT count(*) FROM events) - greatest(1, CAST(floor(0.03 * (SELECT count(*) FROM events)) AS BIGINT)) AS is_val FROM events")(lambda spark, d: C.holdout_tail(table(spark, d, "events").select("event_id"), "event_id", 0.03))
query("t5_shards", "SELECT CAST(event_id // ((SELECT count(*) FROM events) // 7) AS INTEGER) AS shard, count(*) AS n FROM events WHERE event_id // ((SELECT count(*) FROM events) // 7) < 7 GROUP BY 1")(
    lambda spark, d: (lambda e: C.shard(e, "event_id", e.count(), 7).groupBy("shard").agg(F.count("*").alias("n")))(table(spark, d, "events")))
query("t6_resume_offset", "SELECT event_id FROM events WHERE event_id >= 16 * 8")(lambda spark, d: G.resume_offset(table(spark, d, "events").select("event_id"), "event_id", 16, 8))
query("t7_sorted_lists", "SELECT DISTINCT lang FROM documents ORDER BY 1")(lambda spark, d: docs(spark, d).select("lang").distinct().orderBy("lang"))
query("t8_first_match", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS hit FROM embeddings")(lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > 0.2).alias("hit")))
query("w6_ema", """WITH RECURSIVE s AS (SELECT event_id % 16 AS k, event_id // 16 AS i, value FROM events), r AS (SELECT k, i, value AS ema FROM s WHERE i = 0
UNION ALL SELECT s.k, s.i, 0.95 * r.ema + 0.05 * s.value FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1) SELECT k, i, round(ema + 1e-9, 5) AS ema FROM r""")(
    lambda spark, d: G.smoothed(table(spark, d, "events").select((F.col("event_id") % 16).alias("k"), F.floor(F.col("event_id") / 16).alias("i"), "value"), ["k"], "i", "value").select("k", "i", F.round(F.col("ema") + 1e-9, 5).alias("ema")))
query("w7_priority_sample", """WITH e AS (SELECT c_custkey, pow(abs(c_acctbal), 1.0) + 1e-6 AS w FROM customer ORDER BY c_custkey LIMIT 256), r AS (SELECT c_custkey, sum(w) OVER (ORDER BY c_custkey) AS hi, sum(w) OVER (ORDER BY c_custkey) - w AS lo, sum(w) OVER () AS t FROM e),
u AS (SELECT CAST(('0x' || substr(md5('42:' || draw), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM range(1000) AS d(draw)) SELECT c_custkey, count(*) AS n FROM u JOIN r ON u * t >= lo AND u * t < hi GROUP BY 1""")(
    lambda spark, d: G.priority_draws(table(spark, d, "customer").orderBy("c_custkey").limit(256), 1000, "c_custkey", "c_acctbal").groupBy("c_custkey").agg(F.count("*").alias("n")))
query("w8_fifo", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 256")(lambda spark, d: G.last_rows(table(spark, d, "events").select("event_id"), "event_id", 256))
query("w9_stratified", f"WITH r AS (SELECT doc_id, lang, {h42('doc_id')} AS h, row_number() OVER (PARTITION BY lang ORDER BY {h42('doc_id')}, doc_id) AS r FROM documents) SELECT doc_id, lang FROM r ORDER BY r > 20, h, doc_id LIMIT 90")(
    lambda spark, d: C.stratified(docs(spark, d), "lang", "doc_id", 20, 90).select("doc_id", "lang"))
query("w10_early_stop", """WITH RECURSIVE s AS (SELECT event_id AS i, value AS x FROM events WHERE event_id < 60), r AS (SELECT i, x, x AS best, 0 AS since_best FROM s WHERE i = 0
UNION ALL SELECT s.i, s.x, CASE WHEN s.x < r.best - 0.01 THEN s.x ELSE r.best END, CASE WHEN s.x < r.best - 0.01 THEN 0 ELSE r.since_best + 1 END FROM r JOIN s ON s.i = r.i + 1) SELECT i AS event_id, x AS value, best, since_best, since_best >= 5 AS stop FROM r""")(
    lambda spark, d: G.early_stop(table(spark, d, "events").where("event_id < 60"), "event_id", "value"))
query("w11_warmup", "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0 ELSE 1 END * 0.001, 9) AS lr FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.round(N.warmup(F.col("event_id"), 100, 0.001), 9).alias("lr")))
query("w12_trend", "SELECT w, round(avg(value), 6) AS mean FROM (SELECT value, CAST((row_number() OVER (ORDER BY event_id) - 1) * 10 // (SELECT count(*) FROM events) AS INTEGER) AS w FROM events) GROUP BY 1")(
    lambda spark, d: G.windowed_trend(table(spark, d, "events"), "event_id", "value").select("w", F.round("mean", 6).alias("mean")))
query("w13_early_late", "WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events) SELECT round(avg(value) FILTER (p < greatest(1, n // 10)) - avg(value) FILTER (p >= n - greatest(1, n // 10)), 6) AS delta FROM n")(
    lambda spark, d: G.early_late(table(spark, d, "events"), "event_id", "value").select(F.round("delta", 6).alias("delta")))

# ---- arithmetic -----------------------------------------------------------------------------
query("p30_to_unit", "SELECT c_custkey, round(least(greatest((c_acctbal + 999) / 10999.0, 0), 1), 6) AS x FROM customer")(lambda spark, d: table(spark, d, "customer").select("c_custkey", F.round(N.to_unit(F.col("c_acctbal"), -999, 10000), 6).alias("x")))
query("p31_majority", "SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN 'A' WHEN c_nationkey < 12 THEN 'B' END AS v FROM customer")(lambda spark, d: table(spark, d, "customer").select("c_custkey", N.majority(F.col("c_nationkey"), F.lit(12)).alias("v")))
query("p32_iou", "SELECT vec_id, vec_id % 20 < 10 AND vec_id % 7 < 5 AS hit, round(greatest(0, 10 - vec_id % 20) * greatest(0, 5 - vec_id % 7) / (100.0 - greatest(0, 10 - vec_id % 20) * greatest(0, 5 - vec_id % 7)), 6) AS iou FROM embeddings")(
    lambda spark, d: (lambda a, b: emb(spark, d).select("vec_id", N.intersects(a, b).alias("hit"), F.round(N.iou(a, b), 6).alias("iou")))((F.lit(0), F.lit(0), F.lit(10), F.lit(5)), (F.col("vec_id") % 20, F.col("vec_id") % 7, F.lit(10), F.lit(5))))
query("p33_resize", "SELECT c_custkey, CASE WHEN w * h <= 250000 THEN w ELSE CAST(floor(w * sqrt(250000.0 / (w * h))) AS BIGINT) END AS w FROM (SELECT c_custkey, 300 + c_custkey % 900 AS w, 200 + c_custkey % 700 AS h FROM customer)")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", N.resized(300 + F.col("c_custkey") % 900, 200 + F.col("c_custkey") % 700, 250000)[0].alias("w")))


@query("p34_homography", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE), 4) + 0.0 AS y FROM embeddings")
def _p34(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    h = [F.lit(2.0) + e(3), F.lit(0.1), F.lit(3.0), F.lit(0.2), F.lit(1.5), F.lit(1.0), F.lit(0.01), F.lit(0.02), F.lit(1.0)]
    x, y = N.warp(*N.warp(e(0), e(1), h), N.inverse3(h))
    return emb(spark, d).select("vec_id", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


query("p35_luminance", "SELECT vec_id, round(0.2126 * f(vec_id % 256) + 0.7152 * f(vec_id % 100) + 0.0722 * f(7), 6) AS l FROM embeddings".replace("f(vec_id % 256)", "pow((vec_id % 256 / 255.0 + 0.055) / 1.055, 2.4)").replace("f(vec_id % 100)", "CASE WHEN vec_id % 100 / 255.0 <= 0.04045 THEN vec_id % 100 / 255.0 / 12.92 ELSE pow((vec_id % 100 / 255.0 + 0.055) / 1.055, 2.4) END").replace("f(7)", "(7 / 255.0 / 12.92)").replace("pow((vec_id % 256", "CASE WHEN vec_id % 256 / 255.0 <= 0.04045 THEN vec_id % 256 / 255.0 / 12.92 ELSE pow((vec_id % 256", 1).replace("2.4) + 0.7152", "2.4) END + 0.7152", 1))(
    lambda spark, d: emb(spark, d).select("vec_id", F.round(N.luminance(F.col("vec_id") % 256, F.col("vec_id") % 100, F.lit(7)), 6).alias("l")))
query("p35_disk_mean", """WITH d AS (SELECT vec_id, vec_id % 8 AS cx, vec_id // 8 % 8 AS cy, embedding FROM embeddings), c AS (SELECT vec_id, CAST(embedding[(y * 8 + x) + 1] AS DOUBLE) * 2 + 0.5 AS v FROM d, range(8) AS a(x), range(8) AS b(y) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 4)
SELECT vec_id, round(avg(v * v), 6) AS mean FROM c GROUP BY 1""")(
    lambda spark, d: emb(spark, d).select("vec_id", F.round(RC.disk_mean(F.col("embedding"), 8, 8, F.col("vec_id") % 8, F.floor(F.col("vec_id") / 8) % 8, 2, lambda v: (v.cast("double") * 2 + 0.5) * (v.cast("double") * 2 + 0.5)), 6).alias("mean")))
_TASKS = list(RC.QUESTIONS)
_Q = lambda t: "'" + RC.QUESTIONS[t].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
query("p22_questions", "SELECT doc_id, replace(CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {_Q(t)}" for i, t in enumerate(_TASKS)) + " END, '{}', lang) AS question FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", RC.question(F.element_at(F.array(*map(F.lit, _TASKS)), (F.col("doc_id") % 9 + 1).cast("int")), F.col("lang")).alias("question")))
query("p21_records", "SELECT doc_id, concat('{\"question\":\"Q ', lang, '\",\"ground_truth\":\"', CASE WHEN doc_id % 3 = 0 THEN '(B)' WHEN doc_id % 3 = 1 THEN '12' ELSE '(B)' END, '\",\"answer_type\":\"mcq\",\"choices\":\"(A) 3, (B) 5\",\"images\":[\"/i/', doc_id, '.png\"],\"dataset_name\":\"', source, '\",\"split\":\"train\"}') AS record FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", F.to_json(RC.record(F.concat(F.lit("Q "), "lang"), F.element_at(F.array(F.lit("B"), F.lit("12"), F.lit("(B)")), (F.col("doc_id") % 3 + 1).cast("int")), F.array(F.lit("(A) 3"), F.lit("(B) 5")),
                                                                         F.concat(F.lit("/i/"), "doc_id", F.lit(".png")), F.col("source"), F.lit("train"))).alias("record")))
query("p36_shuffled_choices", "WITH o AS (SELECT vec_id, list_transform(list_sort(list_transform(range(0, 4), lambda i: md5(concat(vec_id, ':', i)) || i)), lambda x: CAST(x[33:33] AS INTEGER)) AS \"order\" FROM embeddings) SELECT vec_id, \"order\", CAST(list_position(\"order\", CAST(vec_id % 4 AS INTEGER)) AS INTEGER) - 1 AS pos FROM o")(
    lambda spark, d: (lambda o: emb(spark, d).select("vec_id", o[0].alias("order"), o[1].alias("pos")))(N.shuffled_choices(F.col("vec_id"), 4, F.col("vec_id") % 4)))
_LP = "list_transform(range(1, 33), lambda i: CAST(embedding[i] AS DOUBLE))", "list_transform(range(33, 65), lambda i: CAST(embedding[i] AS DOUBLE))"
query("p37_kl", f"SELECT vec_id, round(list_sum(list_transform(list_zip({_LP[0]}, {_LP[1]}), lambda p: exp(p[1] - p[2]) - (p[1] - p[2]) - 1)) / 32, 6) AS kl FROM embeddings")(
    lambda spark, d: emb(spark, d).select("vec_id", F.round(N.kl_term(F.slice("embedding", 1, 32).cast("array<double>"), F.slice("embedding", 33, 32).cast("array<double>"), 32.0), 6).alias("kl")))
query("p38_surrogate", f"SELECT vec_id, round(-list_sum(list_transform(list_zip({_LP[0]}, {_LP[1]}), lambda p: least(exp(p[1] - p[2]) * label, least(greatest(exp(p[1] - p[2]), 0.8), 1.2) * label))) / 32, 6) + 0.0 AS loss FROM embeddings")(
    lambda spark, d: emb(spark, d).select("vec_id", (F.round(N.surrogate(F.slice("embedding", 1, 32).cast("array<double>"), F.slice("embedding", 33, 32).cast("array<double>"), F.col("label"), 32.0), 6) + 0.0).alias("loss")))
query("p39_aligned", "SELECT vec_id, vec_id % 3 <> 0 AS ok FROM embeddings")(lambda spark, d: emb(spark, d).select("vec_id", N.aligned(F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 3 == 0, 10).otherwise(32)), F.slice("embedding", 33, 32)).alias("ok")))
query("p40_pixel", "SELECT vec_id, CAST(round_even(vec_id % 8 / 8.0 * 100, 0) AS BIGINT) AS px FROM embeddings")(lambda spark, d: emb(spark, d).select("vec_id", N.pixel(F.col("vec_id") % 8 / 8.0, F.lit(100)).alias("px")))
query("p41_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) + 0.0 AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda spark, d: emb(spark, d).alias("a").join(emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id").select("vec_id", (F.round(N.cosine(F.col("embedding"), F.col("e2")), 5) + 0.0).alias("cos")))


# ---- streams: the same results as a batch ------------------------------------------------------
@query("st_running_metrics", D.SR + "SELECT dataset_name, count(*) AS total_trajectories, round(avg(CASE WHEN traj % 2 = 0 THEN 1 ELSE 0 END), 6) AS a1_accuracy, round(avg(CASE WHEN traj % 3 = 0 THEN 1 ELSE 0 END), 6) AS a2_accuracy FROM sr GROUP BY 1")
def _st(spark, d):
    path, out = scratch(spark, "st"), "millrace_running"
    r = rollouts(spark, d).select("sample_index", "traj", "dataset_name", (F.col("traj") % 2 == 0).alias("a1_correct"), (F.col("traj") % 3 == 0).alias("a2_correct"))
    r.repartition(3).write.json(path)
    log = ST.read_log(spark, path, "sample_index long, traj long, dataset_name string, a1_correct boolean, a2_correct boolean")
    ST.running_metrics(log, "dataset_name").writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "st-ck")).start().awaitTermination()
    return spark.table(out).select("dataset_name", "total_trajectories", F.round("a1_accuracy", 6).alias("a1_accuracy"), F.round("a2_accuracy", 6).alias("a2_accuracy"))


@query("st_exactly_once", D.SR + "SELECT sample_index, traj FROM sr")
def _sx(spark, d):
    path, out, ck = scratch(spark, "sx"), scratch(spark, "sx-out"), scratch(spark, "sx-ck")
    rollouts(spark, d).select("sample_index", "traj").repartition(2).write.json(path)
    log = ST.read_log(spark, path, "sample_index long, traj long")
    for _ in range(2):  # the second run finds nothing new
        ST.append_batches(log, out, ck, ["sample_index", "traj"]).awaitTermination()
    return spark.read.parquet(out).select("sample_index", "traj")


@query("st_keys_once_over_batches", D.SR + "SELECT sample_index, traj FROM sr")
def _sk(spark, d):
    path, out, ck = scratch(spark, "sk"), scratch(spark, "sk-out"), scratch(spark, "sk-ck")
    r = rollouts(spark, d).select("sample_index", "traj")
    for part in (r.where("traj < 5"), r.where("traj > 2"), r):  # three files, so three micro-batches, that repeat keys
        part.coalesce(1).write.mode("append").json(path)
    ST.append_batches(ST.read_log(spark, path, "sample_index long, traj long"), out, ck, ["sample_index", "traj"]).awaitTermination()
    return spark.read.parquet(out).select("sample_index", "traj")


@query("st_running_average", """WITH RECURSIVE s AS (SELECT event_id % 16 AS k, event_id // 16 AS i, value FROM events), r AS (SELECT k, i, value AS ema FROM s WHERE i = 0
UNION ALL SELECT s.k, s.i, 0.95 * r.ema + 0.05 * s.value FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1) SELECT k, max(i) + 1 AS n, round(arg_max(ema, i) + 1e-9, 5) AS ema FROM r GROUP BY 1""")
def _sr(spark, d):
    path, out = scratch(spark, "sa"), scratch(spark, "sa-out")
    e = table(spark, d, "events").select((F.col("event_id") % 16).alias("k"), F.floor(F.col("event_id") / 16).alias("i"), "value")
    half = e.agg(F.max("i")).first()[0] // 2
    for part in (e.where(F.col("i") <= half), e.where(F.col("i") > half)):  # files arrive in order
        part.coalesce(1).write.mode("append").json(path)
    ST.running_average(ST.read_log(spark, path, "k long, i long, value double"), "k", "i", "value").writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "sa-ck")).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("k").agg(F.max("n").alias("n"), F.round(F.max_by("ema", "n") + 1e-9, 5).alias("ema"))


@query("st_windowed_counts", "SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def _sw(spark, d):
    path, out = scratch(spark, "sw"), scratch(spark, "sw-out")
    table(spark, d, "events").select("event_type", "ts").repartition(3).write.json(path)
    log = ST.read_log(spark, path, "event_type string, ts timestamp", 3)
    name = "millrace_windows"
    ST.windowed_counts(log, "ts", "1 hour", "10 minutes", "event_type").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", out).start().awaitTermination()
    return spark.table(name).select("event_type", F.floor(F.unix_timestamp(F.from_utc_timestamp("window.start", F.current_timezone())) / 3600).alias("hour"), "n")


# ---- the rest of the inventory: resume scans, split loads, folders, configurations, nested and long forms ----
@query("s4_resume_scan", "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 50 <> 7")
def _s4(spark, d):
    path = scratch(spark, "s4")
    done = F.to_json(F.struct("doc_id"))
    docs(spark, d).where("doc_id % 4 <> 0").select(F.when(F.col("doc_id") % 50 == 7, F.lit("{cut off")).otherwise(done).alias("value")).write.text(path)
    return S.read_jsonl_tolerant(spark, path, "doc_id long").select("doc_id").distinct()


@query("s14_split_loads", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def _s14(spark, d):
    path = scratch(spark, "s14")
    docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train").alias("split")).write.partitionBy("split").parquet(path)
    parts = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


@query("s17_folder_scan", "SELECT concat('lang=', lang) AS label, sum(1) > 0 AS found FROM documents GROUP BY 1")
def _s17(spark, d):
    path = scratch(spark, "s17")
    docs(spark, d).select("doc_id", "lang").repartition(1).write.partitionBy("lang").json(path)
    return S.images(spark, path, "*.json").groupBy("label").agg((F.count("*") > 0).alias("found"))


@query("s22_configuration", "SELECT 'response' AS name, CAST(0.27 AS DOUBLE) AS a1_correctness, CAST(0.4 AS DOUBLE) AS no_regression, 42 AS seed")
def _s22(spark, d):
    from millrace.operators.rewards import ResponseWeights
    path = scratch(spark, "s22")
    S.write_config(spark, {"name": "response", "weights": ResponseWeights(), "seed": 42}, path, ("name", "seed"))
    c = S.read_config(spark, path)
    return spark.createDataFrame([(c["name"], c["weights"]["a1_correctness"], c["weights"]["no_regression"], c["seed"])], "name string, a1_correctness double, no_regression double, seed int")


@query("s15_fetch_once", "SELECT doc_id, 2 AS runs FROM documents")
def _s15(spark, d):
    path, runs = scratch(spark, "s15"), []

    def fetch(to: str) -> None:
        runs.append(to)
        docs(spark, d).select("doc_id").write.mode("overwrite").parquet(f"{to}/rows")
        if len(runs) == 1:
            raise OSError("cut short")
    try:
        S.fetch_once(spark, path, fetch)
    except OSError:
        pass
    S.fetch_once(spark, path, fetch)  # not marked, so again
    S.fetch_once(spark, path, fetch)  # marked
    return spark.read.parquet(f"{path}/rows").withColumn("runs", F.lit(len(runs)))


@query("s16_rebuild_and_merge", "SELECT doc_id, lang AS task, lang IN ('de', 'fr') AS again FROM documents WHERE doc_id % 5 <> 0")
def _s16(spark, d):
    root, merged = scratch(spark, "s16"), scratch(spark, "s16-merged")
    task = lambda t, again: docs(spark, d).where(F.col("lang") == t).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"), F.lit(again).alias("again"))
    S.rebuild(spark, root, {t: task(t, False) for t in ("de", "en", "es", "fr")}, merged)
    return S.rebuild(spark, root, {t: task(t, True) for t in ("de", "fr")}, merged).select("doc_id", F.col("task").cast("string").alias("task"), "again")


@query("s23_task_loop", "SELECT lang AS task, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1")
def _s23(spark, d):
    path, out = scratch(spark, "s23"), None
    for task in ("de", "fr"):
        S.write_tsv(docs(spark, d).where(F.col("lang") == task).select("doc_id", "lang"), f"{path}/{task}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for task in ("de", "fr", "xx"):  # a missing input is skipped
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{task}")):
            t = S.read_tsv(spark, f"{path}/{task}").select(F.lit(task).alias("task"))
            out = t if out is None else out.unionByName(t)
    return out.groupBy("task").agg(F.count("*").alias("n"))


query("a4_manifest_counts", "SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM documents GROUP BY GROUPING SETS ((1, 2), (1))")(
    lambda spark, d: C.manifest(docs(spark, d).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val")), "source", "split"))
query("a10d_metrics_long", D.SR + "SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT avg(CASE WHEN traj % 2 = 0 THEN 1.0 ELSE 0 END) AS a1_accuracy, avg(CASE WHEN traj % 3 = 0 THEN 1.0 ELSE 0 END) AS a2_accuracy, avg(CASE WHEN traj % 6 = 0 THEN 1.0 ELSE 0 END) AS rr_rate FROM sr) ON COLUMNS(*) INTO NAME metric VALUE value)")(
    lambda spark, d: G.transition_metrics(rollouts(spark, d).select((F.col("traj") % 2 == 0).alias("a1_correct"), (F.col("traj") % 3 == 0).alias("a2_correct"))).unpivot([], ["a1_accuracy", "a2_accuracy", "rr_rate"], "metric", "value").select("metric", F.round("value", 6).alias("value")))
query("m7_nested_rollouts", D.SR + "SELECT sample_index, list(a1 ORDER BY traj) AS answers FROM sr GROUP BY 1")(
    lambda spark, d: rollouts(spark, d).groupBy("sample_index").agg(F.sort_array(F.collect_list(F.struct("traj", "a1"))).alias("x")).select("sample_index", F.transform("x", lambda e: e["a1"]).alias("answers")))
query("m7_long_rollouts", D.SR + "SELECT sample_index, CAST(traj AS INTEGER) AS traj, a1 FROM sr")(
    lambda spark, d: rollouts(spark, d).groupBy("sample_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("traj", "a1"))), lambda e: e["a1"]).alias("x")).select("sample_index", F.posexplode("x").alias("traj", "a1")))
query("t1_seeded_order", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY {h42('doc_id')}, doc_id) AS INTEGER) AS pos FROM documents")(
    lambda spark, d: docs(spark, d).select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(N.seeded(F.col("doc_id")), "doc_id")).alias("pos")))
query("t9_natural_order", "SELECT * FROM (VALUES (0, 'image'), (1, 'image_2'), (2, 'image_10')) AS t(pos, name)")(
    lambda spark, d: S.image_cells(spark.range(1).select("id", *[F.lit(c.encode()).alias(c) for c in ("image_10", "image", "image_2")]), "id").select("pos", F.col("bytes").cast("string").alias("name")))
query("u6_merged_folders", "SELECT doc_id, lang FROM documents")(lambda spark, d: (lambda x: x.where("lang = 'en'").union(x.where("lang <> 'en'")))(docs(spark, d).select("doc_id", "lang")))
query("v9_short_pairs", D.SR + f", t AS (SELECT sample_index, traj, len(list_filter(string_split({D.norm('a1')}, ' '), lambda w: w <> '')) AS p, len(list_filter(string_split({D.norm('a2')}, ' '), lambda w: w <> '')) AS g FROM sr) SELECT sample_index, traj, p BETWEEN 1 AND 3 AND g BETWEEN 1 AND 3 AS short FROM t")(
    lambda spark, d: rollouts(spark, d).select("sample_index", "traj", (F.size(T.words(F.col("a1"))).between(1, 3) & F.size(T.words(F.col("a2"))).between(1, 3)).alias("short")))
query("d1_line_drift", "SELECT doc_id FROM documents WHERE doc_id % 50 <> 7")(
    lambda spark, d: (lambda p: (docs(spark, d).coalesce(1).sortWithinPartitions("doc_id").select(F.when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.to_json(F.struct("doc_id", "lang", "text"))).alias("value")).write.text(p),
                                 S.read_jsonl_tolerant(spark, p, SMALL).where("line = doc_id").select("doc_id"))[1])(scratch(spark, "d1")))
