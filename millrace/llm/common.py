"""Helpers shared by the training-data operators: shared storage, hashing, components.

Everything here is safe against lost executors: intermediate tables are written
as Parquet to the shared folder named by ``spark.checkpoint.dir``, never to a
local one, and nothing is cached in a single copy.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; there is none to fall back on."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # one machine: any folder of it is shared by all of the session
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever they run: Spark's file server hands it out once a session.
    Arrow batches of whole texts are kept small, unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default, made for narrow rows
        spark.conf.set(ARROW_ROWS, "1000")
    if str(spark.conf.get(ARROW_BYTES)) == "67108864b":  # held several times over, on both sides, by every task
        spark.conf.set(ARROW_BYTES, "8m")
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="millrace-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(name)
    sc._millrace_shipped = True


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.
    ``by``: a column of few values that later plans filter on. The table goes when the session's JVM ends, if not before (``unstage``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            while "=" in path.getName():
                path = path.getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Free the disk of shuffles that no plan needs any more: Spark deletes their files once the driver's JVM collects what names them."""
    spark._jvm.System.gc()


#: A table of so many bytes or fewer is dealt out anew before costly work on its texts.
SMALL = 24 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small: a small file may be a single unit of reading. Larger tables are left as they lie."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of a value's text, modulo ``m``; -1 for null."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % m, F.lit(-1))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list ``(a, b)`` of longs: ``(node, component)``.

    Alternates large-star and small-star steps, so the number of rounds grows
    with the logarithm of a component's size; component is its smallest node.
    Each round is a written table; only a count reaches the driver.
    """
    cur = staged(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                 .where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: each node links its larger neighbours to its smallest neighbour (itself included)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small-star: each node links itself and its smaller neighbours to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nxt = staged(small, "edges")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


#: Buckets of a key filter; the broadcast holds at most so many numbers.
FILTER_BUCKETS = 1 << 20


def may_match(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``: no row with a match is lost, most others are.

    Only hash buckets are broadcast, at most FILTER_BUCKETS of them whatever the
    size of ``keys``; with many more keys the filter passes everything.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS))
    hit = keys.select(bucket.alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket).join(F.broadcast(hit), "_bucket", "left_semi").drop("_bucket")
