"""Token counts as delta-maintained rollups (operator 8).

A delta is a signed change of one document's count under one tokenizer version:
an insert adds the document and its tokens, a delete takes both away, a revision
adds the difference. A batch of deltas becomes one small table of additive sums
by source, language and tokenizer version, partly summed before the shuffle, and
is committed under its batch id: the table is written under a name of its own
and renamed, so a batch is there whole or not at all, and a batch id that is
there already is skipped. A mark inside the table tells its writer whether the
table under that name is its own, so of several writers of one batch one wins.
Totals are the sum of all committed tables, and of the base that ``compact`` folds
older ones into. A base lists the batches it holds, both from one look at the
folder; what is committed meanwhile is in neither and keeps its own table.

Defined results: null text counts no token; null source or language is a group
of its own; a delta without a count changes nothing but the number of documents;
groups whose documents have all gone show zeros. Rows that repeat a doc_id are
documents of their own. Very long texts are counted whole. A change of a kind that
is not known is an error. An empty table gives no group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, ship, spread, staged
from .packing import encoder

KEYS = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """Signed deltas of ``changes``: op (insert, delete, revise), KEYS, n_tokens and, for a revision, old_tokens."""
    n, old, op = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0)), F.col("op")
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null")))).cast("long")
    by_op = lambda insert, delete, revise: F.when(op == "insert", insert).when(op == "delete", delete).when(op == "revise", revise).otherwise(wrong).cast("long")
    return changes.select(*KEYS, by_op(F.lit(1), F.lit(-1), F.lit(0)).alias("d_docs"), by_op(n, -n, n - old).alias("d_tokens"))


class Rollup:
    """Totals kept in a folder of Spark's own storage."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def state(self) -> tuple[str | None, list[str], list[str]]:
        """The folder at one look: the latest base, the ids it holds, and ids of batches beside it."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        base = max((n for n in names if n.startswith("base-")), default=None)
        held = [r[0] for r in self.spark.read.parquet(f"{self.path}/{base}/batches").collect()] if base else []  # a row a batch
        return base, sorted(held), sorted({n[6:] for n in names if n.startswith("batch=")} - set(held))

    def batches(self) -> list[str]:
        """Ids of committed batches, those folded into the base included."""
        _, held, beside = self.state()
        return sorted({*held, *beside})

    def _put(self, tables: dict[str, DataFrame], name: str) -> bool:
        """Writes tables (by their names within) and gives them a name; False if the name is taken."""
        mine = uuid.uuid4().hex
        tmp, to = f"{self.path}/_tmp-{mine}", f"{self.path}/{name}"
        for part, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp}/{part}".rstrip("/"))
        self._fs.create(self._path(f"{tmp}/_owner-{mine}")).close()
        if not self._fs.exists(self._path(to)):
            self._fs.rename(self._path(tmp), self._path(to))
        won = self._fs.exists(self._path(f"{to}/_owner-{mine}"))
        if not won:  # the folder may have moved into that of the winner, where no reader looks
            for left in (tmp, f"{to}/_tmp-{mine}"):
                self._fs.delete(self._path(left), True)
        return won

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if its id is committed already."""
        if batch_id in self.batches():
            return False
        return self._put({"": signed(changes).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))}, f"batch={batch_id}")

    def totals(self, state: tuple | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, as of ``state``, or now."""
        base, _, beside = state or self.state()
        tables = [f"{self.path}/{base}/sums"] * bool(base) + [f"{self.path}/batch={b}" for b in beside]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        df = self.spark.read.schema(schema).parquet(*tables) if tables else self.spark.createDataFrame([], schema)
        return df.select(*KEYS, "n_docs", "n_tokens").groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, state: tuple | None = None) -> bool:
        """Fold the batches of ``state`` (or of now) into a new base; readers see the old tables or the new base."""
        state = state or self.state()
        base, held, beside = state
        done = self.spark.createDataFrame([(b,) for b in [*held, *beside]], "batch string")
        return self._put({"sums": self.totals(state), "batches": done}, f"base-{int(base[5:]) + 1 if base else 0:09d}")


def count_tokens(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """source, lang, tokenizer, n_tokens of each row and tokenizer version (name: rank file)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: encoder(path).encode_ordinary for name, path in tokenizers.items()}
        for b in batches:
            texts = b.column("text").to_pylist()
            for name, encode in encoders.items():
                n = [len(encode(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return spread(docs.select(*cols)).mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in four insert batches, one of them delivered twice; then one batch's documents are
    revised away from and back to their counts, deleted and inserted again: totals of the whole table."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = staged(count_tokens(docs, {f"{n}@1": P.path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}), "token-counts")
    roll = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    as_op = lambda df, op, n=F.col("n_tokens"), old=F.lit(0): df.select(F.lit(op).alias("op"), *KEYS, n.alias("n_tokens"), old.cast("long").alias("old_tokens"))
    slices = [counts.where(part == k) for k in range(4)]
    for k, s in enumerate(slices):
        roll.commit(f"insert-{k}", as_op(s, "insert"))
    roll.commit("insert-0", as_op(slices[0], "insert"))
    roll.compact()
    roll.commit("revise-0", as_op(slices[0], "revise", F.col("n_tokens") + 1, F.col("n_tokens")))
    roll.commit("revise-1", as_op(slices[0], "revise", F.col("n_tokens"), F.col("n_tokens") + 1))
    roll.commit("delete-0", as_op(slices[0], "delete"))
    roll.commit("again-0", as_op(slices[0], "insert"))
    return roll.totals()
