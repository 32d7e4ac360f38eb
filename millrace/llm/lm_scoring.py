"""Language-model scoring (operator 10): a unigram base and a causal self-attention model with a memory.

Plan
  1. One pass encodes all texts. One pass over the training texts counts words (by
     64-bit hash), ids, pairs and triples of ids, merged per task before the
     shuffle. Nothing is sampled: counts cover all training text.
  2. The count models take the pairs and triples counted most, as many as PAIRS
     and TRIPLES allow (the size of the model, as its width is); the mass of the
     rest backs off and stays whole.
  3. The attention model (``attention_lm``) learns from all training windows, in
     ROUNDS passes over disjoint parts: each task learns from its own windows,
     parameters are averaged, weighted by the inputs seen, and the next round goes
     on from there. What reaches the driver is bounded by the model.
  4. One pass scores whole texts in overlapping windows, and the base over hot
     words (at most HOT, broadcast); a text's other words are joined to the counts
     by a shuffle, where no key is common any more.
  5. The memory holds every training text, in segments. A segment ends where the
     hash of two ids says so, about every SPAN ids, so the same passage falls into
     the same segments wherever it stands. Where the segment before was seen n
     times in other training texts, the memory expects what followed it there:
     P(segment) = (1 - m) P_attention(segment) + m c / n with m = n / (n + 1), c of
     them being this one; a text's first segment has m = START and n = all texts.
     As ends of segments follow from the ids, segments are a prefix-free code and
     probabilities still sum to one. The memory grows with the corpus and is
     joined, never broadcast.

A training text leaves its own occurrences out of all that the model holds against
it (leave one out), so scores of training and held-out texts are on one scale. The
base counts them, as its definition says.

Defined results: null text counts as empty, that is the end alone. Rows with a
null doc_id train and are not held out. Rows that repeat a doc_id are scored as
rows of their own, and know each other through the counts and the memory. Very
long texts are scored whole. An empty table gives none. Without training rows
c = N = V = 0 and all ids are equally likely. The learned parameters, so
``score``, depend a little on how rows lie in partitions.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .attention_lm import DIM, STEP, Batch, Counts, Model
from .common import crc_mod, may_match, ship, spread, staged, unstage
from .packing import encoder
from .shingles import mix, word_hashes

PAIRS, TRIPLES = 1 << 20, 1 << 21
HOT = 1 << 20
_FLUSH = 6_000_000
#: Rates of the rounds over all training windows, and ids that a task learns from at once.
ROUNDS = (0.01, 0.003)
_AT_ONCE = 400_000
#: Mean ids of a segment of the memory, and most.
SPAN, LONGEST = 16, 64
START = 0.1
_HASH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def vocabulary(ranks_path: str) -> tuple[int, int, str]:
    """Size, the id of the end (one above all ranks), and a type that holds ids."""
    n = encoder(ranks_path).n_vocab + 1
    return n, n - 1, "<u2" if n <= 1 << 16 else "<u4"


def _encode(ranks_path: str, kind: str):
    """Each text with its ids, so that it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(ranks_path).encode_ordinary, TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                piece = batch.slice(s, 512)
                raw = [np.asarray(encode(t), kind).tobytes() for t in piece.column("text").to_pylist()]
                row = pa.array((part << 40) + at + np.arange(len(raw)))
                at += len(raw)
                yield pa.RecordBatch.from_arrays([row, *(piece.column(c) for c in ("doc_id", "held_out", "text")), pa.array(raw, pa.binary())], ["row", "doc_id", "held_out", "text", "ids"])

    return run


def _count(vocab: int, end: int, kind: str):
    """(kind, key, n): kind 0 words, 1 ids, 2 pairs, 3 triples, 4 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, held, ends = [], [], 0, np.array([end], kind)

        def flush() -> Iterator[pa.RecordBatch]:
            if not texts:
                return
            flat = np.concatenate([x for t in texts for x in (ends, t, ends)]).astype(np.int64)
            a, b = flat[:-1], flat[1:]
            # every text is the end, its ids, the end; the pair of two ends between texts is no event
            inner = np.ones(len(a), bool)
            inner[np.cumsum([len(t) + 2 for t in texts])[:-1] - 1] = False
            pair = a * vocab + b
            triple = (pair[:-1] * vocab + b[1:])[inner[:-1] & inner[1:]]
            pair = pair[inner]
            found = [np.unique(x, return_counts=True) for x in (np.concatenate(hashes).view(np.int64), pair % vocab, pair, triple)] + [(np.zeros(1, np.int64), np.array([len(texts)]))]
            for k, (key, n) in enumerate(found):
                for s in range(0, len(key), 1 << 18):
                    part = key[s : s + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part), pa.array(n[s : s + (1 << 18)])], ["kind", "key", "n"])

        for batch in batches:
            for text, raw in zip(batch.column("text"), batch.column("ids"), strict=True):
                hashes.append(word_hashes(text.as_buffer().to_pybytes()))
                texts.append(np.frombuffer(raw.as_buffer(), kind))
                held += len(hashes[-1]) + len(texts[-1])
                if held >= _FLUSH:
                    yield from flush()
                    hashes, texts, held = [], [], 0
        yield from flush()

    return run


def _pieces(batches: Iterator[pa.RecordBatch], kind: str, least: int) -> Iterator[list[np.ndarray]]:
    """Ids of texts, in lists of at least ``least`` ids in all but the last."""
    texts, held = [], 0
    for batch in batches:
        for raw in batch.column("ids"):
            texts.append(np.frombuffer(raw.as_buffer(), kind))
            held += len(texts[-1]) + 1
            if held >= least:
                yield texts
                texts, held = [], 0
    if texts:
        yield texts


def _parts(texts: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """Texts in lists of at most ``most`` ids, but for single longer texts."""
    out, held = [], 0
    for t in texts:
        if out and held + len(t) > most:
            yield out
            out, held = [], 0
        out.append(t)
        held += len(t) + 1
    if out:
        yield out


def _learn(tables, shared, kind: str, rate: float):
    """(key, w, v): a task's parameters after its own windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for texts in _pieces(batches, kind, _AT_ONCE):
            if model is None:
                model = copy.copy(shared.value)
                model.learner()
            model.learn(Batch(tables.value, model.end, texts, np.ones(len(texts))), rate)
        if model is not None:
            key, weight, values = model.rows()
            for s in range(0, len(key), 4096):
                v = values[s : s + 4096].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 4096].astype(np.int32)), pa.array(weight[s : s + 4096]), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, DIM), pa.int32()), pa.array(v.ravel()))], ["key", "w", "v"])

    return run


def learn_all(model: Model, tables, train: DataFrame, kind: str) -> None:
    """Moves the model's parameters over all training windows; ``train``: row, ids; ``tables``: the broadcast counts."""
    sc = train.sparkSession.sparkContext
    for k, rate in enumerate(ROUNDS):
        shared = sc.broadcast(model)
        part = train.where(F.pmod(F.xxhash64("row"), F.lit(len(ROUNDS))) == k).select("ids").mapInArrow(_learn(tables, shared, kind, rate), "key int, w double, v array<float>")
        # at most one row an id and a few hundred more, whatever the input
        means = part.groupBy("key").agg(*[(F.sum(F.col("w") * F.col("v")[i]) / F.sum("w")).cast("float").alias(f"v{i}") for i in range(DIM)]).toArrow()
        if means.num_rows:
            model.take(means.column("key").to_numpy(), np.column_stack([means.column(f"v{i}").to_numpy() for i in range(DIM)]))
        shared.destroy()


def segments(batch: Batch, logs: np.ndarray, vocab: int) -> tuple[np.ndarray, ...]:
    """Of each segment of a batch's texts: its text's place, hash of the segment before (0: none) and of both,
    how often its text has each of them, and log10 of its probability."""
    target, last, n = batch.target.astype(np.uint64), batch.last.astype(np.uint64), len(batch.target)
    first = np.zeros(n, bool)
    first[np.concatenate(([0], np.cumsum(batch.lengths)[:-1]))] = True
    cut = mix(last * np.uint64(vocab) + target) % np.uint64(SPAN) == 0
    begin = np.empty(n, bool)
    begin[0], begin[1:] = True, cut[:-1]
    begin |= first
    start = np.flatnonzero(begin)
    since = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    begin |= since % LONGEST == 0
    start = np.flatnonzero(begin)
    since = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    own = np.add.reduceat(mix((target + np.uint64(1)) * _HASH[0] + since.astype(np.uint64) * _HASH[1]), start)
    own = mix(own + np.diff(np.append(start, n)).astype(np.uint64))
    text = np.cumsum(first)[start] - 1
    before = np.concatenate((np.zeros(1, np.uint64), own[:-1]))
    before[first[start]] = 0
    both = mix(before * _HASH[2] + own)
    times = []
    for x in (before, both):
        _, at, count = np.unique(mix(x + text.astype(np.uint64) * _HASH[1]), return_inverse=True, return_counts=True)
        times.append(count[at])
    return text, before.view(np.int64), both.view(np.int64), *times, np.add.reduceat(logs, start)


def _score(tables, shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, (model, keys, times, z, c_end) = tables.value, shared.value
        log_hot = np.log10((times + 0.5) / z)
        log_end, log_none = np.log10((c_end + 0.5) / z), np.log10(0.5 / z)
        lists = lambda off, **cols: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in cols.values()], list(cols)))
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                piece = batch.slice(s, 128)
                n, known, base, th, tm = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for text in piece.column("text"):
                    h, m = np.unique(word_hashes(text.as_buffer().to_pybytes()).view(np.int64), return_counts=True)
                    p = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                    hit = keys[p] == h if len(keys) else np.zeros(len(h), bool)
                    n.append(int(m.sum()) + 1)
                    known.append(int(m[hit].sum()) + (c_end > 0))
                    base.append(float((m[hit] * log_hot[p[hit]]).sum() + m[~hit].sum() * log_none + log_end))
                    th.append(h[~hit])
                    tm.append(m[~hit])
                ids = [np.frombuffer(raw.as_buffer(), kind) for raw in piece.column("ids")]
                own = 1 - np.asarray(piece.column("held_out").to_pylist(), np.int64)
                score, seg, at = [], [], 0
                for part in _parts(ids, _AT_ONCE):
                    b = Batch(counts, model.end, part, own[at : at + len(part)])
                    logs = model.logs(b)
                    score.append(np.add.reduceat(logs, np.concatenate(([0], np.cumsum(b.lengths)[:-1]))))
                    text, *more = segments(b, logs, model.vocab)
                    seg.append([text + at, *more])
                    at += len(part)
                text, before, both, n_before, n_both, logs = map(np.concatenate, zip(*seg, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("row", "doc_id", "held_out")), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(np.concatenate(score)),
                     lists(np.cumsum([len(x) for x in th]), key=np.concatenate(th), m=np.concatenate(tm)),
                     lists(np.searchsorted(text, np.arange(piece.num_rows + 1)), before=before, both=both, n_before=n_before.astype(np.int32), n_both=n_both.astype(np.int32), log=logs.astype(np.float32))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "parts"])

    return run


_SCORES = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<key: long, m: long>>, "
           "parts array<struct<before: long, both: long, n_before: int, n_both: int, log: float>>")


def recalled(scores: DataFrame, n_texts: int) -> DataFrame:
    """(row, gain): what the memory of other training texts adds to the log10 probability of each row it knows of."""
    e = scores.select("row", F.col("held_out").alias("new"), F.inline("parts"))
    # of the memory's segments this reads the hashes alone
    seen = (scores.select(F.col("held_out").alias("new"), F.explode("parts.before").alias("before")).where("before <> 0")
            .groupBy("before").agg(F.count(F.when(~F.col("new"), 1)).alias("n"), F.count("*").alias("k")).where("n > 0 AND k > 1").select("before", "n"))
    seen = staged(seen, "seen")
    known = may_match(e.where("before <> 0"), seen, "before").join(seen, "before").where("n > n_before OR new")
    known = staged(known.unionByName(e.where("before = 0").withColumn("n", F.lit(n_texts).cast("long"))), "recalled")
    times = known.where("NOT new").groupBy("both").agg(F.count("*").alias("c"))
    own = lambda c: F.when(F.col("new"), 0).otherwise(F.col(c))
    n, c = F.col("n") - own("n_before"), F.coalesce(F.col("c"), F.lit(0)) - own("n_both")
    trust = F.when(F.col("before") == 0, F.lit(START)).otherwise(n / (n + 1))
    gain = F.when(n > 0, F.log10(1 - trust + trust * c / n * F.pow(F.lit(10.0), F.least(-F.col("log").cast("double"), F.lit(300.0))))).otherwise(0.0)
    return known.join(times, "both", "left").groupBy("row").agg(F.sum(gain).alias("gain"))


def most_counted(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of all that is counted at least so often that no more than ``limit`` are."""
    steps = counts.groupBy(F.least(F.col("n"), F.lit(4096)).alias("b")).agg(F.count("*").alias("c")).orderBy(F.desc("b")).collect()  # at most 4096 rows
    least, kept = 1 << 62, 0
    for r in steps:
        if kept + r["c"] > limit:
            break
        least, kept = r["b"], kept + r["c"]
    t = counts.where(F.col("n") >= least).select("key", "n").toArrow()  # at most ``limit`` rows
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def score(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    vocab, end, kind = vocabulary(ranks_path)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
    coded = staged(spread(docs).mapInArrow(_encode(ranks_path, kind), "row long, doc_id long, held_out boolean, text string, ids binary"), "encoded")
    train = coded.where(~F.col("held_out"))
    counts = staged(train.select("text", "ids").mapInArrow(_count(vocab, end, kind), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts", by="kind")
    of = lambda k: counts.where(F.col("kind") == k).select("key", "n")
    ones = np.zeros(vocab, np.int64)
    t = of(1).toArrow()  # at most a row an id
    ones[t.column("key").to_numpy()] = t.column("n").to_numpy()
    tables = sc.broadcast(Counts(vocab, ones, most_counted(of(2), PAIRS), most_counted(of(3), TRIPLES)))
    model = Model(vocab, end)
    learn_all(model, tables, train.select("row", "ids"), kind)
    words = of(0)
    n_words, v_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    c_end = of(4).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, z = n_words + c_end, n_words + c_end + 0.5 * (v_words + (c_end > 0) + 1)
    key, n = most_counted(words, HOT)
    least = int(n.min()) if len(n) else 1 << 62
    shared = sc.broadcast((model, key, n.astype(np.float64), z, c_end))
    out = staged(coded.mapInArrow(_score(tables, shared, kind), _SCORES), "scores")
    unstage(coded)
    tables.destroy()
    shared.destroy()
    log_none = F.lit(float(np.log10(0.5 / z)))
    rest = words.where(F.col("n") < least)
    more = (out.select("row", F.inline("rare")).join(rest, "key")
            .select("row", F.col("m").alias("known"), (F.col("m") * (F.log10((F.col("n") + 0.5) / F.lit(float(z))) - log_none)).alias("more"), F.lit(0.0).alias("gain")))
    added = (more.unionByName(recalled(out, c_end).select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("more"), "gain"))
             .groupBy("row").agg(F.sum("known").alias("known"), F.sum("more").alias("more"), F.sum("gain").alias("gain")))
    return (out.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(added, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
