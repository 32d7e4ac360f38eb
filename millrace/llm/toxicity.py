"""Toxicity by weak supervision (operator 4).

Plan
  1. At most SAMPLE labelled training documents, chosen by a hash of doc_id, are the
     bounded sample that models are fitted on; texts are joined to the sample's
     ids, so only their texts move. Everything else covers all rows.
  2. Voters. Toxic side: a fixed lexicon, words and beginnings of words mined from
     the sample (frequent in toxic texts, rare elsewhere), and patterns of address,
     shouting and exclaiming. Clean side: words that only clean texts have, and
     patterns of plain prose.
  3. A generative label model, P(votes | class), with the label as one noisy voter
     among them, is fitted by EM. The strongest dependencies given the class, a
     spanning forest by conditional mutual information, are pairwise factors,
     P(vote | vote it depends on, class), so voters that repeat each other count once.
  4. A logistic regression on the votes and on the text itself, as hashed words,
     learns the posterior labels; it alone scores, so labels, language, source and
     id are no inputs of a score, and texts without any vote are told apart.

Defined results: null or empty text scores as a text without vote or word. Without
usable labels the label model starts from the fixed lexicon alone. Several labels
of a doc_id: the largest. Rows that repeat a doc_id are scored as rows of their
own, and train as one (the smallest text); a null doc_id is not held out and trains
nothing. Very long texts are scored whole. An empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, ship, spread, staged, unstage
from .shingles import word_hashes

SAMPLE = 20_000
MINED = 200
#: Insults in English, German, French and Spanish.
LEXICON = ("idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting fool imbecile jerk bastard vermin filth "
           "dumm trottel abschaum versager widerlich erbärmlich wertlos arschloch drecksack connard imbécile abruti minable débile ordure crétin salaud "
           "estúpido imbécil basura escoria asqueroso patético inútil idiota cabrón").split()
_SEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Lengths in bytes of the beginnings of words that are tried.
PREFIXES = (4, 5, 6, 7, 8)
#: Names of columns that no input has.
_TEXT, _SCORE = "__millrace_text", "__millrace_score"
PATTERNS = ("addressed", "shouting", "exclaiming", "marks", "short", "prose", "long", "numbers")
#: Of PATTERNS, those of the toxic side.
TOXIC_SIDE = 4
#: Words that only clean texts have, at most so many.
CLEAN = 40
#: Places of hashed words.
HASHED = 1 << 15


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and any other characters."""
    return raw.translate(_SEP).split()


def traits(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words, marked by a star."""
    return words | {w[:k] + b"*" for w in words for k in PREFIXES if len(w) > k}


class Voters:
    """Lexicon voters by index, in the lexicon's order, after them the clean words, and after them PATTERNS."""

    def __init__(self, lexicon: list[str], clean: list[str] = ()) -> None:
        keys = {w.encode("latin-1"): i for i, w in enumerate([*lexicon, *clean])}
        self.toxic, self.n = len(lexicon), len(lexicon) + len(clean)
        self.words = {w: i for w, i in keys.items() if not w.endswith(b"*")}
        self.starts = {w[:-1]: i for w, i in keys.items() if w.endswith(b"*")}
        self.lengths = sorted({len(w) for w in self.starts})

    def votes(self, raw: bytes) -> list[int]:
        """Indices of the voters that vote."""
        words = tokens(raw)
        kinds = set(words)
        hits = self.words.keys() & kinds
        out = {self.words[w] for w in hits}
        got = {w for w in hits if self.words[w] < self.toxic}
        for k in self.lengths:
            out.update(self.starts[w] for w in self.starts.keys() & {w[:k] for w in kinds if len(w) > k})
        upper, marks, n = sum(raw.count(bytes([c])) for c in range(65, 91)), raw.count(b"!"), max(1, len(words))
        said = (
            bool(got) and any(a in (b"you", b"du", b"tu") for a, w in zip(words, words[2:]) if w in got),
            bool(raw) and upper * 2 > len(raw), bool(got) and marks * 4 > n, marks * 4 > n,
            0 < len(words) < 8, bool(raw) and not marks and upper * 8 < len(raw) and raw.count(b".") * 40 > n, len(words) > 400, sum(raw.count(bytes([c])) for c in range(48, 58)) * 20 > max(1, len(raw)))
        out.update(self.n + i for i, yes in enumerate(said) if yes)
        return sorted(out)


def word_places(raw: bytes) -> np.ndarray:
    """Places of a text's different words."""
    return np.unique(word_hashes(raw) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int32)


def _forest(v: np.ndarray, post: np.ndarray, least: float = 0.01) -> np.ndarray:
    """The voter that each voter depends on (-1: none): a spanning forest by mutual information given the class."""
    m, total = v.shape[1], np.zeros((v.shape[1], v.shape[1]))
    for w in (post, 1 - post):
        n = w.sum() + 1e-9
        one = (w @ v) / n
        both = sum((v[at : at + 4096].T * w[at : at + 4096]) @ v[at : at + 4096] for at in range(0, len(v), 4096)) / n
        for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
            pa, pb = one if a else 1 - one, one if b else 1 - one
            joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}[a, b]
            joint = np.maximum(joint, 1e-12)
            total += n / len(post) * joint * np.log(joint / np.maximum(np.outer(pa, pb), 1e-12))
    np.fill_diagonal(total, 0)
    parent, root = np.full(m, -1), np.arange(m)
    near: list[list[int]] = [[] for _ in range(m)]
    i, j = np.nonzero(np.triu(total) > least)
    for k in np.argsort(-total[i, j], kind="stable"):
        a, b = root[i[k]], root[j[k]]
        if a != b:
            root[root == b] = a
            near[i[k]].append(j[k])
            near[j[k]].append(i[k])
    seen = np.zeros(m, bool)
    for r in range(m):
        stack = [] if seen[r] else [r]
        seen[r] = True
        while stack:
            at = stack.pop()
            for x in near[at]:
                if not seen[x]:
                    seen[x], parent[x] = True, at
                    stack.append(x)
    return parent


def label_model(v: np.ndarray, label: np.ndarray, rounds: int = 30, toxic: np.ndarray | None = None) -> np.ndarray:
    """Posterior P(toxic) of each row. ``v``: rows x voters of 0/1; ``label``: 1, 0, or -1 for none; ``toxic``: voters of the toxic side.

    EM over class-conditional vote rates, given the vote that a voter depends on; the label is a voter whose own
    error rates are estimated.
    """
    n, m = v.shape
    if not n:
        return np.zeros(0)
    known = label >= 0
    any_ = v[:, toxic].any(1) if toxic is not None else v.any(1)
    post = np.where(label == 1, 0.9, np.where(label == 0, 0.05, np.where(any_, 0.8, 0.05))).astype(float)
    # from labelled rows, whose class does not come from the votes; once the votes have decided the class, copies look independent
    told = known if known.sum() >= 100 else np.ones(n, bool)
    parent = _forest(v[told], post[told])
    free, bound = np.flatnonzero(parent < 0), np.flatnonzero(parent >= 0)
    # of bound voters: the vote each depends on, and where both vote
    alone, on = v[:, free], v[:, parent[bound]]
    both = on * v[:, bound]
    for _ in range(rounds):
        prior = (post.sum() + 1) / (n + 2)
        log = np.full(n, np.log(prior / (1 - prior)))
        for sign, w in ((1, post), (-1, 1 - post)):
            w32 = w.astype(v.dtype)
            p = (w32 @ alone + 0.5) / (w.sum() + 1)
            log += sign * (alone @ (np.log(p) - np.log(1 - p)).astype(v.dtype) + np.log(1 - p).sum())
            if len(bound):
                n_on, n_both, n_own = w32 @ on, w32 @ both, w32 @ v[:, bound]
                for state, votes, n_state, n_votes in ((on, both, n_on, n_both), (None, None, w.sum() - n_on, n_own - n_both)):
                    p = (n_votes + 0.5) / (n_state + 1)
                    yes, no = (np.log(p) - np.log(1 - p)).astype(v.dtype), np.log(1 - p).astype(v.dtype)
                    # without the vote it depends on: all rows less those with it
                    log += sign * (both @ yes + on @ no if state is not None else v[:, bound] @ yes - both @ yes + no.sum() - on @ no)
        if known.any():
            h1, h0 = (post[known] @ (label[known] == 1) + 4) / (post[known].sum() + 5), ((1 - post[known]) @ (label[known] == 1) + 0.2) / ((1 - post[known]).sum() + 5)
            log += np.where(label == 1, np.log(h1 / h0), np.where(label == 0, np.log((1 - h1) / (1 - h0)), 0))
        post = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
    return post


def fit_linear(starts: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, l2: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by Newton steps with conjugate gradients. Row i has the features
    ``col[starts[i]:starts[i + 1]]`` with the values ``val``; ``l2``: by feature."""
    n, m = len(y), len(l2)
    at = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    l2 = np.append(l2, 1e-9)
    of = lambda w: np.bincount(at, val * w[:m].astype(np.float32)[col], n) + w[m]
    back = lambda d: np.append(np.bincount(col, val * d.astype(np.float32)[at], m), d.sum())
    loss = lambda z, w: (np.logaddexp(0, z) - y * z).mean() + (l2 * w * w).sum() / 2
    w = np.zeros(m + 1)
    z = of(w)
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g, curve = back((p - y) / n) + l2 * w, np.maximum(p * (1 - p), 1e-6) / n
        if np.abs(g).max() < 1e-6:
            break
        step, r = np.zeros(m + 1), -g
        d, rr = r.copy(), r @ r
        for _ in range(40):
            h = back(curve * of(d)) + l2 * d
            a = rr / (d @ h)
            step, r = step + a * d, r - a * h
            new = r @ r
            if new < 1e-4 * (g @ g):
                break
            d, rr = r + new / rr * d, new
        now, size = loss(z, w), 1.0
        while loss(z + size * of(step), w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
        z = of(w)
    return w[:m], float(w[m])


def _count_traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, all_ = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(all_)
        out = pa.RecordBatch.from_arrays([pa.array([k.decode("latin-1") for k in keys], pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], ["trait", "a", "c"])
        toxic.clear()
        all_.clear()
        return out

    for b in batches:
        for x, t in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
            got = traits(set(tokens(t.as_buffer().to_pybytes())))
            all_.update(got)
            if x:
                toxic.update(got)
            if len(all_) > 200_000:
                yield flush()
    yield flush()


def _mine(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that mark toxic texts, and words that only clean ones have."""
    t, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    every = staged(sample.mapInArrow(_count_traits, "trait string, a long, c long").groupBy("trait").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where("c > 4"), "traits")
    counts = every.where((F.col("a") >= max(5, 0.004 * t)) & (F.col("a") > 0.9 * F.col("c")) & (F.length("trait") > 3))
    out: list[str] = []
    for r in counts.orderBy(F.desc(F.col("a") * F.col("a") / (F.col("c") + 1)), F.length("trait"), "trait").limit(20 * MINED).collect():
        # of a word and its beginnings, the one that ranks first says it all
        root = r["trait"].rstrip("*")
        if len(out) < MINED and not any(root.startswith(x.rstrip("*")) if x.endswith("*") else x.startswith(root) for x in out):
            out.append(r["trait"])
    clean = every.where((F.col("a") == 0) & (F.col("c") >= max(20, 0.01 * n)) & (F.length("trait") > 3) & ~F.endswith("trait", F.lit("*"))).orderBy(F.desc("c"), "trait").limit(CLEAN).collect() if t else []
    unstage(every)
    return out, sorted(r["trait"] for r in clean)


def _vote_batches(lexicon: list[str], clean: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon, clean)
        for b in batches:
            raws = [t.as_buffer().to_pybytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([voters.votes(r) for r in raws], pa.list_(pa.int32())), pa.array([word_places(r) for r in raws], pa.list_(pa.int32()))], ["toxic", "votes", "words"])

    return run


Fitted = tuple[list[str], list[str], np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """Lexicon, clean words, weights (lexicon, clean words, PATTERNS, hashed words) and bias. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .where(crc_mod(F.col("doc_id"), 4) != 2))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    chosen = staged(docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.min("text"), F.lit("")).alias("text")), "sample")
    mined, clean = _mine(chosen)
    lexicon = sorted({*(w.encode().decode("latin-1") for w in LEXICON), *mined})
    rows = chosen.mapInArrow(_vote_batches(lexicon, clean), "toxic int, votes array<int>, words array<int>").toArrow()  # at most ``sample`` rows
    unstage(chosen)
    (s_off, said), (w_off, placed) = (_flat(rows.column(c)) for c in ("votes", "words"))
    label = np.array(rows.column("toxic").to_pylist(), int)
    del rows
    n, m, k = len(label), len(lexicon) + len(clean) + len(PATTERNS), len(lexicon)
    v = np.zeros((n, m), np.float32)
    v[np.repeat(np.arange(n), np.diff(s_off)), said] = 1
    seen = np.flatnonzero(v.any(0))
    post = label_model(v[:, seen], label, toxic=np.flatnonzero((seen < k) | (seen >= m - len(PATTERNS)) & (seen < m - len(PATTERNS) + TOXIC_SIDE)))
    del v
    # one prior row per voter stands for what its name says; it decides only where the sample has no case
    names = np.r_[np.ones(k), np.zeros(len(clean)), np.full(TOXIC_SIDE, 0.1), np.zeros(len(PATTERNS) - TOXIC_SIDE)]
    n_words = np.diff(w_off)
    order = np.argsort(np.r_[np.repeat(np.arange(n, dtype=np.int32), np.diff(s_off)), np.repeat(np.arange(n, dtype=np.int32), n_words)], kind="stable")
    col = np.r_[np.r_[said, m + placed][order], np.arange(m, dtype=np.int32)]
    val = np.r_[np.r_[np.ones(len(said), np.float32), np.repeat(_scale(n_words), n_words).astype(np.float32)][order], np.ones(m, np.float32)]
    del order
    starts = np.r_[s_off + w_off, (s_off + w_off)[-1] + np.arange(1, m + 1), np.full(3, len(col))] if n else np.r_[np.arange(m + 1), np.full(3, m)]
    w, b = fit_linear(starts, col, val, np.concatenate([post, names, np.zeros(3)]), np.r_[np.full(m, 1e-5), np.full(HASHED, 1e-4)])
    return lexicon, clean, w, b


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    parts = [c for c in col.chunks if len(c)]
    lengths = [np.diff(c.offsets.to_numpy()) for c in parts]
    return np.cumsum(np.concatenate([np.zeros(1, int), *lengths])), np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in parts]])


def _scale(n):
    """The weight of a hashed word among ``n``: all of a text's words together weigh as much as one vote."""
    return np.maximum(1, n) ** -0.5


def score(docs: DataFrame, model: Fitted, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out`` of every row."""
    lexicon, clean, weights, bias = model
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    m = len(lexicon) + len(clean) + len(PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon, clean)
        for b in batches:
            got = []
            for t in b.column(_TEXT):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = word_places(raw)
                got.append(bias + weights[voters.votes(raw)].sum() + _scale(len(words)) * weights[m + words].sum())
            p = 1 / (1 + np.exp(-np.clip(np.array(got, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], [*keep, out])

    texts = F.col("text").cast("string").alias(_TEXT)
    return spread(docs.select(*keep, texts)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    return (score(docs, fit(docs, labels)).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def screen(docs: DataFrame, labels: DataFrame, at_most: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at_most``, all columns as they are."""
    ship(docs.sparkSession)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(typed, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    return score(docs, model, docs.columns, _SCORE).where(F.col(_SCORE) < at_most).drop(_SCORE)
