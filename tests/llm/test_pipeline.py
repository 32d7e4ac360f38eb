"""The pipeline against a plain Python version of its decisions, with odd rows and without any."""

import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P

from millrace.llm import quality_rules, toxicity
from .test_operators import DOCS, VOCAB, edited, linked_rows, text

LABELS = "doc_id long, quality int, toxic int"


def plain_toxic(t, weights):
    """The score's formula on one text."""
    lexicon, clean, w, bias = weights
    raw = (t or "").encode()
    words = toxicity.word_places(raw)
    m = len(lexicon) + len(clean) + len(toxicity.PATTERNS)
    return 1 / (1 + np.exp(-(bias + w[toxicity.Voters(lexicon, clean).votes(raw)].sum() + w[m + words].sum() / max(1, len(words)) ** 0.5)))


def plain_base_failed(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = list(zip(w, w[1:], w[2:]))
    count = {}
    for g in tri:
        count[g] = count.get(g, 0) + 1
    cover = {k + j for k, g in enumerate(tri) if count[g] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(cover) > 50 * len(w)


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")


def rows_(texts):
    return [(i, t, "en", "s", len(t or ""), 0.5, "k", 1, "v") for i, t in texts]


def test_pipeline_is_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    base = [text(90, 500 + k) for k in range(12)]
    texts = [(None, text(80, 1)), (0, None), (1, ""), (2, "two words"), (3, "a b c " * 60), (4, "you moron idiot trash " + text(70, 2)), (5, base[0]), (5, base[1]), (5, base[0]), (6, text(6000, 3))]
    texts += [(10 + k, b) for k, b in enumerate(base)] + [(100 + k, edited(base[k % 12], 1 + k % 3, k)) for k in range(30)] + [(200 + k, text(70, 900 + k) + " " + " ".join(VOCAB[:8])) for k in range(20)]
    r.shuffle(texts)
    write(spark, tmp_path, rows_(texts), [(i, 1, int(i == 4)) for i, _ in texts if i is not None])
    sf = f"file://{tmp_path}"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    left = [(i, t) for i, t in texts if plain_toxic(t, weights) < 0.3]
    assert (4, texts[[i for i, _ in texts].index(4)][1]) not in left
    # too few labels for any cutoff: the base rules alone
    left = [(i, t) for i, t in left if not plain_base_failed(t)]
    with_id = [(i, t) for i, t in left if i is not None]
    stay = {}
    for (i, t), c in zip(with_id, linked_rows(with_id, 80), strict=True):
        if i == c:
            stay.setdefault((i, t), None)
    # one row of each group: none of those that stay are linked
    got = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.staged(corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.staged(corpus_pipeline.STAGES[0][1](spark, docs, sf)), sf)), sf)
    assert got.columns == docs.columns
    kept = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert set(kept) <= set(stay) | {x for x in left if x[0] is None} and len(kept) == len(set(kept))
    groups = linked_rows(kept_ids := [x for x in kept if x[0] is not None], 80)
    assert groups == [i for i, _ in kept_ids] and {c for c in linked_rows(with_id, 80)} == set(groups)
    pieces = corpus_pipeline.run(spark, sf).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, x in kept:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= 1024 else None] = len(ids)
    assert sum(p.length for p in pieces) == sum(want.values())
    short = {(p.doc_id, p.doc_tokens, p.ids_crc32) for p in pieces if p.doc_tokens <= 1024}
    assert short == {k for k in want if k[1] <= 1024}
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all([o for o, _ in sorted(s)] == [0, *itertools.accumulate(n for _, n in sorted(s))][:-1] and sum(n for _, n in s) <= 1024 for s in by.values())


def test_pipeline_of_nothing_and_without_labels(spark, tmp_path):
    write(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    write(spark, tmp_path / "bare", rows_([(1, text(60, 5)), (2, "you moron idiot " + text(60, 6)), (None, None)]), [])
    assert {p.doc_id for p in corpus_pipeline.run(spark, f"file://{tmp_path}/bare").collect()} == {1}


def test_stages_keep_what_their_operators_keep(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    a = corpus_pipeline.staged(corpus_pipeline.drop_toxic(spark, docs, sf))
    assert a.columns == docs.columns and ids(a) == ids(toxicity.judge(docs, labels).where("score < 0.3"))
    b = corpus_pipeline.staged(corpus_pipeline.drop_low_quality(spark, a, sf))
    assert b.columns == docs.columns and ids(b) == ids(quality_rules.judge(a, labels).where("kept"))
    c = corpus_pipeline.staged(corpus_pipeline.drop_near_duplicates(spark, b, sf))
    left = [(x.doc_id, x.text) for x in b.select("doc_id", "text").collect()]
    assert ids(c) == set(linked_rows(left, 80)) and ids(corpus_pipeline.run(spark, sf)) == ids(c)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "packing"]
