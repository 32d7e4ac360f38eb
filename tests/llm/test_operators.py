"""Small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns; results against brute force."""

import base64
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from millrace.llm import attention_lm, byte_bpe, html_extract, knn_join, lm_scoring, near_dedup, packing, quality_rules, token_rollup, toxicity, url_filter
from millrace.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row int, v string"
R = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(t, k, seed):
    r, w = random.Random(seed), t.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


BASE = text(120, 1)
TEXTS = ([None, "", "  \n ", "one two", "one two", "One TWO", BASE, BASE, BASE.upper(), text(4, 2), text(30_000, 3), edited(text(30_000, 3), 20, 4), "é" * 50, "\x1c a\x85b"]
         + [edited(BASE, 1 + k % 6, 10 + k) for k in range(25)] + [text(60, 100 + k) + " " + text(40, 7) for k in range(15)] + ["you moron idiot " + text(60, 50)])


def rows(texts=TEXTS):
    out = [(i, t, ["en", "de", None][i % 3], ["src0", None][i % 5 == 0], len(t or ""), 0.5, "k", 1, "v") for i, t in enumerate(texts)]
    return [*out, (None, "no id here at all, really none", "en", "s", 1, None, None, None, None), out[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 54)) for i in range(0, 55, 2)] + [(None, 1, 1), (3, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def test_near_dedup_is_brute_force(docs, monkeypatch):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for block in (near_dedup.BLOCK, 4):  # long lists are cut in blocks
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_duplicates(docs).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept is False
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def linked_rows(texts, percent):
    """Brute force over (doc_id, text): the smallest doc_id that each row's text reaches; None without words."""
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            root[find(b)] = find(a)
    return [min(texts[j][0] for j in range(len(texts)) if find(j) == find(k)) for k in range(len(texts))]


def test_near_dedup_by_text_not_by_id(spark):
    a, z = text(90, 70), text(90, 71)
    data = [(5, a), (5, z), (7, z + " more"), (8, a + " more"), (5, a), (9, None), (9, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted([(5, 5, True)] * 3 + [(7, 5, False), (8, 5, False)] + [(9, 9, True)] * 2)
    kept = [tuple(r) for r in near_dedup.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (5, z), (9, None)], key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_loses_no_link_at_the_threshold(spark, monkeypatch, percent):
    """Sets of all sizes with overlaps right at, above and below the threshold, copies of shared passages between them."""
    r = random.Random(percent)
    data, at = [], 0
    passage = " ".join(f"p{k}" for k in range(60))
    for n in [*range(5, 60, 3), 64, 65, 66, 90, 128, 200, 400, 900]:
        words = [f"n{n}w{k}" for k in range(n)]
        for _ in range(3):
            other, k = list(words), r.randrange(0, max(1, n // 30) + 2)
            for _ in range(k):
                other[r.randrange(n)] = f"e{r.randrange(10**9)}"
            data += [(at, " ".join(other)), (at + 1, " ".join(words[: n - n * (100 - percent) // 100 + r.randrange(-1, 2)]) + (" " + passage if n > 500 else ""))]
            at += 2
    data += [(at + k, " ".join(f"q{r.randrange(10**6)}" for _ in range(20)) + " " + passage) for k in range(30)]
    for block in (near_dedup.BLOCK, 6):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), percent=percent).collect()}
        assert [got[i] for i, _ in data] == linked_rows(data, percent)


def test_near_dedup_empty_and_keep_one(docs, none):
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 7 not in ids and 6 in ids


def test_near_dedup_of_all_documents(spark):
    """The query over its whole table."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in near_dedup.op1_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = linked_rows(docs, 85)
    for (i, t), c in zip(docs, want, strict=True):
        n = len(shingles(t))
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c if n else i, (c if n else i) == i)


def test_near_dedup_moves_no_sketch_where_names_fit_as_bits(spark, monkeypatch):
    base = spark.createDataFrame([(i, edited(text(100, i % 40), 2 * (i % 3), i)) for i in range(400)], "doc_id long, text string").repartition(3)
    plans, old = {}, near_dedup.staged

    def staged(df, name="stage", by=None):
        out = old(df, name, by)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(near_dedup, "staged", staged)
    plain = lambda: sorted(map(tuple, near_dedup.near_duplicates(base, percent=80).collect()))
    want = plain()
    # names of 173 classes and more would take 2,768 bytes at 16 each, as bits of 400 rows in 3 partitions about 9 x 16
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 400)
    assert plain() == want and "Exchange hashpartitioning" not in plans["classes"]
    assert plans["marked"].index("Join") < plans["marked"].index("slice(sketch")  # cut before it travels
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 0)
    assert plain() == want and "Exchange hashpartitioning" in plans["classes"]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 100), (7, 7), (200, 1)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 1, 100: 99} or {k: v for k, v in got.items() if k != v} == {**{i: 1 for i in range(2, 41)}, 200: 1, 100: 99}


def test_knn_join(spark):
    r = np.random.default_rng(1)
    vs = [(i, [float(x) for x in r.normal(0, 1, 8)]) for i in range(300)]
    vs += [(1000 + i, [1.0] * 8) for i in range(40)] + [(500, None), (501, [None] * 8), (502, [math.nan] * 8), (503, [math.inf] * 8), (504, []), (None, [1.0] * 8), (505, [1.0] * 3), (5, vs[5][1])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in (g for g in good if g[0] % 100 == 0):
        s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        want += [(q, k + 1, i, -sc) for k, (sc, i) in enumerate(s)]
    assert sorted(map(tuple, knn_join.top_k(df, df.where("vec_id % 100 = 0")).collect())) == sorted(want)
    small = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 2.0]), (2, [1e8, 3.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in knn_join.top_k(small, small.where("vec_id = 0"), scale=1).orderBy("rank").collect()] == [(2, 10**16 + 3), (1, 10**16 + 2)]
    assert knn_join.top_k(df.where("false"), df.where("false")).count() == 0


def test_knn_join_prunes_clusters(spark):
    """On clustered vectors most groups are ruled out, and the results are still those of brute force."""
    r = np.random.default_rng(2)
    centres = r.normal(0, 3, (20, 16))
    x = np.floor(1024 * (np.repeat(centres, 150, 0) + r.normal(0, 0.05, (3000, 16)))) / 1024
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[7].tolist())], "vec_id long, embedding array<double>").repartition(4)
    ints = np.floor(1024 * np.vstack([x, x[7]])).astype(np.int64)
    ids = np.r_[np.arange(3000), 100]
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = sorted((-int(ints[q] @ ints[j]), int(ids[j])) for j in range(3001) if ids[j] != ids[q])[:10]
        want += [(int(ids[q]), k + 1, i, -sc) for k, (sc, i) in enumerate(s)]
    assert sorted(map(tuple, knn_join.top_k(df, df.where("vec_id % 100 = 0")).collect())) == sorted(want)
    rows = df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.floor(v * 1024).cast("double")).alias("v"))
    _, asked, groups = knn_join.asked(rows, rows.where("id % 100 = 0"), 16, 10, 27, "int")
    sent = asked.select(F.sum(F.size("grps"))).first()[0]
    assert sent < 0.35 * asked.count() * len(groups)


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>menu</li></ul></nav><div class=\"ad\">buy</div><article><h1>Head &amp; more</h1><p><b>One\n two<br><p>Three<div class=comments>no</div></article><footer>f</footer>"
    df = spark.createDataFrame([(1, "http://a.b/x", page, "h"), (1, "http://a.b/x", page, "h"), (2, None, None, "h"), (3, "", "", "h"), (None, "x", "<article>cut <p", "h"), (5, "http://c/d", "<div><p>plain</p> tail</div>", "h")], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(df).collect()]
    main = "Head & more\nOne two\nThree"
    assert sorted(got, key=str) == sorted([(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (None, "cut", 3), (5, "plain\ntail", 10)], key=str)
    assert html_extract.main_text(df.where("false")).count() == 0


def test_wrapper_is_union_free():
    infer = lambda *pages: html_extract.pattern(html_extract.infer(pages))
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p><i>same</i>", "<ul><li>c</li></ul><p>y</p><b>opt</b><i>same</i>", "<ul><li>d</li><li>e</li><li>f</li></ul><p>z</p><i>same</i>"]
    for some in itertools.permutations(pages):
        assert infer(*some) == "<ul>(<li>#text</li>)+</ul><p>#text</p>(<b>opt</b>)?<i>same</i>"
    assert infer("<p>x</p><b>opt</b>", "<p>z</p>", "<p>y</p><b>opt</b>") == "<p>#text</p>(<b>opt</b>)?"
    one, two = "<dl><dt>x</dt><dd>k</dd></dl>", "<dl><dt>x</dt><dd>z</dd><dt>y</dt><dd>z</dd></dl>"
    assert infer(one, two) == infer(two, one) == "<dl>(<dt>#text</dt><dd>#text</dd>)+</dl>"
    # partial wrappers meet as pages do
    halves = [html_extract.Wrapper(), html_extract.Wrapper()]
    for k, page in enumerate([*pages, pages[1]]):
        halves[k % 2].page(html_extract.tree(page))
    halves[0].add(halves[1].items, halves[1].pages, halves[1].texts)
    assert halves[0].pages == 4 and html_extract.pattern(halves[0].items) == infer(*pages)


def plain_article(page):
    """Brute force for the pages of the test tables: what stands in the article element."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inside)]
    return "\n".join(x for x in found if x)


def test_wrappers_decide_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    want = {i: plain_article(p) for i, p in raw.items()}
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want and len(want) == 2500
    # the same pages with no name that says what is what, and a notice at the end of each article
    mute = lambda p: re.sub(r"</article>|$(?<!</html>)", "<p>Read this site's terms.</p></div>", re.sub(r"<(article|nav|footer)>", "<div>", p).replace("</nav>", "</div>").replace("</footer>", "</div>").replace('<div class="ad">', "<div>"), count=1)
    raw = {i: mute(p) for i, p in raw.items()}
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([(r.page_id, r.url, raw[r.page_id]) for r in pages.select("page_id", "url").collect()], "page_id long, url string, html string").repartition(5)).collect()}
    alone = {i: html_extract.extract(p) for i, p in raw.items()}
    assert got == want
    assert sum(alone[i] != got[i] for i in got) > 2000  # a page on its own does not tell a notice


def test_html_odd_pages(spark, monkeypatch):
    long = "<div><div>menu <a>x</a></div><article>" + "<p>word <b>bold</b> and <i>more</i></p>" * 5000 + "</article></div>"
    assert html_extract.extract(long).count("\n") == 4999 and html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    rows = [(i, f"http://h{i % 3}.x/{i}", f"<nav>n</nav><main><p>text {i} of its own, which is longer than what all pages say</p><p>all pages say so</p></main>", 1, "p", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, plan string, salt int").repartition(4)
    want = {i: f"text {i} of its own, which is longer than what all pages say" for i in range(30)}
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)  # pages and wrappers meet by a shuffle
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want
    copies = spark.createDataFrame([(i, "http://c.x/1", "<main><p>the one text</p></main>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.main_text(copies).collect()} == {"the one text"}


def test_wrapper_forgets_nothing(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "spread", lambda df: df)  # partitions stay as they are made
    # more rare parts than a bound on items kept (4,000), each an article under a name of its own; what all pages share is short
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    body = lambda i: "".join(f"<{t}>{t} of article {i}, as long as articles are</{t}>" for t in ("h2", "p", "h3", "pre", "ul", "dl", "address", "blockquote") for _ in range(2))
    rows = [(i, "http://rare.x/", f"<body><div class={name(i)}>{body(i)}</div><div class=box><i>page {i}</i></div></body>") for i in range(600)]
    schema = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, schema)).collect()}
    assert all(f"p of article {i}, as long as articles are" in got[i] for i in range(600))
    # a notice on 84 % of all pages, but on less than half of those of one partition
    page = lambda i, on: f"<main><p>text {i} of its own, which is longer than the notice</p>{'<p>all say so</p>' * on}</main>"
    some, rest = ([(i, "http://terms.x/", page(i, on)) for i, on in part] for part in ([(i, i < 4) for i in range(10)], [(i, i > 11) for i in range(10, 50)]))
    split = lambda rows: spark.sparkContext.parallelize(rows, 1)
    for pages in (split(some).union(split(rest)), split(some + rest)):
        assert {r.text for r in html_extract.main_text(spark.createDataFrame(pages, schema)).collect()} == {f"text {i} of its own, which is longer than the notice" for i in range(50)}
    # nor does an element of no name fall apart where partial wrappers of rare parts meet
    pages = [f"<div><p>article {i} is here</p><div class={name(i)}>part {i}</div><div class=box><i>page {i}</i></div></div><div id=foot><b>x{i}</b></div>" for i in range(40)]
    held: list = []
    for at in (0, 20):
        w = html_extract.Wrapper()
        for p in pages[at : at + 20]:
            w.page(html_extract.tree(p))
        html_extract.put(held, w)
    html_extract.put(held, None)
    whole = html_extract.Wrapper()
    for p in pages:
        whole.page(html_extract.tree(p))
    assert html_extract.decide(held[0])["region"] == html_extract.decide(whole)["region"] != []
    # what a task holds decides nothing
    monkeypatch.setattr(html_extract, "_ITEMS", 40)
    assert {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows[:50], schema)).collect()} == {i: got[i] for i in range(50)}


def test_common_is_longest():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), *rng.integers(1, 30, (60, 2))]:
        a, b = ([(x, None, 0) if x < "f" else ("div", frozenset(rng.choice(list("uvwxyz"), rng.integers(0, 3))), 2) for x in rng.choice(list("abcdefg"), k)] for k in (n, m))
        best = np.zeros((n + 1, m + 1), int)
        for p, q in itertools.product(range(n), range(m)):
            best[p + 1, q + 1] = best[p, q] + 1 if html_extract._alike(a[p], b[q]) else max(best[p, q + 1], best[p + 1, q])
        got = html_extract._common(a, b)
        assert len(got) == best[n, m] and all(html_extract._alike(a[p], b[q]) for p, q in got)
        assert all(p < r and q < s for (p, q), (r, s) in itertools.pairwise(got))
    # beyond a million pairs of items, too: a far match was left out there
    a, b = ([(x, None, 0) for x in xs] for xs in ([*range(1200)], [*range(2000, 2020), *range(1200)]))
    assert html_extract._common(a, b) == [(k, k + 20) for k in range(1200)]


def test_toxicity(spark, docs, none, labels):
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got.values())
    assert got[len(TEXTS) - 1].predicted == 1 and got[0].predicted == 0 and got[1].score == got[0].score
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert toxicity.judge(none, labels).count() == 0 and toxicity.judge(docs, labels.where("false")).where("predicted = 1").count() == 1
    left = toxicity.screen(docs, labels)
    assert left.columns == docs.columns and left.count() == len(TEXTS) + 1


def test_toxicity_learns_from_noisy_labels(spark):
    r = random.Random(3)
    data = [(i, " ".join(r.choice(VOCAB) for _ in range(40)) + (" zorgface" if i % 10 == 0 else ""), int((i % 10 == 0) ^ (r.random() < 0.03))) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.judge(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [i for i, _, _ in data if got[i].held_out]
    assert len(held) > 300 and sum(got[i].predicted == (i % 10 == 0) for i in held) / len(held) > 0.98


def test_label_model_counts_repeated_voters_once():
    """Two voters that say the same and one that differs: as one voter each, the copies do not outvote it."""
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    good, other = np.where(r.random(4000) < 0.8, y, ~y), np.where(r.random(4000) < 0.85, y, ~y)
    v = np.stack([good, good, good, good, other], 1).astype(float)
    label = np.where(r.random(4000) < 0.1, y, -1).astype(int)
    post = toxicity.label_model(v, label, toxic=np.arange(5))
    apart = toxicity.label_model(np.stack([good, other], 1).astype(float), label, toxic=np.arange(2))
    assert np.abs(post - apart).mean() < 0.05
    parent = toxicity._forest(v, np.where(y, 0.99, 0.01))
    assert (parent[:4] >= 0).sum() == 3 and parent[4] == -1


def test_toxicity_finds_held_out_toxic_texts(spark):
    """Held-out labels of the whole query at sf0.1. Labels are noisy: some toxic ones stand by texts of repeated plain words."""
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    both = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n"))
    share = {r.toxic: (r.p, r.n) for r in both.collect()}
    assert share[1][0] >= 0.87 and share[0][0] <= 0.01 and share[1][1] > 100


def test_toxicity_learns_more_than_its_voters(spark):
    """Texts that no voter speaks of are told apart by their words."""
    r = random.Random(4)
    bad, fine = [f"b{k:02}" for k in range(100)], [f"f{k:02}" for k in range(100)]  # too short to be mined
    data = [(i, " ".join(r.choice(VOCAB) for _ in range(20)) + " " + " ".join(r.choice(bad if i % 2 else fine) for _ in range(8)), i % 2) for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    voters = toxicity.Voters(model[0], model[1])
    mute = [i for i, t, _ in data if not [x for x in voters.votes(t.encode()) if x < voters.toxic]]
    got = {x.doc_id: x for x in toxicity.judge(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    held = [i for i in mute if got[i].held_out]
    assert len(held) > 250 and sum((got[i].score > np.median([got[j].score for j in held])) == (i % 2 == 1) for i in held) > 0.8 * len(held)


def test_quality(docs, none, labels):
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = list(zip(w, w[1:], w[2:]))
        seen = {g for g in tri if tri.count(g) > 1} if len(tri) < 500 else {g for g, n in __import__("collections").Counter(tri).items() if n > 1}
        cover = {k + j for k, g in enumerate(tri) if g in seen for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.judge(docs, labels.where("false")).count() == len(TEXTS) + 2
    assert quality_rules.screen(docs, labels).columns == docs.columns


def test_quality_cutoffs_are_brute_force(spark):
    """Strata with enough labels, with too few, with labels against the rules, and without any."""
    r = random.Random(9)
    data, marks = [], []
    for lang, n, shout in (("aa", 400, 0.0), ("bb", 40, 0.0), ("cc", 500, 0.3), (None, 30, 0.0), ("dd", 260, 0.004)):
        for k in range(n + 40):
            i = len(data)
            words = [f"w{r.randrange(10**6)}" for _ in range(60)]
            if r.random() < shout or k >= n:  # what is no labelled good text is often shouted
                words = [w.upper() + "XYZ" * 3 for w in words]
            data.append((i, " ".join(words) + (" <#$" * r.randrange(0, 12) if k % 7 == 0 else ""), lang))
            if k < n and lang != "bb" or k < 20:
                marks.append((i, int(k < n)))
    data += [(len(data) + k, " ".join(["ABCDEFG"] * 10 + [f"x{j}" for j in range(45)]), "ee") for k in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    good = {i for i, q in marks if q} - {i for i, q in marks if not q}
    got = {x.doc_id: x for x in quality_rules.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}

    def step(i, t):
        x, chars = got[i], max(1, got[i].word_chars)
        value = {"symbols": x.n_symbols / chars, "dup_lines": x.n_dup_lines / 1, "repeats": x.n_repeat_words / max(1, x.n_words), "capitals": sum("A" <= c <= "Z" for c in t) / chars}
        return min((k for k, rule, c in quality_rules.STEPS if value[rule] > c), default=len(quality_rules.STEPS) + 1)

    steps = {i: step(i, t) for i, t, _ in data}
    strata = {}
    for i, _, lang in data:
        if i in good and not got[i].base_failed:
            strata.setdefault(lang or "", []).append(steps[i])
    level = quality_rules.DELTA / (len(strata) + 1)

    def last(found):
        n, proven = len(found), 0
        for k, _, _ in quality_rules.STEPS:
            x = sum(f <= k for f in found)
            if x > n * quality_rules.ALPHA or sum(math.comb(n, j) * quality_rules.ALPHA**j * (1 - quality_rules.ALPHA) ** (n - j) for j in range(x + 1)) > level:
                break
            proven = k
        return proven

    pooled = last([x for f in strata.values() for x in f])
    chosen = {s: last(f) if (1 - quality_rules.ALPHA) ** len(f) <= level else pooled for s, f in strata.items()}
    assert chosen["aa"] > 10 and 0 <= chosen["cc"] < len(quality_rules.STEPS)
    for i, _, lang in data:
        assert got[i].kept == (not got[i].base_failed and steps[i] > chosen.get(lang or "", pooled)), i
    assert sum(not x.kept and not x.base_failed for x in got.values()) >= 40  # cutoffs decide


def test_quality_cutoffs_decide_in_every_language(spark):
    """At sf0.1 every language has proven cutoffs that reject texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").where("NOT kept AND NOT base_failed").groupBy("lang").count().collect()
    assert {r.lang for r in got} == {"de", "en", "es", "fr"} and min(r["count"] for r in got) > 20


def test_quality_repeats_and_lines(spark):
    t = "a b c a b c a b c\nx|y\nx|y\n \n\n"
    r = quality_rules.judge(spark.createDataFrame([(1, t, "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (11, 2, 1, 9)


def test_binomial_bound(spark):
    for n, x in ((100, 0), (1000, 3), (2000, 9), (50, 1)):
        want = sum(math.comb(n, j) * 0.005**j * 0.995 ** (n - j) for j in range(x + 1))
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(n).cast("long"), F.lit(x).cast("long"), 0.005).alias("p")).first().p
        assert got == pytest.approx(want if x <= n * 0.005 else 1.0, rel=1e-9)


def test_packing_of_all_documents(spark):
    """The query over its whole table: every id in one piece, sequences without gaps, little padding."""
    encode = packing.plain_encoder(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = packing.op6_sequence_packing(spark, "/root/testdata/sf0.001").collect()
    of, by = {}, {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(of) == set(texts)
    for i, pieces in of.items():
        ids = np.array([*encode(texts[i] or ""), packing.END_ID], "<u4")
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 1024
    total = sum(r.length for r in got)
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in (sum(x for _, x in s) for s in by.values()))
    assert padded <= 1.03 * total + 1024


def test_packing(docs, none):
    enc = packing.encoder(P.path("byte_bpe_50k.tiktoken"))
    got = packing.pack_documents(docs).collect()
    for i, t in enumerate(TEXTS):
        if i == 6:
            continue
        ids = np.array([*enc.encode_ordinary(t or ""), 0], "<u4")
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens and [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 1024
    assert sum(r.doc_id == 6 for r in got) % 2 == 0 and packing.pack_documents(none).count() == 0


def test_pack_histogram_is_tight():
    r = random.Random(2)
    hist = {n: r.randrange(1, 500) for n in range(1, 1024)}
    patterns = packing.pack_histogram(hist)
    back = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            back[n] = back.get(n, 0) + count
    total = sum(n * c for n, c in hist.items())
    assert back == hist and sum(c for c, _ in patterns) <= 1.03 * total / 1024 + 1


def test_ids_are_those_of_the_tokenizer_at_its_defaults(spark):
    """All documents of sf0.01, odd texts and random ones, the added token among them, with no setting of the tokenizer changed."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing.plain_encoder(P.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [x or "" for x in TEXTS] + ["<|endoftext|> a", "a<|endoftext|>", "  \n\n x’s 12３ ½ 漢字 🙂"]
    r = random.Random(12)
    texts += ["".join(r.choice([" ", "\n", "\t", "a", "Z", "09", "'s", "t", "é", "½", "漢", "🙂", "_", "-", "<|", "|>", "<|endoftext|>", "endoftext"]) for _ in range(r.randrange(30))) for _ in range(3000)]
    for x in texts:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids


def test_packing_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a <|endoftext| > b", "x <|ENDOFTEXT|>"]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, packing.END_ID]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(got) == len(texts)


def test_byte_bpe(docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, path, P.PATTERN).collect():
        t = "no id here at all, really none" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.round_trip(none, path, P.PATTERN).count() == 0 and byte_bpe.encode(none, path, P.PATTERN).columns == ["doc_id", "ids"]
    own = byte_bpe.load(path, P.PATTERN)
    assert sorted(own.hash.slot_of) == list(range(len(ranks))) and own.rank(b"\xff\xfe nothing") == -1
    r = random.Random(1)
    for _ in range(2000):
        s = "".join(r.choice(" \n\t\x1c\x85\xa0abzAZ09'sté½漢🙂_-.") for _ in range(r.randrange(30)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == enc.encode_ordinary(s)


def test_token_rollup(spark, docs, tmp_path):
    roll = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    rows_ = lambda *x: spark.createDataFrame(list(x), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert roll.totals().count() == 0
    assert roll.commit("a", rows_(("insert", "s", "en", "t@1", 5, None), ("insert", None, None, "t@1", None, None), ("insert", "s", "en", "t@2", 7, None)))
    assert not roll.commit("a", rows_(("insert", "s", "en", "t@1", 500, None)))
    assert roll.commit("b", rows_(("revise", "s", "en", "t@1", 9, 5), ("delete", "s", "en", "t@2", 7, None)))
    want = {("s", "en", "t@1", 1, 9), (None, None, "t@1", 1, 0), ("s", "en", "t@2", 0, 0)}
    assert set(map(tuple, roll.totals().collect())) == want
    roll.compact()
    assert set(map(tuple, roll.totals().collect())) == want and not roll.commit("b", rows_()) and roll.commit("c", rows_(("insert", "s", "en", "t@2", 1, None)))
    roll.compact()
    assert ("s", "en", "t@2", 1, 1) in set(map(tuple, roll.totals().collect()))
    assert token_rollup.count_tokens(docs, {"x@1": P.path("byte_bpe_50k.tiktoken")}).where("doc_id = 0").first().n_tokens == 0


def test_token_counts_query_is_direct_counts(spark):
    import collections
    import tiktoken

    want = collections.Counter()
    sizes = collections.Counter()
    rows_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "lang", "text").collect()
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows_:
            want[r.source, r.lang, f"{name}@1"] += len(enc.encode_ordinary(r.text or ""))
            sizes[r.source, r.lang, f"{name}@1"] += 1
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (sizes[k], want[k]) for k in want}


def test_token_counts_odd_rows(spark, docs, none, tmp_path):
    counts = {r.doc_id: r.n_tokens for r in token_rollup.count_tokens(docs, {"x@1": P.path("byte_bpe_50k.tiktoken")}).collect()}
    assert counts[0] == counts[1] == 0 and counts[10] > 30_000
    assert token_rollup.count_tokens(none, {"x@1": P.path("byte_bpe_50k.tiktoken")}).count() == 0
    none.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_rollup.op8_token_counts(spark, f"file://{tmp_path}").count() == 0


def test_rollup_batches_between_and_at_once(spark, tmp_path):
    """A batch committed while the rest is folded counts once; of two writers of one batch one wins; unknown changes are an error."""
    rows_ = lambda *x: spark.createDataFrame(list(x), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    one = lambda n: rows_(("insert", "s", "en", "t@1", n, None))
    roll = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    roll.commit("a", one(5))
    state = roll.state()
    roll.commit("b", one(7))  # between the listing and the folding of ``compact``
    roll.compact(state)
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(2, 12)]
    roll.compact()
    roll.compact()
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(2, 12)] and roll.batches() == ["a", "b"]
    other = token_rollup.Rollup(spark, f"file://{tmp_path}/roll")
    import concurrent.futures as cf

    with cf.ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda r: r.commit("c", one(1)), [roll, other, roll, other]))
    assert sum(done) == 1 and roll.totals().first().n_tokens == 13
    with pytest.raises(Exception, match="unknown change"):
        roll.commit("d", rows_(("replace", "s", "en", "t@1", 1, None)))


def test_url_filter(spark):
    rules = spark.createDataFrame([*url_filter.RULES, ("com", "/en/", "allow"), (None, "/x", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.COM/en/7?x", "https://com/en/", "https://xcom/en/", "http://example.net/de/81#a", "http://b.net/de/", None, "no scheme", "a://b.org/es/?q://x", "://org/es/", "http://x.org", "http://a.com/EN/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), rules).orderBy("page_id").collect()]
    assert got == [("a.example.com", "/en/7", "example.com/en/7", "allow"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("b.net", "/de/", "net/de/", "allow"),
                   ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "/es/", "org/es/", "block"), ("org", "/es/", "org/es/", "block"), ("x.org", "", None, "allow"), ("a.com", "/EN/", None, "allow")]


def test_url_filter_ways_agree(spark, monkeypatch):
    """Sent and shuffled rules, many shapes, upper-case hosts, odd urls, clashing columns and no rows, against brute force."""
    r = random.Random(6)
    hosts, paths = ["com", "a.com", "b.a.com", "A.Com", "net", "x.y.net", "org"], ["/", "/en/", "/en/7", "/EN/", "/a/b/c", ""]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(30)] + [(None, "/", "block"), ("com", None, "block"), ("com", "/", None)]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'q.a.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'x', '?/en/', '#/en/7'])}" for _ in range(300)] + [None, "", "a.com/en/", "http://" + "s." * 500 + "com/" + "p" * 20_000]
    df = spark.createDataFrame([(i, u, "h", "p", "s", "d", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, short string, digest string, row int").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def want(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h.lower() + p), v, h.lower() + p) for h, p, v in rules if h and p is not None and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[1] if best else "allow"

    for most, shapes in ((100_000, 100), (100_000, 0), (0, 0)):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        monkeypatch.setattr(url_filter, "SHAPES", shapes)
        got = {x.page_id: tuple(x)[1:] for x in url_filter.judge(df, table).collect()}
        assert got == {i: want(u) for i, u in enumerate(urls)}
        assert url_filter.judge(df.where("false"), table).count() == 0
    monkeypatch.undo()
    assert {x.verdict for x in url_filter.judge(df, table.where("false")).collect()} == {"allow"}


def test_lm_base_and_model(docs, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT", 5)  # most words take the shuffled way
    path = P.path("byte_bpe_50k.tiktoken")
    got = lm_scoring.score(docs, path).collect()
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    every = [(i, t) for i, t, *_ in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = __import__("collections").Counter(w for i, t in every if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    text_of = dict(every)
    assert len(got) == len(every)
    for r in got:
        w = words(text_of[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0
    assert lm_scoring.score(none, path).count() == 0


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def naive_logs(m, counts, ids, own):
    """log10 probability of each id of a text and of its end, one place after the other."""
    A = attention_lm
    p = {k: v.astype(float) for k, v in m.p.items()}
    last, target = [m.end, *ids], [*ids, m.end]
    out = []
    for t in range(len(target)):
        begin = t // A.STEP * A.STEP - A.CONTEXT
        x = lambda j: p["E"][last[j]] if max(0, begin) <= j <= t else np.zeros(A.DIM)
        u = lambda j: x(j) + (x(j - 1) @ p["S"] if j > begin else 0)
        back = lambda c, n, left, kinds, lower: lower if n - own <= 0 else (max(max(c - own, 0) - A.DISCOUNT, 0) + (max(left - own * (c == 0), 0) + A.DISCOUNT * (kinds - own * (c == 1))) * lower) / max(n - own, 1)
        b, c, a = last[t], target[t], last[t - 1] if t else None
        p1 = (max(counts.ones[c] - own, 0) + 0.01) / (max(counts.total - own, 0) + 0.01 * m.vocab)
        of = lambda b: {k - b * m.vocab: n for k, n in counts.raw2.items() if k // m.vocab == b}
        two = of(b)
        p2 = back(two.get(c, 0), counts.ones[b], max(counts.ones[b] - sum(two.values()), 0), len(two), p1)
        n3 = counts.raw2.get(a * m.vocab + b, 0) if t else 0
        three = {k % m.vocab: n for k, n in counts.raw3.items() if t and n3 and k // m.vocab == a * m.vocab + b}
        p3 = back(three.get(c, 0), n3, max(n3 - sum(three.values()), 0), len(three), p2) if n3 else p2
        bucket = min(A.BUCKETS - 1, math.ceil(math.log2(n3 + 1)))
        q = u(t) @ p["Q"]
        seen = range(max(0, begin), t)
        e = {j: math.exp(min(30, q @ (u(j) @ p["K"]) / math.sqrt(A.DIM) + p["R"][t - begin - A.CONTEXT, j - begin])) for j in seen}
        null = math.exp(min(30, u(t) @ p["N"][0] + p["C"][bucket].sum()))
        total = null + sum(e.values())
        h = np.tanh(u(t) + sum((e[j] * (u(j) @ p["V"]) for j in seen), np.zeros(A.DIM)) / total)
        g = np.exp(h @ p["G"].T + p["B"][bucket, :3])
        g /= g.sum()
        out.append(math.log10((null * (g @ [p1, p2, p3]) + sum(e[j] for j in seen if last[j + 1] == c)) / total))
    return out


class KeepCounts(attention_lm.Counts):
    def __init__(self, vocab, ones, pairs, triples):
        super().__init__(vocab, ones, pairs, triples)
        self.raw2, self.raw3 = (dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in (pairs, triples))


def naive_segments(ids, m):
    """(hash of the segment before, ids) of a text's segments, (first place, end) of each."""
    from millrace.llm.shingles import mix

    last, target, out, begin = [m.end, *ids], [*ids, m.end], [], 0
    for t in range(len(target)):
        cut = int(mix(np.array([last[t] * m.vocab + target[t]], np.uint64))[0]) % lm_scoring.SPAN == 0
        if cut or t == len(target) - 1 or t + 1 - begin == lm_scoring.LONGEST:
            out.append((tuple(target[begin : t + 1]), begin, t + 1))
            begin = t + 1
    return [(out[k - 1][0] if k else None, *s) for k, s in enumerate(out)]


def test_lm_score_is_brute_force(docs, monkeypatch):
    made = []
    monkeypatch.setattr(lm_scoring, "Model", lambda *a: made.append(attention_lm.Model(*a)) or made[-1])
    monkeypatch.setattr(lm_scoring, "Counts", lambda *a: made.append(KeepCounts(*a)) or attention_lm.Counts(*a))
    some = docs.where("doc_id is null or doc_id <> 10 and doc_id <> 11")  # without the two very long texts
    path = P.path("byte_bpe_50k.tiktoken")
    got = lm_scoring.score(some, path).collect()
    counts, model = made
    e = packing.encoder(path)
    every = [(i, e.encode_ordinary(t or "")) for i, t, *_ in rows() if i not in (10, 11)]
    segs = [naive_segments(ids, model) for _, ids in every]
    first, both = __import__("collections").Counter(), __import__("collections").Counter()
    for (i, _), ss in zip(every, segs, strict=True):
        if not held(i):
            first.update(x for x, *_ in ss)
            both.update((x, s) for x, s, *_ in ss)
    n_texts = sum(not held(i) for i, _ in every)
    want = []
    for (i, ids), ss in zip(every, segs, strict=True):
        own = int(not held(i))
        logs = naive_logs(model, counts, ids, own)
        score = sum(logs)
        for x, s, at, end in ss:
            n = (n_texts if x is None else first[x]) - own * sum(y == x for y, *_ in ss)
            c = both[x, s] - own * sum((y, z) == (x, s) for y, z, *_ in ss)
            if n > 0:
                trust = lm_scoring.START if x is None else n / (n + 1)
                score += math.log10(1 - trust + trust * c / n * 10 ** -sum(logs[at:end]))
        want.append((str(i), score))
    # texts that are the same, with and without an id, differ in nothing but the id
    assert [k for k, _ in sorted(want)] == sorted(str(r.doc_id) for r in got)
    for (i, w), r in zip(sorted(want), sorted(got, key=lambda r: (str(r.doc_id), r.score)), strict=True):
        assert r.score == pytest.approx(w, rel=1e-3, abs=1e-2), i


def test_lm_learns_from_all_training_texts(docs, monkeypatch):
    made = []
    monkeypatch.setattr(lm_scoring, "Model", lambda *a: made.append(attention_lm.Model(*a)) or made[-1])
    path = P.path("byte_bpe_50k.tiktoken")
    lm_scoring.score(docs, path)
    seen = sorted({x for i, t, *_ in rows() if not held(i) for x in packing.encoder(path).encode_ordinary(t or "")})
    was = attention_lm.Model(made[0].vocab, made[0].end)
    assert (was.p["E"][seen] != made[0].p["E"][seen]).any(1).mean() > 0.99  # an id that nothing points to moves by nothing


def small_lm(vocab=40, end=39, seed=4):
    r = np.random.default_rng(seed)
    texts = [r.integers(0, end, r.integers(1, 90)) % (5 + k % 30) for k in range(60)]
    flat = [np.r_[end, t, end] for t in texts]
    pairs = np.unique(np.concatenate([f[:-1] * vocab + f[1:] for f in flat]), return_counts=True)
    triples = np.unique(np.concatenate([(f[:-2] * vocab + f[1:-1]) * vocab + f[2:] for f in flat]), return_counts=True)
    ones = np.bincount(np.concatenate([f[1:] for f in flat]), minlength=vocab)
    often = lambda kn, least: (kn[0][kn[1] >= least], kn[1][kn[1] >= least])
    m = attention_lm.Model(vocab, end)
    for k, v in m.p.items():
        m.p[k] = (v + r.normal(0, 0.3, v.shape)).astype(np.float32)
    return m, attention_lm.Counts(vocab, ones, often(pairs, 2), often(triples, 3)), texts


def test_lm_is_a_distribution():
    m, counts, texts = small_lm()
    for own in (0, 1):
        for n in (0, 1, 20, attention_lm.STEP, 80):
            prefix = np.resize(texts[7], n) if n else np.zeros(0, np.int64)
            # the ids that may follow a text, its end included, share all of its probability
            nexts = [m.logs(attention_lm.Batch(counts, m.end, [np.append(prefix, i)], np.array([own])))[n] for i in range(m.end)]
            ends = m.logs(attention_lm.Batch(counts, m.end, [prefix], np.array([own])))[n]
            total = sum(10.0**x for x in [*nexts, ends])
            # a counted text's left-out place is one of the ids that may follow: the sum is one but for that
            assert total == pytest.approx(1, abs=1e-4 if not own else 0.35)


def test_lm_gradients():
    m, counts, texts = small_lm()
    ids, *rest = attention_lm.Batch(counts, m.end, texts[:9], np.ones(9)).pick(slice(None))
    g, dx, _ = m._gradients(ids, *rest)
    g["E"] = np.zeros_like(m.p["E"])
    np.add.at(g["E"], ids[ids >= 0], dx[ids >= 0])
    r = np.random.default_rng(0)
    for name, v in m.p.items():
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in v.shape)
            if name == "B" and at[1] > 2:
                continue
            old, loss = v[at], []
            for d in (0.02, -0.02):
                v[at] = old + np.float32(d)
                loss.append(m._gradients(ids, *rest)[2])
            v[at] = old
            assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 0.04, rel=0.05, abs=3e-4), name


def test_lm_batches_and_windows_do_not_matter():
    m, counts, texts = small_lm()
    whole = m.logs(attention_lm.Batch(counts, m.end, texts, np.zeros(len(texts))))
    parts = np.concatenate([m.logs(attention_lm.Batch(counts, m.end, [t], np.zeros(1)), size=1) for t in texts])
    assert whole == pytest.approx(parts, rel=1e-4)
    at, ok = attention_lm.windows(np.array([1, 33, 32, 100]))
    assert sorted(at[:, attention_lm.CONTEXT :][ok]) == list(range(166)) and ok.shape[1] == attention_lm.STEP


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm_scoring.op10_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 2000 and got[0] > 0.95 * got[1]
