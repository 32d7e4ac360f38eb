"""Examples for extraction, verification, rewards and group analytics."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers as N, text as T
from millrace.operators import corpus as C, dedup as X, groups as G, rewards as R
from millrace.operators.verify import verify
from millrace.sources import files as S


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_extraction(spark):
    loose = lambda k: lambda c: T.extract(c, F.lit(k))
    strict = lambda k: lambda c: T.extract(c, F.lit(k), strict=True)
    assert column(spark, ["A", "(b)", "The answer is C", "A and B", "presented. D.", "<think>E.</think><answer>(F)</answer>", "", "answer: (d)", "x", "B. 24"], loose("mcq")) == ["A", "B", "C", "", "D", "F", "", "D", "", "B"]
    assert column(spark, ["yes", "No, it is not", "maybe yes", "I THINK no", "yesterday", "it's  yes."], loose("yesno")) == ["Yes", "No", "", "", "", "Yes"]
    assert column(spark, ["six", "There are 7 or 8", "1/3", "-2.5 cm", "none"], loose("counting")) == ["6", "7", "1/3", "-2.5", ""]
    assert column(spark, ["six", "1,234"], loose("numeric")) == ["", "1"]
    assert column(spark, ["A", "<answer>A</answer>", "<answer>(b) text</answer>", "<answer>A is wrong</answer>", "<answer>Apple</answer>"], strict("mcq")) == ["", "A", "B", "A", ""]
    assert column(spark, ["<answer>6 people</answer>", "<answer>six</answer>", "<answer>1/2</answer>"], strict("counting")) == ["6", "", ""]
    assert column(spark, ["<ANSWER>\n yes, so </answer>", "<answer>Yes.</answer>"], strict("yesno")) == ["Yes", "Yes"]


def test_text(spark):
    assert column(spark, [" (A). ", "Cat;", "x)", "( b )", ")"], T.normalize_answer) == ["a", "cat", "x", "b", ""]
    assert column(spark, ["Thought: q\nAnswer: one\nThought: r\nAnswer: two\nRationale: z", "<answer> k </answer>", "plain "], T.answer_portion) == ["two", "k", "plain"]
    assert column(spark, ["1,234 then 5,678", "twenty", "no number", "-3.5"], T.sentence_number) == [5678.0, 20.0, None, -3.5]
    assert column(spark, ["1/4", "50%", "1,000", "about 7 cm", "x", "1/0", "1/2/3"], T.parse_number) == [0.25, 50.0, 1000.0, 7.0, None, None, 1.0]
    assert column(spark, ["\\boxed{ CORRECT }", "none"], T.boxed) == ["CORRECT", ""]
    assert column(spark, ["It's  a CAT!", "..."], T.normalize_text) == ["its a cat", ""] and column(spark, ["...", "a a b"], T.token_set) == [[], ["a", "b"]]
    assert column(spark, ["Score: 12", "7", "none"], T.judge_score) == [1.0, 0.7, 0.0]
    assert column(spark, ["A", "é", "AB"], T.record_truth) == ["(A)", "(é)", "AB"]
    assert column(spark, ["pick (A) red one (B) two\n(C)x"], T.choices_of) == ["(A) red one, (B) two, (C)x"]


def test_answer_type(spark):
    rows = [("q", "B", "a, b", "mcq"), ("Which? (A) cat", "x", "", "mcq"), ("a. cat", "x", "", "mcq"), ("q", "y", "", "yesno"), ("q", "d", "", "mcq"), ("q", "1,200.5", "", "numeric"), ("q", "cat", "", "open"), ("q", "1_000", "", "open")]
    got = spark.createDataFrame(rows, "q string, g string, c string, want string").withColumn("t", T.answer_type(F.col("q"), F.col("g"), F.col("c"))).collect()
    assert [r.t for r in got] == [r.want for r in got]


CASES = [("counting", "8", "9", "CORRECT"), ("counting", "2", "3", "WRONG"), ("counting", "5", "8", "WRONG"), ("counting", "There are six cups", "6", "CORRECT"), ("open", "a domestic cat", "cat", "CORRECT"), ("open", "colur", "color", "CORRECT"),
         ("open", "red dress", "pink dress", "WRONG"), ("open", "left", "right", "WRONG"), ("open", "", "x", "WRONG"), ("numeric", "1/2", "0.5", "CORRECT"), ("numeric", "3.14", "3.5", "WRONG"), ("mcq", "(A) yes", "A", "CORRECT"), ("mcq", "B", "A", "WRONG"),
         ("mcq", "(A) Blue", "blue", "CORRECT"), ("yesno", "Yes, it is", "no", "WRONG"), ("yesno", "yes", "Yes", "CORRECT"), ("yesno", "maybe", "Yes", "WRONG"), ("yesno", "well, no", "No", "CORRECT")]


def test_verification(spark):
    df = spark.createDataFrame(CASES, "k string, a string, g string, want string")
    got = verify(df, "a", "g", "k", "m").collect()
    assert [(r.a, r.g, r.m.verdict) for r in got] == [(r.a, r.g, r.want) for r in got]
    by = {(r.k, r.a): r.m for r in got}
    assert by["open", "a domestic cat"].score == 0.95 and by["counting", "There are six cups"].score == 1.0 and by["counting", "2"].score == pytest.approx(2 / 3) and not by["open", ""].parse_ok
    strict = verify(spark.createDataFrame([("mcq", "A", "A"), ("mcq", "<answer>A</answer>", "A"), ("yesno", "<answer>no</answer>", "No"), ("counting", "<answer>six</answer>", "6"), ("numeric", "<answer>7 cm</answer>", "7")], "k string, a string, g string"), "a", "g", "k", "m", strict=True).collect()
    assert [r.m.verdict for r in strict] == ["WRONG", "CORRECT", "CORRECT", "WRONG", "CORRECT"]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_rewards(spark):
    mcq, t, f = F.lit("mcq"), F.lit(True), F.lit(False)
    pairs = [(t, t), (t, f), (f, t), (f, f)]
    r = one(spark, **{f"n{i}": R.no_regression_01(mcq, *p) for i, p in enumerate(pairs)}, **{f"d{i}": R.downstream_01(F.lit("fb"), mcq, *p) for i, p in enumerate(pairs)}, e=R.downstream_01(F.lit(" "), mcq, t, t))
    assert [r[f"n{i}"] for i in range(4)] == pytest.approx([0.6, 0, 1, 0.4]) and [r[f"d{i}"] for i in range(4)] == pytest.approx([2.5 / 4.5, 0, 1, 0.5 / 4.5]) and r.e == pytest.approx(1 / 3)
    good = F.lit("<think>r</think><answer>(A)</answer>")
    b = one(spark, **{f"x{i}": R.baseline(ok, R.tag_format(x, mcq))["total"] for i, (ok, x) in enumerate([(t, good), (f, good), (t, F.lit("A")), (f, F.lit("A"))])})
    assert list(b) == pytest.approx([1.0, 0.1, 0.9, 0.0])
    wrong_honest = R.feedback(F.lit("<think>r</think>\\boxed{INCORRECT}"), mcq, f, t)["downstream"]
    sycophant = R.feedback(F.lit("<think>r</think>\\boxed{CORRECT}"), mcq, f, t)["downstream"]
    s = one(spark, a=wrong_honest, b=sycophant, c=R.verification(F.lit("none"), t), d=R.correctness(F.lit("counting"), t, F.lit(0.75)), e=R.bare_format(F.lit("1/2"), F.lit("numeric")), g=R.bare_format(F.lit("1/2/3"), F.lit("numeric")))
    assert tuple(s) == (3.0, 0.0, -1.0, 0.5, 0.0, -1.0)
    assert R.convex(R.ResponseWeights()) and not R.convex(R.CriticWeights())


def test_buckets(spark):
    rows = [(7 / 8, 8, "trivial"), (6 / 8, 8, "easy"), (3 / 8, 8, "medium"), (0.0, 8, "brick_wall"), (14 / 16, 16, "trivial"), (0.5, -1, "brick_wall"), (0.5, 0, "brick_wall"), (0.5, 1, "brick_wall"), (0.5, 2, "trivial")]
    got = spark.createDataFrame(rows, "r double, k int, want string").withColumn("b", N.bucket(F.col("r"), F.col("k"))).collect()
    assert [r.b for r in got] == [r.want for r in got]


def test_group_advantages(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 0.0, 1.0), (0, 3, 1.0, 1.0)], "b int, i int, x double, y double").withColumn("g", F.lit(1))
    got = [r.advantage for r in G.component_advantage(df, {"x": 1.0, "y": 1.0}, ["g"], ["b"]).orderBy("i").collect()]
    assert got == pytest.approx([-1.2247, 0, 0, 1.2247], abs=1e-4)
    one_row = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0)], "g int, r double").select("g", G.advantage(F.col("r"), "g").alias("a")).collect()
    assert [r.a for r in one_row] == [0.0, 0.0, 0.0]
    rows = [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 2.0)]
    kept = {r.g for r in G.keep_varied(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], ["a", "b"], 2).collect()}
    assert kept == {2}


@pytest.mark.parametrize("n", [1, 5, 9000])
def test_ema_is_the_recursion(spark, n):
    r = random.Random(n)
    xs = [r.uniform(-5, 5) for _ in range(n)]
    want, e = [], None
    for x in xs:
        e = x if e is None else 0.95 * e + 0.05 * x
        want.append(e)
    got = [r.ema for r in G.smoothed(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i long, v double"), ["k"], "i", "v").orderBy("i").collect()]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_arrays(spark):
    def d(v):
        return F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, k0=N.kl_term(d([]).cast("array<double>"), d([]).cast("array<double>"), 4.0), k=N.kl_term(d([0.0, 1.0]), d([0.0, 0.0]), 2.0), nan=N.kl_term(d([math.nan]), d([0.0]), 1.0), big=N.kl_term(d([100.0]), d([0.0]), 1.0),
            s=N.surrogate(d([0.5]), d([0.0]), F.lit(1.0), 1.0), ids=N.drop_ids(F.array(F.lit(1), F.lit(2), F.lit(3)), d([0.1, 0.2, 0.3]), [2])[0], e=N.edit_distance(F.lit("kitten"), F.lit("sitting")), z=N.edit_distance(F.lit(""), F.lit("a")))
    assert r.k0 == 0 and r.k == pytest.approx((math.e - 2) / 2) and r.nan == 0 and r.big == pytest.approx(math.exp(20) - 21) and r.s == pytest.approx(-1.2) and r.ids == [1, 3] and r.e == pytest.approx(3 / 7) and r.z == 1.0


def test_splits_share_no_entity(spark):
    df = spark.range(500).select("id", (F.col("id") % 37).alias("e"))
    got = C.entity_split(df, "e").groupBy("e").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in got) and [sum(r.s == s for r in got) for s in ("train", "val", "test")] == [29, 3, 5]
    assert C.holdout_tail(df, "id", 0.001).where("is_val").count() == 1
    pairs = C.adjacent_pairs(df.withColumn("g", F.lit(1)).withColumn("m", F.col("id") % 2), "g", "id", "m").collect()
    assert all(p.a_member != p.b_member for p in pairs) and len({x for p in pairs for x in (p.a, p.b)}) == 2 * len(pairs)


#: Answers and the letter that stands for the choice ('' where none does).
LETTERS = [
    ("A", "A"), ("(c)", "C"), (" b. ", "B"), ("D ", "D"), ("f.", "F"), ("g", ""), ("(G)", ""), ("", ""), ("   ", ""),
    ("I think (B) is right", "B"), ("so it is C. Done", "C"), ("(A) or (B)", "A"), ("B. and not (A)", "B"), ("x.A. y", "A"), ("xA. (D)", "D"),
    ("the answer is d", "D"), ("Answer: (e)", "E"), ("ANSWER IS F because", "F"), ("answer b", ""), ("my answer is C, not A", "C"),
    ("only E here", "E"), ("rust", ""), ("A or B", ""), ("B B B", "B"), ("xyz (C", "C"),
]


def test_letters(spark):
    assert column(spark, [t for t, _ in LETTERS], T.mcq_letter) == [x for _, x in LETTERS]


def test_contaminated_by_many_short_texts_is_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 12)))
    texts = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(300)] + [None, "", "x" * 300_000 + " zz of"]
    held = {x for t in texts[:300:6] for w in [t.split(" ")] for x in [" ".join(w[2 : 3 + k])[k:] for k in range(4)] if len(x) > 9} | {"zz of", "nowhere at all", "y" * 200, "x" * 200}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {p.i for p in X.contaminated(df, spark.createDataFrame([(h,) for h in held], "h string"), "i", "t", "h").collect()}
    assert got == {i for i, t in enumerate(texts) if t and any(h in t for h in held)} and 30 < len(got) < 300
    plan = X.contaminated(df, spark.createDataFrame([("zz of",)], "h string"), "i", "t", "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no row for every place of a text


def test_repair_of_numbers_beyond_five_digits(spark):
    df = spark.createDataFrame([(f"counting_train_{i:05d}.png", 1) for i in (7, 99_999, 100_000, 256_409, 12_345_678)] + [("counting_train_0007.png", 1)], "path string, value int")
    source = spark.createDataFrame([("train", i, v) for i, v in ((7, 1), (99_999, 99), (100_000, 99), (256_409, 1), (0, 5), (12_345_678, 99), (45_678, 5))], "split string, idx long, value int")
    got = [(p.status, p.fixed) for p in C.repair(df, source, "path", "value", F.lit("train")).orderBy(F.length("path"), "path").collect()]
    assert got == [("missing", 1), ("same", 1), ("updated", 99), ("updated", 99), ("same", 1), ("updated", 99)]


def test_near_signatures_are_brute_force_and_broadcast_no_signature(spark, monkeypatch):
    r = np.random.default_rng(11)
    base = r.integers(-(2**63), 2**63 - 1, 4)
    near = lambda n: [int(np.int64(base[r.integers(4)]) ^ np.int64(sum(1 << int(b) for b in r.choice(63, r.integers(0, 9), replace=False)))) for _ in range(n)]
    left, right = near(300), near(200)
    want = sorted((a, b, n) for a in set(left) for b in set(right) if (n := bin((a ^ b) % 2**64).count("1")) < 8)
    cands, held = (spark.createDataFrame([(x,) for x in [*xs, None]], f"{c} long") for xs, c in ((left, "s"), (right, "o")))
    for most in (X.MEET, 7):  # groups of very many candidates are cut
        monkeypatch.setattr(X, "MEET", most)
        got = X.near_signatures(cands, held, "s", "o")
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()  # after it ran: 36 or more rows a signature never go through the driver
    assert plan[: plan.index("Initial Plan")].count("BroadcastExchange") == 2 and plan[: plan.index("Initial Plan")].count("BroadcastHashJoin") == 2 and "LeftOuter" in plan


def test_signatures_are_votes_of_words(spark):
    texts = ["", None, "One two  two", "ONE", " ".join(f"w{i % 7}" for i in range(40_000)), "é È x"]
    rows = [(i % 5, t) for i, t in enumerate(texts)]  # key 0 has two rows
    want = {}
    for k, t in rows:
        for w in t.lower().split(" ") if t is not None else ():
            h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
            want.setdefault(k, np.zeros(60, int))[:] += [(h >> b & 1) * 2 - 1 for b in range(60)]
    got = {p.k: p.sig for p in X.signature(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {k: sum(1 << b for b in range(60) if v[b] > 0) for k, v in want.items()}


def test_signatures_and_images(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 12)]
    flip = lambda x, bits: x ^ sum(1 << int(b) for b in bits)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    other = [signed(flip(x % 2**64, r.choice(64, k, replace=False))) for x in base for k in (0, 1, 6, 7, 8, 9)]
    left, right = spark.createDataFrame([(x,) for x in base], "s long"), spark.createDataFrame([(x,) for x in other], "o long")
    far = lambda a, b: bin((a ^ b) % 2**64).count("1")
    got = X.near_signatures(left, right, "s", "o").collect()
    assert sorted((p.s, p.o, p.distance) for p in got) == sorted((a, b, far(a, b)) for a in base for b in set(other) if far(a, b) < 8)

    def naive(x, y):
        out = []
        for i in range(x.shape[0] - 6):
            for j in range(x.shape[1] - 6):
                p, q = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
                c = np.cov(p, q)
                out.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
        return np.mean(out)

    x = r.uniform(0, 255, (5, 10, 10))
    y = x + r.normal(0, 20, x.shape)
    assert X.structural_similarity(x, y) == pytest.approx([naive(a, b) for a, b in zip(x, y, strict=True)])
    pairs = spark.createDataFrame([(1, x[0].ravel().tolist(), y[0].ravel().tolist()), (2, x[0].ravel().tolist(), None), (3, [1.0] * 9, [1.0] * 9)], "k int, x array<double>, y array<double>")
    got = {p.k: p.ssim for p in X.similar_images(pairs, "x", "y", ["k"]).collect()}
    assert got[1] == pytest.approx(naive(x[0], y[0])) and got[2] is None and got[3] is None
    # an image that can't be read is dropped by the perceptual test, kept by the cosine test, kept by both together
    rows = [(1, [1.0, 0.0], base[0], x[0].ravel().tolist()), (2, [0.0, 1.0], base[1], x[1].ravel().tolist()), (3, None, None, None)]
    img = spark.createDataFrame(rows, "k int, v array<double>, s long, t array<double>")
    held = img.where("k = 1")
    assert {p.k: p.kept for p in X.perceptual_keep(img, held, "k", "s", "t").collect()} == {1: False, 2: True, 3: False}
    assert {p.k: p.kept for p in X.composite_keep(img, held, "k", "v", "s", "t").collect()} == {1: False, 2: True, 3: True}
    assert [(p.a, p.b) for p in X.alike_members(img, held, "k", "v", "s", "t").collect()] == [(1, 1)]


def test_cosines_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0, None, 1.0, 1.0])], "i int, e array<double>")
    u = x / np.sqrt((x**2).sum(1, keepdims=True))
    want = (u @ u[:20].T).max(1)
    for most in (X.BROADCAST_BYTES, 200):
        monkeypatch.setattr(X, "BROADCAST_BYTES", most)
        got = {p.i: p.max_sim for p in X.cosine_keep(df, df.where("i < 20 or i > 90"), "i", "e").collect()}
        assert [got[i] for i in range(60)] == pytest.approx(want, abs=1e-9) and got[99] is None and got[98] is None


def test_contaminated_by_short_texts(spark, monkeypatch):
    texts = ["alpha beta gamma delta epsilon zeta", "xalpha beta gammax", "beta  gamma", "tail of alpha", "a", "", None, "one two three four five", "(one two three four five)", "zz one\ttwo"]
    held = ["beta", "beta gamma", "alpha beta gamma", "alpha beta gamma delta", "one two three four five", "a", " of ", "two three four fi", "zz", "nowhere", "", None, "  "]
    for most in (X.BROADCAST_BYTES, 0):
        monkeypatch.setattr(X, "BROADCAST_BYTES", most)
        for some in ([h] for h in held):
            got = {p.i for p in X.contaminated(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(h,) for h in some], "h string"), "i", "t", "h").collect()}
            assert got == {i for i, t in enumerate(texts) if t and some[0] and some[0] in t}, some
    got = {p.i for p in X.contaminated(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(h,) for h in held], "h string"), "i", "t", "h").collect()}
    assert got == {i for i, t in enumerate(texts) if t and any(h and h in t for h in held)}


def test_equal_rewards_have_no_advantage(spark):
    df = spark.createDataFrame([(g, x) for g in range(3) for x in ([0.1 * 3] * 3 + [0.3] * 4 + [0.1 + 0.2] if g < 2 else [0.0, 1.0, 1.0, 0.0])], "g int, r double")
    got = df.select("g", G.advantage(F.col("r"), "g").alias("a")).collect()
    assert all(p.a == 0.0 for p in got if p.g < 2) and {round(p.a, 4) for p in got if p.g == 2} == {0.866, -0.866}


def test_metrics_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(True, None, 1.0, "a b  c"), (False, True, 0.0, ""), (True, False, 0.5, None)], "a1_correct boolean, a2_correct boolean, total double, f1 string")
    m = G.critic_metrics(df).first()
    assert (m.total_pairs, m.reward_mean, m.rr_rate, m.rw_rate, m.wr_rate, m.ww_rate) == (3, 0.5, 0.0, pytest.approx(1 / 3), pytest.approx(1 / 3), 0.0) and m.feedback_length_mean == 1.0
    assert G.critic_metrics(df.where("false")).count() == 0
    b = G.baseline_metrics(df.withColumn("a1_format", F.lit(0.0))).first()
    assert math.isnan(b.a2_accuracy) and b.feedback_reward_mean == 0.0 and b.a1_format_violation_rate == 1.0
    long = G.rekeyed(G.keyed(G.critic_metrics(df), "rollout"), "val").collect()
    assert {p.metric: p.value for p in long}["val/total_pairs"] == 3.0
    ids = spark.createDataFrame([([1, 2, 3], 9, 4), (None, 9, 4)], "i array<int>, w int, p int")
    assert [p[0] for p in ids.select(G.completion_length(F.col("i"))).collect()] == [3, 0] and [p[0] for p in ids.select(G.completion_length(F.col("i"), F.col("w"), F.col("p"))).collect()] == [3, 5]


def test_positions_and_trends(spark):
    df = spark.createDataFrame([(float(i * i), float(i)) for i in range(100)], "o double, x double").repartition(5)
    assert sorted((p.o, p.position) for p in G.positions(df, "o").collect()) == [(float(i * i), i) for i in range(100)]
    assert {p.w: p["mean"] for p in G.windowed_trend(df, "o", "x").collect()} == {w: 10 * w + 4.5 for w in range(10)}
    assert G.early_late(df, "o", "x").first().delta == pytest.approx(4.5 - 94.5)
    assert sorted(p.o for p in C.holdout_tail(df, "o", 0.03).where("is_val").collect()) == [97.0**2, 98.0**2, 99.0**2]


def test_prompts_take_instructions_from_the_environment(spark, monkeypatch):
    monkeypatch.setenv("ANSWER_TAG_INSTRUCTION", "  Say it. ")
    monkeypatch.setenv("THINK_ANSWER_INSTRUCTION", " ")
    r = one(spark, tag=T.answer_prompt(F.lit("Q"), "tag"), think=T.answer_prompt(F.lit("Q"), "think"))
    assert r.tag[0].content[1].text == "Q\n\nSay it." and r.tag[0].content[0].type == "image" and r.think[0].content[1].text == "Q\n\n" + T.INSTRUCTIONS["THINK_ANSWER_INSTRUCTION"]


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (3000).to_bytes(4, "big") + (20).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF" + b"\x00" * 10 + b"\xff\xdb\x00\x05abc" + b"\xff\xc2\x00\x11\x08" + (600).to_bytes(2, "big") + (800).to_bytes(2, "big") + b"\x03rest"
    df = spark.createDataFrame([(0, png), (1, jpeg), (2, b"\xff\xd8\xff\xe0\x00\x10"), (3, b"GIF89a"), (4, None), (5, b"")], "i int, b binary")
    w, h = S.image_size(F.col("b"))
    got = {r.i: (r.w, r.h, r.s and tuple(r.s), r.t and tuple(r.t)) for r in df.select("i", w.alias("w"), h.alias("h"), S.bounded_size(F.col("b")).alias("s"), S.bounded_size(F.col("b"), 120_000).alias("t")).collect()}
    assert got[0] == (3000, 20, (1024, 6), (3000, 20)) and got[1] == (800, 600, (800, 600), (400, 300)) and all(got[i] == (None, None, None, None) for i in (2, 3, 4, 5))


def test_configuration_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="seed"):
        S.write_config(spark, {"name": "x", "seed": None}, f"file://{tmp_path}/c", ("name", "seed"))
