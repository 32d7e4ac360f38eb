"""Queries over rollouts: extraction, verification, rewards, group analytics; each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import numbers as N, text as T
from millrace.operators import corpus as C, groups as G, rewards as R
from millrace.operators.verify import CORRECT, match_answer, verify, verify_distinct, word_overlap
from millrace.sources.views import rollouts

from . import duck as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ("sample_index", "traj")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def over_rollouts(name: str, cols, sql: dict[str, str], source: str = "sr") -> None:
    """A projection of the rollouts."""
    query(name, D.SR + f"SELECT sample_index, traj, {', '.join(f'{e} AS {c}' for c, e in sql.items())} FROM {source}")(
        lambda spark, d: rollouts(spark, d).select(*KEY, *[x.alias(n) for n, x in cols().items()]))




class _Columns:
    """Columns of the judged rollouts by short names; made when asked for, as they need a session."""

    _of = {"a1": "a1", "a2": "a2", "f1": "f1", "truth": "ground_truth", "kind": "answer_type"}

    def __getattr__(self, name: str):
        return F.col(self._of[name]) if name in self._of else F.col(f"{name}.verdict") == CORRECT


c = _Columns()
over_rollouts("p1_answer_tags", lambda: {"x": T.answer_tag(c.a1), "has_tag": T.has_answer_tag(c.a1)}, {"x": D.tag("a1"), "has_tag": D.has_tag("a1")})
over_rollouts("p2_think_answer_tags", lambda: {"x": T.has_think_answer(c.a1)}, {"x": D.has_think("a1")})
over_rollouts("p3_boxed", lambda: {"x": T.boxed(c.f1), "think": T.has_think_boxed(c.f1)}, {"x": D.boxed("f1"), "think": r"regexp_matches(f1, '(?is)<think>.*?</think>.*?\\boxed\{.*?\}')"})
over_rollouts("p4_extract_answer", lambda: {"loose": T.extract(c.a1, c.kind), "strict": T.extract(c.a1, c.kind, strict=True)}, {"loose": D.extract("a1", "answer_type"), "strict": D.extract("a1", "answer_type", True)})
over_rollouts("p5_atomic_answer", lambda: {"x": T.atomic(T.answer_tag(c.a2), c.kind)}, {"x": D.atomic(f"({D.tag('a2')})", "answer_type")})
over_rollouts("p6_mcq_letter", lambda: {"x": T.mcq_letter(c.a1)}, {"x": D.mcq("a1")})
over_rollouts("p7_yesno", lambda: {"x": T.yesno(c.a1), "hedge": T.hedging(F.concat(F.lit("Maybe "), c.a1))}, {"x": D.yesno("a1"), "hedge": D.hedge("concat('Maybe ', a1)")})
over_rollouts("p8_numeric", lambda: {"x": T.numeric(c.a1), "w": T.numeric(F.replace(c.a1, F.lit("2"), F.lit("two")), True)}, {"x": D.numeric("a1", False), "w": D.numeric("replace(a1, '2', 'two')", True)})
over_rollouts("p9_letter_and_text", lambda: {"letter": T.letter_and_text(c.a1)[0], "txt": T.letter_and_text(c.a1)[1]}, {
    "letter": rf"CASE WHEN {D.two(D.strip('a1'), r'(?s)(?:\(([A-Fa-f])\)\s*|([A-Fa-f])\.\s*)(.*)').replace('$$', '')} <> '' THEN {D.two(D.strip('a1'), r'(?s)(?:\(([A-Fa-f])\)\s*|([A-Fa-f])\.\s*)(.*)')} ELSE {D.mcq(D.strip('a1'))} END",
    "txt": D.strip(rf"regexp_extract({D.strip('a1')}, '(?s)(?:\(([A-Fa-f])\)\s*|([A-Fa-f])\.\s*)(.*)', 3)")})
over_rollouts("p10_normalize_answer", lambda: {"x": T.normalize_answer(c.truth)}, {"x": "regexp_replace(rtrim(lower(ground_truth), '.,;:'), '^\\((.*)\\)$', '\\1')"})
over_rollouts("p11_answer_portion", lambda: {"x": T.answer_portion(F.concat(F.lit("Thought: t\nAnswer: "), c.truth, F.lit("\nRationale: r")))}, {"x": D.strip("ground_truth")})
over_rollouts("p12_sentence_number", lambda: {"x": T.sentence_number(c.a1)}, {"x": D.sentence_number("a1")})
over_rollouts("p13_normalize_text", lambda: {"x": T.normalize_text(c.a1), "n": F.size(T.token_set(c.a1))}, {"x": D.norm("a1"), "n": f"CAST(len(list_distinct(list_filter(string_split({D.norm('a1')}, ' '), lambda w: w <> ''))) AS INTEGER)"})
over_rollouts("p14_parse_number", lambda: {"x": T.parse_number(c.truth), "y": F.round(T.parse_number(F.concat(T.numeric(c.truth), F.lit("/7"))), 6), "z": T.parse_number(F.concat(F.lit("1,"), F.lpad(T.numeric(c.truth), 3, "0"), F.lit("%")))},
              {"x": D.parse_number("ground_truth"), "y": f"round({D.parse_number(f"concat({D.numeric('ground_truth', False)}, '/7')")}, 6)", "z": D.parse_number(f"concat('1,', lpad({D.numeric('ground_truth', False)}, 3, '0'), '%')")})
over_rollouts("p15_answer_type", lambda: {"x": T.answer_type(F.lit("What is it?"), c.truth, F.lit("")), "y": T.answer_type(F.concat(F.lit("Which? "), c.truth, F.lit(" one")), F.lit("q"), F.lit(""))}, {
    "x": rf"CASE WHEN lower(ground_truth) IN ('yes', 'no', 'y', 'n', 'true', 'false') THEN 'yesno' WHEN regexp_matches(lower(ground_truth), '^[a-f]$') THEN 'mcq' WHEN ({D.num("replace(ground_truth, ',', '')")}) IS NOT NULL THEN 'numeric' ELSE 'open' END",
    "y": r"CASE WHEN regexp_matches(concat('Which? ', ground_truth, ' one'), '(?i)\([A-F]\)\s*\w+') THEN 'mcq' ELSE 'open' END"})
over_rollouts("p16_category_type", lambda: {"x": T.category_type(F.when(c.kind == "yesno", "yes_no").otherwise(F.concat(c.kind, F.lit(""))), F.lit("fallback"))}, {"x": "CASE answer_type WHEN 'mcq' THEN 'mcq' WHEN 'yesno' THEN 'yesno' WHEN 'counting' THEN 'counting' ELSE 'fallback' END"})
over_rollouts("p17_completion_text", lambda: {"x": T.completion_text(F.array(T.message("user", c.f1), T.message("assistant", c.a1), T.message("assistant", c.a2))), "y": T.completion_text(F.array(T.message("user", c.a1), T.message("tool", c.a2)))}, {"x": "a1", "y": "concat(a1, ' ', a2)"})
over_rollouts("p19_choices", lambda: {"x": T.choices_of(F.concat(F.lit("Pick:\n(A) red one\n(B) "), c.truth))}, {"x": r"list_aggregate(list_transform(regexp_extract_all(concat('Pick:' || chr(10) || '(A) red one' || chr(10) || '(B) ', ground_truth), '\([A-F]\)\s*[^()\n]+'), lambda m: regexp_replace(m, '^\s+|\s+$', '', 'g')), 'string_agg', ', ')"})
over_rollouts("p20_image_path", lambda: {"x": T.image_path(F.lit(""), F.array(F.concat(F.lit("d/"), F.col("traj").cast("string"), F.lit(".png"))), "/base"), "y": T.image_path(F.lit("/abs.png"), F.array().cast("array<string>"), "/base")}, {"x": "concat('/base/d/', CAST(traj AS VARCHAR), '.png')", "y": "'/abs.png'"})
over_rollouts("p21_record_truth", lambda: {"x": T.record_truth(T.extract(c.truth, F.lit("mcq"))), "question": T.clean_question(F.concat(F.lit(" <image> What? "), c.kind))}, {"x": f"regexp_replace({D.extract('ground_truth', chr(39) + 'mcq' + chr(39))}, '^([A-Za-z])$', '(\\1)')", "question": "concat('What? ', answer_type)"})
over_rollouts("p22_question_template", lambda: {"x": F.format_string("How many %s are there in image %d?", F.col("dataset_name"), F.col("sample_index"))}, {"x": "printf('How many %s are there in image %d?', dataset_name, sample_index)"})
_TEXT = lambda prompt, at=1: F.element_at(prompt, -1)["content"][at]["text"]
_SAY = lambda name: "'" + T.INSTRUCTIONS[name] + "'"
_NL = "chr(10) || chr(10)"
_AGAIN = f"concat('Question: Q?', {_NL}, 'Your previous answer: ', a1, {_NL}, 'Feedback on your previous answer: ', f1, {_NL}, '{T.REFINE}'"
over_rollouts("p23_prompts", lambda: {"first": _TEXT(T.answer_prompt(F.lit("Q?"))), "first_think": _TEXT(T.answer_prompt(F.lit("Q?"), "think")), "first_tag": _TEXT(T.answer_prompt(F.lit("Q?"), "tag")), "critic": _TEXT(T.critic_prompt(F.lit("Q?"), c.a1)),
                                      "again": _TEXT(T.refiner_prompt(F.lit("Q?"), c.a1, c.f1)), "again_think": _TEXT(T.refiner_prompt(F.lit("Q?"), c.a1, c.f1, "think")), "again_tag": _TEXT(T.refiner_prompt(F.lit("Q?"), c.a1, c.f1, "tag")),
                                      "done": _TEXT(T.with_completion(T.answer_prompt(F.lit("Q?")), c.a1), 0), "n": F.size(T.with_completion(T.answer_prompt(F.lit("Q?")), c.a1))},
              {"first": "'Q?'", "first_think": f"concat('Q?', {_NL}, {_SAY('THINK_ANSWER_INSTRUCTION')})", "first_tag": f"concat('Q?', {_NL}, {_SAY('ANSWER_TAG_INSTRUCTION')})", "critic": f"concat('Question: Q?', chr(10), 'Candidate answer: ', a1, {_NL}, {_SAY('F1_VERIFIER_INSTRUCTION')})",
               "again": _AGAIN + ")", "again_think": f"{_AGAIN}, ' ', {_SAY('THINK_ANSWER_INSTRUCTION')})", "again_tag": f"{_AGAIN}, ' ', {_SAY('ANSWER_TAG_INSTRUCTION')})", "done": "a1", "n": "2"})
over_rollouts("p24_sample_hash", lambda: {"x": T.sample_hash(c.a1, F.col("dataset_name"))}, {"x": "substr(sha256(concat(a1, '|', dataset_name)), 1, 16)"})
over_rollouts("p25_judge_score", lambda: {"x": T.judge_score(F.concat(F.lit("Score: "), (F.col("sample_index") % 14).cast("string")))}, {"x": "least(sample_index % 14, 10) / 10.0"})
over_rollouts("p26_preview", lambda: {"x": T.preview(F.concat(F.lit("  "), F.repeat(c.a1, 20)), 64)}, {"x": f"substr({D.strip("repeat(a1, 20)")}, 1, 64)"})
over_rollouts("p27_clean_atomic", lambda: {"x": T.clean_atomic(T.answer_tag(c.a1), c.kind)}, {"x": D.clean_atomic(f"({D.tag('a1')})", "answer_type")})
over_rollouts("p29_edit_distance", lambda: {"x": F.round(N.edit_distance(c.a1, c.a2), 6)}, {"x": f"round({D.edit('a1', 'a2')}, 6)"})


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts with liberal (m) and strict (n) results of both answers; each different answer is verified once."""
    df = rollouts(spark, d)
    keys = df.select("answer_type", "ground_truth", F.explode(F.array("a1", "a2")).alias("_t")).distinct()
    found = verify(verify(keys, "_t", "ground_truth", "answer_type", "m"), "_t", "ground_truth", "answer_type", "n", strict=True)
    for k in "12":
        # null answers are answers, too; the side is as small as the different answers are, so Spark sends it round where it fits
        side = found.select(F.col("answer_type").alias("_k"), F.col("ground_truth").alias("_g"), "_t", F.col("m").alias(f"m{k}"), F.col("n").alias(f"n{k}"))
        same = F.col("answer_type").eqNullSafe(F.col("_k")) & F.col("ground_truth").eqNullSafe(F.col("_g")) & F.col(f"a{k}").eqNullSafe(F.col("_t"))
        df = df.join(side, same, "left").drop("_k", "_g", "_t")
    return df


ok = lambda m: F.col(f"{m}.verdict") == CORRECT
J = D.JUDGED
query("v1_verify_answer", J + "SELECT sample_index, traj, m1_v, round(m1_s, 6) AS m1_s, m2_v, round(m2_s, 6) AS m2_s, n1_v, round(n1_s, 6) AS n1_s, n2_v, round(n2_s, 6) AS n2_s FROM j")(
    lambda spark, d: judged(spark, d).select(*KEY, *[c for m in ("m1", "m2", "n1", "n2") for c in (ok(m).alias(f"{m}_v"), F.round(f"{m}.score", 6).alias(f"{m}_s"))]))
for _id, _kind in (("v2_verify_mcq", "mcq"), ("v3_verify_yesno", "yesno"), ("v4_verify_counting", "counting"), ("v5_verify_numeric", "numeric"), ("v6_verify_open", "open")):
    query(_id, J + f"SELECT sample_index, traj, m1_v, round(m1_s, 6) AS m1_s, n2_v FROM j WHERE answer_type = '{_kind}'")(
        lambda spark, d, _kind=_kind: verify(verify(rollouts(spark, d).where(c.kind == _kind), "a1", "ground_truth", "answer_type", "m1"), "a2", "ground_truth", "answer_type", "n2", strict=True)
        .select(*KEY, ok("m1").alias("m1_v"), F.round("m1.score", 6).alias("m1_s"), ok("n2").alias("n2_v")))
# a judge that SQL can say, too: words in common, over all words
_WS = lambda x: f"list_distinct(list_filter(string_split({D.norm(x)}, ' '), lambda w: w <> ''))"
_OVER = lambda x, y: f"coalesce(len(list_filter({_WS(x)}, lambda w: list_contains({_WS(y)}, w))) / CAST(nullif(len(list_distinct(list_concat({_WS(x)}, {_WS(y)}))), 0) AS DOUBLE), 0)"
some_words = lambda p, g: F.when(word_overlap(p, g) >= 0.3, 1.0).otherwise(0.0)
query("v6_judged_open", J + f"SELECT sample_index, traj, m1_v OR (m1_s IS NOT NULL AND {_OVER('a1', 'ground_truth')} >= 0.3) AS judged FROM j WHERE answer_type = 'open' AND NOT contains(a1, '<')")(
    lambda spark, d: verify_distinct(rollouts(spark, d).where((c.kind == "open") & ~F.contains("a1", F.lit("<"))), "a1", "ground_truth", "answer_type", "m", judge=some_words).select(*KEY, ok("m").alias("judged")))
_PG = f"SELECT sample_index, traj, answer_type, lower({D.extract('a1', 'answer_type')}) AS p, lower({D.extract('ground_truth', 'answer_type')}) AS g FROM sr"
query("v5b_match_answer", D.SR + f", t AS ({_PG}), u AS (SELECT *, {D.parse_number('p')} AS np, {D.parse_number('g')} AS ng FROM t) SELECT sample_index, traj, CASE WHEN p = '' THEN NULL WHEN answer_type IN ('mcq', 'yesno') THEN p = g "
      "WHEN answer_type = 'numeric' THEN coalesce(abs(np - ng) / abs(ng) <= 0.01, false) WHEN answer_type = 'counting' THEN coalesce(np = ng, false) WHEN p = g THEN true END AS x FROM u")(
    lambda spark, d: rollouts(spark, d).select(*KEY, "answer_type", T.extract(c.a1, c.kind).alias("p"), T.extract(c.truth, c.kind).alias("g")).withColumns({"p": T.normalize_answer(F.col("p")), "g": T.normalize_answer(F.col("g"))})
    .select(*KEY, match_answer(F.col("p"), F.col("g"), c.kind).alias("x")))


@query("v7_token_f1", D.SR + f""", t AS (SELECT sample_index, traj, {D.norm('a1')} AS p, {D.norm('a2')} AS g FROM sr), u AS (SELECT *, list_distinct(list_filter(string_split(p, ' '), lambda w: w <> '')) AS pt, list_distinct(list_filter(string_split(g, ' '), lambda w: w <> '')) AS gt FROM t),
 w AS (SELECT *, len(list_filter(pt, lambda w: list_contains(gt, w))) AS n FROM u)
SELECT sample_index, traj, round(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * (n / len(pt)) * (n / len(gt)) / ((n / len(pt)) + (n / len(gt))) END, 6) AS f1, p <> '' AND g <> '' AND (contains(p, g) OR contains(g, p)) AS inside FROM w""")
def _v7(spark, d):
    from millrace.operators.verify import contained, token_f1
    return rollouts(spark, d).select(*KEY, F.round(token_f1(T.token_set(c.a1), T.token_set(c.a2)), 6).alias("f1"), contained(T.normalize_text(c.a1), T.normalize_text(c.a2)).alias("inside"))


@query("v8_contradictions", D.SR + """, t AS (SELECT sample_index, traj, a1, a2 FROM sr WHERE answer_type = 'open')
SELECT sample_index, traj, (regexp_matches(a1, '\\bleft\\b') AND regexp_matches(a2, '\\bright\\b')) OR (regexp_matches(a1, '\\bright\\b') AND regexp_matches(a2, '\\bleft\\b')) AS antonym,
 (regexp_matches(a1, '\\bred\\b') AND regexp_matches(a2, '\\bblue\\b')) OR (regexp_matches(a1, '\\bblue\\b') AND regexp_matches(a2, '\\bred\\b')) AS color FROM t""")
def _v8(spark, d):
    from millrace.operators.verify import antonym_conflict, color_conflict
    p, g = (T.token_set(F.regexp_replace(x, "<[^>]*>", " ")) for x in (c.a1, c.a2))
    return rollouts(spark, d).where(c.kind == "open").select(*KEY, antonym_conflict(p, g).alias("antonym"), color_conflict(p, g).alias("color"))


query("v10_verify_distinct", J + "SELECT answer_type, count(*) AS n, count(*) FILTER (m1_v) AS right_ FROM j GROUP BY 1")(
    lambda spark, d: verify_distinct(rollouts(spark, d), "a1", "ground_truth", "answer_type", "m1").groupBy("answer_type").agg(F.count("*").alias("n"), F.count_if(ok("m1")).alias("right_")))

# ---- rewards -------------------------------------------------------------------
DET = "answer_type IN ('mcq', 'yesno', 'numeric', 'counting')"


def case(table: str, x1: str, x2: str) -> str:
    one = lambda t: f"CASE WHEN {x1} THEN CASE WHEN {x2} THEN {t[0]} ELSE {t[1]} END ELSE CASE WHEN {x2} THEN {t[2]} ELSE {t[3]} END END"
    return f"(CASE WHEN {DET} THEN {one(R.TABLES[table][0])} ELSE {one(R.TABLES[table][1])} END)"


def corr(v: str, s: str) -> str:
    return f"(CASE WHEN answer_type IN ('counting', 'open') AND {s} IS NOT NULL THEN 2 * {s} - 1 WHEN {v} THEN 1.0 ELSE -1.0 END)"


VER = f"(CASE upper({D.boxed('f1')}) WHEN 'INCORRECT' THEN CASE WHEN m1_v THEN -1.0 ELSE 1.0 END WHEN 'CORRECT' THEN CASE WHEN m1_v THEN 1.0 ELSE -1.0 END ELSE -1.0 END)"
FBF = rf"(CASE WHEN regexp_matches(f1, '(?is)<think>.*?</think>.*?\\boxed\{{.*?\}}') AND upper({D.boxed('f1')}) IN ('CORRECT', 'INCORRECT') THEN 1.0 ELSE 0.0 END)"
EMPTY = f"{D.strip('f1')} = ''"
unit = lambda x, lo, hi: f"least(greatest(({x} - ({lo})) / (({hi}) - ({lo})), 0.0), 1.0)"
typed = lambda x, r: f"(CASE WHEN {DET} THEN {unit(x, *r[0])} ELSE {unit(x, *r[1])} END)"


def reward(name: str, cols, sql: dict[str, str]) -> None:
    query(name, J + f"SELECT sample_index, traj, {', '.join(f'round(CAST({e} AS DOUBLE), 6) AS {c}' for c, e in sql.items())} FROM j")(
        lambda spark, d: judged(spark, d).select(*KEY, *[F.round(x.cast("double"), 6).alias(n) for n, x in cols().items()]))


reward("r1_a2_correctness", lambda: {"x": R.correctness(c.kind, c.m2, F.col("m2.score"))}, {"x": corr("m2_v", "m2_s")})
reward("r2_a1_correctness_01", lambda: {"x": F.when(c.m1, 1.0).otherwise(0.0)}, {"x": "CASE WHEN m1_v THEN 1 ELSE 0 END"})
reward("r3_improvement", lambda: {"x": R.by_transition("improvement", c.kind, c.m1, c.m2)}, {"x": case("improvement", "m1_v", "m2_v")})
reward("r4_no_regression", lambda: {"x": R.by_transition("no_regression_alone", c.kind, c.m1, c.m2)}, {"x": case("no_regression_alone", "m1_v", "m2_v")})
reward("r5_downstream", lambda: {"x": R.critic(c.f1, c.kind, c.m1, c.m2)["downstream"]}, {"x": f"CASE WHEN {EMPTY} THEN 0.0 ELSE {case('downstream_alone', 'm1_v', 'm2_v')} END"})
reward("r6_verification", lambda: {"x": R.verification(c.f1, c.m1)}, {"x": VER})
reward("r7_feedback_format", lambda: {"x": R.feedback_format(c.f1)}, {"x": FBF})
reward("r8_formats", lambda: {"think": R.tag_format(c.a2, c.kind), "tag": R.answer_tag_format(c.a2, c.kind), "bare": R.bare_format(c.a2, c.kind)}, {
    "think": D.tag_format("a2", "answer_type"), "tag": f"CASE WHEN regexp_matches(a2, '(?i)<answer>') AND ({D.tag('a2')}) <> '' AND {D.clean_atomic(f"({D.tag('a2')})", 'answer_type')} THEN 1.0 ELSE 0.0 END",
    "bare": rf"CASE WHEN a2 = '' THEN -1.0 WHEN answer_type = 'open' THEN 0.0 WHEN regexp_matches(lower(a2), CASE answer_type WHEN 'mcq' THEN '^\(?[a-f]\)?$' WHEN 'yesno' THEN '^(yes|no)$' ELSE '^\d+$' END) THEN 0.0 ELSE -1.0 END"})
_BARE = ORACLES["r8_formats"].split("round(CAST(")[3].rsplit(" AS DOUBLE)", 1)[0]
reward("r8_judged_format", lambda: {"bare": R.answer_format(c.a2, c.kind, "bare", some_words, c.truth)}, {"bare": f"CASE WHEN answer_type IN ('mcq', 'yesno') AND {D.strip('a2')} <> '' AND {_OVER('a2', 'ground_truth')} >= 0.3 THEN 0.0 ELSE {_BARE} END"})
reward("r9_critic", lambda: {"total": R.critic(c.f1, c.kind, c.m1, c.m2)["total"]}, {"total": f"2.0 * CASE WHEN {EMPTY} THEN 0.0 ELSE {case('downstream_alone', 'm1_v', 'm2_v')} END"})
reward("r10_refiner", lambda: {"total": R.refiner(c.kind, c.m1, c.m2, F.col("m2.score"), R.tag_format(c.a2, c.kind))["total"]}, {"total": f"{corr('m2_v', 'm2_s')} + 2.0 * {case('no_regression_alone', 'm1_v', 'm2_v')} + 0.15 * {D.tag_format('a2', 'answer_type')}"})
_resp = lambda: R.response(c.kind, c.n1, c.n2, F.col("n2.score"), R.tag_format(c.a1, c.kind), R.tag_format(c.a2, c.kind))
RESP = {"a1_correctness": "(CASE WHEN n1_v THEN 1.0 ELSE -1.0 END)", "a1_format": f"({D.tag_format('a1', 'answer_type')})", "a2_correctness": corr("n2_v", "n2_s"), "a2_format": f"({D.tag_format('a2', 'answer_type')})", "no_regression": case("no_regression", "n1_v", "n2_v")}
TOTAL = lambda comps, w: " + ".join(f"{getattr(w, k)} * {e}" for k, e in comps.items())
reward("r11_response", lambda: {k: _resp()[k] for k in (*RESP, "total")}, {**RESP, "total": TOTAL(RESP, R.ResponseWeights())})
DOWN = f"(CASE WHEN {EMPTY} THEN 0.0 ELSE {case('downstream', 'm1_v', 'm2_v')} END)"
FEED = {"downstream": f"(CASE WHEN {VER} > 0 THEN {DOWN} ELSE least({DOWN}, 0.0) END)", "verification": VER, "format": FBF}
_feed = lambda: R.feedback(c.f1, c.kind, c.m1, c.m2)
reward("r12_feedback", lambda: {k: _feed()[k] for k in (*FEED, "total")}, {**FEED, "total": TOTAL(FEED, R.FeedbackWeights())})
D01 = f"(CASE WHEN {EMPTY} THEN {unit('0.0', -1.5, 3)} ELSE {typed(case('downstream', 'm1_v', 'm2_v'), R.RANGES['downstream'])} END)"
reward("r13_unit_rewards", lambda: {"correctness": R.correctness_01(c.kind, c.m2, F.col("m2.score")), "no_reg": R.no_regression_01(c.kind, c.m1, c.m2), "downstream": R.downstream_01(c.f1, c.kind, c.m1, c.m2), "verification": R.verification_01(c.f1, c.m1), "format": R.format_unit(R.tag_format(c.a2, c.kind))},
       {"correctness": unit(corr("m2_v", "m2_s"), -1, 1), "no_reg": typed(case("no_regression", "m1_v", "m2_v"), R.RANGES["no_regression"]), "downstream": D01, "verification": unit(VER, -1, 1), "format": D.tag_format("a2", "answer_type")})
R01 = {"a1_correctness": "(CASE WHEN n1_v THEN 1.0 ELSE 0.0 END)", "a1_format": RESP["a1_format"], "a2_correctness": unit(corr("n2_v", "n2_s"), -1, 1), "a2_format": RESP["a2_format"], "no_regression": typed(case("no_regression", "n1_v", "n2_v"), R.RANGES["no_regression"])}
F01 = {"downstream": f"(CASE WHEN {VER} > 0 THEN {D01} ELSE least({D01}, CASE WHEN answer_type IN ('mcq', 'yesno', 'numeric') THEN {1.5 / 4.5} ELSE 0.5 END) END)", "verification": unit(VER, -1, 1), "format": FBF}
_r01 = lambda: R.response_01(c.kind, c.n1, c.n2, F.col("n2.score"), R.tag_format(c.a1, c.kind), R.tag_format(c.a2, c.kind))
_f01 = lambda: R.feedback_01(c.f1, c.kind, c.m1, c.m2)
reward("r14_unit_breakdowns", lambda: {"response": _r01()["total"], "feedback": _f01()["total"], "gated": _f01()["downstream"]}, {"response": TOTAL(R01, R.ResponseWeights()), "feedback": TOTAL(F01, R.FeedbackWeights()), "gated": F01["downstream"]})
reward("r15_baseline", lambda: {"format": R.tag_format(c.a1, c.kind), "total": R.baseline(c.m1, R.tag_format(c.a1, c.kind))["total"]}, {"format": RESP["a1_format"], "total": f"0.9 * CASE WHEN m1_v THEN 1 ELSE 0 END + 0.1 * {RESP['a1_format']}"})
_shaped_r = lambda: R.response(c.kind, c.n1, c.n2, F.col("n2.score"), F.lit(1.0), F.lit(1.0), shaping=R.alpha(-1.0, 1.0))
_shaped_f = lambda: R.feedback(c.f1, c.kind, c.m1, c.m2, shaping=0.5)
reward("r17_shaped", lambda: {"no_regression": _shaped_r()["no_regression"], "downstream": _shaped_f()["downstream"]}, {
    "no_regression": f"{RESP['a2_correctness']} - {RESP['a1_correctness']}",
    "downstream": (lambda x: f"CASE WHEN {VER} > 0 THEN {x} ELSE least({x}, 0.0) END")(f"(CASE WHEN {EMPTY} THEN 0.0 ELSE CASE WHEN m2_v THEN 1.0 ELSE -1.0 END + 0.5 * (CASE WHEN m2_v THEN 1.0 ELSE -1.0 END - CASE WHEN m1_v THEN 1.0 ELSE -1.0 END) END)")})
query("r16_weight_sets", "SELECT * FROM (VALUES ('response', true), ('feedback', true), ('baseline', true), ('critic', false)) AS t(name, convex)")(
    lambda spark, d: spark.createDataFrame([(n, R.convex(w)) for n, w in (("response", R.ResponseWeights()), ("feedback", R.FeedbackWeights()), ("baseline", R.BaselineWeights()), ("critic", R.CriticWeights()))], "name string, convex boolean"))
query("r18_transitions", J + "SELECT answer_type, concat(CASE WHEN m1_v THEN 'R' ELSE 'W' END, CASE WHEN m2_v THEN 'R' ELSE 'W' END) AS t, count(*) AS n FROM j GROUP BY ALL")(
    lambda spark, d: judged(spark, d).groupBy("answer_type", R.transition(c.m1, c.m2).alias("t")).agg(F.count("*").alias("n")))
reward("r19_refiner_functions", lambda: {"format": R.bare_format(F.coalesce(c.a2, F.lit("")), c.kind), "correctness": R.correctness(c.kind, c.m2, F.col("m2.score")), "no_regression": R.by_transition("no_regression_alone", c.kind, F.lit(True), c.m2)},
       {"format": ORACLES["r8_formats"].split("round(CAST(")[3].rsplit(" AS DOUBLE)", 1)[0], "correctness": corr("m2_v", "m2_s"), "no_regression": case("no_regression_alone", "true", "m2_v")})

# ---- metrics and group analytics -----------------------------------------------


def flags(spark, d):
    return judged(spark, d).withColumns({"a1_correct": c.m1, "a2_correct": c.m2})


RATES = ", ".join(f"round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 6) AS {n}" for n, c in {"a1_accuracy": "m1_v", "a2_accuracy": "m2_v", "rr_rate": "m1_v AND m2_v", "rw_rate": "m1_v AND NOT m2_v", "wr_rate": "NOT m1_v AND m2_v", "ww_rate": "NOT m1_v AND NOT m2_v"}.items())
rounded = lambda df, *keep: df.select(*keep, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep])
def rewarded(spark, d):
    j = judged(spark, d)
    return j.select(*KEY, "dataset_name", *[c.alias(k) for k, c in _resp().items() if k in (*RESP, "total")], *[_feed()[k].alias(f"fb_{k}") for k in (*FEED, "total")])


RW = J + ", rw AS (SELECT sample_index, traj, dataset_name, " + ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in RESP.items()) + f", CAST({TOTAL(RESP, R.ResponseWeights())} AS DOUBLE) AS total, " + ", ".join(f"CAST({e} AS DOUBLE) AS fb_{k}" for k, e in FEED.items()) + f", CAST({TOTAL(FEED, R.FeedbackWeights())} AS DOUBLE) AS fb_total FROM j)\n"
ADV = lambda c, g: f"CASE WHEN max({c}) OVER (PARTITION BY {g}) - min({c}) OVER (PARTITION BY {g}) > 1e-9 THEN ({c} - avg({c}) OVER (PARTITION BY {g})) / (stddev_samp({c}) OVER (PARTITION BY {g}) + 1e-8) ELSE 0.0 END"
# the same with the flags and texts that metrics need
RWM = RW.replace("rw AS (SELECT sample_index, traj, dataset_name, ", "rw AS (SELECT sample_index, traj, dataset_name, answer_type, m1_v, m2_v, n1_v, f1, a2, ", 1)


def measured(spark, d):
    return judged(spark, d).select(*KEY, "dataset_name", "answer_type", "f1", "a2", c.m1.alias("a1_correct"), c.m2.alias("a2_correct"), *[x.alias(k) for k, x in _resp().items() if k in (*RESP, "total")],
                                   *[_feed()[k].alias(f"fb_{k}") for k in (*FEED, "total")], R.baseline(c.m1, R.tag_format(c.a1, c.kind))["total"].alias("base_total"), R.critic(c.f1, c.kind, c.m1, c.m2)["total"].alias("critic_total"))


zero = lambda e: f"round(avg(CASE WHEN {e} = 0.0 THEN 1 ELSE 0 END), 6)"
MEANS = f"round(avg(total), 6) AS response_reward_mean, round(avg(fb_total), 6) AS feedback_reward_mean, {zero('a2_format')} AS a2_format_violation_rate, {zero('fb_format')} AS fb_format_violation_rate"
query("a10_transition_metrics", RWM + f"SELECT dataset_name, count(*) AS total_trajectories, {RATES}, {MEANS} FROM rw GROUP BY 1")(lambda spark, d: rounded(G.reflection_metrics(measured(spark, d), "dataset_name"), "dataset_name"))
_NAN = ", ".join(f"CAST('NaN' AS DOUBLE) AS {k}" for k in ("a2_accuracy", "rr_rate", "rw_rate", "wr_rate", "ww_rate", "a2_format_violation_rate", "fb_format_violation_rate"))
query("a10b_baseline_metrics", RWM + f"SELECT answer_type, count(*) AS total_trajectories, round(avg(CASE WHEN m1_v THEN 1 ELSE 0 END), 6) AS a1_accuracy, round(avg(0.9 * CASE WHEN m1_v THEN 1 ELSE 0 END + 0.1 * a1_format), 6) AS response_reward_mean, {zero('a1_format')} AS a1_format_violation_rate, CAST(0.0 AS DOUBLE) AS feedback_reward_mean, {_NAN} FROM rw GROUP BY 1")(
    lambda spark, d: rounded(G.baseline_metrics(measured(spark, d), "answer_type", reward="base_total"), "answer_type"))
_PAIR = ", ".join(f"round(avg(CASE WHEN {x} THEN 1 ELSE 0 END), 6) AS {n}" for n, x in {"rr_rate": "m1_v AND v2", "rw_rate": "m1_v AND NOT v2", "wr_rate": "NOT m1_v AND v2", "ww_rate": "NOT m1_v AND NOT v2"}.items())
query("a10c_critic_metrics", RWM + f", p AS (SELECT *, CASE WHEN a2 <> '' THEN m2_v END AS v2 FROM rw) SELECT dataset_name, count(*) AS total_pairs, round(avg(2.0 * CASE WHEN {EMPTY} THEN 0.0 ELSE {case('downstream_alone', 'm1_v', 'm2_v')} END), 6) AS reward_mean, {_PAIR}, " + r"round(avg(len(list_filter(regexp_split_to_array(f1, '\s+'), lambda w: w <> ''))), 6) AS feedback_length_mean FROM p GROUP BY 1")(
    lambda spark, d: rounded(G.critic_metrics(measured(spark, d).withColumn("a2_correct", F.when(F.col("a2") != "", F.col("a2_correct"))), "dataset_name", reward="critic_total"), "dataset_name"))
query("w1_grpo_advantage", RW + f"SELECT sample_index, traj, round({ADV('total', 'sample_index')}, 5) + 0.0 AS adv, round({ADV('fb_total', 'sample_index')}, 5) + 0.0 AS fb FROM rw")(
    lambda spark, d: rewarded(spark, d).select(*KEY, (F.round(G.advantage(F.col("total"), "sample_index"), 5) + 0.0).alias("adv"), (F.round(G.advantage(F.col("fb_total"), "sample_index"), 5) + 0.0).alias("fb")))
query("w2_drgrpo_advantage", RW + "SELECT sample_index, traj, round(total - avg(total) OVER (PARTITION BY sample_index), 10) + 0.0 AS adv FROM rw")(
    lambda spark, d: rewarded(spark, d).select(*KEY, (F.round(G.advantage(F.col("total"), "sample_index", plain=True), 10) + 0.0).alias("adv")))
query("w3_ragged_advantage", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({ADV('l_extendedprice', 'l_orderkey')}, 5) + 0.0 AS adv FROM lineitem")(
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.round(G.advantage(F.col("l_extendedprice"), "l_orderkey"), 5) + 0.0).alias("adv")))
_W = R.ResponseWeights()
_Z = " + ".join(f"{getattr(_W, k)} * CASE WHEN coalesce(stddev_samp({k}) OVER g, 0) > 1e-8 THEN ({k} - avg({k}) OVER g) / (stddev_samp({k}) OVER g + 1e-8) ELSE 0.0 END" for k in RESP)
query("w4_gdpo_advantage", RW + f", z AS (SELECT sample_index, traj, dataset_name, {_Z} AS x FROM rw WINDOW g AS (PARTITION BY sample_index)) SELECT sample_index, traj, round((x - avg(x) OVER b) / (stddev_samp(x) OVER b + 1e-8), 4) + 0.0 AS adv FROM z WINDOW b AS (PARTITION BY dataset_name)")(
    lambda spark, d: G.component_advantage(rewarded(spark, d), {k: getattr(_W, k) for k in RESP}, ["sample_index"], ["dataset_name"]).select(*KEY, (F.round("advantage", 4) + 0.0).alias("adv")))
_A1, _A2 = f"({_W.a1_correctness} * a1_correctness + {_W.a1_format} * a1_format)", f"({_W.a2_correctness} * a2_correctness + {_W.a2_format} * a2_format + {_W.no_regression} * no_regression)"
query("w5_turn_advantages", RW + f"SELECT sample_index, traj, round({ADV(_A1, 'sample_index')}, 4) + 0.0 AS a1_adv, round({ADV(_A2, 'sample_index')}, 4) + 0.0 AS a2_adv FROM rw")(
    lambda spark, d: G.turn_advantages(rewarded(spark, d), ["sample_index"]).select(*KEY, (F.round("a1_advantage", 4) + 0.0).alias("a1_adv"), (F.round("a2_advantage", 4) + 0.0).alias("a2_adv")))
_SPREAD = lambda c: f"avg(CASE WHEN s_{c} < 1e-6 THEN 0 ELSE abs(({c} - m_{c}) / (s_{c} + 1e-6)) END)"
_GS = RW + ", gs AS (SELECT *, stddev_samp(total) OVER g AS s_total, avg(total) OVER g AS m_total, stddev_samp(fb_total) OVER g AS s_fb_total, avg(fb_total) OVER g AS m_fb_total FROM rw WINDOW g AS (PARTITION BY sample_index)), "
_GS += f"gg AS (SELECT sample_index, count(*) AS n, {_SPREAD('total')} AS a, {_SPREAD('fb_total')} AS b, max(s_total) AS st FROM gs GROUP BY 1)\n"
query("a11_group_spread", _GS + "SELECT sample_index, n, round(a, 4) AS a, round(b, 4) AS b, n = 8 AND a + b > 1e-4 AS kept FROM gg")(
    lambda spark, d: G.group_spread(rewarded(spark, d), ["sample_index"], ["total", "fb_total"], 8).select("sample_index", "n", F.round("total_spread", 4).alias("a"), F.round("fb_total_spread", 4).alias("b"), "kept"))
query("f14_keep_varied", _GS + "SELECT sample_index, traj FROM rw WHERE sample_index IN (SELECT sample_index FROM gg WHERE n = 8 AND a + b > 1e-4)")(
    lambda spark, d: G.keep_varied(rewarded(spark, d), ["sample_index"], ["total", "fb_total"], 8).select(*KEY))
query("f15_empty_batch", "SELECT CAST(NULL AS BIGINT) AS sample_index, CAST(NULL AS BOOLEAN) AS kept WHERE false")(
    lambda spark, d: G.group_spread(rewarded(spark, d).where("false"), ["sample_index"], ["total"], 8).select("sample_index", "kept"))
query("a12_zero_std_share", _GS + "SELECT round(avg(CASE WHEN coalesce(st, 0) < 1e-4 THEN 1 ELSE 0 END), 6) AS zero_std_share, count(*) AS n_groups FROM gg")(
    lambda spark, d: rounded(G.zero_std_share(rewarded(spark, d), ["sample_index"], "total")))
query("a13_component_means", RW + "SELECT component, round(mean, 6) AS mean FROM (UNPIVOT (SELECT " + ", ".join(f"avg({k}) AS {k}" for k in RESP) + " FROM rw) ON COLUMNS(*) INTO NAME component VALUE mean)")(
    lambda spark, d: rounded(G.component_means(rewarded(spark, d), list(RESP))))
query("a14_batch_diagnostics", RW + f", av AS (SELECT *, {ADV('total', 'sample_index')} AS a, {ADV('fb_total', 'sample_index')} AS b FROM rw) SELECT dataset_name, round(stddev_samp(total), 6) AS reward_std, round(avg(abs(a)), 5) AS response_abs_mean, count(*) FILTER (a = 0) AS response_zeros, round(avg(abs(b)), 5) AS feedback_abs_mean, count(*) FILTER (b = 0) AS feedback_zeros FROM av GROUP BY 1")(
    lambda spark, d: G.batch_diagnostics(rewarded(spark, d).withColumns({"a": G.advantage(F.col("total"), "sample_index"), "b": G.advantage(F.col("fb_total"), "sample_index")}), "dataset_name", reward="total", advantages={"response": "a", "feedback": "b"})
    .select("dataset_name", F.round("reward_std", 6).alias("reward_std"), F.round("response_abs_mean", 5).alias("response_abs_mean"), "response_zeros", F.round("feedback_abs_mean", 5).alias("feedback_abs_mean"), "feedback_zeros"))
query("a15_across_ranks", RW + "SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(t), 6) AS total, round(avg(f), 6) AS fb_total FROM (SELECT sample_index % 4 AS r, count(*) AS n, avg(total) AS t, avg(fb_total) AS f FROM rw GROUP BY 1)")(
    lambda spark, d: rounded(G.across_ranks(rewarded(spark, d).withColumn("r", F.col("sample_index") % 4).withColumn("n", F.lit(1)), "r", ["total", "fb_total"], "n")))
_TOK = "SELECT label % 3 AS b, list_transform(range(1, 33), lambda k: CAST(embedding[k] AS DOUBLE) * 3) AS n, list_transform(range(33, 65), lambda k: CAST(embedding[k] AS DOUBLE) * 3) AS o FROM embeddings"
query("a18_clip_and_entropy", f"WITH t AS ({_TOK}), u AS (SELECT b, list_transform(range(1, 33), lambda k: exp(n[k] - o[k])) AS r, list_sum(list_transform(n, lambda x: abs(x))) AS e FROM t) SELECT b, round(sum(len(list_filter(r, lambda x: x < 0.8 OR x > 1.2))) / CAST(sum(32) AS DOUBLE), 6) AS clip_fraction, round(sum(e) / sum(32), 6) AS entropy FROM u GROUP BY 1")(
    lambda spark, d: rounded(G.token_diagnostics(spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("label") % 3).alias("b"), *[F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double") * 3).alias(n) for n, at in (("n", 1), ("o", 33))])
                                                 .withColumn("e", F.transform("n", F.abs)), "b", new="n", old="o", entropy="e"), "b"))
query("a19_completion_length", D.SR + r"SELECT answer_type, round(avg(len(regexp_split_to_array(a1, '\s+'))), 6) AS a1, round(avg(CASE WHEN f1 = '' THEN 0 ELSE len(regexp_split_to_array(f1, '\s+')) END), 6) AS f1, round(avg(length(a2) - length(ground_truth)), 6) AS a2 FROM sr GROUP BY 1")(
    lambda spark, d: rollouts(spark, d).groupBy("answer_type").agg(F.round(F.avg(G.completion_length(F.split("a1", r"\s+"))), 6).alias("a1"), F.round(F.avg(G.completion_length(F.when(F.col("f1") != "", F.split("f1", r"\s+")))), 6).alias("f1"),
                                                                    F.round(F.avg(G.completion_length(whole=F.length("a2"), prompt=F.length("ground_truth"))), 6).alias("a2")))
query("a20_validation_metrics", RWM + f"SELECT concat('val/', name) AS metric, value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS total_trajectories, {RATES}, {MEANS} FROM rw WHERE sample_index % 5 = 0) ON COLUMNS(*) INTO NAME name VALUE value)")(
    lambda spark, d: (lambda sr: G.rekeyed(sr, "val").select("metric", F.round("value", 6).alias("value")))(G.keyed(G.reflection_metrics(measured(spark, d).where("sample_index % 5 = 0")), "sr")))
query("a1_pass_rates", J + "SELECT sample_index, CAST(count(*) AS INTEGER) AS k, count(*) FILTER (m1_v) AS a1_correct_count, round(count(*) FILTER (m1_v) / CAST(count(*) AS DOUBLE), 6) AS a1_pass_rate FROM j GROUP BY 1")(
    lambda spark, d: rounded(C.pass_rates(flags(spark, d), "sample_index", correct="a1_correct"), "sample_index"))
_BUCKET = "CASE WHEN c = 0 THEN 'brick_wall' WHEN c >= 7 THEN 'trivial' WHEN c >= 4 THEN 'easy' ELSE 'medium' END"
_DIFF = J + f", dd AS (SELECT sample_index, dataset_name, count(*) FILTER (m1_v) AS c FROM j GROUP BY 1, 2), db AS (SELECT *, {_BUCKET} AS b FROM dd)\n"


def difficulty(spark, d):
    return C.with_bucket(C.pass_rates(flags(spark, d), "sample_index", "dataset_name", correct="a1_correct"))


query("p28_bucket", _DIFF + "SELECT sample_index, b FROM db")(lambda spark, d: difficulty(spark, d).select("sample_index", F.col("difficulty_bucket").alias("b")))
query("a2_bucket_counts", _DIFF + "SELECT dataset_name, b, count(*) AS n FROM db GROUP BY ALL")(lambda spark, d: difficulty(spark, d).groupBy("dataset_name", F.col("difficulty_bucket").alias("b")).agg(F.count("*").alias("n")))
query("a6_bucket_table", _DIFF + "SELECT x.pos, x.b AS difficulty_bucket, count(db.b) AS n, round(100.0 * count(db.b) / (SELECT count(*) FROM db), 1) AS share FROM (VALUES (0, 'trivial'), (1, 'easy'), (2, 'medium'), (3, 'brick_wall')) AS x(pos, b) LEFT JOIN db ON db.b = x.b GROUP BY 1, 2")(
    lambda spark, d: C.bucket_table(difficulty(spark, d)))
query("a7_bucket_pivot", _DIFF + "SELECT dataset_name, " + ", ".join(f"count(*) FILTER (b = '{b}') AS {b}" for b in N.BUCKETS) + ", count(*) AS total FROM db GROUP BY 1")(
    lambda spark, d: C.pivot_counts(difficulty(spark, d), "dataset_name", "difficulty_bucket", list(N.BUCKETS)))
query("a8_correct_histogram", _DIFF + "SELECT dataset_name, " + ", ".join(f'count(*) FILTER (c = {k}) AS "{k}"' for k in range(9)) + ", count(*) AS total FROM db GROUP BY 1")(
    lambda spark, d: C.pivot_counts(difficulty(spark, d), "dataset_name", "a1_correct_count", list(range(9))))
query("a9_recommendation", _DIFF + "SELECT count(*) FILTER (b IN ('trivial', 'brick_wall')) AS drop_, count(*) FILTER (b NOT IN ('trivial', 'brick_wall')) AS keep_, round(100.0 * count(*) FILTER (b NOT IN ('trivial', 'brick_wall')) / count(*), 1) AS keep_share FROM db")(
    lambda spark, d: difficulty(spark, d).select(F.col("difficulty_bucket").isin("trivial", "brick_wall").alias("x")).agg(F.count_if("x").alias("drop_"), F.count_if(~F.col("x")).alias("keep_"), F.round(100.0 * F.try_divide(F.count_if(~F.col("x")), F.count("*")), 1).alias("keep_share")))
query("j1_drop_extremes", _DIFF + "SELECT sample_index, traj FROM sr WHERE sample_index NOT IN (SELECT sample_index FROM db WHERE b IN ('trivial', 'brick_wall'))")(
    lambda spark, d: C.drop_extremes(rollouts(spark, d), difficulty(spark, d), "sample_index").select(*KEY))
query("m5_difficulty_rows", J + "SELECT sample_index, list_sort(list(substr(a1, 1, 16))) AS completions FROM j GROUP BY 1")(
    lambda spark, d: rollouts(spark, d).groupBy("sample_index").agg(F.sort_array(F.collect_list(T.preview(c.a1, 16))).alias("completions")))
query("j10_repeat_interleave", D.SR + "SELECT sample_index, traj, sample_index * 8 + traj AS pos, sample_index = (sample_index * 8 + traj) // 8 AS same FROM sr")(
    lambda spark, d: rollouts(spark, d).withColumn("pos", F.col("sample_index") * 8 + F.col("traj")).select(*KEY, "pos", (G.block_of(F.col("pos"), 8) == F.col("sample_index")).alias("same")))
query("j12_lookup_by_key", D.SR + ", q AS (SELECT DISTINCT sample_index, concat('Q', CAST(sample_index % 50 AS VARCHAR)) AS question FROM sr) SELECT sr.sample_index, traj, question FROM sr JOIN q USING (sample_index)")(
    lambda spark, d: (lambda r: r.join(r.select("sample_index", F.concat(F.lit("Q"), (F.col("sample_index") % 50).cast("string")).alias("question")).distinct(), "sample_index").select(*KEY, "question"))(rollouts(spark, d)))
