"""Verification of free-text answers against ground truth: (parse_ok, verdict, extracted, score).

``verify`` works in stages of plain columns, so that no extraction is computed
twice; ``verify_distinct`` scores each different question only once and joins the
results back, for logs in which answers repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import numbers as N, text as T

CORRECT, WRONG = "CORRECT", "WRONG"
DETERMINISTIC = ("mcq", "yesno", "numeric", "counting")
F1_LEAST, ANLS_LEAST, COUNT_LEAST = 0.85, 0.7, 0.75
# Fixed values.
COLORS = "black blue brown gray green grey orange pink purple red white yellow".split()
ANTONYMS = [
    ("left", "right"), ("up", "down"), ("above", "below"), ("top", "bottom"), ("front", "back"), ("inside", "outside"), ("before", "after"), ("yes", "no"), ("true", "false"),
    ("positive", "negative"), ("higher", "lower"), ("more", "less"), ("larger", "smaller"), ("bigger", "smaller"), ("increase", "decrease"), ("north", "south"), ("east", "west"),
    ("horizontal", "vertical"), ("clockwise", "counterclockwise"), ("ascending", "descending"),
]
#: A model's score from which two answers count as the same.
JUDGE_LEAST = 0.7
Judge = Callable[[Column, Column], Column]


def result(ok: Column | bool, verdict: Column | str, extracted: Column | str, score: Column | None = None) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lift(ok).alias("parse_ok"), lift(verdict).alias("verdict"), lift(extracted).alias("extracted"), (F.lit(None) if score is None else score).cast("double").alias("score"))


def antonym_conflict(p: Column, g: Column) -> Column:
    """Of token sets: words that only one has form an antonym pair."""
    po, go = F.array_except(p, g), F.array_except(g, p)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ANTONYMS])
    crossed = lambda x, y: F.array_contains(po, x) & F.array_contains(go, y)
    return (F.size(po) > 0) & (F.size(go) > 0) & F.exists(pairs, lambda w: crossed(w["a"], w["b"]) | crossed(w["b"], w["a"]))


def color_conflict(p: Column, g: Column) -> Column:
    colors = F.array(*map(F.lit, COLORS))
    pc, gc = F.array_intersect(p, colors), F.array_intersect(g, colors)
    return (F.size(pc) > 0) & (F.size(gc) > 0) & ((F.size(F.array_except(pc, gc)) > 0) | (F.size(F.array_except(gc, pc)) > 0))


def token_f1(p: Column, g: Column) -> Column:
    n = F.size(F.array_intersect(p, g))
    precision, recall = n / F.size(p), n / F.size(g)
    return F.when((n == 0) | (F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def contained(p: Column, g: Column) -> Column:
    """Of normalised texts."""
    return (p != "") & (g != "") & (F.contains(p, g) | F.contains(g, p))


def word_overlap(p: Column, g: Column) -> Column:
    """A judge that needs no model: shared words over all words of both."""
    a, b = F.array_distinct(T.words(p)), F.array_distinct(T.words(g))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def judged_by(judge: Judge, pred: Column, truth: Column, extracted: Column, least: float = JUDGE_LEAST) -> Column:
    score = F.coalesce(judge(pred, truth).cast("double"), F.lit(0.0))
    return result(True, F.when(score >= least, CORRECT).otherwise(WRONG), extracted, score)


def open_stages(df: DataFrame, pred: str, truth: str, out: str, judge: Judge | None = None, least: float = JUDGE_LEAST) -> DataFrame:
    """Adds ``out``: the verdict of the open-ended cascade. ``judge`` scores, from answer and truth, what no earlier stage
    tells; without one the last stage is WRONG. A model's judge is an Arrow UDF behind the same two columns."""
    p, g = F.col(pred), F.col(truth)
    df = df.withColumns({"_pl": F.lower(T.strip(p)), "_gl": F.lower(T.strip(g)), "_pn": T.normalize_text(p), "_gn": T.normalize_text(g), "_pw": T.words(p), "_gw": T.words(g)})
    df = df.withColumns({"_pt": F.array_distinct("_pw"), "_gt": F.array_distinct("_gw")})
    pt, gt = F.col("_pt"), F.col("_gt")
    df = df.withColumns({"_f1": F.when((F.size("_pw") <= 4) & (F.size("_gw") <= 4), token_f1(pt, gt)),
                         "_anls": F.when((F.size("_pw").between(1, 3)) & F.size("_gw").between(1, 3), 1 - N.edit_distance(F.col("_pl"), F.col("_gl"))),
                         "_bad": antonym_conflict(pt, gt) | color_conflict(pt, gt)})
    cascade = (F.when(F.col("_bad"), result(True, WRONG, p)).when(F.col("_pl") == F.col("_gl"), result(True, CORRECT, p, F.lit(1.0)))
               .when(contained(F.col("_pn"), F.col("_gn")), result(True, CORRECT, p, F.lit(0.95))).when(F.col("_f1") >= F1_LEAST, result(True, CORRECT, p, F.col("_f1")))
               .when(F.col("_anls") >= ANLS_LEAST, result(True, CORRECT, p, F.col("_anls")))
               .otherwise(result(True, WRONG, p, F.col("_anls")) if judge is None else judged_by(judge, p, g, p, least)))
    return df.withColumn(out, F.when(p == "", result(False, WRONG, "")).otherwise(cascade)).drop("_pl", "_gl", "_pn", "_gn", "_pw", "_gw", "_pt", "_gt", "_f1", "_anls", "_bad")


def number_match(p: Column, g: Column, tolerance: float) -> Column:
    return F.coalesce(F.when(g == 0, F.abs(p) <= tolerance).otherwise(F.abs(p - g) / F.greatest(F.abs(g), F.lit(1e-10)) <= tolerance), F.lit(False))


def match_answer(pred: Column, truth: Column, kind: Column, tolerance: float = 0.01) -> Column:
    """True, False, or null where it can't be told, of normalised answers."""
    p, g = T.parse_number(pred), T.parse_number(truth)
    return (F.when(pred == "", F.lit(None).cast("boolean")).when(kind.isin("mcq", "yesno"), pred == truth).when(kind == "numeric", number_match(p, g, tolerance))
            .when(kind == "counting", number_match(p, g, 0.0)).when(pred == truth, F.lit(True)))


def _number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def verify(df: DataFrame, text: str, truth: str, kind: str, out: str, strict: bool = False, tolerance: float = 0.01, judge: Judge | None = None) -> DataFrame:
    """Adds ``out``, a struct (parse_ok, verdict, extracted, score). ``judge``: scores free answers that the rules leave open,
    and whole yes/no answers that agree in their first word."""
    k = F.col(kind)
    raw = F.col(text) if strict else T.answer_portion(F.col(text))
    df = df.withColumns({"_raw": F.coalesce(raw, F.lit("")), "_truth": F.coalesce(T.answer_portion(F.col(truth)), F.lit(""))})
    r, g = F.col("_raw"), F.col("_truth")
    df = df.withColumns({"_x": T.strip(r), "_in": T.answer_tag(r), "_has": T.has_answer_tag(r), "_gin": T.answer_tag(g)})
    inner = F.col("_in")
    if strict:
        pred, number = F.when(~F.col("_has"), "").otherwise(T.atomic(inner, k)), F.when(F.col("_has"), T.to_float(F.regexp_extract(inner, T.NUMERIC_ATOMIC, 1)))
    else:
        pred, number = F.when(k == "mcq", T.mcq_letter(inner)).when(k == "yesno", T.yesno(inner)).when(k == "numeric", T.numeric(inner)).otherwise(inner), T.sentence_number(r)
    df = df.withColumns({
        "_p": pred, "_gm": F.when(k == "mcq", T.mcq_letter(F.col("_gin"))), "_tail": F.when(k == "mcq", F.regexp_extract(F.col("_x"), T.MCQ_LETTER_TEXT, 3)),
        "_hedge": F.when(k == "yesno", T.hedging(r)), "_ps": F.lower(F.regexp_extract(r, T.YESNO_START, 1)), "_gs": F.lower(F.regexp_extract(g, T.YESNO_START, 1)),
        "_pa": F.lower(F.regexp_extract(r, T.YESNO, 1)), "_ga": F.lower(F.regexp_extract(g, T.YESNO, 1)),
        "_gnum": F.when(k == "counting", T.sentence_number(g)), "_pnum": F.when(k == "counting", number)})
    df = open_stages(df, "_x", "_truth", "_open", judge)
    p, x, o = F.col("_p"), F.col("_x"), F.col("_open")
    none = result(False, WRONG, "")
    sided = lambda a, b: F.when(a == b, CORRECT).otherwise(WRONG)
    gm = F.col("_gm")
    mcq = (F.when((p != "") & (gm != ""), result(True, sided(p, gm), p)).when((p != "") & (gm == "") & (F.col("_tail") != "") & (F.lower(T.strip(g)) == F.lower(T.strip(F.col("_tail")))), result(True, CORRECT, x))
           .when(gm == "", o).otherwise(none))
    ps, gs, pa, ga = (F.col(c) for c in ("_ps", "_gs", "_pa", "_ga"))
    first = F.coalesce(F.nullif(gs, F.lit("")), ga)
    if strict:
        yn = F.when(p == "", none).when(first == "", result(True, WRONG, p)).otherwise(result(True, sided(F.lower(p), first), p))
    else:
        agreed = lambda said: o if judge is None else judged_by(judge, x, g, F.initcap(said))
        yn = (F.when(F.col("_hedge"), none).when((ps != "") & (gs != ""), F.when(ps == gs, agreed(ps)).otherwise(result(True, WRONG, F.initcap(ps)))).when(ga == "", o)
              .when(pa != "", F.when(pa == ga, agreed(pa)).otherwise(result(True, WRONG, F.initcap(pa)))).otherwise(none))
    pn, gn = F.col("_pnum"), F.col("_gnum")
    share = F.greatest(F.lit(0.0), 1 - F.abs(pn - gn) / F.greatest(F.abs(gn), F.lit(3.0)))
    counted = result(True, F.when(share >= COUNT_LEAST, CORRECT).otherwise(WRONG), _number_text(pn), share)
    count = F.when(pn.isNotNull() & gn.isNotNull(), counted)
    count = count.when(pn.isNull(), none).otherwise(result(False, WRONG, _number_text(pn))) if strict else count.otherwise(o)
    numeric = F.when(p == "", none).otherwise(result(True, F.when(number_match(T.parse_number(p), T.parse_number(g), tolerance), CORRECT).otherwise(WRONG), p))
    found = F.when(k == "mcq", mcq).when(k == "yesno", yn).when(k == "counting", count).when(k == "numeric", numeric).otherwise(o)
    return df.withColumn(out, found).drop("_raw", "_truth", "_x", "_in", "_has", "_gin", "_p", "_gm", "_tail", "_hedge", "_ps", "_gs", "_pa", "_ga", "_gnum", "_pnum", "_open")


def verify_distinct(df: DataFrame, text: str, truth: str, kind: str, out: str, scorer: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
    """As ``verify``, but each distinct (type, truth, text) is scored once. ``scorer`` may refine the distinct rows: it
    gets (kind, truth, text, out) and returns them with another ``out``, as a model-based last stage would."""
    keys = df.select(F.col(kind).alias("_k"), F.col(truth).alias("_g"), F.col(text).alias("_t")).distinct()
    scored = verify(keys, "_t", "_g", "_k", out, **how)
    if scorer is not None:
        scored = scorer(scored)
    same = F.col(kind).eqNullSafe(F.col("_k")) & F.col(truth).eqNullSafe(F.col("_g")) & F.col(text).eqNullSafe(F.col("_t"))
    return df.join(scored, same, "left").drop("_k", "_g", "_t")
