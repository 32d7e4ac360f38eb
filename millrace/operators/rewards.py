"""Reward algebra over one trajectory, as Column expressions.

``a1`` and ``a2`` are booleans: whether the first and the second answer are right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from millrace.functions import text as T
from millrace.functions.numbers import to_unit

from .verify import DETERMINISTIC

# Rewards by transition, right-right, right-wrong, wrong-right, wrong-wrong.
TABLES = {
    "no_regression": ((1.0, -2.0, 3.0, 0.0), (1.0, -3.0, 2.0, 0.0)),
    "no_regression_alone": ((1.0, -2.0, 2.35, -0.5), (1.0, -3.0, 2.35, -0.5)),
    "downstream": ((1.0, -1.5, 3.0, -1.0), (1.0, -2.0, 2.0, -1.0)),
    "downstream_alone": ((3.0, -1.5, 3.0, -1.0), (2.0, -2.0, 2.0, -1.0)),
    "improvement": ((1.0, -2.0, 2.0, -0.5), (1.0, -2.0, 2.0, -0.5)),
}
RANGES = {"correctness": (-1, 1), "no_regression": ((-2, 3), (-3, 2)), "downstream": ((-1.5, 3), (-2, 2)), "verification": (-1, 1), "bare_format": (-1, 0), "improvement": (-2, 2)}


@dataclass(frozen=True)
class ResponseWeights:
    a1_correctness: float = 0.27
    a1_format: float = 0.03
    a2_correctness: float = 0.27
    a2_format: float = 0.03
    no_regression: float = 0.40


@dataclass(frozen=True)
class FeedbackWeights:
    downstream: float = 0.45
    verification: float = 0.45
    format: float = 0.10


@dataclass(frozen=True)
class BaselineWeights:
    a1_correctness: float = 0.9
    a1_format: float = 0.1


@dataclass(frozen=True)
class CriticWeights:
    downstream: float = 2.0


@dataclass(frozen=True)
class RefinerWeights:
    correctness: float = 1.0
    no_regression: float = 2.0
    format: float = 0.15


def convex(weights) -> bool:
    """Whether a weight set sums to one."""
    return abs(sum(vars(weights).values()) - 1) < 1e-6


def alpha(own: float, shared: float) -> float:
    """A negative own shaping weight stands for the shared one."""
    return shared if own < 0 else own


def deterministic(kind: Column) -> Column:
    return kind.isin(*DETERMINISTIC)


def transition(a1: Column, a2: Column) -> Column:
    return F.concat(F.when(a1, "R").otherwise("W"), F.when(a2, "R").otherwise("W"))


def _pick(values: tuple, a1: Column, a2: Column) -> Column:
    rr, rw, wr, ww = values
    return F.when(a1, F.when(a2, rr).otherwise(rw)).otherwise(F.when(a2, wr).otherwise(ww))


def by_transition(table: str, kind: Column, a1: Column, a2: Column) -> Column:
    det, other = TABLES[table]
    return F.when(deterministic(kind), _pick(det, a1, a2)).otherwise(_pick(other, a1, a2))


def signed(ok: Column) -> Column:
    return F.when(ok, 1.0).otherwise(-1.0)


def correctness(kind: Column, ok: Column, score: Column) -> Column:
    """Graded for counting and open answers with a score, else +-1."""
    return F.when(kind.isin("counting", "open") & score.isNotNull(), 2 * score - 1).otherwise(signed(ok))


def verification(feedback: Column, a1: Column) -> Column:
    said = F.upper(T.boxed(feedback))
    return F.when(said == "INCORRECT", signed(~a1)).when(said == "CORRECT", signed(a1)).otherwise(-1.0)


def feedback_format(feedback: Column) -> Column:
    return F.when(T.has_think_boxed(feedback) & F.upper(T.boxed(feedback)).isin("CORRECT", "INCORRECT"), 1.0).otherwise(0.0)


def tag_format(text: Column, kind: Column) -> Column:
    inner = T.answer_tag(text)
    return F.when(T.has_think_answer(text) & (inner != "") & T.clean_atomic(inner, kind), 1.0).otherwise(0.0)


def answer_tag_format(text: Column, kind: Column) -> Column:
    inner = T.answer_tag(text)
    return F.when(text.rlike("(?i)<answer>") & (inner != "") & T.clean_atomic(inner, kind), 1.0).otherwise(0.0)


def bare_format(text: Column, kind: Column, judge=None, truth: Column | None = None, least: float = 0.7) -> Column:
    """0 for a clean answer, else -1. ``judge`` (text, truth -> score) may clear a lengthy choice or verdict; without one, or
    without a truth, it counts as unclean."""
    n = T.normalize_answer(text)
    plain = F.regexp_replace(n, ",", "")
    parts = F.split(plain, "/")
    number = F.when(F.instr(plain, "/") > 0, (F.size(parts) == 2) & T.to_float(parts[0]).isNotNull() & T.to_float(F.get(parts, F.lit(1))).isNotNull()).otherwise(T.to_float(F.rtrim(plain, F.lit("%"))).isNotNull())
    ok = (F.when(n == "", False).when(kind == "mcq", n.rlike("^[a-f]$")).when(kind == "yesno", n.isin("yes", "no")).when(kind == "counting", n.rlike(r"(?U)^[+-]?\d+$")).when(kind == "numeric", number).otherwise(True))
    if judge is not None and truth is not None:
        ok = ok | (kind.isin("mcq", "yesno") & (n != "") & (F.coalesce(truth, F.lit("")) != "") & F.coalesce(judge(T.strip(text), truth) >= least, F.lit(False)))
    return F.when(ok, 0.0).otherwise(-1.0)


def answer_format(text: Column, kind: Column, mode: str = "think", judge=None, truth: Column | None = None) -> Column:
    """The format reward of a mode: think, tag or bare; only bare ones may ask a judge."""
    if mode == "bare":
        return bare_format(text, kind, judge, truth)
    return {"think": tag_format, "tag": answer_tag_format}[mode](text, kind)


def format_unit(raw: Column) -> Column:
    return F.when(raw < 0, to_unit(raw, *RANGES["bare_format"])).otherwise(F.least(raw, F.lit(1.0)))


def weighted(components: dict[str, Column], weights) -> dict[str, Column]:
    """Components, their weighted values and the total, as columns."""
    w = {f"w_{k}": c * getattr(weights, k) for k, c in components.items()}
    return {**components, **w, "total": sum(list(w.values())[1:], list(w.values())[0])}


def response(kind: Column, a1: Column, a2: Column, score2: Column, f1: Column, f2: Column, weights=ResponseWeights(), shaping: float = 0.0) -> dict[str, Column]:
    r1, r2 = signed(a1), correctness(kind, a2, score2)
    no_reg = shaping * (r2 - r1) if shaping > 0 else by_transition("no_regression", kind, a1, a2)
    return weighted({"a1_correctness": r1, "a1_format": f1, "a2_correctness": r2, "a2_format": f2, "no_regression": no_reg}, weights)


def _downstream(feedback: Column, kind: Column, a1: Column, a2: Column, improvement: bool, shaping: float) -> Column:
    r1, r2 = signed(a1), signed(a2)
    raw = r2 + shaping * (r2 - r1) if shaping > 0 else r2 - r1 if improvement else by_transition("downstream", kind, a1, a2)
    return F.when(T.strip(feedback) == "", 0.0).otherwise(raw)


def feedback(text: Column, kind: Column, a1: Column, a2: Column, weights=FeedbackWeights(), improvement: bool = False, shaping: float = 0.0) -> dict[str, Column]:
    """A verdict that is not right takes away what the second answer would earn."""
    down, ver = _downstream(text, kind, a1, a2, improvement, shaping), verification(text, a1)
    gated = F.when(ver > 0, down).otherwise(F.least(down, F.lit(0.0)))
    return weighted({"downstream": gated, "verification": ver, "format": feedback_format(text)}, weights)


def critic(text: Column, kind: Column, a1: Column, a2: Column, weights=CriticWeights()) -> dict[str, Column]:
    return weighted({"downstream": F.when(T.strip(text) == "", 0.0).otherwise(by_transition("downstream_alone", kind, a1, a2))}, weights)


def refiner(kind: Column, a1: Column, a2: Column, score2: Column, fmt: Column, weights=RefinerWeights()) -> dict[str, Column]:
    return weighted({"correctness": correctness(kind, a2, score2), "no_regression": by_transition("no_regression_alone", kind, a1, a2), "format": fmt}, weights)


def baseline(a1: Column, fmt: Column, weights=BaselineWeights()) -> dict[str, Column]:
    return weighted({"a1_correctness": F.when(a1, 1.0).otherwise(0.0), "a1_format": fmt}, weights)


# ---- the same on the unit interval -------------------------------------------


def _typed(kind: Column, raw: Column, ranges: tuple) -> Column:
    return F.when(deterministic(kind), to_unit(raw, *ranges[0])).otherwise(to_unit(raw, *ranges[1]))


def correctness_01(kind: Column, ok: Column, score: Column) -> Column:
    return to_unit(correctness(kind, ok, score), *RANGES["correctness"])


def no_regression_01(kind: Column, a1: Column, a2: Column, r1: Column | None = None, r2: Column | None = None, shaping: float = 0.0) -> Column:
    if shaping > 0:
        return to_unit(shaping * (r2 - r1), -2 * shaping, 2 * shaping)
    return _typed(kind, by_transition("no_regression", kind, a1, a2), RANGES["no_regression"])


def downstream_01(text: Column, kind: Column, a1: Column, a2: Column, improvement: bool = False, shaping: float = 0.0) -> Column:
    raw = _downstream(text, kind, a1, a2, improvement, shaping)
    unit = to_unit(raw, -1 - 2 * shaping, 1 + 2 * shaping) if shaping > 0 else to_unit(raw, *RANGES["improvement"]) if improvement else _typed(kind, raw, RANGES["downstream"])
    return F.when(T.strip(text) == "", to_unit(F.lit(0.0), *RANGES["downstream"][0])).otherwise(unit)


def verification_01(text: Column, a1: Column) -> Column:
    return to_unit(verification(text, a1), *RANGES["verification"])


def response_01(kind: Column, a1: Column, a2: Column, score2: Column, f1: Column, f2: Column, weights=ResponseWeights(), shaping: float = 0.0) -> dict[str, Column]:
    return weighted({"a1_correctness": F.when(a1, 1.0).otherwise(0.0), "a1_format": format_unit(f1), "a2_correctness": correctness_01(kind, a2, score2), "a2_format": format_unit(f2),
                     "no_regression": no_regression_01(kind, a1, a2, signed(a1), signed(a2), shaping)}, weights)


def feedback_01(text: Column, kind: Column, a1: Column, a2: Column, weights=FeedbackWeights(), improvement: bool = False, shaping: float = 0.0) -> dict[str, Column]:
    """The gate holds the downstream share to the rescaled zero, which for counting is that of open answers."""
    zero = F.when(kind.isin("mcq", "yesno", "numeric"), to_unit(F.lit(0.0), *RANGES["downstream"][0])).otherwise(to_unit(F.lit(0.0), *RANGES["downstream"][1]))
    down, ver = downstream_01(text, kind, a1, a2, improvement, shaping), verification(text, a1)
    gated = F.when(ver > 0, down).otherwise(F.least(down, zero))
    return weighted({"downstream": gated, "verification": to_unit(ver, *RANGES["verification"]), "format": feedback_format(text)}, weights)
