"""DuckDB text for the oracles of extraction and verification, written apart from the Column expressions.

RE2 has no look-behind; where the cascade uses one, the character before is matched instead.
"""

from __future__ import annotations

from millrace.operators.verify import ANTONYMS, COLORS
from millrace.sources.views import ROLLOUTS

WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def tag(c: str) -> str:
    p = r"'(?is)<answer>\s*(.*?)\s*</answer>'"
    return f"CASE WHEN regexp_matches({c}, {p}) THEN regexp_extract({c}, {p}, 1) ELSE {strip(c)} END"


def has_tag(c: str) -> str:
    return f"regexp_matches({c}, '(?is)<answer>.*?</answer>')"


def has_think(c: str) -> str:
    return f"(regexp_matches({c}, '(?is)<think>.*?</think>') AND {has_tag(c)})"


def boxed(c: str) -> str:
    return rf"regexp_extract({c}, '(?is)\\boxed\{{\s*(.*?)\s*\}}', 1)"


def two(c: str, p: str) -> str:
    return f"upper(concat(regexp_extract({c}, '{p}', 1), regexp_extract({c}, '{p}', 2)))"


def mcq(c: str) -> str:
    letters = f"list_distinct(regexp_extract_all(upper({c}), '[A-F]'))"
    return (rf"coalesce(nullif({two(c, r'^\s*(?:\(([A-Fa-f])\)|([A-Fa-f])[.\s]?)\s*$')}, ''), nullif({two(c, r'(?:\(([A-Fa-f])\)|(?:^|[^A-Za-z0-9_])([A-Fa-f])\.)')}, ''), "
            rf"nullif(upper(regexp_extract({c}, '(?i)(?:the\s+)?answer\s*(?:is|:)\s*\(?([A-Fa-f])\)?', 1)), ''), CASE WHEN len({letters}) = 1 THEN {letters}[1] END, '')")


def hedge(c: str) -> str:
    return rf"regexp_matches({c}, '(?i)\b(maybe|possibly|perhaps|it could be|it might be|I think|I believe|it seems|probably|not sure|not certain|likely|unlikely)\b')"


def cap(x: str) -> str:
    return f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"


def yesno(c: str) -> str:
    return rf"CASE WHEN {hedge(c)} THEN '' ELSE {cap(rf"regexp_extract({c}, '(?i)\b(yes|no)\b', 1)")} END"


def word(c: str, upto: int) -> str:
    ws = WORDS[: upto + 1]
    table = "map {" + ", ".join(f"'{w}': '{i}'" for i, w in enumerate(ws)) + "}"
    return rf"coalesce({table}[lower(regexp_extract({c}, '(?i)\b({'|'.join(ws)})\b', 1))], '')"


def numeric(c: str, words: bool) -> str:
    n = rf"nullif(regexp_extract({c}, '-?\d+(?:\.\d+)?(?:/\d+)?'), '')"
    return f"coalesce({n}, {word(c, 15)})" if words else f"coalesce({n}, '')"


def atomic(c: str, kind: str) -> str:
    return (rf"CASE WHEN {kind} = 'mcq' THEN {two(c, r'(?s)^\s*(?:\(([A-Fa-f])\)|([A-Fa-f])\.?)(?:\s+\S.*)?\s*$')} WHEN {kind} = 'yesno' THEN {cap(rf"regexp_extract({c}, '(?is)^\s*(yes|no)[\.,;:]?(?:\s+\S.*)?\s*$', 1)")} "
            rf"WHEN {kind} IN ('numeric', 'counting') THEN regexp_extract({c}, '(?s)^\s*(-?\d+(?:\.\d+)?)(?:\s+\S.*)?\s*$', 1) ELSE {strip(c)} END")


def extract(c: str, kind: str, strict: bool = False) -> str:
    t = f"({tag(c)})"
    if strict:
        return f"CASE WHEN NOT {has_tag(c)} THEN '' ELSE {atomic(t, kind)} END"
    return f"CASE {kind} WHEN 'mcq' THEN {mcq(t)} WHEN 'yesno' THEN {yesno(t)} WHEN 'counting' THEN {numeric(t, True)} WHEN 'numeric' THEN {numeric(t, False)} ELSE {t} END"


def norm(c: str) -> str:
    marks = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
    return rf"trim(regexp_replace(translate(lower({strip(c)}), '{marks}', ''), '\s+', ' ', 'g'))"


def num(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, '{FLOAT}') THEN TRY_CAST({strip(c)} AS DOUBLE) END"


def parse_number(c: str) -> str:
    t = strip(c)
    plain = f"replace(rtrim({t}, '%'), ',', '')"
    return (rf"CASE WHEN contains({t}, '/') AND len(string_split({t}, '/')) = 2 THEN ({num(f"string_split({t}, '/')[1]")}) / nullif({num(f"string_split({t}, '/')[2]")}, 0) "
            rf"ELSE coalesce({num(plain)}, TRY_CAST(nullif(regexp_extract({plain}, '-?\d+(?:\.\d+)?'), '') AS DOUBLE)) END")


def sentence_number(c: str) -> str:
    return rf"coalesce(TRY_CAST(replace(regexp_extract_all({c}, '-?\d+(?:,\d{{3}})*(?:\.\d+)?')[-1], ',', '') AS DOUBLE), TRY_CAST(nullif({word(c, 20)}, '') AS DOUBLE))"


def edit(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0.0 WHEN {a} = '' OR {b} = '' THEN 1.0 ELSE levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def clean_atomic(c: str, kind: str) -> str:
    return (rf"CASE {kind} WHEN 'mcq' THEN regexp_matches({c}, '^(\([A-Da-d]\)|[A-Da-d]\.?)$') WHEN 'yesno' THEN rtrim(lower({c}), '.,;:') IN ('yes', 'no') WHEN 'counting' THEN regexp_matches({c}, '^\d+$') "
            rf"WHEN 'numeric' THEN ({num(f"replace(rtrim(replace({c}, ',', ''), '%'), '/', '.')")}) IS NOT NULL ELSE {c} <> '' END")


def tag_format(c: str, kind: str) -> str:
    t = f"({tag(c)})"
    return f"CASE WHEN {has_think(c)} AND {t} <> '' AND {clean_atomic(t, kind)} THEN 1.0 ELSE 0.0 END"


def verified(src: str, name: str, text: str, strict: bool, keep: str = "*") -> str:
    """CTEs that end in ``name``: rows of ``src`` with verdict {name}_v (boolean), score {name}_s, parse_ok {name}_ok, extracted {name}_x of ``text`` against ground_truth."""
    k = "answer_type"
    raw = text if strict else f"({tag(text)})"
    toks = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    only = lambda a, b: f"list_filter({a}, lambda w: NOT list_contains({b}, w))"
    anti = " OR ".join(f"(list_has_any({only('pt', 'gt')}, ['{a}', '{b}']) AND list_has_any({only('gt', 'pt')}, ['{a}', '{b}']))" for a, b in ANTONYMS)
    col = lambda t: f"list_sort(list_filter(list_distinct({t}), lambda w: list_contains({COLORS}, w)))"
    com = "len(list_filter(list_distinct(pt), lambda w: list_contains(gt, w)))"
    f1 = f"CASE WHEN len(pt) <= 4 AND len(gt) <= 4 AND {com} > 0 THEN 2.0 * ({com} / len(list_distinct(pt))) * ({com} / len(list_distinct(gt))) / (({com} / len(list_distinct(pt))) + ({com} / len(list_distinct(gt)))) ELSE 0.0 END"
    pnum = num(extract("raw", "'counting'", True)) if strict else sentence_number("raw")
    num_ok = f"coalesce(CASE WHEN ng = 0 THEN abs(np) <= 0.01 ELSE abs(np - ng) / greatest(abs(ng), 1e-10) <= 0.01 END, false)"
    share = "(CASE WHEN pn IS NOT NULL AND gn IS NOT NULL THEN greatest(0.0, 1 - abs(pn - gn) / greatest(abs(gn), 3.0)) END)"
    lib_yn = "CASE WHEN hd THEN NULL WHEN ps <> '' AND gs <> '' THEN ps = gs WHEN ga = '' THEN NULL WHEN pa <> '' THEN pa = ga END"
    yn_open = "NOT hd AND ((ps <> '' AND gs <> '' AND ps = gs) OR (NOT (ps <> '' AND gs <> '') AND (ga = '' OR (pa <> '' AND pa = ga))))"
    if strict:
        v = f"""CASE {k} WHEN 'mcq' THEN CASE WHEN gm = '' THEN ov ELSE coalesce(p <> '' AND p = gm, false) END WHEN 'yesno' THEN p <> '' AND lower(p) = coalesce(nullif(gs, ''), ga)
            WHEN 'counting' THEN coalesce({share} >= 0.75, false) WHEN 'numeric' THEN p <> '' AND {num_ok} ELSE ov END"""
        s = f"CASE {k} WHEN 'mcq' THEN CASE WHEN gm = '' THEN os END WHEN 'yesno' THEN NULL WHEN 'counting' THEN {share} WHEN 'numeric' THEN NULL ELSE os END"
    else:
        v = f"""CASE {k} WHEN 'mcq' THEN CASE WHEN gm = '' THEN ov ELSE coalesce(p <> '' AND p = gm, false) END WHEN 'yesno' THEN CASE WHEN {yn_open} THEN ov ELSE coalesce({lib_yn}, false) END
            WHEN 'counting' THEN CASE WHEN pn IS NOT NULL AND gn IS NOT NULL THEN {share} >= 0.75 ELSE ov END WHEN 'numeric' THEN p <> '' AND {num_ok} ELSE ov END"""
        s = f"""CASE {k} WHEN 'mcq' THEN CASE WHEN gm = '' THEN os END WHEN 'yesno' THEN CASE WHEN {yn_open} THEN os END
            WHEN 'counting' THEN CASE WHEN pn IS NOT NULL AND gn IS NOT NULL THEN {share} ELSE os END WHEN 'numeric' THEN NULL ELSE os END"""
    return f"""
{name}_1 AS (SELECT *, {raw} AS raw, ({tag('ground_truth')}) AS tr FROM {src}),
{name}_2 AS (SELECT *, {extract('raw', k, strict)} AS p, {mcq('tr')} AS gm, {hedge('raw')} AS hd, lower(regexp_extract(raw, '(?i)^\\s*(yes|no)\\b', 1)) AS ps, lower(regexp_extract(tr, '(?i)^\\s*(yes|no)\\b', 1)) AS gs,
  lower(regexp_extract(raw, '(?i)\\b(yes|no)\\b', 1)) AS pa, lower(regexp_extract(tr, '(?i)\\b(yes|no)\\b', 1)) AS ga, {pnum} AS pn, {sentence_number('tr')} AS gn, lower({strip('raw')}) AS pl, lower({strip('tr')}) AS gl,
  {norm('raw')} AS pz, {norm('tr')} AS gz, {parse_number('tr')} AS ng FROM {name}_1),
{name}_3 AS (SELECT *, {toks('pz')} AS pt, {toks('gz')} AS gt, {parse_number('p')} AS np FROM {name}_2),
{name}_4 AS (SELECT *, ({anti}) OR (len({col('pt')}) > 0 AND len({col('gt')}) > 0 AND {col('pt')} <> {col('gt')}) AS bad, {f1} AS tf, CASE WHEN len(pt) BETWEEN 1 AND 3 AND len(gt) BETWEEN 1 AND 3 THEN 1 - ({edit('pl', 'gl')}) END AS anls FROM {name}_3),
{name}_5 AS (SELECT *, CASE WHEN {strip('raw')} = '' OR bad THEN NULL WHEN pl = gl THEN 1.0 WHEN pz <> '' AND gz <> '' AND (contains(pz, gz) OR contains(gz, pz)) THEN 0.95 WHEN tf >= 0.85 THEN tf ELSE anls END AS os,
  CASE WHEN {strip('raw')} = '' OR bad THEN false WHEN pl = gl OR (pz <> '' AND gz <> '' AND (contains(pz, gz) OR contains(gz, pz))) OR tf >= 0.85 OR coalesce(anls >= 0.7, false) THEN true ELSE false END AS ov FROM {name}_4),
{name} AS (SELECT * EXCLUDE (raw, tr, p, gm, hd, ps, gs, pa, ga, pn, gn, pl, gl, pz, gz, ng, pt, gt, np, bad, tf, anls, os, ov), {v} AS {name}_v, {s} AS {name}_s FROM {name}_5)"""


#: CTEs up to ``j``: rollouts with liberal verdicts m1, m2 and strict ones n1, n2 of both answers.
JUDGED = "WITH sr AS (" + ROLLOUTS + ")," + verified("sr", "m1", "a1", False) + "," + verified("m1", "m2", "a2", False) + "," + verified("m2", "n1", "a1", True) + "," + verified("n1", "n2", "a2", True) + ", j AS (SELECT * FROM n2)\n"
SR = "WITH sr AS (" + ROLLOUTS + ")\n"
