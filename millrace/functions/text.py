"""Answer extraction and text normalisation as Column expressions.

Java's \\s, \\d, \\w and \\b are ASCII unless (?U); the flag is set wherever a
Unicode meaning is wanted.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F

# Patterns and word lists that results depend on.
ANSWER_TAG = r"(?isU)<answer>\s*(.*?)\s*</answer>"
THINK_TAG = r"(?isU)<think>\s*(.*?)\s*</think>"
BOXED = r"(?isU)\\boxed\{\s*(.*?)\s*\}"
THINK_BOXED = r"(?is)<think>.*?</think>.*?\\boxed\{.*?\}"
MCQ_STRICT = r"(?U)^\s*(?:\(([A-Fa-f])\)|([A-Fa-f])[.\s]?)\s*$"
MCQ_OPTION = r"(?U)(?:\(([A-Fa-f])\)|(?<!\w)([A-Fa-f])\.)"
MCQ_LETTER_TEXT = r"(?sU)(?:\(([A-Fa-f])\)\s*|([A-Fa-f])\.\s*)(.*)"
MCQ_ANSWER_IS = r"(?iU)(?:the\s+)?answer\s*(?:is|:)\s*\(?([A-Fa-f])\)?"
MCQ_ATOMIC = r"(?sU)^\s*(?:\(([A-Fa-f])\)|([A-Fa-f])\.?)(?:\s+\S.*)?\s*$"
NUMERIC_ATOMIC = r"(?sU)^\s*(-?\d+(?:\.\d+)?)(?:\s+\S.*)?\s*$"
YESNO_ATOMIC = r"(?isU)^\s*(yes|no)[\.,;:]?(?:\s+\S.*)?\s*$"
YESNO = r"(?iU)\b(yes|no)\b"
YESNO_START = r"(?iU)^\s*(yes|no)\b"
NUMERIC = r"(?U)-?\d+(?:\.\d+)?(?:/\d+)?"
SENTENCE_NUMBER = r"(?U)-?\d+(?:,\d{3})*(?:\.\d+)?"
HEDGES = ("maybe", "possibly", "perhaps", "it could be", "it might be", "I think", "I believe", "it seems", "probably", "not sure", "not certain", "likely", "unlikely")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
CATEGORY_TYPES = {"mcq": "mcq", "yes_no": "yesno", "counting": "counting", "chart_reasoning": "open", "descriptive_vqa": "open"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _group(c: Column, pattern: str, *groups: int) -> Column:
    """The first group that matched, else ''."""
    found = [F.regexp_extract(c, pattern, g) for g in groups]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def answer_tag(c: Column) -> Column:
    return F.when(c.rlike(ANSWER_TAG), strip(F.regexp_extract(c, ANSWER_TAG, 1))).otherwise(strip(c))


def has_answer_tag(c: Column) -> Column:
    return c.rlike(ANSWER_TAG)


def has_think_answer(c: Column) -> Column:
    return c.rlike(THINK_TAG) & c.rlike(ANSWER_TAG)


def boxed(c: Column) -> Column:
    return strip(F.regexp_extract(c, BOXED, 1))


def has_think_boxed(c: Column) -> Column:
    return c.rlike(THINK_BOXED)


def hedging(c: Column) -> Column:
    return c.rlike(r"(?iU)\b(?:" + "|".join(HEDGES) + r")\b")


def mcq_letter(c: Column) -> Column:
    every = F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-F])")))
    return F.coalesce(F.nullif(F.upper(_group(c, MCQ_STRICT, 1, 2)), F.lit("")), F.nullif(F.upper(_group(c, MCQ_OPTION, 1, 2)), F.lit("")),
                      F.nullif(F.upper(F.regexp_extract(c, MCQ_ANSWER_IS, 1)), F.lit("")), F.when(F.size(every) == 1, every[0]), F.lit(""))


def yesno(c: Column) -> Column:
    return F.when(hedging(c), "").otherwise(F.initcap(F.lower(F.regexp_extract(c, YESNO, 1))))


def number_word(c: Column, upto: int) -> Column:
    """The first number word up to ``upto`` as digits, else ''."""
    words = NUMBER_WORDS[: upto + 1]
    word = F.lower(F.regexp_extract(c, r"(?iU)\b(" + "|".join(words) + r")\b", 1))
    table = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, str(i))])
    return F.coalesce(F.try_element_at(table, word), F.lit(""))


def numeric(c: Column, words: bool = False) -> Column:
    found = F.nullif(F.regexp_extract(c, NUMERIC, 0), F.lit(""))
    return F.coalesce(found, number_word(c, 15)) if words else F.coalesce(found, F.lit(""))


def atomic(c: Column, kind: Column) -> Column:
    """An answer at the very start, by type, else ''; other types as they are."""
    return (F.when(kind == "mcq", F.upper(_group(c, MCQ_ATOMIC, 1, 2))).when(kind == "yesno", F.initcap(F.lower(F.regexp_extract(c, YESNO_ATOMIC, 1))))
            .when(kind.isin("numeric", "counting"), F.regexp_extract(c, NUMERIC_ATOMIC, 1)).otherwise(strip(c)))


def extract(c: Column, kind: Column, strict: bool = False, need_tag: bool = False) -> Column:
    """An answer from free text, by type; strict and need_tag demand the answer tag."""
    inner = answer_tag(c)
    loose = (F.when(kind == "mcq", mcq_letter(inner)).when(kind == "yesno", yesno(inner)).when(kind == "counting", numeric(inner, True))
             .when(kind == "numeric", numeric(inner)).otherwise(inner))
    out = atomic(inner, kind) if strict else loose
    return F.when(~has_answer_tag(c), "").otherwise(out) if strict or need_tag else out


def letter_and_text(c: Column) -> tuple[Column, Column]:
    t = strip(c)
    letter = F.upper(_group(t, MCQ_LETTER_TEXT, 1, 2))
    return F.when(letter != "", letter).otherwise(mcq_letter(t)), F.when(letter != "", strip(F.regexp_extract(t, MCQ_LETTER_TEXT, 3))).otherwise("")


def normalize_answer(c: Column) -> Column:
    t = strip(F.rtrim(F.lower(strip(c)), F.lit(".,;:")))
    return (F.when(t.startswith("(") & t.endswith(")") & (F.length(t) > 1), strip(t.substr(F.lit(2), F.length(t) - 2)))
            .when(t.endswith(")"), strip(t.substr(F.lit(1), F.length(t) - 1))).otherwise(t))


def answer_portion(c: Column) -> Column:
    """Inside the tag, else after the last 'Answer:', else all."""
    tag = answer_tag(c)
    every = F.regexp_extract_all(c, F.lit(r"(?sU)Answer:\s*(.*?)(?=\nThought:|\z)"), F.lit(1))
    last = strip(F.try_element_at(every, F.lit(-1)))
    return F.when(tag != strip(c), tag).when(last.isNotNull(), strip(F.split(last, "\nRationale:")[0])).otherwise(strip(c))


def sentence_number(c: Column) -> Column:
    """The last number of a sentence, else its first number word, as double; null if none."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(f"({SENTENCE_NUMBER})"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.regexp_replace(last, ",", "").try_cast("double"), number_word(c, 20).try_cast("double"))


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(strip(c)), PUNCTUATION, ""), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words of normalised text; none for the empty text."""
    return F.filter(F.split(normalize_text(c), " "), lambda w: w != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def to_float(c: Column) -> Column:
    """A plain decimal number as double, else null."""
    t = strip(c)
    return F.when(t.rlike(FLOAT), t.try_cast("double"))


def parse_number(c: Column) -> Column:
    """A fraction, percentage, number with commas, or the first number of a text, as double."""
    t = strip(c)
    parts = F.split(t, "/")
    plain = F.regexp_replace(F.rtrim(t, F.lit("%")), ",", "")
    return (F.when((F.instr(t, "/") > 0) & (F.size(parts) == 2), F.try_divide(to_float(parts[0]), to_float(F.get(parts, F.lit(1)))))
            .otherwise(F.coalesce(to_float(plain), F.regexp_extract(plain, r"(?U)-?\d+(?:\.\d+)?", 0).try_cast("double"))))


def answer_type(question: Column, truth: Column, choices: Column) -> Column:
    low = F.lower(strip(truth))
    return (F.when(F.coalesce(choices, F.lit("")) != "", "mcq").when(question.rlike(r"(?iU)\([A-F]\)\s*\w+") | question.rlike(r"(?imU)^[A-F]\.\s*.+"), "mcq")
            .when(low.isin("yes", "no", "y", "n", "true", "false"), "yesno").when(low.rlike("^[a-f]$"), "mcq").when(to_float(F.regexp_replace(truth, ",", "")).isNotNull(), "numeric").otherwise("open"))


def category_type(category: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv]), category), fallback)


def completion_text(messages: Column) -> Column:
    """The first assistant message's content, else all contents joined by a space; of an array of (role, content)."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.when(F.size(said) > 0, said[0]["content"]).otherwise(F.array_join(F.transform(messages, lambda m: m["content"]), " "))


def choices_of(question: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(question, F.lit(r"(\([A-F]\)\s*[^()\n]+)"), F.lit(1)), strip), ", ")


def image_path(path: Column, images: Column, base: str) -> Column:
    p = F.coalesce(F.nullif(path, F.lit("")), F.try_element_at(images, F.lit(1)), F.lit(""))
    return F.when((p != "") & ~p.startswith("/"), F.concat(F.lit(base.rstrip("/") + "/"), p)).otherwise(p)


def clean_question(c: Column) -> Column:
    return strip(F.replace(c, F.lit("<image>"), F.lit("")))


def record_truth(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{L}$"), F.concat(F.lit("("), c, F.lit(")"))).otherwise(c)


def sample_hash(question: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", question, path), 256), 1, 16)


def judge_score(c: Column) -> Column:
    """The first integer, held to 0..10, as a share of 10."""
    n = F.regexp_extract(c, r"\d+", 0).try_cast("double")
    return F.when(n.isNull(), 0.0).otherwise(F.least(n, F.lit(10.0)) / 10)  # least() would skip a null


def preview(c: Column, n: int = 256) -> Column:
    return F.substring(strip(c), 1, n)


def clean_atomic(inner: Column, kind: Column) -> Column:
    """Whether the inside of a tag is just an answer of its type."""
    number = F.regexp_replace(F.rtrim(F.regexp_replace(inner, ",", ""), F.lit("%")), "/", ".")
    return (F.when(kind == "mcq", inner.rlike(r"^\([A-Da-d]\)$") | inner.rlike(r"^[A-Da-d]\.?$")).when(kind == "yesno", F.rtrim(F.lower(inner), F.lit(".,;:")).isin("yes", "no"))
            .when(kind == "counting", inner.rlike(r"(?U)^\d+$")).when(kind == "numeric", to_float(number).isNotNull()).otherwise(inner != ""))


# ---- prompts -----------------------------------------------------------------


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


# Instructions of the prompts; a variable of the same name in the environment goes before each.
INSTRUCTIONS = {
    "ANSWER_TAG_INSTRUCTION": "Put your final answer inside <answer> tags. Example: <answer>(A)</answer>",
    "THINK_ANSWER_INSTRUCTION": "The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in <answer> </answer> tags.",
    "F1_VERIFIER_INSTRUCTION": "Re-examine the image and determine whether the candidate answer is correct or incorrect. The reasoning process MUST BE enclosed within <think> </think> tags. "
    "The final verdict MUST BE put in \\boxed{} as either CORRECT or INCORRECT.",
}
REFINE = "Re-examine the image and either correct your answer or keep it if you believe it is right."
_BY_MODE = {"think": "THINK_ANSWER_INSTRUCTION", "tag": "ANSWER_TAG_INSTRUCTION"}


def instruction(name: str) -> str:
    return os.environ.get(name, "").strip() or INSTRUCTIONS[name]


def turn(role: str, text: Column, image: bool = False) -> Column:
    """A message of typed parts."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"))
    return F.struct(F.lit(role).alias("role"), F.array(*[part("image", F.lit(None))] * image, part("text", text)).alias("content"))


def answer_prompt(question: Column, mode: str = "") -> Column:
    """The first answer's prompt; ``mode``: think (tags for both), tag (for the answer), or neither."""
    return F.array(turn("user", F.concat_ws("\n\n", question, *([F.lit(instruction(_BY_MODE[mode]))] if mode in _BY_MODE else [])), True))


def critic_prompt(question: Column, answer: Column) -> Column:
    """The prompt that asks for a verdict on a candidate answer."""
    return F.array(turn("user", F.concat(F.lit("Question: "), question, F.lit("\nCandidate answer: "), answer, F.lit("\n\n" + instruction("F1_VERIFIER_INSTRUCTION"))), True))


def refiner_prompt(question: Column, answer: Column, feedback: Column, mode: str = "") -> Column:
    """The second answer's prompt, with the first and the feedback quoted in one turn."""
    last = REFINE + (" " + instruction(_BY_MODE[mode]) if mode in _BY_MODE else "")
    parts = [F.concat(F.lit("Question: "), question), F.concat(F.lit("Your previous answer: "), answer), F.concat(F.lit("Feedback on your previous answer: "), feedback), F.lit(last)]
    return F.array(turn("user", F.concat_ws("\n\n", *parts), True))


def with_completion(prompt: Column, completion: Column) -> Column:
    return F.concat(prompt, F.array(turn("assistant", completion)))
