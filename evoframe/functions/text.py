"""Scalar functions on text as Columns: parsing model output, answers, scores and prompts.

White space follows the Unicode definition everywhere, so trimming uses a regular
expression instead of trim(), which knows blanks only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of the trajectory format (fixed values).
THINK = "<|think|>"
ANSWER = "<|answer|>"
#: Keys under which a JSON answer may stand, in order (fixed values).
ANSWER_KEYS = ("Major Product", "result", "answer", "By Product")
#: Phrases that introduce a final answer after a blank line, in order (fixed values).
ANSWER_PHRASES = ("final result", "The answer is", "Answer", "Thus, the answer is")
#: Phrases taken off the front of an answer that is a reply's last line; the first that fits goes (fixed values).
LINE_PHRASES = ("Answer:", "The answer is", "Result:", "Final answer:")
#: Marks around an answer (fixed values).
ANSWER_MARKS = ("[ANSWER_START]", "[ANSWER_END]")
#: The look-behind starts a run of white space once, which keeps the search linear.
_END = r"(?U)(?<!\s)\s++$"
_EDGES = r"(?U)^\s+|(?<!\s)\s++$"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text) -> Column:
    return F.regexp_replace(_c(text), _EDGES, "")


def squeeze(text) -> Column:
    """White space runs to one blank, none at the edges."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def word_count(text) -> Column:
    """Words by white space; null has none."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def word_set(text) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct elements; 0 if both are empty."""
    share = lambda n: F.try_divide(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double"))
    return F.coalesce(bind(F.size(F.array_intersect(a, b)), share), F.lit(0.0))


def length_score(text, lower: int, upper: int) -> Column:
    """0 below ``lower`` words, 0.5 above ``upper``, else 1; bounds are inside."""
    n = word_count(text)
    return F.when(n < lower, 0.0).when(n > upper, 0.5).otherwise(1.0)


def between_markers(text, start: str, end: str) -> Column:
    """Stripped text between the first ``start`` and the first ``end``; null if one is absent or they are reversed."""
    t = _c(text)
    i, j = F.locate(start, t), F.locate(end, t)
    inner = F.substring(t, i + len(start), F.greatest(j - i - len(start), F.lit(0)))
    return F.when((i > 0) & (j > i), strip(inner))


def marked_or_all(text, name: str) -> Column:
    """Text between [NAME_START] and [NAME_END], else the whole stripped text."""
    return F.coalesce(between_markers(text, f"[{name}_START]", f"[{name}_END]"), strip(text))


def marker_parts(text) -> Column:
    """struct<reasoning,answer,error> of the strict marker format; one error says what is wrong."""
    t = _c(text)
    i, j = F.locate(THINK, t), F.locate(ANSWER, t)
    error = F.when(i == 0, "reasoning marker not found").when(j == 0, "answer marker not found").when(j <= i, "answer marker comes first")
    ok = error.isNull() & t.isNotNull()
    reasoning = F.when(ok, strip(F.substring(t, i + len(THINK), F.greatest(j - i - len(THINK), F.lit(0)))))
    answer = F.when(ok, strip(F.substring(t, j + len(ANSWER), F.length(t))))
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"), error.alias("error"))


def _with_markers(t: Column) -> Column:
    def parts(at: Column) -> Column:
        i, j = at["i"], at["j"]
        width = j - i - len(THINK)
        reasoning = F.when(width > 0, strip(F.substring(t, i + len(THINK), F.greatest(width, F.lit(0))))).otherwise("")
        return F.when((i > 0) & (j > 0), _pair(reasoning, strip(F.substring(t, j + len(ANSWER), F.length(t)))))

    return bind(F.struct(F.locate(THINK, t).alias("i"), F.locate(ANSWER, t).alias("j")), parts)


def _pair(reasoning: Column, answer: Column) -> Column:
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))


def _before(t: Column, found: Column) -> Column:
    return strip(F.substring(t, F.lit(1), F.position(found, t) - 1))


def _with_json(t: Column, key: str) -> Column:
    pattern = rf'\{{\s*"{key}"\s*:\s*"[^"]+"\s*\}}'

    def parts(found: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(found), f"$['{key}']", "string")
        return bind(value, lambda v: F.when(v.isNotNull(), _pair(_before(t, found), F.to_json(F.create_map(F.lit(key), v)))))

    return F.when(t.contains(f'"{key}"'), bind(F.regexp_substr(t, F.lit(pattern)), parts))


def _with_phrase(t: Column, phrase: str) -> Column:
    pattern = rf"(?isU)\n\n{phrase}\s*:?\s*(.+)$"

    def parts(x: Column) -> Column:
        return F.when(x["found"].isNotNull(), _pair(_before(x["core"], x["found"]), strip(F.regexp_extract(x["found"], pattern, 1))))

    # White space at the end becomes one blank, so that nothing is tried again for each of it.
    found = lambda core: bind(F.struct(core.alias("core"), F.regexp_substr(core, F.lit(pattern)).alias("found")), parts)
    return F.when(t.contains("\n\n"), bind(F.regexp_replace(t, _END, " "), found))


def last_line(text) -> Column:
    """What follows the last line break, once white space at the end is off."""
    return F.substring_index(F.regexp_replace(_c(text), _END, ""), "\n", -1)


def _with_last_line(t: Column) -> Column:
    """The last line with text is the answer, what stands before it the reasoning."""

    def parts(core: Column) -> Column:
        answer = F.substring_index(core, "\n", -1)
        head = F.substring(core, F.lit(1), F.length(core) - F.length(answer))
        return F.when(core != "", _pair(strip(head), strip(answer)))

    return F.when(t.contains("\n"), bind(F.regexp_replace(t, _END, ""), parts))


def reasoning_and_answer(text) -> Column:
    """struct<reasoning,answer> of model output: markers, a JSON answer, a phrase, the last line, else all reasoning.

    Null gives two empty strings.
    """

    def parts(t: Column) -> Column:
        ways = [_with_markers(t), *[_with_json(t, k) for k in ANSWER_KEYS[:3]], *[_with_phrase(t, p) for p in ANSWER_PHRASES], _with_last_line(t)]
        return F.when(t.isNull(), _pair(F.lit(""), F.lit(""))).otherwise(F.coalesce(*ways, _pair(strip(t), F.lit(""))))

    return bind(_c(text), parts)


def seed_pair(response, model) -> Column:
    """struct<reasoning,answer,model> of a dataset's reply; all null where it has no reasoning, 'unknown' for no model."""
    named = F.coalesce(_c(model), F.lit("unknown"))
    return bind(reasoning_and_answer(response), lambda p: F.struct(*[F.when(p["reasoning"] != "", x).alias(n) for n, x in (("reasoning", p["reasoning"]), ("answer", p["answer"]), ("model", named))]))


def final_result(answer) -> Column:
    """An answer behind the markers, a JSON object in its plain written form."""

    def written(x: Column) -> Column:
        return bind(F.try_parse_json(x), lambda v: F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.to_json(v)).otherwise(x))

    return combined(F.lit("Your reasoning goes here"), bind(_c(answer), written))


def answer_line(text) -> Column:
    """The last line with text, without one leading phrase of LINE_PHRASES in any case; '' without such a line, null for null."""
    phrases = "|".join(LINE_PHRASES)
    return strip(F.regexp_replace(strip(last_line(text)), f"(?i)^(?:{phrases})", ""))


def answer_json(text) -> Column:
    """The ``result`` of the last flat JSON object that ends with that key; where there is none, or it is no JSON, answer_line().

    An object that has a key twice is no JSON here.
    """
    pattern = r'\{[^{}]*"result"\s*:\s*"[^"]*"\s*\}'

    def of_last(t: Column) -> Column:
        found = F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.lit(-1))
        return F.coalesce(F.try_variant_get(F.try_parse_json(found), "$.result", "string"), answer_line(t))

    return bind(_c(text), of_last)


def answer_marked(text) -> Column:
    """The stripped text from the first [ANSWER_START] to the next [ANSWER_END]; without such a pair answer_line()."""
    start, end = ANSWER_MARKS

    def parts(t: Column) -> Column:
        rest = F.when(t.contains(start), F.substring(t, F.locate(start, t) + len(start), F.length(t)))
        inner = bind(rest, lambda r: F.when(r.contains(end), strip(F.substring(r, F.lit(1), F.locate(end, r) - 1))))
        return F.coalesce(inner, answer_line(t))

    return bind(_c(text), parts)


def pure_reasoning(text) -> Column:
    """The stripped text between the markers, where both are there ('' if reversed), else the text as it is; '' for null."""

    def parts(t: Column) -> Column:
        i, j = F.locate(THINK, t), F.locate(ANSWER, t)
        inner = strip(F.substring(t, i + len(THINK), F.greatest(j - i - len(THINK), F.lit(0))))
        return F.when(t.isNull(), "").when((i > 0) & (j > 0), inner).otherwise(t)

    return bind(_c(text), parts)


def reasoning_length(text, of: str = "words") -> Column:
    """Length of a reasoning by one of three definitions: ``words`` and ``chars`` of pure_reasoning(), ``raw_words`` of all of it."""
    if of == "raw_words":
        return word_count(text)
    if of == "words":
        return word_count(pure_reasoning(text))
    if of == "chars":
        return F.length(pure_reasoning(text)).cast("long")
    raise ValueError(f"unknown length {of!r}; known: chars, raw_words, words")


def combined(reasoning, answer) -> Column:
    return F.concat(F.lit(THINK + "\n"), _c(reasoning), F.lit("\n" + ANSWER + "\n"), _c(answer))


def clean_answer(text) -> Column:
    """An answer for comparison: markers out, the first string under a known JSON key, a leading phrase off, blanks squeezed.

    A JSON object without such a string stays as it is; null and empty give ''.
    """

    def cleaned(bare: Column) -> Column:
        def of_json(json: Column) -> Column:
            is_object = F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))

            def under(key: str) -> Column:
                path = f"$['{key}']"
                kind = F.schema_of_variant(F.try_variant_get(json, path, "variant"))
                return F.when(kind == "STRING", strip(F.try_variant_get(json, path, "string")))

            return F.when(is_object, F.coalesce(*[under(k) for k in ANSWER_KEYS], bare))

        plain = squeeze(F.regexp_replace(bare, r"(?iU)^(final result|answer|the answer is)\s*:?\s*", ""))
        return F.coalesce(F.when(bare.startswith("{"), bind(F.try_parse_json(bare), of_json)), plain, F.lit(""))

    bare = F.replace(F.replace(_c(text), F.lit(THINK), F.lit("")), F.lit(ANSWER), F.lit(""))
    return bind(strip(bare), cleaned)


def exact_match(predicted, truth, strict: bool = True) -> Column:
    """Equality of clean answers in lower case; lenient also ignores blanks, tabs and line breaks."""
    p, g = F.lower(strip(clean_answer(predicted))), F.lower(strip(clean_answer(truth)))
    return p == g if strict else F.translate(p, " \t\n", "") == F.translate(g, " \t\n", "")


def without_prefix(text) -> Column:
    """Lower case without the leading words 'answer:', 'the answer is' and 'result:', taken off in this order."""
    return reduce(lambda t, p: strip(F.regexp_replace(t, f"^{p}", "")), ("answer:", "the answer is", "result:"), F.lower(strip(text)))


def judge_score(text) -> Column:
    """The first number of a judge's reply within 1 to 5; 3 without one."""
    digits = F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"\d+", 0)
    value = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 3, 5).otherwise(F.try_to_number(F.substring(digits, -3, 3), F.lit("999")).cast("int"))
    return F.when(digits == "", 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), value)))


def first_number(text) -> Column:
    """The first decimal anywhere, else the first integer, without sign; null without either."""

    def found(t: Column) -> Column:
        part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
        return F.coalesce(part(r"(\d+\.\d+)"), part(r"(\d+)")).cast("double")

    return bind(_c(text), found)


def bullets(text, fallback: bool = True) -> Column:
    """All '* ' items joined by line breaks; without one the stripped text, or null."""
    t = _c(text)
    items = F.transform(F.regexp_extract_all(t, F.lit(r"\*\s*(.+)"), F.lit(1)), strip)
    return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(strip(t) if fallback else F.lit(None))


def binding_point(text, quoted) -> Column:
    """Zero-based position of the quoted sentence; four fifths of the text where it isn't found."""
    at = F.position(_c(quoted), _c(text))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.floor(F.length(_c(text)) * 4 / 5).cast("int"))


def trajectory_id(query, reasoning, model) -> Column:
    parts = [F.coalesce(_c(x), F.lit("")) for x in (query, reasoning, model)]
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def cache_key(model, text) -> Column:
    return F.sha2(F.concat(_c(model), F.lit(":"), _c(text)), 256)


def fitness(exact, length, knowledge, weight_length: float = 0.3, weight_knowledge: float = 0.5) -> Column:
    """exact + weight_length * length + weight_knowledge * knowledge / 5; without knowledge no such term."""
    base = F.when(_c(exact), 1.0).otherwise(0.0) + F.lit(weight_length) * F.coalesce(_c(length), F.lit(0.0))
    return base + F.coalesce(F.lit(weight_knowledge) * (_c(knowledge) / F.lit(5.0)), F.lit(0.0))


def is_reasoning_model(name) -> Column:
    return F.lower(_c(name)).rlike("deepseek|r1|thinking|qwen-235")


def truncated(text, limit: int = 200) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def ratio(text) -> Column:
    """'a/b' as a number; 0 for anything else and for b = 0."""
    part = F.split(_c(text), "/")
    value = F.when(F.size(part) == 2, F.try_divide(part[0].try_cast("double"), part[1].try_cast("double"))).when(F.size(part) == 1, part[0].try_cast("double"))
    return F.coalesce(value, F.lit(0.0))
