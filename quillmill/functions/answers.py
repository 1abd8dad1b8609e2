"""Extraction and typed scoring of answers (survey section C) as Column expressions.

The chains of rules state which form of an answer counts first; every rule is a regular expression both engines
read alike. Only what needs parsing of expressions is Python: a small evaluator of arithmetic, never ``eval``.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Phrases before an answer, calculator ids by the type of their result, ASCII punctuation.
TRIGGERS = r"(?:The answer is:|the answer is:|Therefore, the answer is|therefore, the answer is)"
DATE_IDS = (13, 68)
GESTATIONAL_ID = 69
INTEGER_IDS = (4, 15, 16, 17, 18, 20, 21, 25, 27, 28, 29, 32, 33, 36, 43, 45, 48, 51)
PUNCTUATION = r"[!-/:-@\[-`{-~]"
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
FRACTION = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\s*$"
WEEKS = r"""\(?["']?([0-9]+)\s*(?:weeks?)?\s*["']?,?\s*["']?([0-9]+)\s*(?:days?)?["']?\s*\)?"""


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match; null without a match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_line(c: Column) -> Column:
    """The last line that is not blank; '' if there is none."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def after_trigger(c: Column) -> Column:
    """What follows the last trigger in its line, without a full stop and slash at its end; null without one."""
    tail = _first(c, rf"(?s)^.*{TRIGGERS}(.*)$")
    line = strip(F.get(F.split(tail, "\n"), F.lit(0)))
    return strip(F.regexp_replace(F.regexp_replace(line, r"\.+$", ""), "/+$", ""))


def within(p: Column, g: Column, share: float = 0.04) -> Column:
    """Within a share of the truth, at least 1e-9, bounds included."""
    eps = F.greatest(F.abs(g) * share, F.lit(1e-9))
    return p.between(g - eps, g + eps)


def number(c: Column) -> Column:
    """A finite number or a fraction a/b; null for anything else."""
    plain = F.when(c.rlike(NUMBER), F.regexp_replace(c, r"\s+", "").try_cast("double"))
    top, bottom = F.regexp_extract(c, FRACTION, 1).try_cast("double"), F.regexp_extract(c, FRACTION, 2).try_cast("double")
    value = F.coalesce(plain, F.when(c.rlike(FRACTION), F.try_divide(top, bottom)))
    return F.when(F.abs(value) < float("inf"), value)


# -- toolqa ----------------------------------------------------------------------------------------


def toolqa_extract(c: Column) -> Column:
    """Last Finish[...], else what follows a trigger, else the last line."""
    return F.coalesce(strip(_last(c, r"Finish\[([^\]]*)\]")), after_trigger(c), last_line(c))


def toolqa_normalize(c: Column) -> Column:
    """Lower case without punctuation, articles and superfluous space."""
    bare = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the|usd)\b", " "), r"\s+", " "))


def toolqa_match(extracted: Column, answer: Column) -> Column:
    """exact, numeric, boolean or none."""
    a, g = number(extracted), number(answer)
    plain = extracted.rlike(NUMBER) & answer.rlike(NUMBER)
    yes = F.when(F.lower(extracted) == "true", "yes").when(F.lower(extracted) == "false", "no")
    return (
        F.when(toolqa_normalize(extracted) == toolqa_normalize(answer), "exact")
        .when(plain & (F.abs(a - g) < 1e-6), "numeric")
        .when(yes == strip(F.lower(answer)), "boolean")
        .otherwise("none")
    )


# -- logicbench ------------------------------------------------------------------------------------

# Wordings that deny a conclusion; those of stated answers stand in the functions that look for them.
NEGATIONS = (
    r"cannot\s+(?:be\s+)?(?:conclude|infer|say|determine)",
    r"not\s+necessarily\s+true",
    r"not\s+(?:possible|correct|true|valid)",
    r"cannot\s+(?:logically|necessarily|definitively)",
    r"\bno,\s",
)


def _tail(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.substr(c, F.length(c) - n + 1)).otherwise(c)


def bqa_extract(c: Column) -> Column:
    """yes or no: stated last, said first, negated, mentioned last; else the last line."""
    text = strip(c)
    low = F.lower(text)
    stated = _last(low, r"(?:the\s+)?answer\s+is[:\s]*\**\s*(yes|no|true|false)\b")
    tail = _tail(low)
    line = F.element_at(F.split(text, "\n"), -1)
    return F.coalesce(
        F.when(stated.isin("yes", "true"), "yes").when(stated.isNotNull(), "no"),
        _first(low, r"^\**(yes|no)\**[.,!\s]"),
        F.when(tail.rlike("|".join(NEGATIONS)), "no"),
        _last(tail, r"\b(yes|no)\b"),
        F.when(F.contains(tail, F.lit("true")), "yes").when(F.contains(tail, F.lit("false")), "no"),
        F.lower(strip(line)),
    )


def mcqa_extract(c: Column, question: Column) -> Column:
    """choice_N: named last, answer or option N, a choice's own words, a digit; else the answer itself (C4)."""
    text = strip(c)
    low = F.lower(text)
    tail = _tail(low)
    named = _last(low, r"choice[_ ]?(\d+)")
    option = _first(low, r"(?:answer|option)\s*(?:is)?[:\s]*\**\s*(?:choice[_ ]?)?(\d+)\b")
    words = []
    for i in range(5, 0, -1):
        own = strip(_first(question, rf"(?i)choice_{i}:\s*(.+?)(?:\n|choice_|$)"))
        words.append(F.when(F.contains(tail, F.substring(F.lower(own), 1, 40)), f"choice_{i}"))
    answer = strip(F.lower(F.coalesce(after_trigger(text), last_line(text))))
    digit = _first(answer, r"\b([1-5])\b")
    label = lambda x: F.concat(F.lit("choice_"), x)
    return F.coalesce(label(named), label(option), *words, label(digit), answer)


# -- medcalcbench ----------------------------------------------------------------------------------


def medcalc_extract(c: Column, output_type: Column, calculator: Column) -> Column:
    """ANSWER: line, JSON answer, trigger, date, weeks and days, last number, last line."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.upper(x).startswith("ANSWER:"))
    stated = F.try_element_at(lines, F.lit(-1))
    line = strip(F.regexp_replace(strip(F.substr(stated, F.lit(8))), r"^\*+|\*+$", ""))
    field = F.regexp_replace(F.regexp_replace(strip(_first(c, r'[Aa]nswer":\s*(.*?)\}')), '^"+|"+$', ""), "^'+|'+$", "")
    field = F.when((field != "") & ~field.isin("X.XX", "str(short_and_direct_answer_of_the_question)", "str(value which is the answer to the question)"), field)
    date = r"(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/([0-9]{4})"
    is_date = F.coalesce(output_type == "date", F.lit(False)) | F.coalesce(calculator.isin(*DATE_IDS), F.lit(False))
    day = F.concat_ws("/", F.lpad(_first(c, date, 1), 2, "0"), F.lpad(_first(c, date, 2), 2, "0"), _first(c, date, 3))
    weeks = F.concat(F.lit("("), _first(c, WEEKS, 1), F.lit(", "), _first(c, WEEKS, 2), F.lit(")"))
    return F.coalesce(
        line,
        field,
        after_trigger(c),
        F.when(is_date & c.rlike(date), day),
        F.when((calculator == GESTATIONAL_ID) & c.rlike(WEEKS), weeks),
        _last(c, r"-?[0-9]+\.?[0-9]*", 0),
        last_line(c),
    )


def _date(c: Column) -> Column:
    return F.when(strip(c).rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(strip(c), "M/d/yyyy"))


def _weeks_days(c: Column) -> Column:
    return F.when(c.rlike(WEEKS), F.regexp_extract(c, WEEKS, 1).cast("bigint") * 100 + F.regexp_extract(c, WEEKS, 2).cast("bigint"))


def medcalc_correct(extracted: Column, answer: Column, calculator: Column, output_type: Column, lower: Column, upper: Column) -> Column:
    """Equal dates, equal weeks and days, equal rounded integers (half to even), or within the limits."""
    p, g = number(extracted), number(answer)
    integer = F.coalesce(calculator.isin(*INTEGER_IDS), F.lit(False)) | F.coalesce(output_type == "integer", F.lit(False))
    correct = (
        F.when(calculator.isin(*DATE_IDS), _date(extracted) == _date(answer))
        .when(calculator == GESTATIONAL_ID, _weeks_days(extracted) == _weeks_days(answer))
        .when(integer, F.bround(p) == F.bround(g))
        .otherwise(p.between(number(lower), number(upper)))
    )
    return F.coalesce(correct, F.lit(False))


# -- theoremqa -------------------------------------------------------------------------------------

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_FUNCTIONS = {k: getattr(math, k) for k in ("sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "exp", "log", "log2", "log10", "floor", "ceil", "fabs", "factorial")} | {"abs": abs, "round": round}
_NAMES = {"pi": math.pi, "e": math.e}


def arithmetic(text: str) -> float | None:
    """The value of an arithmetic expression; null for anything else, for towers of powers and for huge results."""

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return n.value
        if isinstance(n, ast.Name) and n.id in _NAMES:
            return _NAMES[n.id]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            a, b = walk(n.left), walk(n.right)
            if abs(b) > 1000 or abs(a) > 1e12:
                raise ValueError
            return float(a) ** b
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _FUNCTIONS and not n.keywords:
            args = [walk(a) for a in n.args]
            if n.func.id == "factorial" and not 0 <= args[0] <= 170:
                raise ValueError
            return _FUNCTIONS[n.func.id](*args)
        raise ValueError

    try:
        v = walk(ast.parse(text.strip().replace("^", "**"), mode="eval"))
        return v if isinstance(v, (int, float)) and math.isfinite(v) else None
    except (SyntaxError, ValueError, TypeError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def clean_units(text: str) -> str:
    """Pi as 3.14, percent as hundredths, without currency and degrees (C11)."""
    t = text.replace("\\pi", "π")
    t = re.sub(r"(?<=\d)π", "*3.14", t)
    t = re.sub(r"\{π\}", "3.14", t).replace("π", "3.14").replace("%", "/100")
    for unit in ("$", "¥", "°C", " C", "°"):
        t = t.replace(unit, "")
    return t


def theorem_number(text: str | None) -> float | int | None:
    """A number, LaTeX fraction or arithmetic expression; whole numbers as int."""
    if text is None:
        return None
    t = clean_units(text).strip()
    t = re.sub(r"\\d?frac\{([^{}]+)\}\{([^{}]+)\}", r"((\1)/(\2))", t)
    t = re.sub(r"\\sqrt\{([^{}]+)\}", r"sqrt(\1)", t).replace("\\times", "*").replace("\\cdot", "*").replace(",", "") if not t.startswith(("[", "(")) else t
    v = arithmetic(t)
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v


def _spoken_truth(low: str) -> str | None:
    """A truth value named in a lower-case text, affirmation before negation."""
    said = set(re.findall(r"\b(?:yes|true|no|false)\b", low))
    return None if not said else "True" if said & {"yes", "true"} else "False"


def theorem_extract(text: str) -> str:
    """The answer that a reply states, as text.

    A truth value, or the text with an option (a) to (f); behind a trigger phrase what follows the last equals sign,
    evaluated to its value where it is an expression, or its leading number; without a trigger the last number.
    """
    *before, tail = re.split(TRIGGERS, text.strip("\n"))
    tail = tail.strip("\n").rstrip(".").rstrip("/").strip()
    truth = _spoken_truth(tail.lower())
    if truth:
        return truth
    if re.search(r"\([a-f]\)", tail.lower()):
        found = tail
    elif not before:
        found = (re.findall(r"-?\d*\.?\d+", tail) or [""])[-1]
    else:
        stated = clean_units(tail.rsplit("=", 1)[-1].strip())
        value = theorem_number(stated)
        led = re.match(r"(-?[\d.]+)\s(?:\D+|\S+)$", stated)
        found = str(value) if value is not None else led.group(1) if led else stated
    return found.rstrip(".").rstrip("/")


def theorem_list(text: str, brackets: str) -> list[float] | None:
    """The numbers of a list in one of the kinds of ``brackets`` ("()", "[]"), or none."""
    t = text.strip()
    if len(t) < 2 or t[0] + t[-1] not in {brackets[i : i + 2] for i in range(0, len(brackets), 2)}:
        return None
    out = [theorem_number(x) for x in t[1:-1].split(",") if x.strip()]
    return None if any(x is None for x in out) else out


def plain_number(text: str) -> float | int | None:
    """A written number, a whole one as int; expressions such as 1/2 are none."""
    try:
        v = float(text.strip())
    except ValueError:
        return None
    return None if not math.isfinite(v) else int(v) if v.is_integer() and re.fullmatch(r"[-+]?\d+", text.strip()) else v


def _meets(value: float | None, truth: float) -> bool:
    if value is None or not math.isfinite(value):
        return False
    if isinstance(truth, int):
        return round(value) == truth
    room = max(abs(truth) * 0.04, 1e-9)
    return truth - room <= value <= truth + room


def theorem_correct(extracted: str, answer: str, kind: str | None) -> bool:
    """Whether an extracted answer meets the truth (C14).

    An option is contained in the answer; else equal words, whatever their case; else numbers: whole ones equal once
    rounded, others within 4 %. A truth that is a list is met by a list in round brackets, element by element in
    ascending order. A truth that is written as an expression is no number.
    """
    given, truth = extracted.strip(), str(answer).strip()
    if re.fullmatch(r"\([a-f]\)", truth.lower()):
        return truth.lower() in given.lower()
    if given.lower() == truth.lower():
        return True
    if "list" in (kind or ""):
        have, want = theorem_list(given, "()"), theorem_list(truth, "()[]")
        return have is not None and want is not None and len(have) == len(want) and all(map(_meets, sorted(have), sorted(want)))
    if kind not in ("integer", "float", None):
        return False
    number = plain_number(truth)
    return number is not None and _meets(theorem_number(given), number)


@F.pandas_udf(StringType())
def theorem_answer(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`theorem_extract`; null stays null."""
    for s in texts:
        yield s.map(lambda t: None if t is None else theorem_extract(t))


@F.pandas_udf(BooleanType())
def theorem_agrees(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Column form of :func:`theorem_correct` on (extracted, answer, kind); a null answer is never met."""
    for x, g, k in parts:
        yield pd.Series([e is not None and a is not None and theorem_correct(e, a, t) for e, a, t in zip(x, g, k)], dtype=bool)


# -- calculator ------------------------------------------------------------------------------------


def calculate(c: Column) -> Column:
    """mean, median, sum, max or min of a list of numbers in a call like mean(1, 2); null for others.

    NaN and empty elements are ignored; results are rounded to three digits except max and min.
    """
    call = r"(?i)^(mean|median|sum|max|min)\((.+)\)$"
    name = F.lower(F.regexp_extract(F.trim(c), call, 1))
    parts = F.filter(F.transform(F.split(F.regexp_extract(F.trim(c), call, 2), ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))
    n = F.array_sort(F.transform(parts, lambda x: x.try_cast("double")))
    size = F.size(n)
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    middle = (F.get(n, F.floor((size - 1) / 2).cast("int")) + F.get(n, F.floor(size / 2).cast("int"))) / 2
    value = (
        F.when(name == "mean", F.round(F.try_divide(total, size), 3)).when(name == "median", F.round(middle, 3)).when(name == "sum", F.round(total, 3)).when(name == "max", F.array_max(n)).when(name == "min", F.array_min(n))
    )
    return F.when(F.trim(c).rlike(call) & (size > 0), value)


def calculate_text(text: str | None) -> str | None:
    """Any arithmetic expression as the tool answers it: whole numbers without point, others to three digits."""
    v = arithmetic(text or "")
    if v is None:
        return None
    return str(int(v)) if float(v).is_integer() else str(round(v, 3))


# -- checks of instances ---------------------------------------------------------------------------

ANSWER_TYPES = ("float", "integer", "bool", "option", "list of integer", "list of float")


def eval_data_reason(dataset: Column, question: Column, data: str) -> Column:
    """Why an instance's expected answer is not valid; '' if it is."""
    a, t, task = F.coalesce(F.col(f"{data}.answer"), F.lit("")), F.coalesce(F.col(f"{data}.answer_type"), F.lit("")), F.coalesce(F.col(f"{data}.task_type"), F.lit(""))
    out, cal = F.coalesce(F.col(f"{data}.output_type"), F.lit("")), F.col(f"{data}.calculator_id")
    low, up = F.coalesce(F.col(f"{data}.lower_limit"), F.lit("")), F.coalesce(F.col(f"{data}.upper_limit"), F.lit(""))
    want = F.when(cal.isin(*DATE_IDS), "date").when(cal == GESTATIONAL_ID, "gestational_age").when(cal.isin(*INTEGER_IDS), "integer").otherwise("decimal")
    n, nl, nu = number(a), number(low), number(up)
    off = lambda x, y: F.abs(x - y) > F.greatest(F.abs(y) * 0.01, F.lit(1e-6))
    choices = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"choice_\d"), F.lit(0))))
    theorem = (
        F.when(~t.isin(*ANSWER_TYPES), "answer_type")
        .when(a.isin("", "X.XX", "PLACEHOLDER", "..."), "placeholder")
        .when((t == "float") & n.isNull() & ~a.startswith("["), "float")
        .when((t == "integer") & (n.isNull() | (n != F.floor(n))), "integer")
        .when((t == "bool") & ~a.isin("True", "False"), "bool")
        .when((t == "option") & ~a.rlike(r"^\([a-f]\)$"), "option")
        .when(t.startswith("list") & ~(a.startswith("[") & a.endswith("]")), "list")
    )
    logic = (
        F.when(~task.isin("BQA", "MCQA"), "task_type")
        .when((task == "BQA") & ~a.isin("yes", "no"), "yes_no")
        .when((task == "MCQA") & ~a.rlike("^choice_[1-5]$"), "choice")
        .when((task == "MCQA") & (F.coalesce(question, F.lit("")) != "") & (choices < 2), "choices_in_question")
    )
    medcalc = (
        F.when(cal.isNull(), "calculator_id")
        .when(out != want, "output_type")
        .when(a.isin("", "X.XX", "PLACEHOLDER"), "placeholder")
        .when((low == "") | (up == ""), "limits")
        .when((want != "decimal") & ((low != a) | (up != a)), "limits_equal")
        .when((want == "decimal") & (n.isNull() | nl.isNull() | nu.isNull()), "limits_number")
        .when((want == "decimal") & (off(nl, n * 0.95) | off(nu, n * 1.05)), "limits_range")
    )
    reason = (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "question")
        .when(dataset == "theoremqa", theorem)
        .when(dataset == "logicbench", logic)
        .when(dataset == "medcalcbench", medcalc)
        .when(dataset == "toolqa", F.when(a == "", "answer"))
        .otherwise(F.lit("dataset"))
    )
    return F.coalesce(reason, F.lit(""))
