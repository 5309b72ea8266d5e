"""What built-in expressions can't say: balanced braces, strict block scans, similarity, token counts, answer equivalence.

Each is a plain function of Python values, and an Arrow UDF of the same name with a leading `udf_`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import algebra
from strandlake.functions.matching import neighbour_similarity, similarity

BOXED = "\\boxed{"
#: Markers that announce an answer, special tokens, and wrappers.
_MARKER = re.compile(r"(?i)(?:final answer|answer)\s*(?:is|:)\s*")
_SPECIAL = re.compile(r"<\|[^|>]*\|>")
_BRACE = re.compile(r"\\boxed\{|[{}]")
_INTEGER = re.compile(r"-?\d+")
_WRAPPED = re.compile(r"\\(?:boxed|text|mathrm|operatorname)\{(.+)\}")
_CONTROL = re.compile(r"</?(?:think|steer|exec)>")
#: Control tags and their beginnings that are stripped from the edges of a block.
EDGES = [t[:n] for t in ("</steer>", "</exec>", "</think>", "<steer>", "<exec>", "<think>") for n in range(len(t), 1, -1)]


def arrow(kind: T.DataType) -> Callable:
    """An Arrow UDF that gives null for a row with a null argument."""

    def wrap(f: Callable):
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

        # the number of arguments is the function's own
        n = f.__code__.co_argcount
        by_count = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[n]
        by_count.__annotations__ = {x: pd.Series for x in by_count.__code__.co_varnames[:n]} | {"return": pd.Series}
        return F.pandas_udf(by_count, kind)

    return wrap


def boxes(text: str) -> list[tuple[int, int]]:
    """Where balanced boxed expressions begin and end, in the order in which they end."""
    out, open_ = [], []
    for m in _BRACE.finditer(text):  # an opening is a box or a bare brace
        if m[0] != "}":
            open_.append(m.start() if m[0] == BOXED else None)
        elif open_ and (begin := open_.pop()) is not None:
            out.append((begin, m.end()))
    return out


def boxed_answers(text: str) -> list[str]:
    """Every balanced boxed expression, nested ones too, by where they begin."""
    return [text[a:b] for a, b in sorted(boxes(text))]


def last_box(text: str) -> str | None:
    """What the last box holds; one of the form '\\boxed x$' comes before all others, and an unbalanced last one holds nothing."""
    _, spaced, rest = text.rpartition("\\boxed ")
    if spaced:
        return rest.partition("$")[0]
    begun = text.rfind("\\boxed")
    return next((text[a + len(BOXED) : b - 1] for a, b in boxes(text) if a == begun), None) if begun >= 0 else None


def candidate_answer(text: str) -> str:
    """The last box, or what follows the last answer marker (a box, the first integer, or between dollars), or what stands between the last two dollars, or all."""
    text = _SPECIAL.sub("", text).strip()

    def dollars(t: str) -> str:
        parts = t.split("$")
        return parts[-2] if len(parts) > 2 else t

    if (box := last_box(text)) is not None:
        return box
    markers = list(_MARKER.finditer(text))
    if not markers:
        return dollars(text)
    tail = text[markers[-1].end() :]
    if (box := last_box(tail)) is not None:
        return box
    number = _INTEGER.search(tail)
    return number[0] if number else dollars(tail)


def completion_check(text: str) -> tuple[str, int, int, str]:
    """The reason that a completion is rejected for, or ok; steer and exec blocks; the answer."""
    text = _SPECIAL.sub("", text).strip()
    if not text.startswith("<think>"):
        return "missing_open_think", 0, 0, ""
    inner, found, answer = text[len("<think>") :].partition("</think>")
    answer = answer.strip()
    if not found:
        return "missing_close_think", 0, 0, ""
    if not answer:
        return "empty_final_answer", 0, 0, ""
    if _CONTROL.search(answer):
        return "final_answer_control_tag", 0, 0, ""
    counts, rest, want, other = {"steer": 0, "exec": 0}, inner.lstrip(), "steer", "exec"
    while rest:
        if not rest.startswith(f"<{want}>"):
            return f"expected_{want}_open", 0, 0, answer
        body, closed, rest = rest[len(want) + 2 :].partition(f"</{want}>")
        if not closed:
            return f"missing_{want}_close", 0, 0, answer
        if not body.strip():
            return f"empty_{want}_block", 0, 0, answer
        counts[want] += 1
        want, other, rest = other, want, rest.lstrip()
    if not counts["steer"] or not counts["exec"]:
        return "missing_steer_exec_pair", 0, 0, answer
    if counts["steer"] != counts["exec"]:
        return "unbalanced_steer_exec_blocks", 0, 0, answer
    return "ok", counts["steer"], counts["exec"], answer


def bare_edges(text: str) -> str:
    """Without control tags, or their beginnings, at either end."""
    text = text.strip()
    while True:
        low = text.lower()
        cut = next((e for e in EDGES if low.startswith(e) or low.endswith(e)), None)
        if cut is None:
            return text
        text = (text[len(cut) :] if low.startswith(cut) else text[: -len(cut)]).strip()


def resembles(a: str, b: str, least: float) -> bool:
    """Whether similarity() is `least` or more; what bounds it from above is looked at first."""
    if not a or not b:
        return least <= 0
    if 2 * min(len(a), len(b)) / (len(a) + len(b)) < least:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= least and m.ratio() >= least


def repeat_runs(blocks: list[str], threshold: float = 0.9, window: int = 3) -> list[int]:
    """For each block, how many in a row resemble one of the `window` blocks before them, itself included."""
    out, run = [], 0
    for i, b in enumerate(blocks):
        run = run + 1 if any(resembles(p, b, threshold) for p in blocks[max(0, i - window) : i]) else 1
        out.append(run)
    return out


def peelings(text: str) -> list[str]:
    """The stripped text, and what each peeling of a wrapper leaves."""
    out = [text.strip()]
    while m := _WRAPPED.fullmatch(out[-1]):
        out.append(m[1].strip())
    return out


def peeled(text: str) -> list[str]:
    return list(dict.fromkeys(x for x in peelings(text) if x))


def peeled_to_the_end(text: str) -> str:
    return peelings(text)[-1]


def as_number(text: str) -> Fraction | None:
    """An exact value of a number, fraction, percentage-free LaTeX fraction; else None."""
    t = re.sub(r"\\[!,;: ]|\$|\s|\\left|\\right", "", text).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").rstrip(".")
    if re.fullmatch(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?", t):
        t = t.replace(",", "")
    if m := re.fullmatch(r"([+-]?)\\frac\{([+-]?\d+)\}\{([+-]?\d+)\}", t):
        t = f"{m[1]}{m[2]}/{m[3]}" if not (m[1] and m[2][0] in "+-") else "?"
    try:
        return Fraction(t)
    except (ValueError, ZeroDivisionError):
        return None


def variants(text: str) -> list[str]:
    """An answer and what is left of it under its wrappers, in lower case and with single spaces."""
    return list(dict.fromkeys(" ".join(x.lower().replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").split()) for x in peeled(text)))


def same_answer(prediction: str, gold: str) -> bool:
    """Equal as texts (G08), as exact numbers, or as formulas, tuples, sets and intervals of them."""
    if set(variants(prediction)) & set(variants(gold)):
        return True
    a, b = peeled(prediction), peeled(gold)
    numbers = {n for x in a if (n := as_number(x)) is not None}, {n for x in b if (n := as_number(x)) is not None}
    return bool(numbers[0] & numbers[1]) or any(algebra.same(x, y) for x in a for y in b)


def reward(text: str, gold: str, valid: bool) -> float:
    """0.1 for a valid form and 1.0 for a right last box."""
    boxes = boxed_answers(text)
    return 0.1 * valid + 1.0 * bool(boxes and same_answer(boxes[-1], gold))


class Tokens:
    """H36, H37 with a tokenizer: a file of the tokenizers library that all executors have. Each worker loads it once."""

    known: dict[str, object] = {}

    def __init__(self, path: str):
        self.path = path

    def encode(self, texts: list[str]) -> list:
        if self.path not in self.known:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = True
            self.known[self.path] = t
        return self.known[self.path].encode_batch(texts, add_special_tokens=False)

    def count(self):
        """An Arrow UDF that counts the tokens of a text."""
        return F.pandas_udf(lambda texts: pd.Series([None if t is None else len(x) for t, x in zip(texts, self.encode([t or "" for t in texts]))], dtype="Int32"), T.IntegerType())

    def first(self, n: int):
        """An Arrow UDF that cuts a text behind its n-th token."""
        return F.pandas_udf(lambda texts: pd.Series([None if t is None else t[: x.offsets[n - 1][1] if len(x) > n else len(t)].rstrip() for t, x in zip(texts, self.encode([t or "" for t in texts]))], dtype=object), T.StringType())


def register(spark) -> list[str]:
    """The functions of this module under names for SQL."""
    named = {"boxed_answers": udf_boxed_answers, "last_box": udf_last_box, "candidate_answer": udf_candidate_answer, "same_answer": udf_same_answer, "completion_check": udf_completion_check, "answer_variants": udf_variants}
    for name, f in named.items():
        spark.udf.register(f"strandlake_{name}", f)
    return [f"strandlake_{n}" for n in named]


def regex_tokens(text: str) -> list[str]:
    """H36 without a tokenizer: runs of up to four letters or digits, single other signs."""
    return re.findall(r"[^\W\d_]{1,4}|\d{1,3}|[^\w\s]|_", text)


def first_tokens(text: str, n: int) -> str:
    """The text up to the end of its n-th token."""
    end = 0
    for i, m in enumerate(re.finditer(r"[^\W\d_]{1,4}|\d{1,3}|[^\w\s]|_", text)):
        if i >= n:
            return text[:end].rstrip()
        end = m.end()
    return text.rstrip()


udf_boxed_answers = arrow(T.ArrayType(T.StringType()))(boxed_answers)
udf_candidate_answer = arrow(T.StringType())(candidate_answer)
udf_similarity = arrow(T.DoubleType())(lambda a, b: similarity(a, b))
udf_neighbour_similarity = arrow(T.DoubleType())(lambda blocks: neighbour_similarity(list(blocks)))
udf_bare_edges = arrow(T.StringType())(bare_edges)
udf_variants = arrow(T.ArrayType(T.StringType()))(variants)
udf_last_box = arrow(T.StringType())(last_box)
udf_same_answer = arrow(T.BooleanType())(same_answer)
udf_token_count = arrow(T.IntegerType())(lambda text: len(regex_tokens(text)))
udf_first_tokens = arrow(T.StringType())(first_tokens)
udf_repeat_runs = arrow(T.ArrayType(T.IntegerType()))(lambda blocks: repeat_runs(list(blocks)))


_CHECK = T.StructType([T.StructField("reason", T.StringType()), T.StructField("steer_count", T.IntegerType()), T.StructField("exec_count", T.IntegerType()), T.StructField("answer", T.StringType())])


@F.pandas_udf(_CHECK)
def udf_completion_check(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([completion_check(t or "") for t in texts], columns=["reason", "steer_count", "exec_count", "answer"])
