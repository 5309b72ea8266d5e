"""Text, tag and answer functions as Column builders: built-in expressions (and running sums in Arrow), each takes and returns Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.arrays import running

#: The tag vocabularies differ by operator and are never shared between them.
STEER_TAGS, EXEC_TAGS = "steer|steering", "exec|execute|execution"
TAG_FRAGMENTS = "t|th|thi|thin|s|st|ste|stee|e|ex|exe"
STEER_SUFFIXES = ["</steer>", "</steer", "</stee", "</ste", "</st", "</s", "</"]
WRAPPERS = "boxed|text|mathrm|operatorname"
SYMBOLIC_MARKERS = ["\\sqrt", "\\pi", "^", "\\frac", "π"]
#: Stop reasons, issues and classes of failures.
TRUNCATION = ["max_gen_toks_reached", "post_think_toks_reached", "max_context_length_reached"]
TAG_ISSUES = [
    "steer_exec_outside_think_block",
    "non_whitespace_outside_steer_exec",
    "unequal_steer_exec_block_counts",
    "unpaired_steer_exec_tags",
    "empty_steer_exec_block",
    "missing_steer_exec_blocks",
    "steer_exec_not_interleaved",
]
ENVELOPE_ISSUES = ["expected_single_complete_think_block", "empty_think_block"]
_LETTERS = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]  # no letter beyond has a case
#: Unicode's simple mappings, one letter for one letter, as SQL engines have them (a letter without one stays).
SMALL = {c: c.lower()[0] for c in _LETTERS if c.lower() != c}
CAPITAL = {c: u for c in _LETTERS if (u := c.upper() if len(c.upper()) == 1 else c.title()) != c and len(u) == 1} | {"ß": "ẞ"}


def strip(x: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def let(x: Column, use) -> Column:
    """use(x) with x computed once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def think_blocks(x: Column) -> Column:
    """Bodies of all think blocks, stripped."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)), strip)


def tag_bodies(x: Column, tags: str) -> Column:
    return F.regexp_extract_all(x, F.lit(rf"(?is)<(?:{tags})>(.*?)</(?:{tags})>"), F.lit(1))


def index_pairs(x: Column) -> Column:
    """The n-th steer body with the n-th exec body; what is left over has no pair."""
    a, b = F.transform(tag_bodies(x, STEER_TAGS), strip), F.transform(tag_bodies(x, EXEC_TAGS), strip)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda s, e: F.struct(s.alias("steer"), e.alias("exec")))


def unmatched(x: Column) -> Column:
    """How many bodies have no partner."""
    return F.abs(F.size(tag_bodies(x, STEER_TAGS)) - F.size(tag_bodies(x, EXEC_TAGS)))


_ADJACENT = r"(?is)<steer\b[^>]*>(.*?)</steer>\s*<exec\b[^>]*>(.*?)</exec>"


def adjacent_pairs(x: Column) -> Column:
    """Steer blocks followed by an exec block at once; pairs with a blank side are dropped."""
    found = F.regexp_extract_all(x, F.lit(_ADJACENT), F.lit(0))  # one scan of the trace; each pair is cut again by itself
    side = lambda p, i: squeeze(F.regexp_extract(p, _ADJACENT, i))
    both = F.transform(found, lambda p: F.struct(side(p, 1).alias("steer"), side(p, 2).alias("exec")))
    return F.filter(both, lambda p: (p["steer"] != "") & (p["exec"] != ""))


_SEGMENT = r"(?is)<steer>.*?</steer>|<exec>.*?</exec>"


def _kind_and_body(block: Column) -> Column:
    """Of a whole block, whose tags are equally long at both ends but for the slash."""
    n = F.when(F.lower(F.substr(block, F.lit(2), F.lit(1))) == "s", len("steer")).otherwise(len("exec"))
    return F.struct(F.when(n == len("steer"), "steer").otherwise("exec").alias("type"), F.substr(block, n + 3, F.length(block) - 2 * n - 5).alias("text"))


def segments(x: Column) -> Column:
    """Steer and exec blocks in their order, by type and stripped text; blank ones are dropped. One scan of the text."""
    blocks = F.transform(F.transform(F.regexp_extract_all(x, F.lit(_SEGMENT), F.lit(0)), _kind_and_body), lambda s: F.struct(s["type"].alias("type"), strip(s["text"]).alias("text")))
    return F.filter(blocks, lambda s: s["text"] != "")


def trace_of(trace: Column, blocks: Column, assistant: Column, messages: Column) -> Column:
    """The trace by the first shape that has one; none is an error."""
    joined = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<"), b["type"], F.lit(">"), b["text"], F.lit("</"), b["type"], F.lit(">"))), "\n")
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    return F.coalesce(trace, F.when(F.size(blocks) > 0, joined), assistant, last, F.raise_error(F.lit("the row has no trace")))


def alternation_errors(blocks: Column, most_words: int) -> Column:
    """What is wrong with a list of blocks, in their order."""
    errors = F.transform(
        blocks,
        lambda b, i: F.array_compact(
            F.array(
                F.when(b["type"] != F.when(i % 2 == 0, "steer").otherwise("exec"), F.concat(F.lit("order@"), i)),
                F.when(blank(b["text"]), F.concat(F.lit("empty@"), i)),
                F.when(words(b["text"]) > most_words, F.concat(F.lit("long@"), i)),
            )
        ),
    )
    return F.concat(F.when(F.size(blocks) % 2 != 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")), F.flatten(errors))


def window_check(blocks: Column, pairs: int, first: Column, most_words: int) -> Column:
    """Whether generated blocks are so many pairs, begin with the wanted steer text and keep the form and limits of H06: ok, or the first thing wrong."""
    errors = alternation_errors(blocks, most_words)
    return (
        F.when(F.size(blocks) != 2 * pairs, "pair_count")
        .when(F.get(blocks, F.lit(0))["text"] != first, "first_steer")
        .when(F.size(errors) > 0, F.get(errors, F.lit(0)))
        .otherwise("ok")
    )


def words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


_NONE = "array<string>"


def _label(test: Column, label: str) -> Column:
    return F.when(test, F.array(F.lit(label))).otherwise(F.array().cast(_NONE))


def _block_issues(think: Column) -> Column:
    """Of the steer and exec blocks inside a think block, in the order in which they stand."""
    control = lambda c: c.rlike(r"(?i)</?(?:think|steer|exec)") | c.rlike(rf"(?i)</?(?:{TAG_FRAGMENTS})(?=[^A-Za-z0-9_]|$)") | c.rlike(r"</?\s*$")
    blocks = F.transform(F.regexp_extract_all(think, F.lit(_SEGMENT), F.lit(0)), _kind_and_body)
    parts = F.struct(blocks["type"].alias("kinds"), blocks["text"].alias("bodies"), F.split(think, _SEGMENT, -1).alias("gaps"))

    def issues(p: Column) -> Column:
        each = F.transform(
            F.arrays_zip(p["kinds"].alias("k"), p["bodies"].alias("b"), F.slice(p["gaps"], F.lit(1), F.size(p["kinds"])).alias("g")),
            lambda s, i: F.concat(
                _label(~blank(s["g"]), "non_whitespace_outside_steer_exec"),
                _label(s["k"] != F.when(i % 2 == 0, "steer").otherwise("exec"), "steer_exec_not_interleaved"),
                _label(blank(s["b"]), "empty_steer_exec_block"),
                _label(control(s["b"]), "control_tag_inside_steer_exec_block"),
            ),
        )
        n, steer = F.size(p["kinds"]), F.size(F.filter(p["kinds"], lambda k: k == "steer"))
        return F.concat(
            F.flatten(each),
            _label(~blank(F.element_at(p["gaps"], -1)), "non_whitespace_outside_steer_exec"),
            _label(n == 0, "incomplete_steer_exec_tags"),
            _label(steer * 2 != n, "unequal_steer_exec_block_counts"),
            _label(n % 2 != 0, "unpaired_steer_exec_tags"),
            _label((n > 0) & (F.get(p["kinds"], F.lit(0)) != "steer"), "steer_exec_must_start_with_steer"),
        )

    return let(parts, issues)


def structure_issues(x: Column, require_blocks: bool = True) -> Column:
    """What is wrong with the form of a response, each label once, in the order in which a reader meets it."""
    tag = r"(?i)</?(?:steer|exec)>"
    parts = F.struct(x.alias("all"), F.regexp_extract_all(x, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)).alias("thinks"), F.split(x, r"(?is)<think>.*?</think>", 2).alias("around"))

    def issues(p: Column) -> Column:
        think, before, after = F.get(p["thinks"], F.lit(0)), F.get(p["around"], F.lit(0)), F.get(p["around"], F.lit(1))
        one = F.concat(
            _label((F.regexp_count(p["all"], F.lit("(?i)<think>")) != 1) | (F.regexp_count(p["all"], F.lit("(?i)</think>")) != 1), "expected_single_complete_think_block"),
            _label(~blank(before), "non_whitespace_before_think_block"),
            _label(blank(think), "empty_think_block"),
            _label(before.rlike(tag) | after.rlike(tag), "steer_exec_outside_think_block"),
            F.when(think.rlike(tag), _block_issues(think)).otherwise(_label(F.lit(require_blocks), "missing_steer_exec_blocks")),
            _label(~has_boxed(after), "missing_boxed_answer"),
        )
        other = F.concat(F.array(F.lit("expected_single_complete_think_block")), _label(~has_boxed(p["all"]), "missing_boxed_answer"))
        return F.array_distinct(F.when(F.size(p["thinks"]) == 1, one).otherwise(other))

    return let(parts, issues)


def has_boxed(x: Column) -> Column:
    r"""Whether some \boxed{ is closed again, at any depth: a fold over the braces that knows how many are open, and at what depth the
    innermost open box began (the first one that closes is always that one)."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("box"), F.lit(False).alias("found"))

    def fold(s: Column, t: Column) -> Column:
        opened = F.struct((s["depth"] + 1).alias("depth"), F.when(t == "{", s["box"]).otherwise(s["depth"] + 1).alias("box"), s["found"].alias("found"))
        closed = F.struct(F.greatest(s["depth"] - 1, F.lit(0)).alias("depth"), s["box"].alias("box"), (s["found"] | ((s["depth"] > 0) & (s["depth"] == s["box"]))).alias("found"))
        return F.when(t == "}", closed).otherwise(opened)

    return F.aggregate(F.regexp_extract_all(x, F.lit(r"\\boxed\{|[{}]"), F.lit(0)), start, fold, lambda s: s["found"])


def block_stats(x: Column) -> Column:
    """Blocks of each kind (an unclosed last one included) and their words."""
    out = []
    for tag in ("steer", "exec"):
        bodies = F.regexp_extract_all(x, F.lit(rf"(?is)<{tag}>(.*?)(?:</{tag}>|$)"), F.lit(1))
        out += [F.size(bodies).alias(f"{tag}_blocks"), F.aggregate(bodies, F.lit(0), lambda a, b: a + words(b)).alias(f"{tag}_words")]
    return F.struct(*out)


def eval_answer(x: Column) -> Column:
    r"""Without $ , \! \, and spaces, trailing dots, and leading zeros of whole numbers."""
    y = F.regexp_replace(strip(x), r"\$|\\!|\\,|,| ", "")
    y = F.regexp_replace(y, r"\.+$", "")
    return F.when(y.rlike(r"^-?\d+$"), F.regexp_replace(y, r"^(-?)0+(?=\d)", "$1")).otherwise(y)


def peelings(x: Column) -> Column:
    """The stripped answer, and what each peeling of a whole-answer wrapper such as \\text{...} leaves, until none is left.

    Wrappers are counted at the beginning and closing braces at the end, so that any depth takes one pass each. A wrapper of
    nothing stays, and so do all where the answer holds a line feed.
    """

    def cuts(y: Column) -> Column:
        opened = F.regexp_extract_all(F.regexp_extract(y, rf"(?U)^(?:\\(?:{WRAPPERS})\{{\s*+)++", 0), F.lit(rf"(?U)\\(?:{WRAPPERS})\{{\s*"), F.lit(0))
        closed = F.regexp_extract_all(F.regexp_extract(F.reverse(y), r"(?U)^(?:\}\s*+)++", 0), F.lit(r"(?U)\}\s*"), F.lit(0))
        size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p))
        n = F.when(y.contains("\n"), 0).otherwise(F.least(F.size(opened), F.size(closed)))
        inner = lambda i: F.substr(y, size(opened, i) + 1, F.greatest(F.length(y) - size(opened, i) - size(closed, i), F.lit(0)))
        bare = (n > 0) & (inner(n) == "") & F.get(opened, n - 1).endswith("{")
        return F.transform(F.sequence(F.lit(0), n - bare.cast("int")), lambda i: strip(inner(i)))

    return let(strip(x), cuts)


def unwrapped(x: Column) -> Column:
    """Whole-answer wrappers peeled off until none is left."""
    return F.element_at(peelings(x), -1)


def answer_class(x: Column) -> Column:
    """Plain scalar or simple fraction, exact symbolic expression, or other."""
    y = F.regexp_replace(strip(x), r"(?s)^\$\$(.*)\$\$$", "$1")
    y = F.regexp_replace(strip(y), r"(?s)^\$(.*)\$$", "$1")
    y = F.regexp_replace(F.replace(unwrapped(y), F.lit(","), F.lit("")), r"(?U)\s+", "")
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
    unit = r"(?:\\%|%|\^\\circ|\\text\{[^}]+\})"  # fixed value: units behind a number

    def cls(v: Column) -> Column:
        symbolic = F.lit(False)
        for m in SYMBOLIC_MARKERS:
            symbolic = symbolic | v.contains(m)
        return (
            F.when(v.rlike(rf"^{number}(?:[eE][+-]?\d+)?$"), "plain_scalar_or_simple_fraction")
            .when(v.rlike(r"^[+-]?\d+/[+-]?0*[1-9]\d*$"), "plain_scalar_or_simple_fraction")
            .when(v.rlike(rf"^{number}{unit}$"), "other")
            .when(symbolic, "exact_symbolic_numeric_expression")
            .otherwise("other")
        )

    return let(y, cls)


def non_blank(values: Column) -> Column:
    """The values that are not blank."""
    return F.filter(values, lambda v: v.isNotNull() & ~blank(v))


def labels(values: Column) -> Column:
    """Stripped, lower-case, sorted labels."""
    return F.array_sort(F.transform(non_blank(values), lambda v: F.lower(strip(v))))


def source_family(first: Column, second: Column) -> Column:
    """Last part of the path that the first non-empty column names, without its suffix."""
    name = F.coalesce(F.nullif(strip(first), F.lit("")), F.nullif(strip(second), F.lit("")), F.lit("unknown"))
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?i)_(?:filtered|cleaned)$", "")


def without_role(x: Column) -> Column:
    """Without a leading user:, human: or assistant:."""
    return F.regexp_replace(x, r"(?i)^\s*(?:user|human|assistant)\s*:\s*", "")


def unfenced(x: Column) -> Column:
    """Without byte order mark and code fence."""
    return strip(F.regexp_replace(strip(F.replace(x, F.lit("\ufeff"), F.lit(""))), r"(?s)^```[A-Za-z0-9_-]*\n(.*?)\n?```.*$", "$1"))


def replaced_blocks(x: Column, outputs: Column) -> Column:
    """The n-th think block that is not blank holds the n-th output; a blank one becomes empty and uses none. Counts must agree."""
    bodies = F.regexp_extract_all(x, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    gaps = F.split(x, r"(?is)<think>.*?</think>", -1)
    used = F.size(F.filter(bodies, lambda b: ~blank(b)))
    number = running(F.transform(bodies, lambda b: F.when(blank(b), 0).otherwise(1)))  # of the output that a block uses, from 1
    filled = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(bodies)).alias("gap"), bodies.alias("body"), number.alias("number")), lambda z: F.concat(z["gap"], F.when(blank(z["body"]), F.lit("<think></think>")).otherwise(F.concat(F.lit("<think>\n"), unfenced(F.get(outputs, z["number"] - 1)), F.lit("\n</think>")))))
    return F.when(F.size(outputs) != used, F.raise_error(F.lit("as many outputs as think blocks are needed"))).otherwise(F.concat(F.array_join(filled, ""), F.element_at(gaps, -1)))


def residual(x: Column, preview: int = 220) -> Column:
    """What stands outside the blocks, without stray tags, its first characters."""
    tags = f"{STEER_TAGS}|{EXEC_TAGS}"
    return F.substring(strip(F.regexp_replace(F.regexp_replace(x, rf"(?is)<(?:{tags})>.*?</(?:{tags})>", ""), rf"(?i)</?(?:{tags})>", "")), 1, preview)


def without_tags(x: Column) -> Column:
    """Tags become spaces, white space is squeezed."""
    return squeeze(F.regexp_replace(x, r"(?i)</?(?:think|steer|exec)\b[^>]*>", " "))


def cleaned_generation(x: Column, mode: str) -> Column:
    """Raw, after_think or strip_internal_tags."""
    if mode == "raw":
        return strip(x)
    if mode == "after_think":
        return strip(F.regexp_replace(x, r"(?s)^.*</think>", ""))
    if mode == "strip_internal_tags":
        return without_tags(x)
    raise ValueError(f"unknown mode {mode!r}")


def without_steer_suffix(x: Column) -> Column:
    """Without a closing steer tag at the end, whole or cut off, and without an opening one."""
    suffix = "|".join(STEER_SUFFIXES)
    return strip(F.regexp_replace(strip(F.regexp_replace(x, rf"(?i)(?:{suffix})\s*$", "")), r"(?i)^\s*<steer\b[^>]*>\s*", ""))


def normal_block(x: Column) -> Column:
    """Lower case, squeezed."""
    return F.lower(squeeze(x))


def at_boundary(x: Column) -> Column:
    """Text that only grows to a boundary: a cut closing tag is completed, an open exec block closed, and a closed one ends its line.
    What already ends in an opening tag stays."""
    partial = "|".join(re.escape("</exec>"[:n]) for n in range(6, 0, -1))
    opened = F.regexp_extract(x, r"(?s)^.*<(/?exec)>", 1) == "exec"
    body = F.regexp_replace(x, rf"(?:{partial})$", "")
    return (
        F.when(x.rlike(r"<(?:steer|exec)>\s*$"), x)
        .when(opened, F.concat(body, F.lit("</exec>\n")))
        .when(x.rlike(r"</exec>\s*$"), F.concat(F.regexp_replace(x, r"\s+$", ""), F.lit("\n")))
        .otherwise(x)
    )


def first_stop(x: Column) -> Column:
    """The text before the earliest closing steer or think tag."""
    return F.regexp_extract(x, r"(?s)^(.*?)(?:</steer>|</think>|\z)", 1)


def around_think_end(x: Column) -> Column:
    """What stands before and after the first </think>; without one all is before."""
    return F.struct(F.substring_index(x, "</think>", 1).alias("before"), F.regexp_replace(x, r"(?s)^.*?(?:</think>|\z)", "").alias("after"))


def numbered_options(x: Column) -> Column:
    """The texts of lines such as '1. text', each with its continuation lines, by number."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), x), r"\n\s*(\d+)\.\s+", "\u0001$1\u0002")
    return F.transform(
        F.filter(F.split(marked, "\u0001"), lambda p: p.contains("\u0002")),
        lambda p: F.struct(F.substring_index(p, "\u0002", 1).cast("int").alias("number"), squeeze(F.substring_index(p, "\u0002", -1)).alias("text")),
    )


def mapped(x: Column, letters: dict[str, str]) -> Column:
    return F.translate(x, "".join(letters), "".join(letters.values()))


def small(x: Column) -> Column:
    """In lower case, each letter on its own: no final sigma, and no letter becomes two. lower() is the same on Latin texts, and faster."""
    return F.when(x.rlike("[^\x00-\u012f\u0131-\u024f\u2000-\u206f]"), mapped(x, SMALL)).otherwise(F.lower(x))


def capitalized(x: Column, space: str = r"\s") -> Column:
    """The first letter after leading white space in upper case, which is one letter too; the rest as it is."""
    lead = F.regexp_extract(x, rf"(?U)^{space}*", 0)
    rest = F.substr(x, F.length(lead) + 1)
    return F.concat(lead, mapped(F.substr(rest, F.lit(1), F.lit(1)), CAPITAL), F.substr(rest, F.lit(2)))


def rendered(pairs: Column) -> Column:
    """Pairs as text."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("<steer>"), p["steer"], F.lit("</steer>\n<exec>"), p["exec"], F.lit("</exec>"))), "\n")


def steer_ranges(pairs: Column) -> Column:
    """Where the steer texts stand in the rendered text, as half-open ranges of characters."""
    size = F.transform(pairs, lambda p: F.length(p["steer"]) + F.length(p["exec"]) + len("<steer></steer>\n<exec></exec>\n"))
    places = F.zip_with(running(size), size, lambda upto, n: upto - n + len("<steer>"))
    return F.zip_with(places, pairs, lambda at, p: F.struct(at.alias("start"), (at + F.length(p["steer"])).alias("end")))


def word_count(x: Column, word: str) -> Column:
    """Occurrences of a whole word, in any case."""
    return F.regexp_count(x, F.lit(rf"(?i)\b{word}\b"))


def last_exec_words(x: Column) -> Column:
    """Words of the last exec block; null without one."""
    return words(F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?is)<exec>(.*?)</exec>"), F.lit(1)), F.lit(-1)))


def token_bucket(n: Column) -> Column:
    """H38"""
    return F.when(n > 1024, "over_1024").when(n > 512, "over_512").otherwise("unchanged")


def transcript(messages: Column) -> Column:
    """Role: content, a line for each message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def stop_bucket_exact(stop: Column) -> Column:
    """H40, first definition: by exact names."""
    return F.when(stop == "think_end", "natural").when(stop.isin(TRUNCATION), "max_length").when(stop == "repeated_exec_block_loop", "repeating").otherwise("other")


def stop_bucket_family(stop: Column) -> Column:
    """H40, second definition: by families."""
    return F.when(stop == "think_end", "natural").when(stop.isin([*TRUNCATION, "length"]), "max_length").when(stop.startswith("repeated_"), "repeating").otherwise("other")


def primary_failure(right: Column, stop: Column, issues: Column, boxed: Column, answer: Column, valid: Column) -> Column:
    """The first class that applies."""
    broken = F.arrays_overlap(issues, F.array(*map(F.lit, TAG_ISSUES + ENVELOPE_ISSUES)))
    return (
        F.when(right, "Correct")
        .when(stop.isin(TRUNCATION), "Length limit / truncation")
        .when(stop == "missing_steer_or_think_close", "Malformed steer/think boundary")
        .when(F.array_contains(issues, "missing_boxed_answer") | ~boxed, "Missing boxed answer")
        .when(boxed & ~answer, "Wrong boxed answer")
        .when(broken | ~valid, "Tag structure violation")
        .otherwise("Other incorrect")
    )


def failure_signals(right: Column, stop: Column, issues: Column, boxed: Column, answer: Column) -> Column:
    """All signals that apply."""
    return F.array_compact(
        F.array(
            F.when(~right & boxed & ~answer, "Wrong boxed answer"),
            F.when(F.array_contains(issues, "missing_boxed_answer") | ~boxed, "Missing boxed answer"),
            F.when(stop == "missing_steer_or_think_close", "Malformed steer/think boundary"),
            F.when(stop.isin(TRUNCATION), "Length limit / truncation"),
            F.when(F.arrays_overlap(issues, F.array(*map(F.lit, ENVELOPE_ISSUES))), "Think envelope malformed"),
            F.when(F.arrays_overlap(issues, F.array(*map(F.lit, TAG_ISSUES))), "Steer/exec tag structure"),
        )
    )


def lenient_bool(x: Column) -> Column:
    """H42"""
    return F.coalesce(F.lower(strip(x)).isin("true", "1", "1.0", "yes", "y"), F.lit(False))


def literal_list(x: Column) -> Column:
    """['a', 'b'] as a list; any other text that is not blank as a list of itself."""
    inner = F.regexp_extract(strip(x), r"(?s)^\[(.*)\]$", 1)
    items = F.transform(F.regexp_extract_all(inner, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0)), lambda i: F.substr(i, F.lit(2), F.length(i) - 2))
    return F.when(strip(x).rlike(r"(?s)^\[.*\]$"), items).when(blank(x), F.array().cast("array<string>")).otherwise(F.array(strip(x)))


def readable_label(x: Column) -> Column:
    """A dataset key as a label."""
    return F.initcap(squeeze(F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"[_\-]+", " ")))


def snake(x: Column) -> Column:
    """Lower case, all but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def preview(x: Column, most: int) -> Column:
    """Squeezed, and cut with three dots."""
    y = squeeze(x)
    return F.when(F.length(y) > most, F.concat(F.left(y, F.lit(most - 3)), F.lit("..."))).otherwise(y)


def tail_words(x: Column, n: int) -> Column:
    """The last n words."""
    w = F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0))
    return F.array_join(F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w), " ")


def sections(blocks: Column) -> Column:
    """Each steer block opens a section that the exec blocks up to the next one belong to."""
    start = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("texts")))
    empty = F.slice(start, 1, 0)

    def fold(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        opened = F.concat(acc, F.array(F.struct(b["text"].alias("title"), F.array().cast("array<string>").alias("texts"))))
        unlabelled = F.array(F.struct(F.lit("Unlabeled execution").alias("title"), F.array(b["text"]).alias("texts")))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["title"].alias("title"), F.concat(last["texts"], F.array(b["text"])).alias("texts"))))
        return F.when(b["type"] == "steer", opened).when(F.size(acc) == 0, unlabelled).otherwise(grown)

    return F.transform(F.aggregate(blocks, empty, fold), lambda s: F.struct(s["title"].alias("title"), F.array_join(s["texts"], "\n\n").alias("text")))


def wrapper_variants(x: Column) -> Column:
    """The answer and what each peeling of a wrapper leaves."""
    return F.array_distinct(F.filter(peelings(x), lambda v: v != ""))


def stats_line(x: Column) -> Column:
    """Numbers of a periodic statistics line; null for any other line."""
    get = lambda p: F.regexp_extract(x, p, 1).try_cast("double")
    names = {"prompt_tps": r"Avg prompt throughput: ([\d.]+)", "decode_tps": r"Avg generation throughput: ([\d.]+)", "running": r"Running: (\d+)", "waiting": r"Waiting: (\d+)", "cache_pct": r"KV cache usage: ([\d.]+)%", "hit_pct": r"hit rate: ([\d.]+)%", "preemptions": r"Preemptions: (\d+)"}
    return F.when(x.rlike("Avg prompt throughput:"), F.struct(*[get(p).alias(n) for n, p in names.items()]))
