"""Numbers, JSON, arrays, times and vectors as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def probability(logprob: Column) -> Column:
    """Exp, and 0 at the sentinel of -1e9 or below."""
    return F.when(logprob <= -1e9, 0.0).otherwise(F.exp(logprob))


def top_logprobs(x: Column, shape: str) -> Column:
    """A map or an array of structs as an array of (token, logprob), in order of token."""
    pairs = F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("logprob"))) if shape == "map" else F.transform(x, lambda s: F.struct(s["token"].alias("token"), s["logprob"].alias("logprob")))
    return F.array_sort(pairs)


def entropy(probabilities: Column) -> Column:
    """Natural-log entropy of distinct tokens' probabilities: scaled if they pass 1, else with the rest as one more bucket."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    term = lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)

    def of(t: Column) -> Column:
        own = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + term(p / F.greatest(t, F.lit(1.0))))
        return own + term(F.greatest(F.lit(1.0) - t, F.lit(0.0)))

    return F.get(F.transform(F.array(total), of), F.lit(0))


def ranked_alternatives(pairs: Column) -> Column:
    """The best logprob of each token, the likeliest first, ties by token."""
    best = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["token"])), lambda t: F.struct((-F.array_max(F.transform(F.filter(pairs, lambda p: p["token"] == t), lambda p: p["logprob"]))).alias("k"), t.alias("token")))
    return F.transform(F.array_sort(best), lambda s: F.struct(s["token"].alias("token"), (-s["k"]).alias("logprob")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """An error for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(n > 0, n).otherwise(F.raise_error(F.lit("a vector is zero")).cast("double"))


def normalized(v: Column) -> Column:
    """I06"""
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))), F.lit(0))


def quantized(x: Column, digits: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(x, digits)


def metric_of_json(value: Column) -> tuple[Column, Column]:
    """The number and the text of a JSON value: numbers have both, booleans 1.0 or 0.0 and True or False, others text only."""
    kind = F.schema_of_variant(value)
    text = F.variant_get(value, "$", "string")
    number = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(text.try_cast("double"))
    return number, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def content_hash(*parts: Column) -> Column:
    """I12"""
    return F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256)


def short_id(x: Column) -> Column:
    """Twelve hex digits of SHA-1."""
    return F.substring(F.sha1(x.cast("binary")), 1, 12)


def ratio(after: Column, before: Column) -> Column:
    """Null for a zero."""
    return F.try_divide(after.cast("double"), before)


def iso_seconds(x: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 text; without an offset it is UTC."""
    return F.unix_micros(F.to_timestamp(F.when(x.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), x).otherwise(F.concat(x, F.lit("Z"))))) / 1e6


def step_of_path(path: Column) -> Column:
    """I16: the step that a path or label names; null without one."""
    return F.nullif(F.regexp_extract(path, r"(?:step_|checkpoint-)(\d+)", 1), F.lit("")).cast("long")


def supervision(assistant: Column, overlapped: Column) -> Column:
    """Assistant tokens that are not overlapped; the last position is always on."""
    both = F.zip_with(assistant, overlapped, lambda a, o: F.when((a == 1) & (o == 0), 1).otherwise(0))
    return F.transform(both, lambda x, i: F.when(i == F.size(assistant) - 1, 1).otherwise(x))


def hash_vector(text: Column, dimension: int = 16) -> Column:
    """A repeatable vector of a text: bytes of SHA-256 of 'counter:text', each as byte / 127.5 - 1, cut and brought to length 1."""
    digests = [F.sha2(F.concat(F.lit(f"{i}:"), text).cast("binary"), 256) for i in range(-(-dimension // 32))]
    hexes = F.concat(*digests)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return normalized(raw)
