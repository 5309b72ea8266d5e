"""Arrays in one pass: running sums, spans and masks, as Arrow UDFs over whole batches.

Built-in higher-order functions can say these only by copying what a fold has gathered, or by testing each pair: quadratic in an
array's length. Here each is a sort or a cumulative sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of different rows lie this far apart.
_FAR = 1 << 33
_INTS = T.ArrayType(T.IntegerType())
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The elements of all lists, which list each is of, and the lists' sizes; a null list has none."""
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes), sizes


def _lists(values: pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of so many values each, null where `like` is."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array(like.is_null().to_numpy(zero_copy_only=False)) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)


def _spans(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat, row, sizes = _rows(spans)
    return flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64), row, sizes


@F.arrow_udf(_INTS)
def _running(x: pa.Array) -> pa.Array:
    flat, row, sizes = _rows(x)
    total = np.cumsum(flat.to_numpy(zero_copy_only=False).astype(np.int64))
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return _lists(pa.array((total - before[row]).astype(np.int32)), sizes, x)


@F.arrow_udf(_SPANS)
def _coalesced(spans: pa.Array) -> pa.Array:
    start, end, row, _ = _spans(spans)
    order = np.lexsort((end, start, row))
    start, end, row = start[order], end[order], row[order]
    reached = np.maximum.accumulate(end + row * _FAR) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + row[1:] * _FAR > reached[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    merged = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reached[last] - row[last] * _FAR).astype(np.int32))], ["start", "end"])
    return _lists(merged, np.bincount(row[first], minlength=len(spans)), spans)


@F.arrow_udf(_INTS)
def _overlapping(tokens: pa.Array, spans: pa.Array) -> pa.Array:
    start, end, row, sizes = _spans(tokens)
    a, b, of, _ = _spans(spans)
    some = b > a
    begun = np.searchsorted(np.sort(a[some] + of[some] * _FAR), end + row * _FAR, "left")
    done = np.searchsorted(np.sort(b[some] + of[some] * _FAR), start + row * _FAR, "right")
    return _lists(pa.array((begun > done).astype(np.int32)), sizes, tokens)


@F.arrow_udf(_INTS)
def _inside(size: pa.Array, spans: pa.Array) -> pa.Array:
    sizes = np.array([n or 0 for n in size.to_pylist()], np.int64)
    a, b, of, _ = _spans(spans)
    at = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    low, high = np.clip(a, 0, sizes[of]), np.clip(b, 0, sizes[of])
    some = high > low
    np.add.at(change, (at[of] + low)[some], 1)
    np.add.at(change, (at[of] + high)[some], -1)
    inside = np.cumsum(change)[:-1] > 0
    keep = np.ones(len(inside), bool)
    keep[at + sizes] = False
    return _lists(pa.array(inside[keep].astype(np.int32)), sizes, size)


def running(x: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array of whole numbers."""
    return _running(x.cast("array<int>"))


def coalesced_spans(spans: Column) -> Column:
    """Half-open spans by their starts, those that touch or overlap as one."""
    return _coalesced(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))


def overlapping(tokens: Column, spans: Column) -> Column:
    """For each token span, 1 if it overlaps any of the spans; an empty span overlaps none."""
    plain = lambda x: F.transform(x, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return _overlapping(plain(tokens), plain(spans))


def masked(mask: Column, spans: Column, keep: bool) -> Column:
    """The mask inside (keep) or outside the spans; spans beyond it are cut."""
    inside = _inside(F.size(mask), F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    return F.zip_with(mask, inside, lambda m, i: F.when(i == int(keep), m).otherwise(0))


def word_ends(text: Column, word: str) -> Column:
    """The characters before each occurrence of a word, by splitting once."""
    pieces = F.transform(F.split(text, word, -1), lambda p: F.length(p) + len(word))
    return F.transform(F.slice(running(pieces), F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda n: n - len(word))
