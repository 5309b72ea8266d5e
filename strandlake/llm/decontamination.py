"""Benchmark decontamination: a broadcast set of hashed benchmark windows, scanned over the token windows of each document.

A window is N consecutive words of an item, or all words of a shorter item. Hashes only propose hits; each is verified against
the window's words. The set is broadcast while it has at most MAX_WINDOWS windows, those of several items counted for each; a larger
one is cut into slices of that many by a hash of window and item, whatever items it comes from, with one pass each over a stored
copy of the texts. The passes' hits are united, so nothing depends on the benchmark's size but the number of passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common
from strandlake.llm.words import U, HashSet, Words, letters, lower, window_hashes

N = 13
#: Windows of the benchmark that one broadcast set holds at most (about 200 bytes each).
MAX_WINDOWS = 500_000
#: A document is contaminated if one word in so many is hit.
SHARE = 20


@dataclass
class Windows:
    """The distinct windows of a benchmark by length: hash sets, and for each key its words and the items that hold it."""

    by_length: dict[int, tuple[HashSet, list[list[tuple[bytes, list]]]]]


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(size, key, words, item): the distinct windows of each item of (item, text), with their hashes. Items without words have none."""
    kind = benchmark.schema["item"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in common.slices(batch.column(1)):
                items = batch.column(0).slice(begin, end - begin)
                buf, at = common.buffers(batch.column(1).slice(begin, end - begin))
                words = Words(lower(buf), at, letters())
                h = words.hashes()
                for d, item in enumerate(items):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if not (size := min(n, b - a)):
                        continue
                    keys = window_hashes(h[a:b], size).view(np.int64)
                    for i in range(0, len(keys), 10_000):  # a long item's windows are many times its text
                        spelled = [words.word(j) for j in range(a + i, min(b, a + i + 10_000 + size - 1))]
                        part = keys[i : i + 10_000]
                        rows = [pa.array(np.full(len(part), size, np.int32)), pa.array(part), pa.array([b" ".join(spelled[j : j + size]) for j in range(len(part))]), pa.array([item.as_py()] * len(part), items.type)]
                        yield pa.RecordBatch.from_arrays(rows, ["size", "key", "words", "item"])

    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("item", kind)])
    return benchmark.select("item", "text").mapInArrow(run, schema).distinct()


def gathered(rows: pa.Table) -> dict[tuple[int, int, bytes], list]:
    """(length, hash, words) -> items."""
    out: dict[tuple[int, int, bytes], list] = {}
    for size, key, words, item in zip(*(rows.column(c).to_pylist() for c in ("size", "key", "words", "item"))):
        out.setdefault((size, key & (1 << 64) - 1, words), []).append(item)
    return out


def build(windows: dict[tuple[int, int, bytes], list]) -> Windows:
    by_length: dict[int, dict[int, list]] = {}
    for (size, key, spelled), of in windows.items():
        by_length.setdefault(size, {}).setdefault(key, []).append((spelled, of))
    out = {}
    for size, keys in by_length.items():
        s = HashSet(np.array(list(keys), U), 18)
        out[size] = (s, [keys[int(k)] for k in s.keys])
    return Windows(out)


def scan(texts: pa.Array, windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list], Words]:
    """For each text: number of words, hit spans as merged (first word, past the last), items with occurring windows."""
    buf, at = common.buffers(texts)
    words = Words(lower(buf), at, letters())
    h, first = words.hashes(), words.first
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set] = [set() for _ in range(len(texts))]
    for size, (keys, entries) in windows.by_length.items():
        found, key = keys.find(window_hashes(h, size))
        for i, k in zip(found.tolist(), key.tolist()):
            d = int(words.doc[i])
            if i + size > first[d + 1]:
                continue  # across two texts
            spelled = b" ".join(words.word(j) for j in range(i, i + size))
            for text, of in entries[k]:
                if text == spelled:
                    spans[d].append((i - int(first[d]), i - int(first[d]) + size))
                    items[d].update(of)
    return np.diff(first).tolist(), [merged(x) for x in spans], [sorted(x) for x in items], words


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


def hits(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, n: int = N, most: int = MAX_WINDOWS) -> DataFrame:
    """Adds n_words, hit_words (merged spans of word positions) and hit_items (sorted item ids) to every row.

    Null and empty texts have no words; benchmark rows that are null, empty or repeated add nothing. Ids of items are longs, where
    they are whole numbers (null counts as -1), or strings (null counts as the empty one). A column of df with one of the new
    names is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_words", "hit_words", "hit_items")]
    whole = isinstance(benchmark.schema["item_id"].dataType, T.IntegralType)
    kind = T.LongType() if whole else T.StringType()
    items = benchmark.select(F.coalesce(F.col("item_id").cast(kind), F.lit(-1 if whole else "")).alias("item"), F.col("text").cast("string").alias("text"))
    windows = common.stored(item_windows(items, n))
    parts = max(1, math.ceil(windows.count() / most))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", _SPANS), T.StructField("hit_items", T.ArrayType(kind))]

    def marked(rows: DataFrame, windows: DataFrame, text: str, keep: list[str]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(build(gathered(windows.toArrow())))

        def make():
            def fn(texts: pa.Array) -> list:
                n_words, spans, found, _ = scan(texts, shared.value)
                return [n_words, [[list(s) for s in x] for x in spans], found]

            return fn

        return common.map_text(rows, make, fields, text, keep)

    if parts == 1:
        return marked(df, windows, text, keep)
    rows = common.stored(df.select(*[common.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")))
    slice_of = F.pmod(F.xxhash64("size", "key", "words", "item"), F.lit(parts))
    found = None
    for k in range(parts):  # one set at a time in a worker's memory; only the first pass keeps documents without hits
        own = marked(rows.select("row", "text"), windows.filter(slice_of == k), "text", ["row"])
        own = common.stored(own if k == 0 else own.filter(F.size("hit_items") > 0))
        found = own if found is None else found.unionByName(own)
    own = Window.partitionBy("row").orderBy("a", "b")
    reached = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("row", F.explode("hit_words").alias("s")).select("row", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    spans = spans.withColumn("new", F.when(F.col("a") <= reached, 0).otherwise(1)).withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "span").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda s: F.array(s["a"], s["b"])).alias("hit_words"))
    rest = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    out = rows.drop("text").join(rest, "row").join(spans, "row", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.coalesce("hit_words", F.array().cast(_SPANS)).alias("hit_words"), "hit_items")


def n_hit() -> F.Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])


def contaminated(share: int = SHARE) -> F.Column:
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def _numbered(df: DataFrame) -> DataFrame:
    """df's columns as c0, c1, ..., so that none of its names meets one of hits()."""
    return df.select(*[common.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])


def without_documents(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df without its contaminated documents; all columns stay as they are."""
    marked = hits(_numbered(df), benchmark, f"c{df.columns.index(text)}")
    return marked.filter(~contaminated()).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def cut(text: str | None, spans: list) -> str | None:
    """text without the words of the spans and what stands between the words of one span."""
    if text is None or spans is None or not len(spans):
        return text
    data = text.encode()
    words = Words(lower(np.frombuffer(data, np.uint8)), np.array([0, len(data)]), letters())
    for a, b in reversed([tuple(s) for s in spans]):
        data = data[: words.start[a]] + data[words.end[b - 1] :]
    return data.decode()


def without_spans(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df with every hit span cut from its text; null texts stay null, and all other columns as they are."""
    cut_all = F.pandas_udf(lambda texts, spans: pd.Series([cut(t, s) for t, s in zip(texts, spans)], dtype=object), T.StringType())
    marked = hits(_numbered(df), benchmark, f"c{df.columns.index(text)}")
    return marked.select(*[(cut_all(F.col(f"c{i}"), F.col("hit_words")) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hits(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    listed = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
