"""What the corpus operators share: tables, shared storage and mapping over text columns."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python function sees at once; a longer text comes alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or '/tmp/checkpoints/strandlake').rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and no lost executor takes it along."""
    path = shared_dir(df.sparkSession)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # what a writer holds in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that is no longer needed."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles() if "/strandlake-" in x}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """name, or name with so many underscores that no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_facts(df: DataFrame, facts: DataFrame, key: str, rows: int) -> DataFrame:
    """df joined by key with facts, which has one row for each key, and in n that key's number of rows in df; rows: those of df.

    Keys with over a quarter of a task's fair share of rows, of which there are at most four for each task, are joined by
    broadcast, so that their rows never meet; all others by a shuffle.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    most = max(1000, rows // (4 * tasks))
    heavy, light = facts.filter(F.col("n") > most).drop("n"), facts.filter(F.col("n") <= most).drop("n")
    rest = df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rest.unionByName(df.join(F.broadcast(heavy), key))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n+1 places where they begin and end. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to `limit` bytes of text each, or one row."""
    if not len(texts):
        return
    _, at = buffers(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        yield begin, end
        begin = end


def trim() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and idle ones count in the executor's memory."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField], text: str = "text", keep: list[str] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Adds columns that a function computes from a text column.

    make() runs once in each task and returns the function; that takes a string array and returns one array or list for each
    of `fields`. If it has an attribute close, that is called at the task's end. Of df's columns those in `keep` stay (None: all); a computed column replaces one of its name. Rows are never
    gathered: batches pass one by one, in slices of `limit` bytes.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    sent = [col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    at = len(kept)  # of the text among what is sent; one that is kept is sent once
    if text in kept and isinstance(df.schema[text].dataType, T.StringType):
        at = kept.index(text)
    else:
        sent.append(col(text).cast("string").alias("text"))
    source = df.select(*sent)
    inner = [T.StructField(f"k{i}", source.schema[i].dataType) for i in range(len(kept))] + [T.StructField(f"v{i}", f.dataType) for i, f in enumerate(fields)]
    names = [f.name for f in inner]
    kinds = [f.dataType for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types, fn = [to_arrow_type(k) for k in kinds], make()
        try:
            for batch in batches:
                texts = batch.column(at)
                for begin, end in slices(texts, limit):
                    part = batch.slice(begin, end - begin)
                    got = fn(texts.slice(begin, end - begin))
                    yield pa.RecordBatch.from_arrays(part.columns[: len(kept)] + [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, types, strict=True)], names)
        finally:
            getattr(fn, "close", lambda: None)()
            trim()

    out = source.mapInArrow(run, T.StructType(inner))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, [*kept, *(f.name for f in fields)], strict=True)])
