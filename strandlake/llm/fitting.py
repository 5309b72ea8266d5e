"""Learning from a bounded sample of labelled documents, in one task of an executor: the driver holds neither texts nor features."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import common


#: Bytes of text of each class that are learned from, at most, or one text.
SAMPLE_BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: str, sample: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, y, text, size): up to `sample` labelled texts of each class, in the order of a hash of their id, and no more of
    them than make up `most` bytes.

    size is the number of labelled rows of that class. held_out: SQL condition on doc_id for rows that must not be learned from.
    Rows without an id or a label of 0 or 1 are left out; an id that is labelled twice counts once, with its larger label. What
    is broadcast are at most 2 * sample ids.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(f"doc_id is not null and y in (0, 1) and not ({held_out})").groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    sizes = marked.groupBy("y").agg(F.count("*").alias("size"))
    ids = parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "y")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "y", "size").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    own = texts.withColumn("upto", before)
    return own.filter((F.col("upto") <= most) | (F.col("upto") == F.octet_length("text"))).select("doc_id", "y", "text", "size")


def trained(rows: DataFrame, train: Callable[[pa.Array, np.ndarray, np.ndarray], Any]) -> Any:
    """The model that train(texts, labels, weights) makes of labelled() rows; weights restore the sizes of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            model = train(pa.array([], pa.string()), np.zeros(0), np.zeros(0))
        else:
            t = pa.Table.from_batches(got).sort_by("doc_id")
            y, size = t.column("y").to_numpy().astype(float), t.column("size").to_numpy().astype(float)
            weight = size / np.where(y == 1, max(1.0, (y == 1).sum()), max(1.0, (y == 0).sum()))
            texts = t.column("text").combine_chunks()
            del got, t
            model = train(texts, y, weight / weight.mean())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        common.trim()

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else train(pa.array([], pa.string()), np.zeros(0), np.zeros(0))  # no rows, no task
