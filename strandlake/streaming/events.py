"""Streams of events: fan-out to typed tables, live progress, follow-mode summaries, repeat detection with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions.answers import resembles

#: Which table an event type goes to.
TABLES = {"doc_started": "lifecycle", "doc_finished": "lifecycle", "node_created": "node_created", "leaf_scored": "leaf_score", "vllm_request": "vllm_request"}


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    """Parquet files as they arrive, `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fan_out(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch goes to its typed tables, in one folder for each batch, so that a batch that is run again
    replaces what it wrote before; the checkpoint's offsets are the high-water mark."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.write.mode("overwrite").parquet(f"{out}/event_log/batch={number}")
            for table in sorted(set(TABLES.values())):
                kinds = [k for k, v in TABLES.items() if v == table]
                held.filter(F.col("event_type").isin(kinds)).write.mode("overwrite").parquet(f"{out}/{table}/batch={number}")
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An append-only log; each micro-batch is a folder of its own, written once however often it is tried, and the
    producer's index orders it. The stream's thread writes while others go on, and its first error ends it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_progress(events: DataFrame) -> DataFrame:
    """The latest state of each document, as a running aggregate (update or complete mode)."""
    return events.groupBy("run_id", "doc_id").agg(F.max("event_index").alias("event_index"), F.max_by("event_type", "event_index").alias("event_type"), F.count("*").alias("events"))


def follow(events: DataFrame, name: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """A summary by event type that is recomputed on every trigger, kept in memory under a name."""
    summary = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_index").alias("last_event_index"))
    writer = summary.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def repeat_detector(chunks: DataFrame, threshold: float = 0.9, window: int = 3) -> DataFrame:
    """For each stream of text chunks (stream_id, event_index, chunk) the exec blocks so far and the run of similar last ones.

    Tags may be cut by chunks: what is not closed yet waits in the state, with the last `window` blocks and the run.
    """

    def step(key, batches, state):
        pending, recent, run, blocks = state.get if state.exists else ("", [], 0, 0)
        recent = list(recent)
        rows = pd.concat(list(batches)).sort_values("event_index")
        for chunk in rows.chunk:
            pending += chunk or ""
            while True:
                begin = pending.find("<exec>")
                end = pending.find("</exec>", begin)
                if begin < 0 or end < 0:
                    break
                block = " ".join(pending[begin + len("<exec>") : end].lower().split())
                pending = pending[end + len("</exec>") :]
                run = run + 1 if any(resembles(r, block, threshold) for r in recent) else 1
                recent, blocks = [*recent, block][-window:], blocks + 1
            begin = pending.find("<exec>")
            pending = pending[begin:] if begin >= 0 else pending[-len("<exec>") :]  # a tag may have begun
        state.update((pending, recent, run, blocks))
        yield pd.DataFrame({"stream_id": [key[0]], "blocks": [blocks], "run": [run]})

    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, blocks int, run int", "pending string, recent array<string>, run int, blocks int", "update", "NoTimeout")


def completed_rows(rows: DataFrame, generations: str, n: int) -> DataFrame:
    """Rows that are done: exactly n generations, none of them blank."""
    g = F.col(generations)
    return rows.filter((F.size(g) == n) & F.forall(g, lambda x: x.isNotNull() & x.rlike(r"\S")))
