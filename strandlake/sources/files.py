"""JSON-lines, Parquet and CSV sources and sinks, caches and manifests."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or '/tmp/checkpoints/strandlake').rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what is drawn or placed once stays so, and lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; with a schema typed columns and `_extra` (VARIANT) with the whole object, without one only `_extra`.

    Malformed lines give null columns and stay.
    """
    rows = read_lines(spark, path).select("value", F.try_parse_json("value").alias("_extra"))
    if schema is None:
        return rows.select("_extra")
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "_extra").select("r.*", "_extra")


@F.udtf(returnType=T.StructType([T.StructField("position", T.IntegerType()), T.StructField("object", T.StringType()), T.StructField("error", T.StringType())]))
class DecodeObjects:
    """The objects of one line that may hold several, with the offset of an error."""

    def eval(self, line: str) -> Iterator[tuple]:
        decoder, at, n = json.JSONDecoder(), 0, 0
        while line is not None and at < len(line):
            if line[at].isspace():
                at += 1
                continue
            try:
                value, end = decoder.raw_decode(line, at)
            except ValueError:
                yield n, None, f"no JSON at offset {at}"
                return
            if not isinstance(value, dict):
                yield n, None, f"no object at offset {at}"
                return
            yield n, line[at:end], None
            at, n = end, n + 1


def decode_lines(lines: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Every object of every line, in order; strict: an error is raised when the row is read, else it stands in `error`."""
    lines.sparkSession.udtf.register("strandlake_decode_objects", DecodeObjects)
    out = lines.sparkSession.sql(f"select {{lines}}.*, d.* from {{lines}}, lateral strandlake_decode_objects({{lines}}.`{column}`) d", lines=lines)
    if strict:
        out = out.withColumn("object", F.when(F.col("error").isNotNull(), F.raise_error("error")).otherwise(F.col("object")))
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """Appends; null fields are kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 for a missing file."""
    return read_lines(spark, path).count() if exists(spark, path) else 0


def read_columns(spark: SparkSession, path: str, columns: list[str], not_null: str) -> DataFrame:
    """Only these columns are read, and rows whose `not_null` is null are left out."""
    return spark.read.parquet(path).select(*columns).filter(F.col(not_null).isNotNull())


def write_both(df: DataFrame, path: str) -> None:
    """Parquet, and CSV with a header."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def sampled_shards(spark: SparkSession, path: str, k: int, seed: int) -> DataFrame:
    """The rows of k of a table's shards, chosen by a hash of the shard's name and the seed. A shard is a folder below the
    table (shard=3), or a file where there are none."""
    rows = spark.read.parquet(path)
    shards: dict[str, list[str]] = {}
    for f in rows.inputFiles():
        folder, _, name = f.rpartition("/")
        inner = folder.rpartition("/")[2]
        shards.setdefault(inner if "=" in inner else name, []).append(f)
    chosen = sorted(shards, key=lambda s: hashlib.sha256(f"{seed}|{s}".encode()).hexdigest())[:k]
    files = sorted(f for s in chosen for f in shards[s])
    return spark.read.option("basePath", path).schema(rows.schema).parquet(*files) if files else rows


def steps_of_runs(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet files below folders named *step_<n>, with the step that their path names."""
    return spark.read.option("recursiveFileLookup", "true").parquet(root).withColumn("step", F.regexp_extract(F.col("_metadata.file_path"), r"step_(\d+)", 1).cast("int"))


def config_hash(config: dict) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Manifest:
    """Which stages of a pipeline are done. A stage's hash covers its own settings and those before it, so that a change
    of an earlier stage makes the later ones run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.done: dict[str, str] = {r["stage"]: r["hash"] for r in spark.read.json(path).collect()} if exists(spark, path) else {}

    def finished(self, stage: str, chain: list[dict], output: str) -> bool:
        return self.done.get(stage) == config_hash({"chain": chain}) and exists(self.spark, f"{output}/_SUCCESS")

    def finish(self, stage: str, chain: list[dict]) -> None:
        self.done[stage] = config_hash({"chain": chain})
        rows = [(k, v) for k, v in sorted(self.done.items())]
        self.spark.createDataFrame(rows, "stage string, hash string").coalesce(1).write.mode("overwrite").json(self.path)


def cached(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their cached values, and misses that are still to be computed."""
    keyed = wanted.withColumn("cache_key", F.sha2(F.col(key).cast("binary"), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def kept_tensors(names: DataFrame, name: str, keep: str) -> DataFrame:
    """The keys of a checkpoint that a pattern keeps."""
    return names.filter(F.col(name).rlike(keep))


def tensor_entries(content: bytes) -> tuple[dict[str, dict], memoryview]:
    """A tensor file's header (name -> dtype, shape, data_offsets) and its data. The file: the header's size (8 bytes, little end
    first), the header as JSON, the data."""
    size = struct.unpack_from("<Q", content)[0]
    return json.loads(content[8 : 8 + size]), memoryview(content)[8 + size :]


def tensor_file(entries: dict[str, dict], data: dict[str, bytes | memoryview], notes: dict | None = None) -> bytes:
    """A tensor file of entries (dtype, shape) with their bytes, in the order given, the header padded to 8 bytes."""
    header, at = {"__metadata__": notes} if notes else {}, 0
    for name, e in entries.items():
        header[name] = {"dtype": e["dtype"], "shape": e["shape"], "data_offsets": [at, at + len(data[name])]}
        at += len(data[name])
    text = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([struct.pack("<Q", len(text)), text, *(data[n] for n in entries)])


def filtered_tensors(content: bytes, keep: str) -> tuple[bytes, int]:
    """A tensor file with only the tensors whose names a pattern keeps, bytes and notes unchanged; and how many went."""
    header, data = tensor_entries(content)
    notes = header.pop("__metadata__", None)
    kept = {n: e for n, e in sorted(header.items(), key=lambda x: x[1]["data_offsets"]) if re.search(keep, n)}
    return tensor_file(kept, {n: data[slice(*e["data_offsets"])] for n, e in kept.items()}, notes), len(header) - len(kept)


def rewritten_tensors(images: DataFrame, keep: str) -> DataFrame:
    """(path, content, dropped) of tensor files in a column `content`, as the binaryFile source gives them; one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content, dropped = filtered_tensors(batch.column(1)[i].as_py(), keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([content], pa.binary()), pa.array([dropped], pa.int32())], ["path", "content", "dropped"])

    return images.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, content binary, dropped int")


def tensor_rows(images: DataFrame) -> DataFrame:
    """(path, name, dtype, shape, data): the tensors of tensor files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                header, data = tensor_entries(content)
                for n, e in header.items():
                    if n != "__metadata__":
                        columns = [pa.array([path]), pa.array([n]), pa.array([e["dtype"]]), pa.array([e["shape"]], pa.list_(pa.int64())), pa.array([bytes(data[slice(*e["data_offsets"])])], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "name", "dtype", "shape", "data"])

    return images.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, name string, dtype string, shape array<long>, data binary")


def event_rows(images: DataFrame, table: str = "event_log", order: str = "event_index") -> DataFrame:
    """The rows of an event store's table, as JSON, from database files in a column `content` (as the binaryFile source gives
    them, from any store that Spark reads): (path, event_index, row_json), in order inside each file. One file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with contextlib.closing(sqlite3.connect(":memory:")) as c:
                    c.deserialize(content)
                    c.row_factory = sqlite3.Row
                    found = c.execute(f'select * from "{table}" order by "{order}"')
                    while rows := found.fetchmany(5000):
                        at = [r[order] for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array([json.dumps(dict(r), ensure_ascii=False) for r in rows])], ["path", "event_index", "row_json"])

    return images.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, event_index long, row_json string")


def read_event_store(spark: SparkSession, path: str, table: str = "event_log") -> DataFrame:
    """event_rows() of database files."""
    return event_rows(spark.read.format("binaryFile").load(path), table)


def event_store(rows: DataFrame, per: str, table: str = "event_log") -> DataFrame:
    """One database file (path, content) for each value of `per`, with its rows, keyed by event_index; a producer's bounded set each."""
    names = [c for c in rows.columns if c != per]

    def build(group: pa.Table) -> pa.Table:
        with contextlib.closing(sqlite3.connect(":memory:")) as c:
            c.execute(f'create table "{table}" ({", ".join(chr(34) + n + chr(34) for n in names)}, primary key (event_index))')
            c.executemany(f'insert into "{table}" values ({", ".join("?" * len(names))})', zip(*(group.column(n).to_pylist() for n in names)))
            c.commit()
            return pa.table({"path": pa.array([f"{group.column(per)[0].as_py()}.sqlite"]), "content": pa.array([c.serialize()], pa.binary())})

    return rows.groupBy(per).applyInArrow(build, "path string, content binary")


def dotenv(lines: DataFrame, line: str, position: str) -> DataFrame:
    """(key, value) of lines such as KEY="value"; comments, blank lines and lines without = are passed over, the last of a key counts."""
    text = F.trim(line)
    own = lines.filter((text != "") & ~text.startswith("#") & text.contains("="))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"+|"+$', ""), "^'+|'+$", "")
    key = F.trim(F.substring_index(text, "=", 1))
    return own.select(key.alias("key"), bare(F.substr(text, F.instr(text, "=") + 1)).alias("value"), position).groupBy("key").agg(F.max_by("value", position).alias("value"))


def settings(text: str) -> dict:
    """Nested settings of a YAML subset: `key: value` by indentation, lists of scalars by dashes, numbers, booleans, null, quoted text and comments."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    waiting: tuple[dict, str, int] | None = None  # a key without a value yet
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if waiting and (indent > waiting[2] or indent == waiting[2] and body.startswith("-")):
            child: dict | list = [] if body.startswith("-") else {}
            waiting[0][waiting[1]] = child
            stack.append((indent, child))
        waiting = None
        while indent < stack[-1][0] or indent == stack[-1][0] and isinstance(stack[-1][1], list) and not body.startswith("-"):
            stack.pop()
        top = stack[-1][1]
        if body.startswith("-"):
            if not isinstance(top, list):
                raise ValueError(f"a list entry where none is due: {raw!r}")
            top.append(scalar(body[1:].strip()))
            continue
        key, colon, value = body.partition(":")
        if not colon or isinstance(top, list):
            raise ValueError(f"no setting: {raw!r}")
        top[key.strip()] = scalar(value.strip()) if value.strip() else None
        if not value.strip():
            waiting = top, key.strip(), indent
    return root


def scalar(text: str) -> object:
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~", ""):
        return None
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text


def write_manifest(spark: SparkSession, path: str, facts: DataFrame) -> None:
    """One row of facts about a run, as one JSON file."""
    facts.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_id(prefix: str, at: Column) -> Column:
    """prefix_YYYYmmdd_HHMMSS of a time in UTC; current_timestamp() for now."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(at, "yyyyMMdd_HHmmss"))
