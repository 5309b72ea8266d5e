"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified Hamming distances, connected groups.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two of them that differ in up to DISTANCE bits agree in at least
BLOCKS - DISTANCE blocks, so they meet under one of the keys made of a choice of that many blocks. Equal fingerprints are
merged first. The rows of a key come sorted to one task, which verifies distances with numpy and passes on a spanning forest of
the links: at most one edge less than the key has members, whatever the number of its links. A key with more than CELL members
is dealt over cells, one for each pair of its parts, so that every pair of members still meets in some task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common
from strandlake.llm.components import components

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
SEED = 42
#: Members of a key that one task compares with one another.
CELL = 4096
#: Shingles whose bits are summed at once.
PART = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits that are 1 in over half the hashes of all shingles; no words: 0."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only the six ASCII white-space bytes divide
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, PART):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + PART)], last[i : i + PART])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds fingerprint (the 64 bits as a signed long) to every row; a null text counts as empty."""

    def make():
        def fn(texts: pa.Array) -> list:
            known: dict[str, int] = {}
            for t in texts.to_pylist():
                if t not in known:
                    known[t] = fingerprint(t or "")
            return [pa.array(np.array([known[t] for t in texts.to_pylist()], np.uint64).view(np.int64))]

        return fn

    return common.map_text(df, make, [T.StructField("fingerprint", T.LongType())], text, keep)


def block_edges(blocks: int) -> list[int]:
    return [round(i * 64 / blocks) for i in range(blocks + 1)]


def keys(fp: F.Column, blocks: int, distance: int) -> F.Column:
    """An array of (choice, bits) as one long for each choice of blocks - distance blocks."""
    at = block_edges(blocks)
    out = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        bits = F.lit(0).cast("long")
        for b in chosen:
            width = at[b + 1] - at[b]
            bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned(fp, at[b]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(F.shiftleft(bits, 8).bitwiseOR(F.lit(i)) if 64 * (blocks - distance) < 54 * blocks else F.xxhash64(bits, F.lit(i)))
    return F.array(*out)


def forest(fp: np.ndarray, distance: int, size: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (i, j) positions."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            if (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))

    for a in range(0, len(fp), size):
        for b in range(0, a + 1, size):
            close = np.bitwise_count(fp[a : a + size, None] ^ fp[None, b : b + size]) <= distance
            i, j = np.nonzero(np.tril(close, -1) if a == b else close)  # each unordered pair once, the larger position first
            i, j = i + a, j + b
            if len(i) > 4 * size:  # a dense part: after one link of each row, those that join nothing new are passed over at once
                _, first = np.unique(i, return_index=True)
                join(i[first], j[first])
                label = np.array([root(x) for x in range(min(len(fp), a + size))])
                use = label[i] != label[j]
                i, j = i[use], j[use]
                _, first = np.unique(np.minimum(label[i], label[j]) * len(fp) + np.maximum(label[i], label[j]), return_index=True)
                i, j = i[first], j[first]
            join(i, j)
    return out


def links(fps: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, each within the distance, that connect all that such links connect.

    fps: one long column of distinct values.
    """
    fp = fps.select(F.col(fps.columns[0]).alias("fp"))
    keyed = fp.select("fp", F.explode(keys(F.col("fp"), blocks, distance)).alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > cell).select("key", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("parts"))
    dealt = keyed.join(many, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cells = dealt.select("fp", "key", F.explode(meets).alias("cell")).repartition(n, "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            cut = np.flatnonzero((now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            rest = [x[last:] for x in now]
            yield from pairs(now[0][:last], cut)
        yield from pairs(rest[0], np.zeros(0, np.int64))

    def pairs(fp: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.concatenate([[0], cut[cut < len(fp)]])
        end = np.concatenate([begin[1:], [len(fp)]])
        a, b = [], []
        use = end - begin == 2  # most: all at once
        x, y = fp[begin[use]], fp[begin[use] + 1]
        ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= distance) & (x != y)
        a.append(x[ok]), b.append(y[ok])
        for i, j in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist()):
            part = np.unique(fp[i:j].view(np.uint64))
            if len(got := forest(part, distance)):
                at = np.array(got)
                a.append(part[at[:, 0]].view(np.int64)), b.append(part[at[:, 1]].view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.select("fp", "key", F.col("cell").cast("long").alias("cell")).mapInArrow(run, "a long, b long").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Adds fingerprint (16 hex digits), component_id (the smallest id of the documents that links reach) and component_key.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows share a component. A component
    without any id that is not null has component_id null; component_key is never null and differs between components. A
    column of df with one of these names is replaced. An empty table gives an empty result.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("fingerprint", "component_id", "component_key")]
    own = df.select(*[common.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.col(id_col).alias("id"), common.col(text).alias("text"))
    marked = common.stored(fingerprints(own, keep=[f"k{i}" for i in range(len(keep))] + ["id"]))
    reps = common.stored(marked.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    sizes = reps.agg(F.count("*").alias("fingerprints"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    of = components(links(reps.select("fingerprint"), blocks, distance))
    rooted = common.stored(reps.join(of.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = common.with_facts(rooted.select("root", "fingerprint", F.col("n").alias("rows")), least, "root", sizes["fingerprints"])
    found = common.stored(found.select("fingerprint", "component_id", F.col("root").alias("component_key"), F.col("rows").alias("n")))
    for table in (reps, of, rooted):
        common.forget(table)
    out = common.with_facts(marked, found, "fingerprint", sizes["rows"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "component_key")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id; of several with that id one, by a hash of the text and
    then by place.

    A row's own text decides on its group, so that rows which repeat an id with another text are in another group. A row without an
    id stays only in a group in which no row has one. All columns stay as they are.
    """
    rows = common.stored(df.select(*[common.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.monotonically_increasing_id().alias("row")))
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    found = groups(rows.select("row", F.col(place[id_col]).alias("id"), F.col(place[text]).alias("text"), F.xxhash64(place[text]).alias("hash")), "id", "text", ["row", "id", "hash"])
    best = found.groupBy("component_key").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "hash", "row")).alias("best"))
    return rows.join(best.select("best.row"), "row").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("component_key")
