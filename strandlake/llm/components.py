"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common


#: So many edges at most are finished in one task of an executor.
FEW = 10_000


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(a, b) pairs of long ids, in any order and number -> (node, root): the smallest id that a node reaches.

    Nodes without an edge don't occur; loops and nulls are ignored. Each step is a grouped minimum, which is combined before
    it is shuffled, and a join by node, in which nodes of very many edges are broadcast; the edges of a round are written to the
    shared folder, and gathered in one task only when there are `few` of them.
    """
    both = edges.filter("a <> b")
    now = common.stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if state[0] <= few:
            return now.coalesce(1).mapInArrow(_finished, "node long, root long")
        # large star: what is larger than a node hangs on the smallest of its neighbours and itself
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = common.with_facts(sides, least, "a", 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        large = common.stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = common.with_facts(large, least, "a", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = common.stored(hung.filter("a <> b").distinct())
        then = _state(new)
        common.forget(now)
        common.forget(large)
        now, before, state = new, state, then
        if before == state:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges at once; the smaller node of two becomes the parent, so that a root is the smallest of its component."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = parent[i]
        return i

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    nodes = [i for i in list(parent) if root(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: unequal sets of edges differ in it."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
