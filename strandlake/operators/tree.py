"""Rollout trees: paths, depths, recursive values, variances at branch points, advantages.

A tree (one document's, one prompt's) is walked at once: its size is bounded by the rollout budget, one shuffle brings its rows
together, and depth costs no further job. All else is windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA, EPSILON = 0.5, 1e-6


def ordered_nodes(parent: dict) -> list:
    """Parents before children. A missing parent or a cycle raises ValueError."""
    depth: dict = {}
    for start in parent:
        chain, node = [], start
        while node not in depth:
            if node in chain:
                raise ValueError(f"cycle at node {node}")
            chain.append(node)
            up = parent[node]
            if up is None:
                depth[node] = 0
                break
            if up not in parent:
                raise ValueError(f"node {node} has the unknown parent {up}")
            node = up
        for n in reversed(chain):
            if n not in depth:
                depth[n] = depth[parent[n]] + 1
    return sorted(parent, key=lambda n: depth[n])


def walked(nodes: DataFrame, tree: str, value: str) -> DataFrame:
    """For each node its depth, path from the root, first branch, sum of values along the path, and recursive
    value (a leaf's own; an inner node's mean of its children). Of rows that repeat a node the last by value counts; rows without
    a node id are no nodes.

    Trees come sorted, one after another, so that one Arrow batch holds many of them.
    """
    kind = nodes.select(tree).schema[0].dataType
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField(n, k) for n, k in ((tree, kind), ("node_id", long), ("parent_node_id", long), ("depth", T.IntegerType()), ("path", T.ArrayType(long)), ("branch", long), ("path_sum", double), ("is_leaf", T.BooleanType()), ("node_value", double))])

    def rows_of(key: object, rows: list[tuple]) -> list[tuple]:
        parent = {n: p for n, p, _ in rows}
        own = {n: v or 0.0 for n, _, v in rows}
        path, total, children, worth = {}, {}, {}, {}
        order = ordered_nodes(parent)
        for n in order:
            up = parent[n]
            path[n] = [n] if up is None else [*path[up], n]
            total[n] = own[n] + (0.0 if up is None else total[up])
            if up is not None:
                children.setdefault(up, []).append(n)
        for n in reversed(order):
            worth[n] = sum(worth[c] for c in sorted(children[n])) / len(children[n]) if n in children else own[n]
        return [(key, n, parent[n], len(path[n]) - 1, path[n], path[n][1] if len(path[n]) > 1 else None, total[n], n not in children, worth[n]) for n in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], schema.names)
        key, held, out = None, [], []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and k != key:
                    out += rows_of(key, held)
                    held = []
                key = k
                held.append(tuple(row))
            if out:
                yield as_batch(out)
                out = []
        if held:
            yield as_batch(rows_of(key, held))

    picked = nodes.select(tree, F.col("node_id").cast("long").alias("node_id"), F.col("parent_node_id").cast("long").alias("parent_node_id"), F.col(value).cast("double").alias("value")).filter("node_id is not null")
    return picked.repartition(tree).sortWithinPartitions(tree, "node_id", "value").mapInArrow(run, schema)


def edge_paths(tree: DataFrame, key: str) -> DataFrame:
    """The edges from the root to each leaf, in order."""
    leaves = tree.filter("is_leaf").select(key, F.col("node_id").alias("leaf_id"), F.posexplode("path").alias("step", "node_id"))
    return leaves.filter("step > 0").select(key, "leaf_id", "step", "node_id")


def branch_variance(tree: DataFrame, key: str, value: str) -> DataFrame:
    """Of leaf values: variance, variance of branch means (plain and weighted by leaves), and mean of variances inside branches.

    Leaves on the root form a branch of their own.
    """
    own = tree.filter("is_leaf").groupBy(key, F.coalesce(F.col("branch").cast("string"), F.lit("no_branch")).alias("branch")).agg(F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy(key)
    centre = F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w)
    own = own.withColumn("centre", centre)
    between = own.groupBy(key).agg(
        F.coalesce(F.var_pop("m"), F.lit(0.0)).alias("bp1"),
        (F.sum(F.col("n") * (F.col("m") - F.col("centre")) ** 2) / F.sum("n")).alias("bp1_weighted"),
        F.avg("v").alias("bp2"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("bp2_weighted"),
    )
    return tree.filter("is_leaf").groupBy(key).agg(F.count("*").alias("leaf_count"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("variance")).join(between, key)


def frontier(nodes: DataFrame, key: str, terminal: Column) -> DataFrame:
    """Nodes that are neither terminal nor expanded; a tree whose nodes are all done or expanded gives its root."""
    parents = nodes.filter("parent_node_id is not null").select(key, F.col("parent_node_id").alias("node_id")).distinct()
    parents = parents.withColumn("node_id", F.col("node_id").cast(dict(nodes.dtypes)["node_id"]))
    open_ = nodes.filter(~terminal).join(parents, [key, "node_id"], "left_anti").select(key, "node_id")
    roots = nodes.filter("parent_node_id is null").select(key, "node_id").join(open_.select(key).distinct(), key, "left_anti")
    return open_.unionByName(roots)


def inter_advantage(df: DataFrame, prompt: str, reward: str, epsilon: float = EPSILON) -> DataFrame:
    """The reward against its prompt's mean and deviation; alone it is 0."""
    w = Window.partitionBy(prompt)
    a = (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon)
    return df.withColumn("inter", F.when(F.count("*").over(w) > 1, a).otherwise(0.0))


def edge_advantage(tree: DataFrame, key: str, epsilon: float = EPSILON) -> DataFrame:
    """E14, for each edge: the child's value less its siblings' mean, over the children's deviation; an only child has 0."""
    w = Window.partitionBy(key, "parent_node_id")
    n, total = F.count("*").over(w), F.sum("node_value").over(w)
    siblings = (total - F.col("node_value")) / F.greatest(n - 1, F.lit(1))
    a = (F.col("node_value") - siblings) / (F.stddev_pop("node_value").over(w) + epsilon)
    return tree.filter("parent_node_id is not null").withColumn("edge_advantage", F.when(n > 1, a).otherwise(0.0)).select(key, "node_id", "parent_node_id", "edge_advantage")


def intra_advantage(tree: DataFrame, key: str) -> DataFrame:
    """E14, for each leaf: the mean of the edges on its path; a leaf on the root has 0."""
    edges = edge_advantage(tree, key).select(key, "node_id", "edge_advantage")
    found = edge_paths(tree, key).join(edges, [key, "node_id"]).groupBy(key, "leaf_id").agg(F.avg("edge_advantage").alias("intra"))
    return tree.filter("is_leaf").select(key, F.col("node_id").alias("leaf_id"), F.col("node_value").alias("reward")).join(found, [key, "leaf_id"], "left").fillna(0.0, ["intra"])


def token_advantages(df: DataFrame, offsets: str, edges: str, inter: str, mask: str, alpha: float = ALPHA) -> DataFrame:
    """For each token alpha * (advantage of the edge whose stretch it lies in) + (1 - alpha) * inter, where the mask is 1.

    offsets: first token of each edge; an edge ends where the next one begins. A row without offsets has zeros everywhere.
    """
    o, e = F.col(offsets), F.col(edges)
    stretch = lambda i: F.size(F.filter(o, lambda x: x <= i))
    value = lambda m, i: F.when(stretch(i) > 0, F.lit(alpha) * F.get(e, stretch(i) - 1)).otherwise(0.0) + F.lit(1 - alpha) * F.col(inter)
    return df.withColumn("token_advantage", F.transform(F.col(mask), lambda m, i: F.when((F.size(o) == 0) | (m == 0), 0.0).otherwise(value(m, i))))


def segment_advantages(df: DataFrame, keys: list[str], offsets: str, tokens: str, path: str) -> DataFrame:
    """The token-weighted mean of each edge over all leaves that pass it, with its first and last token and its leaves."""
    size = F.size(tokens)
    parts = F.transform(F.col(offsets), lambda o, i: F.struct(F.get(F.col(path), i).alias("parent"), F.get(F.col(path), i + 1).alias("child"), o.alias("begin"), F.coalesce(F.get(F.col(offsets), i + 1), size).alias("end")))
    rows = df.select(*keys, tokens, F.explode(parts).alias("p")).select(*keys, "p.*", tokens)
    total = F.aggregate(F.slice(F.col(tokens), F.col("begin") + 1, F.greatest(F.col("end") - F.col("begin"), F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    out = rows.withColumn("total", total).groupBy(*keys, "parent", "child").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum(F.greatest(F.col("end") - F.col("begin"), F.lit(0))).alias("token_count"), F.sum("total").alias("total"), F.count("*").alias("leaf_count"))
    return out.filter("token_count > 0").withColumn("mean_advantage", F.col("total") / F.col("token_count")).drop("total")


def advantage_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """D30"""
    return df.agg(*[f.alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg(c)), ("mean_abs", F.avg(F.abs(c))))])


def branch_offsets(df: DataFrame, node_offset: Column, parent_prompt: Column, root_prompt: Column, length: Column) -> DataFrame:
    """An edge's first token: its node's offset or else what the parent's prompt has beyond the root's, inside the response."""
    return df.withColumn("offset", F.greatest(F.lit(0), F.least(F.coalesce(node_offset, parent_prompt - root_prompt), length)))


def earliest_best(df: DataFrame, keys: list[str], scored: Column, order: str) -> DataFrame:
    """The first scored row, or else the first row."""
    rank = F.struct(F.when(scored, 0).otherwise(1).alias("rank"), F.col(order).alias("at"))
    return df.groupBy(*keys).agg(F.min(rank).alias("best")).select(*keys, F.col("best.rank").alias("rank"), F.col("best.at").alias(order))


#: What a branch's index holds.
INDEX = "prompt_uid string, branch_tree_id string, leaf_id string, leaf_node_id string, path_node_ids array<string>, branch_token_offsets array<int>, parent_branch_id string, branch_depth int"


def branch_index(prompt: Column, tree: Column, path: Column, offsets: Column) -> Column:
    """The index of a leaf's branch: its path from the root, where its stretches begin, and names made up from these where none
    is given. There must be one offset for each step behind the root."""
    leaf, depth = F.element_at(path, -1), F.size(path) - 1
    checked = F.when(F.size(offsets) == depth, depth).otherwise(F.raise_error(F.lit("as many offsets as steps are needed")).cast("int"))
    return F.struct(
        prompt.alias("prompt_uid"), F.coalesce(tree, F.concat(F.lit("tree:"), prompt)).alias("branch_tree_id"), F.concat(F.lit("leaf:"), prompt).alias("leaf_id"), leaf.alias("leaf_node_id"), path.alias("path_node_ids"),
        offsets.alias("branch_token_offsets"), F.when(depth > 1, F.get(path, depth - 1)).alias("parent_branch_id"), checked.alias("branch_depth"),
    )


def index_json(index: Column) -> Column:
    """An index as JSON, nulls included."""
    return F.to_json(index, {"ignoreNullFields": "false"})


def index_of_json(text: Column) -> Column:
    """The index that index_json() wrote; malformed text is an error."""
    return F.from_json(text, INDEX, {"mode": "FAILFAST"})
