"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are written once with a place (partition and number in it), which makes every later step repeatable. How many rows go
from each partition to each shard is drawn exactly: row after row of the matrix, from the multivariate hypergeometric law of
what the shards still lack. Rows are permuted inside their partition and cut by that row of the matrix, exchanged, and
permuted again inside their shard, whose slots are numbered through ranges of the random key, so that no task holds a shard.
Only the matrix is drawn on the driver: one row for each partition of the input, eight draws each; a hundred thousand partitions take
it some tens of seconds and a few MB.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common

SHARDS = 8
SEED = 20240917
#: Rows of a shard that one range of the random key holds, about.
RANGE_ROWS = 50_000
#: Rows of the matrix that are broadcast at most (SHARDS longs each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws from good + bad without replacement. Exact for any size: inversion over the law's bulk.

    numpy's own sampler stops at 10 ** 9; the weights here come from ratios of neighbouring probabilities around the mode, over
    14 standard deviations to each side, beyond which less than a double's resolution is left.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    sd = math.sqrt(max(1.0, draws * p * (1 - p) * (total - draws) / max(1, total - 1)))
    a, b = max(low, mode - int(14 * sd) - 20), min(high, mode + int(14 * sd) + 20)
    k = np.arange(a, b, dtype=float)
    log = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))])
    weights = np.exp(log - log.max()).cumsum()
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: sums are `rows` and `sizes`, and the law is that of a uniform shuffle."""
    assert sum(rows) == sum(sizes)
    rng, lack, out = np.random.default_rng(seed), list(sizes), []
    for n in rows:
        line, rest, left = [], sum(lack), n
        for s, size in enumerate(lack):
            got = hypergeometric(rng, size, rest - size, left)
            rest, left = rest - size, left - got
            lack[s] -= got
            line.append(got)
        out.append(line)
    return out


def random_key(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 to shards - 1; sizes at most one apart) and slot (its place in the shard, gapless from 0).

    Every row stays, whatever is null or repeated in it; an empty table gives an empty result. A column of df named shard or
    slot is replaced. The first total % shards shards have one row more.
    """
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(*[common.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("place"))
    placed = common.stored(placed).withColumn("part", F.shiftright("place", 33))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    spark, total = df.sparkSession, sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = matrix([n for _, n in counts], sizes, seed)
    ends = [(part, np.cumsum(line).tolist()) for (part, _), line in zip(counts, drawn, strict=True)]
    ends = spark.createDataFrame(ends, "part long, ends array<long>")
    ends = F.broadcast(ends) if len(drawn) <= BROADCAST_ROWS else ends
    local = F.row_number().over(Window.partitionBy("part").orderBy(random_key(seed + 1, F.col("place")), "place"))
    sent = placed.withColumn("local", local).join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("local"))))
    ranges = max(1, math.ceil(total / shards / RANGE_ROWS))
    second = random_key(seed + 2, F.col("place"))
    sent = sent.withColumn("second", second).withColumn("range", F.floor(F.shiftrightunsigned("second", 32) * F.lit(ranges) / F.lit(float(1 << 32))).cast("int"))
    sent = sent.drop("ends", "local", "part")
    sizes_of = sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = sizes_of.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "range", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "range").orderBy("second", "place"))
    out = sent.withColumn("number", number).join(before, ["shard", "range"]).withColumn("slot", F.col("before") + F.col("number") - 1)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows, one folder for each shard, with their slots to read them in order by."""
    shuffle(df, shards, seed).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = shuffle(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
