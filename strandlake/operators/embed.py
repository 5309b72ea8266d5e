"""Operators over vectors: diverse selection, noise assignment, clustering, cluster ids and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.numeric import dot
from strandlake.operators import density
from strandlake.sources.files import stored


def diverse(df: DataFrame, pool: str, key: str, vector: str, k: int) -> DataFrame:
    """from each pool k rows, the first by key, then ever the one whose largest similarity to the chosen is smallest
    (ties: the first by key). A pool is a bounded set of candidates and is one Arrow group."""
    kinds = dict(df.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        chosen, most = [0], v @ v[0]
        while len(chosen) < min(k, len(v)):
            rest = np.round(most, 12)
            rest[chosen] = np.inf
            nxt = int(np.argmin(rest))
            chosen.append(nxt)
            most = np.maximum(most, v @ v[nxt])
        return pd.DataFrame({pool: pdf[pool].iloc[0], key: pdf[key].to_numpy()[chosen], "pick": range(len(chosen))})

    return df.select(pool, key, vector).groupBy(pool).applyInPandas(pick, f"{pool} {kinds[pool]}, {key} {kinds[key]}, pick int")


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label, by position, so that no group of vectors is gathered."""
    means = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def assign_noise(df: DataFrame, label: str, vector: str, noise: int = -1, most: int = 4096) -> DataFrame:
    """Noise rows take the label of the nearest centroid (Euclidean; ties: the smaller label), with a flag.

    Centroids are broadcast in blocks of about `most`, by a hash of their label; a row keeps the nearest of all blocks, so that any
    number of clusters works.
    """
    spark = df.sparkSession
    all_ = stored(centroids(df.filter(F.col(label) != noise), label, vector))
    blocks = max(1, -(-all_.count() // most))
    kind = dict(df.dtypes)[label]
    distance = lambda v, c: F.aggregate(F.zip_with(v, c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    out = df.withColumn("__best", F.lit(None).cast(f"struct<d:double,label:{kind}>"))
    for k in range(blocks):
        cs = [(r[label], r["centroid"]) for r in all_.filter(F.pmod(F.xxhash64(label), F.lit(blocks)) == k).orderBy(label).collect()]
        one = spark.createDataFrame([(cs,)], f"__cs array<struct<label:{kind},c:array<double>>>")
        nearest = F.array_min(F.transform("__cs", lambda s: F.struct(F.round(distance(F.col(vector), s["c"]), 9).alias("d"), s["label"].alias("label"))))
        out = out.crossJoin(F.broadcast(one)).withColumn("__best", F.when(F.col(label) == noise, F.least("__best", nearest))).drop("__cs")
    return out.withColumn("noise_assigned", F.col(label) == noise).withColumn("assigned", F.when(F.col("noise_assigned"), F.col("__best.label")).otherwise(F.col(label))).drop("__best")


def near_centroid(df: DataFrame, label: str, key: str, vector: str, near: int) -> DataFrame:
    """the rows nearest to their label's centroid."""
    d = F.aggregate(F.zip_with(vector, "centroid", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    far = df.join(centroids(df, label, vector), label).withColumn("distance", F.round(d, 9))
    return far.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy("distance", key))).filter(F.col("place") <= near).select(label, key, "place")


def cluster_ids(df: DataFrame, per: list[str], name: str) -> DataFrame:
    """Ids from 0 by falling size, then name."""
    counted = df.groupBy(*per, name).agg(F.count("*").alias("n"))
    return counted.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("n"), name)) - 1)


def assignment_coverage(items: DataFrame, members: DataFrame, key: str, least: float) -> DataFrame:
    """The share of items that some cluster names; below `least` is flagged, unnamed items go to 'other'."""
    out = items.join(members, key, "left")
    return out.agg(F.count_distinct(key).alias("items"), F.count_distinct(F.when(F.col("cluster_name").isNotNull(), F.col(key))).alias("assigned")).withColumn("rate", F.try_divide(F.col("assigned"), F.col("items"))).withColumn("ok", F.col("rate") > least)


def selectors(df: DataFrame, pool: str, key: str, cluster: str, fan_out: int, seed: int) -> DataFrame:
    """picks of the random, cluster-across and within-cluster selectors of each pool, by hash order.

    across: one row of each cluster, the largest first, then second rows; within: the largest cluster (ties: the smaller name).
    """
    w = Window.partitionBy(pool)
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    sized = df.withColumn("__h", h).withColumn("__n", F.count("*").over(Window.partitionBy(pool, cluster)))
    sized = sized.withColumn("__in", F.row_number().over(Window.partitionBy(pool, cluster).orderBy("__h", key)))
    biggest = F.first(cluster).over(w.orderBy(F.desc("__n"), cluster).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = sized.withColumns(
        {
            "random": F.row_number().over(w.orderBy("__h", key)),
            "across": F.row_number().over(w.orderBy("__in", F.desc("__n"), cluster)),
            "within": F.row_number().over(w.orderBy((F.col(cluster) != biggest).cast("int"), "__h", key)),
        }
    )
    return ranked.select(pool, key, *[(F.col(m) <= fan_out).alias(m) for m in ("random", "across", "within")])


def density_clusters(df: DataFrame, key: str, vector: str, least: int, most: int | None = None) -> DataFrame:
    """Hierarchical density clustering (noise is -1) of one set of unique vectors, which one task holds; its time is quadratic
    in their number, its memory linear."""
    kind = dict(df.dtypes)[key]

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({key: pdf[key], "cluster": density.labels(np.stack(pdf[vector].to_numpy()), least, most)})

    return df.select(key, vector, F.lit(0).alias("__all")).groupBy("__all").applyInPandas(cluster, f"{key} {kind}, cluster int")


def text_id(*texts: str | Column) -> Column:
    """What stands for 'title :: text' where the whole text need not go along: its SHA-256."""
    return F.unhex(F.sha2(F.concat_ws(" :: ", *texts).cast("binary"), 256))


def clustered_texts(df: DataFrame, texts: list[str], vectors: Callable[[DataFrame], DataFrame], least: int, most: int | None = None) -> DataFrame:
    """Clusters of 'title :: text' (or of texts alone), each distinct one once, mapped back to all rows.

    vectors: adds a column `vector` to a table of distinct `__text` and their `__id` (text_id).
    Whole texts are only made distinct and put in order, in ranges of their beginnings, of which the driver sees samples; what one task
    clusters, and what rows are joined by, has none of them.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    unique = df.select(F.concat_ws(" :: ", *texts).alias("__text")).distinct()
    placed = unique.repartitionByRange(tasks, F.substring("__text", 1, 100)).sortWithinPartitions("__text").withColumn("__at", F.monotonically_increasing_id())
    kept = stored(vectors(placed.withColumn("__id", text_id("__text"))).select("__id", "__at", "vector"))
    found = kept.select("__id", "__at").join(density_clusters(kept, "__at", "vector", least, most), "__at").drop("__at")
    return df.withColumn("__id", text_id(*texts)).join(found, "__id", "left").drop("__id")


def unique_then(df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Computes a column for the distinct texts only and joins it to all rows."""
    return df.join(compute(df.select(text).distinct()), text, "left")


def projected(df: DataFrame, key: str, vector: str, axes: int = 2) -> DataFrame:
    """The coordinates of vectors on their principal axes, (key, c0, c1, ...): what a plot of them shows. An axis points to where its
    largest component is positive.

    Each task sums its vectors and their products; what reaches the driver is one number for each pair of components.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, None, None
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                n, one, two = n + len(v), v.sum(0) + (0 if one is None else one), v.T @ v + (0 if two is None else two)
        if n:
            d = len(one)
            i, j = np.divmod(np.arange((d + 1) * (d + 1)), d + 1)
            whole = np.block([[np.array([[float(n)]]), one[None]], [one[:, None], two]])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(whole.ravel())], ["i", "j", "x"])

    got = df.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if not len(got):
        return df.filter("false").select(key, *[F.lit(0.0).alias(f"c{k}") for k in range(axes)])
    d = int(got.i.max())
    whole = np.zeros((d + 1, d + 1))
    whole[got.i, got.j] = got.x
    mean = whole[0, 1:] / whole[0, 0]
    axis = np.linalg.eigh(whole[1:, 1:] / whole[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :axes].T
    axis *= np.sign(axis[np.arange(len(axis)), np.abs(axis).argmax(1)])[:, None]
    at = [dot(F.col(vector), F.lit(a.tolist())) - float(a @ mean) for a in axis]
    return df.select(key, *[x.alias(f"c{k}") for k, x in enumerate(at)])
