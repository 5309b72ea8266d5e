"""Summaries of runs: lengths, percentiles, correlations, densities, rankings, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.operators.dataset import ranked


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def length_summary(df: DataFrame, per: list[str], x: str) -> DataFrame:
    """Zeros for a group without values."""
    return df.groupBy(*per).agg(F.count(x).alias("n"), or_zero(F.avg(x)).alias("mean"), or_zero(F.median(x)).alias("median"), or_zero(F.stddev_pop(x)).alias("std"))


def percentile_summary(df: DataFrame, per: list[str], x: str) -> DataFrame:
    """Exact percentiles, with linear interpolation."""
    p = F.percentile(F.col(x).cast("double"), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]))
    out = df.groupBy(*per).agg(F.sum(x).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), p.alias("p"))
    return out.select(*per, "total", "min", "max", "mean", "std", *[F.col("p")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))])


def failure_summary(leaves: DataFrame, per: list[str], classes: list[str]) -> DataFrame:
    """Counts, mean lengths of right and wrong leaves (null for none), and leaves of each class. Needs right, length and class."""
    one = [F.count_if(F.col("class") == c).alias(column_name(c)) for c in classes]
    return leaves.groupBy(*per).agg(F.count("*").alias("leaf_count"), F.count_if("right").alias("right_count"), F.avg(F.when(F.col("right"), F.col("length"))).alias("right_length"), F.avg(F.when(~F.col("right"), F.col("length"))).alias("wrong_length"), *one)


def column_name(label: str) -> str:
    return "_".join(label.lower().replace("/", " ").split())


def text_density(df: DataFrame, per: list[str], text: str, word: str) -> DataFrame:
    """Characters, a word's occurrences, blocks and their characters, and occurrences a million characters."""
    bodies = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<exec>(.*?)</exec>"), F.lit(1))
    own = df.select(*per, F.length(text).cast("long").alias("c"), X.word_count(F.col(text), word).cast("long").alias("w"), F.size(bodies).cast("long").alias("b"), F.aggregate(bodies, F.lit(0).cast("long"), lambda a, x: a + F.length(X.strip(x))).alias("bc"))
    out = own.groupBy(*per).agg(F.count("*").alias("leaf_count"), F.sum("c").alias("total_chars"), F.sum("w").alias("word_count"), F.sum("b").alias("exec_block_count"), F.sum("bc").alias("exec_block_chars"))
    return out.withColumn("per_million_chars", or_zero(F.try_divide(F.col("word_count") * 1e6, F.col("total_chars"))))


def mean_and_error(df: DataFrame, per: list[str], x: str, split: Column) -> DataFrame:
    """Mean, standard error (0 for one value), and means by a condition."""
    return df.groupBy(*per).agg(F.avg(x).alias("mean"), or_zero(F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))).alias("stderr"), F.avg(F.when(split, F.col(x))).alias("mean_if"), F.avg(F.when(~split, F.col(x))).alias("mean_if_not"))


def correlation(df: DataFrame, per: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r, null for fewer than two rows or no variance, and the least-squares line."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))  # under ANSI rules corr() and regr_slope() fail where nothing varies
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(a))
    r = F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)))
    return df.groupBy(*per).agg(r.alias("r"), slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"))


def moving_average(df: DataFrame, per: list[str], order: str, x: str, window: int) -> DataFrame:
    """Centred, cut at the ends; a window of 1 or less changes nothing."""
    r = max(0, window // 2) if window > 1 else 0
    return df.withColumn("smooth", F.avg(x).over(Window.partitionBy(*per).orderBy(order).rowsBetween(-r, r)))


def ecdf(df: DataFrame, per: list[str], x: str, key: str) -> DataFrame:
    """I / n for the i-th smallest value; ties keep their rows. No task holds a group."""
    sizes = df.groupBy(*[F.col(c).alias(f"__{c}") for c in per]).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranked(df, [F.col(x), F.col(key)], "__rank", per).join(sizes, same).select(*df.columns, (F.col("__rank") / F.col("__n")).alias("ecdf"))


def histogram(df: DataFrame, per: str, x: str, bins: int) -> DataFrame:
    """Shares of bins of [0, 1], the last one closed, for each source and for all together (source null)."""
    binned = df.filter(F.col(x).between(0, 1)).withColumn("bin", F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int"))
    out = binned.groupBy(per, "bin").agg(F.count("*").alias("n"))
    both = out.unionByName(out.groupBy("bin").agg(F.sum("n").alias("n")).withColumn(per, F.lit(None).cast("string")))
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(per)))


def checkpoint_ranking(df: DataFrame) -> DataFrame:
    """By mean of the AIME scores, MATH-500 and step, all falling; a missing step ranks as 10 ** 18, an incomplete row not at all."""
    whole = df.filter("aime24 is not null and aime25 is not null and math500 is not null").withColumn("aime_mean", (F.col("aime24") + F.col("aime25")) / 2)
    return ranked(whole, [F.desc("aime_mean"), F.desc("math500"), F.desc(F.coalesce("checkpoint_step", F.lit(10**18))), F.col("checkpoint_id")], "rank")


def completeness(df: DataFrame, tasks: list[str]) -> DataFrame:
    """C20: which required results a checkpoint lacks."""
    missing = F.array_compact(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in tasks]))
    return df.withColumn("missing", F.array_join(missing, ",")).withColumn("complete", F.col("missing") == "")


def remaining_estimate(df: DataFrame, per: list[str], order: str, x: str) -> DataFrame:
    """The running maximum less the current value, at least 0."""
    w = Window.partitionBy(*per).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("done", F.greatest(F.max(x).over(w) - F.col(x), F.lit(0)))


def finite_summary(df: DataFrame, per: list[str], x: str) -> DataFrame:
    """Of finite values only."""
    ok = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.filter(ok).groupBy(*per).agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"))


def diversity(df: DataFrame, prompt: str, answer: str, reward: str) -> DataFrame:
    """Given and distinct answers, pass rates by prompt, and prompts that are all wrong."""
    own = df.groupBy(prompt).agg(F.count(answer).alias("given"), F.count_distinct(answer).alias("distinct_"), F.avg(reward).alias("rate"), F.bool_and(F.col(reward) == 0).alias("zero"))
    return own.agg(F.sum("given").alias("given"), F.sum("distinct_").alias("distinct_answers"), F.try_divide(F.sum("distinct_"), F.sum("given")).alias("ratio"), F.avg("rate").alias("rate_mean"), F.max("rate").alias("rate_max"), F.min("rate").alias("rate_min"), F.count_if("zero").alias("zero_prompts"), (F.count_if("zero") / F.count("*")).alias("zero_ratio"))


def block_structure(df: DataFrame, per: list[str], text: str) -> DataFrame:
    """Blocks, their mean for a row, and words a block."""
    s = X.block_stats(F.col(text))
    own = df.select(*per, s.alias("s")).select(*per, "s.*")
    out = own.groupBy(*per).agg(*[F.sum(c).alias(c) for c in ("steer_blocks", "steer_words", "exec_blocks", "exec_words")], F.avg("exec_blocks").alias("exec_blocks_mean"))
    return out.withColumn("words_per_exec", or_zero(F.try_divide(F.col("exec_words").cast("double"), F.col("exec_blocks"))))


def repetition(df: DataFrame, kind: str, forced: str, count: str) -> DataFrame:
    """Forced closes and mean counts by kind of block, in one row."""
    kinds = ["exec", "steer"]
    return df.agg(F.count("*").alias("n"), F.count_if(forced).alias("forced"), (F.count_if(forced) / F.count("*")).alias("forced_ratio"), *[F.count_if(F.col(forced) & (F.col(kind) == k)).alias(f"{k}_forced") for k in kinds], *[F.avg(F.when(F.col(kind) == k, F.col(count))).alias(f"{k}_mean") for k in kinds])


def rollout_summary(df: DataFrame, prompt: str, cluster: str, depth: str, selector: str) -> DataFrame:
    """Depths, share of clustered rows, distinct clusters a prompt (0 for none), and share of one selector."""
    own = df.groupBy(prompt).agg(F.count_distinct(cluster).alias("clusters"), F.sum(depth).alias("d"), F.max(depth).alias("most"), F.count("*").alias("n"), F.count(cluster).alias("with_cluster"), F.count_if(F.col(selector) == "random").alias("random"))
    return own.agg((F.sum("d") / F.sum("n")).alias("depth_mean"), F.max("most").alias("depth_max"), (F.sum("with_cluster") / F.sum("n")).alias("clustered_ratio"), F.avg("clusters").alias("clusters_per_prompt"), (F.sum("random") / F.sum("n")).alias("random_ratio"))


def group_sizes(df: DataFrame, order: str, uid: str, size: int) -> DataFrame:
    """Runs of consecutive equal uids that have another size than expected, by where they begin.

    A row's place among all less its place among those of its uid is one number in a run, and differs between a uid's runs.
    """
    both = ranked(ranked(df.select(order, uid), [F.col(order)], "__all"), [F.col(order)], "__own", [uid])
    return both.groupBy(uid, F.col("__all") - F.col("__own")).agg(F.min(order).alias("begin"), F.count("*").alias("n")).filter(F.col("n") != size).select("begin", uid, "n")


def avg_at_k(df: DataFrame, per: list[str], right: str) -> DataFrame:
    """D33"""
    return df.groupBy(*per).agg(F.avg(F.col(right).cast("double")).alias("avg_at_k"), F.count("*").alias("k"))


def metric_means(df: DataFrame, doc: str, name: str, value: str) -> DataFrame:
    """For each document the mean of numbers, else its first text; then the mean over documents of the union of keys."""
    number = F.col(value).try_cast("double")
    own = df.groupBy(doc, name).agg(F.avg(number).alias("mean"), F.min(value).alias("first_text"))
    return own.groupBy(name).agg(F.avg("mean").alias("mean"), F.min(F.when(F.col("mean").isNull(), F.col("first_text"))).alias("text"), F.count("*").alias("docs"))


def majority_name(df: DataFrame, cluster: str, name: str) -> DataFrame:
    """The most frequent name, the first in order of several; 'Cluster <id>' where none is given."""
    good = ~X.blank(F.col(name)) & (F.lower(F.col(name)) != "nan")
    counted = df.withColumn("__name", F.when(good, F.col(name))).groupBy(cluster, "__name").agg(F.count("*").alias("n"))
    ranked = F.when(F.col("__name").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("__name").alias("v")))
    best = counted.groupBy(cluster).agg(F.min(ranked)["v"].alias("majority"))
    return best.withColumn("majority", F.coalesce("majority", F.concat(F.lit("Cluster "), F.col(cluster).cast("string"))))


def source_mix(df: DataFrame, cluster: str, source: str) -> DataFrame:
    """Counts of sources for each cluster, as a map."""
    return df.groupBy(cluster, source).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(source, "n")))).alias("mix"))


def text_frequencies(df: DataFrame, text: str, attempt: str, cluster: str) -> DataFrame:
    """Occurrences, distinct attempts, and clusters by falling count, for each text."""
    own = df.groupBy(text, cluster).agg(F.count("*").alias("n"))
    mix = own.groupBy(text).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(cluster).alias("c")))), lambda s: F.concat(s["c"].cast("string"), F.lit("x"), (-s["k"]).cast("string"))), ",").alias("clusters"))
    return df.groupBy(text).agg(F.count("*").alias("occurrences"), F.count_distinct(attempt).alias("attempts")).join(mix, text)


def validation(df: DataFrame, key: str, text: str, x: str) -> DataFrame:
    """One row of facts about a finished set."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(X.word_count(F.col(text), "the")).alias("keywords"), F.count_if(F.col(text).rlike("  ")).alias("double_spaces"))


def partial_run(df: DataFrame, score: str, expected: int) -> DataFrame:
    """D42"""
    return df.agg(F.avg(score).alias("mean"), F.count(score).alias("completed"), (F.count(score) == expected).alias("complete"))


def null_aware_order(df: DataFrame, ratio: str, instances: str, key: str) -> DataFrame:
    """places in three orders: lowest ratio and highest ratio (null last), most instances; ties by key."""
    c = F.col
    orders = {"lowest": [c(ratio).asc_nulls_last(), c(key)], "highest": [c(ratio).desc_nulls_last(), c(key)], "most": [c(instances).desc(), c(key)]}
    for name, order in orders.items():
        df = ranked(df, order, name)
    return df


def least_squares(df: DataFrame, per: list[str], x: str, y: str) -> DataFrame:
    """The line through (x, y) by least squares; null where x does not vary."""
    return correlation(df, per, x, y).select(*per, "slope", "intercept")


def series_summary(df: DataFrame, per: list[str], x: str) -> DataFrame:
    """Of what can be read as numbers; the rest counts as null."""
    n = F.col(x).cast("string").try_cast("double")
    n = F.when(~F.isnan(n), n)
    p = F.percentile(n, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    out = df.groupBy(*per).agg(F.count(n).alias("count"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), p.alias("p"), F.max(n).alias("max"))
    return out.select(*per, "count", "mean", "std", "min", *[F.col("p")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "max")


def leaf_variance(df: DataFrame, per: list[str], *columns: str) -> DataFrame:
    """Population variances; 0 for one value or none."""
    return df.groupBy(*per).agg(*[or_zero(F.var_pop(c)).alias(f"{c}_variance") for c in columns])


def union_means(df: DataFrame, metrics: str, order: str) -> DataFrame:
    """Over the keys that any row's map has: the mean of numbers, and for a key without any the first text that is given."""
    each = df.select(order, F.explode(metrics).alias("key", "value"))
    n = F.col("value").try_cast("double")
    out = each.groupBy("key").agg(F.avg(n).alias("mean"), F.count("value").alias("n"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col(order))).alias("first"))
    return out.select("key", "mean", F.when(F.col("mean").isNull(), F.col("first")).alias("text"), "n")


def run_outputs(log: DataFrame, per: str, value: str) -> DataFrame:
    """Of each document the last finish, by attempt and index; then count, mean and median by group."""
    last = log.filter("event_type = 'doc_finished'").groupBy("doc_id").agg(F.max_by(F.struct(per, value), F.struct("doc_attempt", "event_index")).alias("v")).select("v.*")
    return last.groupBy(per).agg(F.count("*").alias("docs"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def curation_summary(df: DataFrame, n: str, limit: int) -> DataFrame:
    """Rows, rows changed by a limit, rows far over it, and the largest before and after."""
    c = F.col(n)
    return df.agg(F.count("*").alias("n"), F.count_if(c > limit).alias("changed"), F.max(c).alias("before_max"), F.max(F.least(c, F.lit(limit))).alias("after_max"), F.count_if(c > 2 * limit).alias("far_over"))
