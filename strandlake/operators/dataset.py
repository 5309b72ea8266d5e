"""Dataset operators: filters, allocation, sampling, splits, merges and projections over training rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.functions.arrays import word_ends
from strandlake.sources.files import stored


def is_math_row(label: Column, prompt: Column, truths: Column, wanted: str) -> Column:
    """Labelled as wanted, with a prompt and an answer that are not blank."""
    return F.array_contains(label, F.lower(F.lit(wanted))) & ~X.blank(prompt) & (F.size(X.non_blank(truths)) > 0)


def in_token_range(df: DataFrame, count: Column, low: int, high: int) -> DataFrame:
    """Rows whose count lies in [low, high], with it."""
    return df.withColumn("token_count", count).filter(F.col("token_count").between(low, high))


def of_classes(df: DataFrame, cls: Column, classes: list[str], position: str) -> DataFrame:
    """Rows of some answer classes, numbered without gaps from 0 in order of position."""
    kept = df.withColumn("answer_class", cls).filter(F.col("answer_class").isin(classes))
    return numbered(kept, position)


def numbered(df: DataFrame, position: str, into: str = "index", ranges: int = 64) -> DataFrame:
    """Numbers rows from 0 in order of a numeric column without a global sort in one task.

    The column is cut at approximate quantiles that are fixed before, so a row's range never depends on how a job runs; ranges
    are counted, and rows numbered inside them. Rows without a position come first.
    """
    cuts = df.agg(F.percentile_approx(position, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(position))) if cuts else F.lit(0)
    spread = df.withColumn("__part", F.when(F.col(position).isNull(), -1).otherwise(part))
    counted = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counted.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(position))
    return spread.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before")


def ranked(df: DataFrame, order: list[Column], into: str, per: list[str] | None = None) -> DataFrame:
    """Numbers rows from 1 in an order that tells all rows apart, over all of them or inside each group, without one task for a group.

    Rows are cut into ranges of (group, order) and stored, so that ranges stay; rows are numbered inside them, after those of the
    same group in earlier ranges. What is counted over ranges has a row for each range and group in it.
    """
    per = per or []
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = stored(df.repartitionByRange(tasks, *per, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy(*per, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*per, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = ranges.withColumn("__own", F.row_number().over(Window.partitionBy("__range", *per).orderBy(*order)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*per, "__range"]]
    test = same[0]
    for x in same[1:]:
        test = test & x
    return own.alias("a").join(before.alias("b"), test).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("__before") + F.col("__own")).alias(into))


def buffer_shuffled(df: DataFrame, order: str, buffer: int, seed: int, into: str = "place") -> DataFrame:
    """Rows in an order in which each moves by less than `buffer` places, repeatable by the seed: what a shuffle buffer over a
    stream gives, but without a stream that one task reads."""
    numbered_ = ranked(df, [F.col(order)], "__at")
    moved = F.col("__at") + F.pmod(F.conv(F.substr(hash_order(seed, F.col(order)), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(buffer))
    return ranked(numbered_.withColumn("__to", moved), [F.col("__to"), F.col("__at")], into).drop("__to", "__at")


def skip_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that fails a row; null for a good row."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def allow_listed(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with a wanted key; a wanted key that df lacks is an error when the result is read."""
    have = df.join(wanted.select(key).distinct(), key, "left_semi")
    missing = wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")
    check = missing.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("missing ids: "), F.col("n").cast("string")))).otherwise(F.lit(0)).cast("int").alias("__missing"))
    return have.crossJoin(F.broadcast(check)).filter(F.col("__missing").isNull() | (F.col("__missing") == 0)).drop("__missing")


def sliced(df: DataFrame, order: list[str], offset: int, limit: int | None) -> DataFrame:
    """B06"""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def unprocessed(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose id was not seen; rows without an id are never skipped."""
    return df.join(seen.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def exported(df: DataFrame) -> DataFrame:
    """Prompts as messages, with reward model and extra info; all source columns stay."""
    return df.withColumns(
        {
            "source_prompt_text": F.col("prompt"),
            "data_source": F.col("dataset_source"),
            "reward_model": F.struct(F.array("answer").alias("ground_truth")),
            "extra_info": F.struct(F.col("index"), X.source_family(F.col("original_dataset"), F.col("dataset_source")).alias("source_family"), F.col("id").alias("source_row_id"), F.col("passrate")),
            "prompt": F.array(F.struct(F.lit("user").alias("role"), X.without_role(F.col("prompt")).alias("content"))),
        }
    )


def supervised(df: DataFrame, mask: str) -> DataFrame:
    """Rows in whose mask some position behind the first is on."""
    return df.filter(F.array_position(F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), 1) > 0)


def hash_order(seed: int, *keys: Column) -> Column:
    """A repeatable random order: SHA-256 of the seed and the keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"), 256)


def train_eval(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Split is eval for round-half-even(n * ratio) rows, of 1 to n - 1, first in hash order; fewer than 2 rows are an error."""
    n = df.count()
    if n < 2:
        raise ValueError("a split needs two rows")
    size = max(1, min(n - 1, round(n * ratio)))
    chosen = df.select(key, hash_order(seed, F.col(key)).alias("__h")).orderBy("__h", key).limit(size).select(key, F.lit("eval").alias("split"))
    return df.join(chosen, key, "left").fillna("train", ["split"])


def water_level(capacities: dict[int, int], target: int) -> tuple[int, int]:
    """Of so many containers of each capacity: the highest level to which the target fills all as far as they go, and what is left
    over, which is less than the containers that go higher."""
    total = lambda level: sum(min(c, level) * k for c, k in capacities.items())
    level, high = 0, max(capacities, default=0)
    if total(high) < target:
        raise ValueError(f"{target} rows are wanted, {total(high)} are there")
    while level < high:
        middle = (level + high + 1) // 2
        level, high = (middle, high) if total(middle) <= target else (level, middle - 1)
    return level, target - total(level)


def allocate(capacity: dict[str, int], target: int) -> dict[str, int]:
    """equal shares of the target as far as capacities go; what is left over goes to sources in sorted order."""
    level, rest = water_level(Counter(capacity.values()), target)
    higher = sorted(s for s, c in capacity.items() if c > level)[:rest]
    return {s: min(c, level) + (s in set(higher)) for s, c in capacity.items()}


def allocated(counts: DataFrame, name: str, capacity: str, target: int, into: str) -> DataFrame:
    """allocate() for a table of any number of names. Only the distinct capacities reach the driver: as they sum up to the rows
    at most, there are fewer than the root of twice the rows."""
    counts = stored(counts)
    level, rest = water_level({r[capacity]: r["k"] for r in counts.groupBy(capacity).agg(F.count("*").alias("k")).collect()}, target)
    more = counts.filter(F.col(capacity) > level).orderBy(name).limit(rest).select(F.col(name).alias("__name"), F.lit(1).alias("__more"))
    got = F.least(F.col(capacity), F.lit(level)) + F.coalesce("__more", F.lit(0))
    return counts.join(more, F.col(name).eqNullSafe(F.col("__name")), "left").select(*counts.columns, got.cast("long").alias(into))


def chosen(df: DataFrame, name: str, key: str, shares: DataFrame, most: int, seed: int) -> DataFrame:
    """The first rows of each name in hash order, as many as its share (`__share` in shares, never over `most`): each task keeps its first
    rows of a name before the shuffle."""
    w = Window.partitionBy(name).orderBy(hash_order(seed, F.col(key)), key)
    own = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most)
    return own.join(shares.select(F.col(name).alias("__name"), "__share"), F.col(name).eqNullSafe(F.col("__name"))).filter("__rank <= __share").select(*df.columns)


def balanced(df: DataFrame, source: str, key: str, target: int, seed: int) -> DataFrame:
    """`target` rows, spread over sources as evenly as they allow, in hash order inside each."""
    shares = stored(allocated(df.groupBy(source).agg(F.count("*").alias("__n")), source, "__n", target, "__share"))
    most = shares.agg(F.max("__share").alias("m")).first()["m"] or 0
    return chosen(df, source, key, shares, most, seed)


def fraction_per_bucket(df: DataFrame, bucket: str, key: str, fraction: float, seed: int) -> DataFrame:
    """round-half-even(n * fraction) rows of each bucket."""
    own = ranked(df.withColumn("__hash", hash_order(seed, F.col(key))), [F.col("__hash"), F.col(key)], "__rank", [bucket])
    sizes = df.groupBy(F.col(bucket).alias("__bucket")).agg(F.count("*").alias("__n"))
    return own.join(sizes, F.col(bucket).eqNullSafe(F.col("__bucket"))).filter(F.col("__rank") <= F.bround(F.col("__n") * fraction)).select(*df.columns)


def evenly_spaced(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group at even distances, first and last included; one pick is the first row."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / max(1, k - 1)).cast("int"))
    own = ranked(df, [F.col(c) for c in order], "__rank", [group]).withColumn("__at", (F.col("__rank") - 1).cast("int"))
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    return own.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).filter((F.col("__n") <= k) | F.array_contains(picks, F.col("__at"))).select(*df.columns)


def sample_per_group(df: DataFrame, group: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of each group, or all."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= size).drop("__rank")


def proportional(df: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """about size * share rows of each label, one at least; shares are trimmed and filled in turn to give `size`."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    base = counts.withColumn("__base", F.least("__n", F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("__n") / F.lit(max(1, total))).cast("long"))))
    lacking = min(size, total) - (base.agg(F.sum("__base").alias("n")).first()["n"] or 0)
    # in turn is as water fills: what a label may still get, or lose
    able = base.withColumn("__able", F.col("__n") - F.col("__base") if lacking > 0 else F.col("__base") - 1)
    most = able.agg(F.coalesce(F.sum("__able"), F.lit(0)).alias("n")).first()["n"]
    shares = allocated(able, label, "__able", min(abs(lacking), most), "__change")
    shares = stored(shares.withColumn("__share", F.col("__base") + (1 if lacking > 0 else -1) * F.col("__change")))
    return chosen(df, label, key, shares, shares.agg(F.max("__share").alias("m")).first()["m"] or 0, seed)


def shortlist_size(n: Column, k: int) -> Column:
    """F09"""
    return F.least(n, F.greatest(F.lit(k), F.ceil(F.log2(n) + 1)))


def merged_first_wins(tables: list[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """the first table's rows first, then the next one's by order; a key counts once, and `limit` rows stay."""
    tagged = None
    for i, t in enumerate(tables):
        part = t.withColumn("priority", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    w = Window.partitionBy(key).orderBy("priority", order)
    return tagged.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank").orderBy("priority", order).limit(limit)


def doc_seed(base: int, doc: Column) -> Column:
    """F16: (base * 1000003) xor (doc * 2654435761), 31 bits of it; doc * 2654435761 is taken modulo 2 ** 31 first, so nothing overflows."""
    low = F.pmod(doc, F.lit(1 << 31)) * F.lit(2654435761 % (1 << 31))
    return F.lit((base * 1000003) & 0x7FFFFFFF).bitwiseXOR(low.bitwiseAND(F.lit(0x7FFFFFFF)))


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """G03"""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Distinct texts with their counts, numbered from 1 by count, then text."""
    return ranked(df.groupBy(text).agg(F.count("*").alias("n")), [F.desc("n"), F.col(text)], "item_id")


def equal_texts(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Cleaned texts that are not empty, with the ids that share them, by first id."""
    clean = X.without_steer_suffix(F.col(text))
    return df.withColumn("clean", clean).filter("clean <> ''").groupBy(group, "clean").agg(F.min(key).alias("first_id"), F.sort_array(F.collect_list(key)).alias("ids"))


def overlaid(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of base, replaced where new has their key (its last row); keys that base lacks add nothing."""
    cols = [c for c in base.columns if c != key]
    last = new.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__new"))
    out = base.join(last, key, "left")
    return out.select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """One scan counts the values of several columns: (name, value, n)."""
    sets = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*")
    return sets.groupBy("name", "value").agg(F.count("*").alias("n"))


def windows_of_text(df: DataFrame, text: str, word: str, low: int, high: int) -> DataFrame:
    """places of a word whose text before it has from low to high characters."""
    return df.select("*", F.explode(F.filter(word_ends(F.col(text), word), lambda p: p.between(low, high))).alias("place"))
