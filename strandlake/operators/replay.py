"""Operators that need rows in order: replay of events, monotone alignment, delta streams, splices, plans, joins with anomalies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replayed(log: DataFrame, key: str, order: str) -> DataFrame:
    """The state that an attempt's events lead to, folded in order. An attempt is one bounded Arrow group.

    A retry starts over: events before the last start don't count.
    """
    kind = dict(log.dtypes)[key]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = {"nodes": 0, "leaves": 0, "requests": 0, "finished": False, "restarts": 0}
        for event in pdf.sort_values(order).event_type:
            if event == "doc_started":
                state = {"nodes": 0, "leaves": 0, "requests": 0, "finished": False, "restarts": state["restarts"] + 1}
            elif event == "doc_finished":
                state["finished"] = True
            else:
                name = {"node_created": "nodes", "leaf_scored": "leaves", "vllm_request": "requests"}.get(event)
                if name:
                    state[name] += 1
        return pd.DataFrame([{key: pdf[key].iloc[0], **state}])

    return log.select(key, order, "event_type").groupBy(key).applyInPandas(fold, f"{key} {kind}, nodes int, leaves int, requests int, finished boolean, restarts int")


def aligned(steps: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Each step with the first equal pair after the one that the step before it took; null for none.

    steps: (key, step, text); pairs: (key, place, text).
    """
    kind = dict(steps.dtypes)[key]

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({key: [], "step": [], "place": []})
        texts = list(right.sort_values("place")[["place", "text"]].itertuples(index=False, name=None))
        at, out = 0, []
        for step, text in left.sort_values("step")[["step", "text"]].itertuples(index=False, name=None):
            found = next((i for i in range(at, len(texts)) if texts[i][1] == text), None)
            out.append((left[key].iloc[0], step, None if found is None else texts[found][0]))
            at = at if found is None else found + 1
        return pd.DataFrame(out, columns=[key, "step", "place"])

    return steps.groupBy(key).cogroup(pairs.groupBy(key)).applyInPandas(walk, f"{key} {kind}, step int, place int")


def stream_parts(df: DataFrame, key: str, order: str, delta: str, used: str) -> DataFrame:
    """What each row adds to its stream: the output consumed since the row before, and its delta; and where that begins in the
    stream. A row's whole input is all up to the end of its part, so that the stream is told once, not once for each row."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.concat(F.coalesce(F.lag(used).over(w), F.array().cast(dict(df.dtypes)[used])), F.col(delta))
    parts = df.withColumn("part", part)
    return parts.withColumn("begin", F.sum(F.size("part")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.size("part"))


def rebuilt_stream(parts: DataFrame, key: str, order: str, wanted: DataFrame) -> DataFrame:
    """The whole inputs of the rows that are asked for. wanted: (key, order)."""
    rows = parts.join(wanted.select(key, F.col(order).alias("__upto")), key).filter(F.col(order) <= F.col("__upto"))
    own = rows.groupBy(key, F.col("__upto").alias(order)).agg(F.sort_array(F.collect_list(F.struct("begin", "part"))).alias("p"))
    return own.select(key, order, F.flatten(F.transform("p", lambda x: x["part"])).alias("input"))


def paired(before: DataFrame, after: DataFrame, key: str, order: str) -> DataFrame:
    """Each row after with the last row before of its id; a missing one is an error when it is read."""
    last = before.groupBy(key).agg(F.max_by(F.struct(*[c for c in before.columns if c != key]), order).alias("before"))
    out = after.join(last, key, "left")
    return out.withColumn("before", F.when(F.col("before").isNull(), F.raise_error(F.lit("a row has no row before"))).otherwise(F.col("before")))


def with_anomalies(new: DataFrame, old: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides, and those with a missing, ambiguous or invalid side, by kind."""
    counted = old.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    first = counted.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in old.columns if c != key]))).filter("__r = 1").drop("__r")
    both = new.join(first, key, "left").withColumn("anomaly", F.when(F.col("__n").isNull(), "missing_original").when(F.col("__n") > 1, "ambiguous_original").when(~valid, "invalid")).drop("__n")
    return both.filter("anomaly is null").drop("anomaly"), both.filter("anomaly is not null").select(key, "anomaly")


def with_think(sections: DataFrame, thinks: DataFrame, key: str) -> DataFrame:
    """C14: sections with the think rows of their key; a section without one stays, with nulls."""
    return sections.join(thinks, key, "left")


def hydrated(responses: DataFrame, choices: DataFrame, tokens: DataFrame) -> DataFrame:
    """Responses with their choices, and those with their tokens, as nested arrays in order."""
    own = tokens.groupBy("response_event_index", "choice_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("token_index", "token_text"))), lambda s: s["token_text"]).alias("tokens"))
    nested = choices.join(own, ["response_event_index", "choice_index"], "left").groupBy("response_event_index").agg(F.sort_array(F.collect_list(F.struct("choice_index", "text", "tokens"))).alias("choices"))
    return responses.join(nested, responses["event_index"] == nested["response_event_index"], "left").drop("response_event_index")


def variants(df: DataFrame, point: str, variant: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Both variants of each point in one row; a missing one is an error when it is read."""
    out = df.groupBy(point).pivot(variant, list(names)).agg(F.first(value))
    need = lambda n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"variant {n} is missing"))).otherwise(F.col(n))
    return out.select(point, *[need(n).alias(n) for n in names])


def splice_points(df: DataFrame, key: str, blocks: str, k: int, seed: int) -> DataFrame:
    """One boundary inside each of k stretches of equal length, by hash; the bucket says whether it lies early, mid or late; with an id of its own."""
    n = F.size(blocks)
    hash_of = lambda i: F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    place = lambda i: F.floor(n * i / k) + 1
    pick = lambda i: (place(i) + F.pmod(hash_of(i), F.greatest(F.floor(n * (i + 1) / k) - place(i), F.lit(1)))).cast("int")
    points = F.filter(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), pick)), lambda p: (p > 0) & (p < n))
    out = df.select("*", F.explode(points).alias("point"))
    share = F.col("point") / F.size(blocks)
    return out.withColumn("bucket", F.when(share <= 0.25, "early").when(share >= 0.75, "late").otherwise("mid")).withColumn("splice_id", F.concat(F.col(key).cast("string"), F.lit("-"), F.substring(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.col("point").cast("string")).cast("binary")), 1, 12)))


def spliced(blocks: Column, point: Column, new: Column, keep_rest: bool = True) -> Column:
    """The blocks up to a point, the new ones, and those after it."""
    head = F.concat(F.slice(blocks, F.lit(1), point), new)
    return F.concat(head, F.slice(blocks, point + 1, F.greatest(F.size(blocks) - point, F.lit(0)))) if keep_rest else head


def preferred_progress(df: DataFrame, doc: str, order: list[Column]) -> DataFrame:
    """E23"""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).filter("__r = 1").drop("__r")


def named_clusters(df: DataFrame, cluster: str, text: str, words: int = 3) -> DataFrame:
    """Without a model that names clusters: its words of the largest tf-idf, ties by word."""
    token = df.select(cluster, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    tf = token.groupBy(cluster, "w").agg(F.count("*").alias("tf"))
    clusters = df.select(cluster).distinct().count()
    idf = tf.groupBy("w").agg((F.log(F.lit(1.0 + clusters)) - F.log1p(F.count("*"))).alias("idf"))
    top = tf.join(idf, "w").withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "w"))).filter(F.col("__r") <= words)
    return top.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", "w"))), lambda s: s["w"]), " ").alias("name"))


def transformed(df: DataFrame, column: str, call, into: str) -> DataFrame:
    """An injected callable on every row of a text column, in Arrow batches; a row that fails keeps its text, with the error."""

    @F.pandas_udf("value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((call(t), None))
            except Exception as e:  # the caller's code may raise anything, and the row says so
                out.append((t, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return df.withColumn("__out", run(column)).withColumns({into: F.col("__out.value"), f"{into}_error": F.col("__out.error")}).drop("__out")


def sanitized_picks(df: DataFrame, pool: str, key: str, text: str, fan_out: int) -> DataFrame:
    """`fan_out` picks of each pool: distinct texts first, then repeats, and all once more where a pool is exhausted."""
    w = Window.partitionBy(pool)
    dup = F.row_number().over(Window.partitionBy(pool, text).orderBy(key))
    ranked = df.withColumn("__dup", dup).withColumn("__place", F.row_number().over(w.orderBy("__dup", key)) - 1).withColumn("__n", F.count("*").over(w))
    slots = F.filter(F.sequence(F.lit(0), F.lit(fan_out - 1)), lambda s: s % F.col("__n") == F.col("__place"))
    return ranked.select(pool, key, F.explode(slots).alias("slot")).select(pool, "slot", key)


def top_and_bottom(df: DataFrame, cluster: str, key: str, k: int, examples: int) -> DataFrame:
    """examples of the k largest and k smallest clusters; one that is both counts as large."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    large = sizes.orderBy(F.desc("n"), cluster).limit(k).withColumn("side", F.lit("top"))
    small = sizes.orderBy("n", cluster).limit(k).join(large.select(cluster), cluster, "left_anti").withColumn("side", F.lit("bottom"))
    own = df.withColumn("__r", F.row_number().over(Window.partitionBy(cluster).orderBy(key))).filter(F.col("__r") <= examples)
    return own.join(F.broadcast(large.unionByName(small)), cluster).select(cluster, "n", "side", key)


def previous_chain(df: DataFrame, per: list[str], order: str, text: str, window: int) -> DataFrame:
    """The texts of up to `window` rows before, joined by >>."""
    w = Window.partitionBy(*per).orderBy(order).rowsBetween(-window, -1)
    return df.withColumn("chain", F.array_join(F.collect_list(text).over(w), " >> "))


def one_metric(metrics: Column, prefix: str) -> Column:
    """The value of the one key that begins so; none or several are an error."""
    found = F.map_values(F.map_filter(metrics, lambda k, v: k.startswith(prefix)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit("not exactly one metric")).cast("double"))
