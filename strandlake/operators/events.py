"""Event-store operators: attempts, leaves, requests and responses, progress. All take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPT = ["doc_id", "doc_attempt", "task_name", "model_id", "selector_mode"]
#: Metric names of leaves, and texts that count as true.
METRICS = ["raw_answer_acc", "answer_reward", "format_valid", "boxed_present", "structure_issues"]
TRUE_TEXTS = ["true", "1", "1.0", "yes", "y"]
#: Events that a node's time line shows.
VISIBLE = ["node_created", "leaf_scored", "vllm_request"]
#: Stop reasons by exact name (first definition) and by family (second).
NATURAL, AT_LIMIT, REPEATING = ["think_end"], ["length", "max_gen_toks_reached", "post_think_toks_reached", "max_context_length_reached"], ["repeated_exec_block_loop", "repeated_steer_block_loop"]


def truthy(text: Column) -> Column:
    """Lenient boolean: null is false."""
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_TEXTS), F.lit(False))


def mean_or_zero(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def attempt_keys(log: DataFrame) -> DataFrame:
    """Rows and last index of each attempt."""
    return log.groupBy(*ATTEMPT).agg(F.count("*").alias("event_count"), F.max("event_index").alias("last_event_index"))


def attempt_lifecycle(log: DataFrame) -> DataFrame:
    """Starts, finishes, last index and the time at it, without a self join."""
    kind = F.col("event_type")
    return log.groupBy(*ATTEMPT).agg(
        F.count("*").alias("event_count"),
        F.count_if(kind.isin("doc_started", "doc_resumed")).alias("started_count"),
        F.count_if(kind == "doc_finished").alias("finished_count"),
        F.max("event_index").alias("last_event_index"),
        F.max_by("timestamp_utc", "event_index").alias("last_timestamp"),
    )


def pivot_metrics(metrics: DataFrame, names: list[str] = METRICS) -> DataFrame:
    """One row for each leaf, one text column for each metric. One pass; columns that nobody reads are pruned."""
    return metrics.groupBy("leaf_event_index").agg(*[F.max(F.when(F.col("metric_name") == n, F.col("metric_text"))).alias(n) for n in names])


def with_answer(leaves: DataFrame, metrics: DataFrame) -> DataFrame:
    """Leaves with right_answer: whether their metric raw_answer_acc is true, null without one. Booleans aggregate without a sort."""
    own = metrics.filter("metric_name = 'raw_answer_acc' and metric_text is not null").groupBy(F.col("leaf_event_index").alias("event_index")).agg(F.max(truthy(F.col("metric_text"))).alias("right_answer"))
    return leaves.join(own, "event_index", "left")


def leaf_rows(leaves: DataFrame, metrics: DataFrame) -> DataFrame:
    """Leaves with their metrics; one pivot and one join stand for a scalar lookup each."""
    return leaves.join(pivot_metrics(metrics).withColumnRenamed("leaf_event_index", "event_index"), "event_index", "left")


def leaf_summary(leaves: DataFrame, metrics: DataFrame) -> DataFrame:
    """Correct, incorrect, answers, stop buckets, mean length and distinct previews of each attempt."""
    right = F.col("right_answer")
    stop = F.col("stop_reason")
    return with_answer(leaves, metrics).groupBy(*ATTEMPT).agg(
        F.count("*").alias("leaf_count"),
        F.count_if(F.col("verification") == 1).alias("correct_count"),
        F.count_if(F.col("verification") == 0).alias("incorrect_count"),
        F.count(right).alias("answer_count"),
        F.count_if(right).alias("answer_correct_count"),
        F.count_if(stop.isin(NATURAL)).alias("natural_count"),
        F.count_if(stop.isin("max_gen_toks_reached", "post_think_toks_reached", "max_context_length_reached")).alias("max_length_count"),
        F.count_if(stop == "repeated_exec_block_loop").alias("repeating_count"),
        F.count_if(~stop.isin("think_end", "max_gen_toks_reached", "post_think_toks_reached", "max_context_length_reached", "repeated_exec_block_loop")).alias("other_count"),
        F.count_distinct("text_preview").alias("unique_answer_count"),
        mean_or_zero(F.sum("length_tokens_total").cast("double"), F.count("length_tokens_total")).alias("length_mean"),
    )


def attempt_spine(*tables: DataFrame) -> DataFrame:
    """The distinct attempts that any of the tables has."""
    out = tables[0].select(*ATTEMPT)
    for t in tables[1:]:
        out = out.union(t.select(*ATTEMPT))
    return out.distinct()


def attempt_progress(log: DataFrame, leaves: DataFrame, responses: DataFrame) -> DataFrame:
    """Every attempt with its leaves and finishes, pass rate and status: one aggregate of a tagged union, no join."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    finished = F.col("event_type") == "doc_finished"
    rows = log.select(*ATTEMPT, none.alias("leaf"), none.alias("right"), F.when(finished, one).otherwise(none).alias("done"), F.when(finished, F.col("event_index")).alias("at"))
    rows = rows.unionByName(leaves.select(*ATTEMPT, one.alias("leaf"), F.when(F.col("verification") == 1, one).otherwise(none).alias("right"), none.alias("done"), F.col("event_index").alias("at")))
    rows = rows.unionByName(responses.select(*ATTEMPT, none.alias("leaf"), none.alias("right"), none.alias("done"), F.lit(None).cast("long").alias("at")))
    out = rows.groupBy(*ATTEMPT).agg(F.sum("leaf").alias("leaf_count"), F.sum("right").alias("correct_count"), F.sum("done").alias("finish_count"), F.coalesce(F.max("at"), F.lit(-1)).alias("last_event_index"))
    status = F.when(F.col("finish_count") > 0, "finished").when(F.col("leaf_count") > 0, "running").otherwise("started")
    return out.withColumns({"passrate": mean_or_zero(F.col("correct_count").cast("double"), F.col("leaf_count")), "status": status})


def attempt_counts(log: DataFrame, leaves: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts and last index over four tables in one pass of a tagged union. An index of 0 stays 0."""
    tagged = None
    for name, t in (("event", log), ("leaf", leaves), ("request", requests), ("response", responses)):
        part = t.groupBy(*ATTEMPT).agg(F.count("*").alias("n"), F.max("event_index").alias("last")).withColumn("kind", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_count") for k in ("event", "leaf", "request", "response")]
    return tagged.groupBy(*ATTEMPT).agg(*sums, F.max("last").alias("last_event_index"))


def global_counts(log: DataFrame) -> DataFrame:
    """Number of events and last index, -1 for none."""
    return log.agg(F.count("*").alias("event_count"), F.coalesce(F.max("event_index"), F.lit(-1).cast("long")).alias("last_event_index"))


def step_pass_rate(leaves: DataFrame, step: str) -> DataFrame:
    """Mean over documents of their pass rate, and the mean over leaves, in one pass of two levels."""
    own = leaves.groupBy(step, "doc_id", "doc_attempt").agg(F.avg("verification").alias("rate"), F.sum("verification").alias("right"), F.count("verification").alias("n"))
    return own.groupBy(step).agg(F.avg("rate").alias("doc_passrate"), F.try_divide(F.sum("right").cast("double"), F.sum("n")).alias("leaf_passrate"), F.count("*").alias("attempt_count"))


def preferred_attempts(summary: DataFrame, per: list[str]) -> DataFrame:
    """Finished ones first, then the highest attempt, then the latest index; all keys end the ties."""
    w = Window.partitionBy(*per).orderBy((F.col("finished_count") > 0).desc(), F.col("doc_attempt").desc(), F.col("last_event_index").desc(), *ATTEMPT)
    return summary.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def preferred_by_tuple(summary: DataFrame, per: list[str]) -> DataFrame:
    """The same choice as one aggregate of the largest tuple."""
    rank = F.struct((F.col("finished_count") > 0).alias("done"), "doc_attempt", "last_event_index")
    return summary.groupBy(*per).agg(F.max(rank).alias("best")).select(*per, "best.*")


def selected_doc_pass_rate(leaves: DataFrame, metrics: DataFrame) -> DataFrame:
    """The preferred attempt of each document and selector, and the mean of its answer accuracy by selector."""
    own = with_answer(leaves, metrics).groupBy(*ATTEMPT).agg(
        F.count("*").alias("leaf_count"),
        F.count("right_answer").alias("answer_count"),
        F.count_if("right_answer").alias("answer_correct"),
        F.count_if(F.col("verification") == 1).alias("correct"),
        F.count_if(F.col("stop_reason") == "think_end").alias("finished_count"),
        F.max("event_index").alias("last_event_index"),
    ).filter("leaf_count > 0")
    best = preferred_attempts(own, ["doc_id", "selector_mode"])
    rate = F.when(F.col("answer_count") > 0, F.col("answer_correct") / F.col("answer_count")).otherwise(F.col("correct") / F.col("leaf_count"))
    return best.groupBy("selector_mode").agg(F.count("*").alias("doc_count"), F.avg(rate).alias("passrate"), F.sum("leaf_count").alias("leaf_count"))


def request_steps(requests: DataFrame, responses: DataFrame, choices: DataFrame, pending: bool = False) -> DataFrame:
    """C02 (answered only) and C03 (pending kept): requests with response and first choice, numbered inside their node."""
    key = [*ATTEMPT, "request_id"]
    a = requests.select(*key, F.col("event_index").alias("request_index"), "node_id", "prompt_tokens", "stream_id")
    b = responses.select(*key, F.col("event_index").alias("response_index"), "status", "latency_seconds", "output_token_count")
    first = choices.filter("choice_index = 0").select(F.col("response_event_index").alias("response_index"), "text", "finish_reason")
    out = a.join(b, key, "left" if pending else "inner").join(first, "response_index", "left")
    number = F.row_number().over(Window.partitionBy(*ATTEMPT, "node_id").orderBy(F.coalesce("response_index", "request_index"), "request_index"))
    return out.select(
        *ATTEMPT, "request_id", "request_index", "response_index", "node_id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("output_token_count", F.lit(0)).alias("token_delta"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("stream_id").startswith("decode:").alias("is_decode"), number.alias("local_step"),
    )


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response."""
    return requests.join(responses.select(*ATTEMPT, "request_id"), [*ATTEMPT, "request_id"], "left_anti")


def answered_texts(requests: DataFrame, responses: DataFrame, choices: DataFrame) -> DataFrame:
    """Every choice of the requests that were answered well."""
    good = responses.filter("status = 'ok'").select(*ATTEMPT, "request_id", F.col("event_index").alias("response_event_index"))
    return requests.select(*ATTEMPT, "request_id", "node_id", F.col("event_index").alias("request_index")).join(good, [*ATTEMPT, "request_id"]).join(choices, "response_event_index")


def token_trajectory(requests: DataFrame, responses: DataFrame, choices: DataFrame) -> DataFrame:
    """The words of each answer, one row each, with their place."""
    rows = answered_texts(requests, responses, choices)
    return rows.select("request_index", "response_event_index", "choice_index", F.posexplode(F.split("text", " ")).alias("token_index", "token_text"))


def selector_pools(selectors: DataFrame, pools: DataFrame) -> DataFrame:
    """Selector events with every pool of their attempt and branch point."""
    key = [*ATTEMPT, "branch_point_id"]
    return selectors.select(*key, F.col("event_index").alias("selector_index"), "active_selector_mode").join(pools.select(*key, F.col("event_index").alias("pool_index"), "num_candidates"), key)


def with_optional(rows: DataFrame, context: DataFrame | None, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Columns of a context table, or typed nulls where the table, or a column of it, is missing."""
    if context is None:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    have = context.select(*keys, *[(F.col(c) if c in context.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    return rows.join(have, keys, "left")


def visible_steps(log: DataFrame, node: str, visible: list[str] = VISIBLE) -> DataFrame:
    """Visible events, numbered inside their node."""
    w = Window.partitionBy(*ATTEMPT, node).orderBy("event_index")
    return log.filter(F.col("event_type").isin(visible)).withColumn("local_step", F.row_number().over(w))


def running_metrics(log: DataFrame, delta: str) -> DataFrame:
    """Running steps and sums inside an attempt, and seconds since it began."""
    w = Window.partitionBy(*ATTEMPT).orderBy("event_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    began = F.min("timestamp_utc").over(Window.partitionBy(*ATTEMPT))
    seconds = F.unix_micros(F.col("timestamp_utc").cast("timestamp")) - F.unix_micros(began.cast("timestamp"))
    return log.select(*ATTEMPT, "event_index", F.row_number().over(w).alias("step"), F.round(F.sum(delta).over(upto), 6).alias("running"), F.greatest(F.lit(0.0), seconds / 1e6).alias("elapsed_seconds"))


def latest(log: DataFrame, per: list[str]) -> DataFrame:
    """the event of the largest index for each key."""
    return log.groupBy(*per).agg(F.max("event_index").alias("event_index"), F.max_by("event_type", "event_index").alias("event_type"))


def document_progress(leaves: DataFrame) -> DataFrame:
    """The last write of each leaf id wins; then counts by family of stop reason."""
    last = leaves.groupBy("doc_id", "doc_attempt", "leaf_id").agg(F.max_by(F.struct("verification", "stop_reason", "text_preview"), "event_index").alias("v")).select("doc_id", "doc_attempt", "v.*")
    stop = F.col("stop_reason")
    bucket = F.when(stop.isin(NATURAL), "natural").when(stop.isin(AT_LIMIT), "max_length").when(stop.isin(REPEATING), "repeating").otherwise("other")
    one = lambda b: F.count_if(bucket == b).alias(f"{b}_count")
    return last.groupBy("doc_id", "doc_attempt").agg(F.count("*").alias("leaf_count"), F.count_if(F.col("verification") == 1).alias("correct_count"), one("natural"), one("max_length"), one("repeating"), one("other"), F.sort_array(F.collect_set("text_preview")).alias("answers"))


def batch_summary(log: DataFrame) -> DataFrame:
    """State of each document of a run."""
    kind = F.col("event_type")
    return log.groupBy("run_id", "doc_id").agg(F.bool_or(kind == "doc_started").alias("started"), F.bool_or(kind == "doc_finished").alias("finished"), F.count_if(kind == "leaf_scored").alias("leaf_count"), F.max_by(kind, "event_index").alias("last_event_type"))


def execution_plan(log: DataFrame, docs: DataFrame) -> DataFrame:
    """Skip what the latest attempt finished, resume what it began, start the rest at attempt 0."""
    state = log.groupBy("doc_id").agg(F.max("doc_attempt").alias("latest"), F.max(F.when(F.col("event_type") == "doc_finished", F.col("doc_attempt"))).alias("finished"))
    out = docs.join(state, "doc_id", "left")
    action = F.when(F.col("latest").isNull(), "start").when(F.col("finished") == F.col("latest"), "skip").otherwise("resume")
    return out.select("doc_id", action.alias("action"), F.coalesce("latest", F.lit(0)).cast("long").alias("doc_attempt"))


def upserted(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key; new rows win ties."""
    tagged = base.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("__new").desc())
    return tagged.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__new")


def joined_progress(log: DataFrame, leaves: DataFrame, responses: DataFrame) -> DataFrame:
    """The spine of attempts with their leaf counts and their finishes, by two joins that keep attempts without either."""
    leaf = leaves.groupBy(*ATTEMPT).agg(F.count("*").alias("leaf_count"))
    finish = log.filter("event_type = 'doc_finished'").groupBy(*ATTEMPT).agg(F.max("event_index").alias("finish_index"))
    return attempt_spine(log, leaves, responses).join(leaf, ATTEMPT, "left").join(finish, ATTEMPT, "left")


def local_steps(rows: DataFrame, node: str, *order: str) -> DataFrame:
    """Places from 1 inside each node of an attempt, by the first of the order's columns that is not null, then the others."""
    return rows.withColumn("local_step", F.row_number().over(Window.partitionBy(*ATTEMPT, node).orderBy(F.coalesce(*order), *order)))


def elapsed(log: DataFrame) -> DataFrame:
    """Seconds since an attempt's first event, at least 0."""
    began = F.min("timestamp_utc").over(Window.partitionBy(*ATTEMPT))
    return log.withColumn("elapsed_seconds", F.greatest(F.lit(0.0), (F.unix_micros(F.col("timestamp_utc").cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 1e6))


def next_states(nodes: DataFrame, tree: str, closed: Column, slots: int) -> DataFrame:
    """What a scheduler of `slots` workers a tree takes up next: open nodes, the oldest first. The calls themselves are not data."""
    w = Window.partitionBy(tree).orderBy("event_index")
    return nodes.filter(~closed).withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= slots)


def cache_states(entries: DataFrame, per: str, capacity: int, fresh: int, now: Column) -> DataFrame:
    """Of cache entries (stored_at, used_at in seconds): evicted beyond the `capacity` last used ones of their cache, else fresh
    up to an age, else stale, which is served while it is computed again."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("used_at"), "entry"))
    age = now - F.col("stored_at")
    return entries.withColumn("state", F.when(place > capacity, "evicted").when(age <= fresh, "fresh").otherwise("stale"))


def rate_limited(calls: DataFrame, per: str, at: str, limit: int, seconds: int) -> DataFrame:
    """How many calls of a key fall into the window that ends with each call, and whether that is over the limit."""
    w = Window.partitionBy(per).orderBy(F.col(at)).rangeBetween(-(seconds - 1), 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("over_limit", F.col("in_window") > limit)


def retry_delays(attempts: Column, base: float, most: float) -> Column:
    """Seconds before the next try after so many failures: doubling, up to a limit."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
