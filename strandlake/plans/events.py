"""Queries over the event store."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import events as E
from strandlake.plans.base import Plans

P = Plans()
K = "doc_id, doc_attempt, task_name, model_id, selector_mode"
TRUE = "coalesce(lower(trim({0})) in ('true', '1', '1.0', 'yes', 'y'), false)"
PIVOT = "(select leaf_event_index, " + ", ".join(f"max(case when metric_name = '{m}' then metric_text end) as {m}" for m in E.METRICS) + " from {leaf_metric} group by 1)"


@P.query("d01_attempt_keys", f"select {K}, count(*) as event_count, max(event_index) as last_event_index from {{event_log}} group by all")
def _(t):
    return E.attempt_keys(t("event_log"))


@P.query("d02_attempt_lifecycle", f"""select a.*, b.timestamp_utc as last_timestamp from (select {K}, count(*) as event_count, sum(case when event_type in ('doc_started', 'doc_resumed') then 1 else 0 end)::bigint as started_count,
  sum(case when event_type = 'doc_finished' then 1 else 0 end)::bigint as finished_count, max(event_index) as last_event_index from {{event_log}} group by all) a join {{event_log}} b on b.event_index = a.last_event_index""")
def _(t):
    return E.attempt_lifecycle(t("event_log"))


@P.query("d14_metric_pivot", f"select * from {PIVOT}")
def _(t):
    return E.pivot_metrics(t("leaf_metric"))


@P.query("c09_leaf_rows", "select l.*, " + ", ".join(f"(select max(metric_text) from {{leaf_metric}} m where m.leaf_event_index = l.event_index and metric_name = '{m}') as {m}" for m in E.METRICS) + " from {leaf_score} l")
def _(t):
    return E.leaf_rows(t("leaf_score"), t("leaf_metric"))


@P.query("d03_leaf_summary", f"""select {K}, count(*) as leaf_count, count(*) filter (verification = 1) as correct_count, count(*) filter (verification = 0) as incorrect_count, count(raw_answer_acc) as answer_count,
  count(*) filter ({TRUE.format("raw_answer_acc")}) as answer_correct_count, count(*) filter (stop_reason = 'think_end') as natural_count,
  count(*) filter (stop_reason in ('max_gen_toks_reached', 'post_think_toks_reached', 'max_context_length_reached')) as max_length_count, count(*) filter (stop_reason = 'repeated_exec_block_loop') as repeating_count,
  count(*) filter (stop_reason not in ('think_end', 'max_gen_toks_reached', 'post_think_toks_reached', 'max_context_length_reached', 'repeated_exec_block_loop')) as other_count,
  count(distinct text_preview) as unique_answer_count, coalesce(avg(length_tokens_total), 0.0) as length_mean
  from {{leaf_score}} left join {PIVOT} p on leaf_event_index = event_index group by all""")
def _(t):
    return E.leaf_summary(t("leaf_score"), t("leaf_metric"))


_PROGRESS = f"""from (select {K} from {{event_log}} union select {K} from {{leaf_score}} union select {K} from {{responses}})
  left join (select {K}, count(*) as lc, count(*) filter (verification = 1) as cc, max(event_index) as li from {{leaf_score}} group by all) using ({K})
  left join (select {K}, count(*) as fc, max(event_index) as fi from {{event_log}} where event_type = 'doc_finished' group by all) using ({K})"""


@P.query("d04_attempt_progress", f"""select {K}, coalesce(lc, 0) as leaf_count, coalesce(cc, 0) as correct_count, coalesce(fc, 0) as finish_count, coalesce(greatest(li, fi), -1) as last_event_index,
  case when coalesce(lc, 0) = 0 then 0.0 else cc / lc end as passrate, case when fc > 0 then 'finished' when lc > 0 then 'running' else 'started' end as status {_PROGRESS}""")
def _(t):
    return E.attempt_progress(t("event_log"), t("leaf_score"), t("responses"))


@P.query("g01_attempt_spine", f"select {K} from {{event_log}} union select {K} from {{leaf_score}} union select {K} from {{responses}}")
def _(t):
    return E.attempt_spine(t("event_log"), t("leaf_score"), t("responses"))


@P.query("d05_attempt_counts", f"""select {K}, sum(e)::bigint as event_count, sum(l)::bigint as leaf_count, sum(q)::bigint as request_count, sum(r)::bigint as response_count, max(i) as last_event_index from (
  select {K}, 1 as e, 0 as l, 0 as q, 0 as r, event_index as i from {{event_log}} union all select {K}, 0, 1, 0, 0, event_index from {{leaf_score}}
  union all select {K}, 0, 0, 1, 0, event_index from {{requests}} union all select {K}, 0, 0, 0, 1, event_index from {{responses}}) group by all""")
def _(t):
    return E.attempt_counts(t("event_log"), t("leaf_score"), t("requests"), t("responses"))


@P.query("d06_global_counts", "select count(*) as event_count, coalesce(max(event_index), -1) as last_event_index from {event_log}")
def _(t):
    return E.global_counts(t("event_log"))


@P.query("d07_step_pass_rate", """select selector_mode, avg(rate) as doc_passrate, sum(s) / sum(n) as leaf_passrate, count(*) as attempt_count from (
  select selector_mode, doc_id, doc_attempt, avg(verification) as rate, sum(verification) as s, count(verification) as n from {leaf_score} group by all) group by all""")
def _(t):
    return E.step_pass_rate(t("leaf_score"), "selector_mode")


@P.query("d08_selected_doc_pass_rate", f"""with own as (select {K}, count(*) as leaf_count, count(raw_answer_acc) as ac, count(*) filter ({TRUE.format("raw_answer_acc")}) as acc, count(*) filter (verification = 1) as cc,
  count(*) filter (stop_reason = 'think_end') as fin, max(event_index) as li from {{leaf_score}} left join {PIVOT} p on leaf_event_index = event_index group by all),
  best as (select * from own qualify row_number() over (partition by doc_id, selector_mode order by fin > 0 desc, doc_attempt desc, li desc, {K}) = 1)
  select selector_mode, count(*) as doc_count, avg(case when ac > 0 then acc / ac else cc / leaf_count end) as passrate, sum(leaf_count)::bigint as leaf_count from best group by all""")
def _(t):
    return E.selected_doc_pass_rate(t("leaf_score"), t("leaf_metric"))


_SUMMARY = f"(select {K}, count(*) filter (event_type = 'doc_finished') as finished_count, max(event_index) as last_event_index from {{event_log}} group by all)"


@P.query("e02_preferred_attempt", f"select {K}, finished_count, last_event_index from {_SUMMARY} qualify row_number() over (partition by doc_id order by finished_count > 0 desc, doc_attempt desc, last_event_index desc, {K}) = 1")
def _(t):
    s = E.attempt_lifecycle(t("event_log")).select(*E.ATTEMPT, "finished_count", "last_event_index")
    return E.preferred_attempts(s, ["doc_id"])


@P.query("e03_preferred_by_tuple", f"select doc_id, finished_count > 0 as done, doc_attempt, last_event_index from {_SUMMARY} qualify row_number() over (partition by doc_id order by finished_count > 0 desc, doc_attempt desc, last_event_index desc) = 1")
def _(t):
    return E.preferred_by_tuple(E.attempt_lifecycle(t("event_log")), ["doc_id"])


def _steps(join: str) -> str:
    return f"""select q.doc_id, q.doc_attempt, q.task_name, q.model_id, q.selector_mode, q.request_id, q.event_index as request_index, r.event_index as response_index, q.node_id, coalesce(r.status, 'pending') as status,
  coalesce(r.output_token_count, 0) as token_delta, coalesce(c.text, '') as text, q.stream_id >= 'decode:' and q.stream_id < 'decode;' as is_decode,
  row_number() over (partition by q.doc_id, q.doc_attempt, q.task_name, q.model_id, q.selector_mode, q.node_id order by coalesce(r.event_index, q.event_index), q.event_index) as local_step
  from {{requests}} q {join} join {{responses}} r using (doc_id, doc_attempt, task_name, model_id, selector_mode, request_id) left join {{choices}} c on c.response_event_index = r.event_index and c.choice_index = 0"""


@P.query("c02_answered_steps", _steps("inner"))
def _(t):
    return E.request_steps(t("requests"), t("responses"), t("choices"))


@P.query("c03_steps_with_pending", _steps("left"))
def _(t):
    return E.request_steps(t("requests"), t("responses"), t("choices"), pending=True)


@P.query("c04_pending_requests", f"select q.* from {{requests}} q left join {{responses}} r using ({K}, request_id) where r.event_index is null")
def _(t):
    return E.pending_requests(t("requests"), t("responses")).select(*t("requests").columns)


@P.query("c05_answered_texts", f"select {K}, request_id, node_id, q.event_index as request_index, response_event_index, choice_index, text, finish_reason from {{requests}} q join {{responses}} r using ({K}, request_id) join {{choices}} c on c.response_event_index = r.event_index where status = 'ok'")
def _(t):
    return E.answered_texts(t("requests"), t("responses"), t("choices"))


@P.query("c06_token_trajectory", f"""select request_index, response_event_index, choice_index, (i - 1)::int as token_index, w[i] as token_text from (select q.event_index as request_index, response_event_index, choice_index, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i
  from {{requests}} q join {{responses}} r using ({K}, request_id) join {{choices}} c on c.response_event_index = r.event_index where status = 'ok')""")
def _(t):
    return E.token_trajectory(t("requests"), t("responses"), t("choices"))


@P.query("c07_selector_pools", f"select {K}, branch_point_id, s.event_index as selector_index, active_selector_mode, p.event_index as pool_index, num_candidates from {{selectors}} s join {{pools}} p using ({K}, branch_point_id)")
def _(t):
    return E.selector_pools(t("selectors"), t("pools"))


@P.query("c08_optional_context", "select event_index, prompt_text, golden_answer from (select event_index, doc_id from {pools}) left join (select doc_id, text as prompt_text, cast(null as varchar) as golden_answer from {documents}) using (doc_id)")
def _(t):
    context = t("documents").select("doc_id", F.col("text").alias("prompt_text"))
    return E.with_optional(t("pools").select("event_index", "doc_id"), context, ["doc_id"], {"prompt_text": "string", "golden_answer": "string"}).drop("doc_id")


@P.query("b10_visible_steps", f"select {K}, event_index, event_type, row_number() over (partition by {K}, user_value order by event_index) as local_step from (select *, floor(value / 10)::int as user_value from {{event_log}}) where event_type in ('node_created', 'leaf_scored', 'vllm_request')")
def _(t):
    return E.visible_steps(t("event_log").withColumn("user_value", F.floor(F.col("value") / 10)), "user_value").select(*E.ATTEMPT, "event_index", "event_type", "local_step")


@P.query("b11_stream_prefix", "select event_index, stream_id from {requests} where stream_id >= 'decode:' and stream_id < 'decode;'")
def _(t):
    return t("requests").filter(F.col("stream_id").startswith("decode:")).select("event_index", "stream_id")


@P.query("b12_baseline_leaves", "select event_index, leaf_id from {leaf_score} where leaf_id ilike 'leaf_baseline_%'")
def _(t):
    return t("leaf_score").filter(F.col("leaf_id").ilike("leaf_baseline_%")).select("event_index", "leaf_id")


@P.query("b13_index_list", "select event_index, status from {responses} where event_index in (select event_index + 1000000 from {pools})")
def _(t):
    return t("responses").join(t("pools").select((F.col("event_index") + 1000000).alias("event_index")), "event_index", "left_semi").select("event_index", "status")


@P.query("e09_running_metrics", f"""select {K}, event_index, row_number() over w as step, round(sum(value) over (w rows between unbounded preceding and current row), 6) as running,
  greatest(0.0, (epoch_us(timestamp_utc) - epoch_us(min(timestamp_utc) over (partition by {K}))) / 1000000) as elapsed_seconds from {{event_log}} window w as (partition by {K} order by event_index)""")
def _(t):
    return E.running_metrics(t("event_log"), "value")


@P.query("f14_latest_event", "select doc_id, event_index, event_type from {event_log} qualify row_number() over (partition by doc_id order by event_index desc) = 1")
def _(t):
    return E.latest(t("event_log"), ["doc_id"])


@P.query("d23_document_progress", """with last as (select * from {leaf_score} qualify row_number() over (partition by doc_id, doc_attempt, leaf_id order by event_index desc) = 1)
  select doc_id, doc_attempt, count(*) as leaf_count, count(*) filter (verification = 1) as correct_count, count(*) filter (stop_reason = 'think_end') as natural_count, count(*) filter (stop_reason in ('length', 'max_gen_toks_reached')) as max_length_count,
  count(*) filter (stop_reason like 'repeated_%') as repeating_count, count(*) filter (stop_reason = 'missing_steer_or_think_close') as other_count, list_sort(list(distinct text_preview)) as answers from last group by all""")
def _(t):
    return E.document_progress(t("leaf_score"))


@P.query("d24_batch_summary", """select run_id, doc_id, bool_or(event_type = 'doc_started') as started, bool_or(event_type = 'doc_finished') as finished, count(*) filter (event_type = 'leaf_scored') as leaf_count,
  arg_max(event_type, event_index) as last_event_type from {event_log} group by all""")
def _(t):
    return E.batch_summary(t("event_log"))


@P.query("j11_execution_plan", """select d.doc_id, case when latest is null then 'start' when fin = latest then 'skip' else 'resume' end as action, coalesce(latest, 0) as doc_attempt
  from (select doc_id from {documents}) d left join (select doc_id, max(doc_attempt) as latest, max(case when event_type = 'doc_finished' then doc_attempt end) as fin from {event_log} group by 1) using (doc_id)""")
def _(t):
    return E.execution_plan(t("event_log"), t("documents").select("doc_id"))


@P.query("g07_upsert", "select doc_id, event_index, event_type from {event_log} qualify row_number() over (partition by doc_id order by event_index desc) = 1")
def _(t):
    log = t("event_log").select("doc_id", "event_index", "event_type")
    base, new = (E.latest(log.filter(f"event_index % 2 = {k}"), ["doc_id"]) for k in (0, 1))
    return E.upserted(base, new, ["doc_id"], "event_index").select("doc_id", "event_index", "event_type")


@P.query("c10_joined_progress", f"""select {K}, lc as leaf_count, fi as finish_index {_PROGRESS}""")
def _(t):
    return E.joined_progress(t("event_log"), t("leaf_score"), t("responses"))


@P.query("c11_last_event", f"select {K}, event_index as last_event_index, timestamp_utc as last_timestamp from {{event_log}} qualify row_number() over (partition by {K} order by event_index desc) = 1")
def _(t):
    return E.attempt_lifecycle(t("event_log")).select(*E.ATTEMPT, "last_event_index", "last_timestamp")


@P.query("e01_local_steps", f"select event_index, row_number() over (partition by {K}, node_id order by coalesce(answered, event_index), answered nulls first, event_index) as local_step from (select *, case when event_index % 3 = 0 then event_index - 50 end as answered from {{requests}})")
def _(t):
    rows = t("requests").withColumn("answered", F.when(F.col("event_index") % 3 == 0, F.col("event_index") - 50))
    return E.local_steps(rows, "node_id", "answered", "event_index").select("event_index", "local_step")


@P.query("e10_elapsed", f"select event_index, greatest(0.0, (epoch_us(timestamp_utc) - epoch_us(min(timestamp_utc) over (partition by {K}))) / 1000000) as elapsed_seconds from {{event_log}}")
def _(t):
    return E.elapsed(t("event_log")).select("event_index", "elapsed_seconds")


@P.query("g02_union_all", "select event_index, event_type from {event_log} union all select event_index, 'leaf' from {leaf_score} union all select event_index, event_type from {event_log} where event_index % 10 = 0")
def _(t):
    log = t("event_log").select("event_index", "event_type")
    return log.unionAll(t("leaf_score").select("event_index", F.lit("leaf").alias("event_type"))).unionAll(log.filter("event_index % 10 = 0"))


@P.query("j06_next_states", "select doc_id, node_id, row_number() over (partition by doc_id order by event_index) as slot from {nodes} where event_type <> 'purchase' qualify slot <= 3")
def _(t):
    return E.next_states(t("nodes"), "doc_id", F.col("event_type") == "purchase", 3).select("doc_id", F.col("node_id").cast("long").alias("node_id"), "slot")


@P.query("j09_cache_states", "select entry, case when row_number() over (partition by cache order by used_at desc, entry) > 20 then 'evicted' when 1000 - stored_at <= 600 then 'fresh' else 'stale' end as state from (select event_id as entry, user_id % 10 as cache, event_id % 997 as used_at, event_id % 1000 as stored_at from {events})")
def _(t):
    e = t("events").select(F.col("event_id").alias("entry"), (F.col("user_id") % 10).alias("cache"), (F.col("event_id") % 997).alias("used_at"), (F.col("event_id") % 1000).alias("stored_at"))
    return E.cache_states(e, "cache", 20, 600, F.lit(1000)).select("entry", "state")


@P.query("j13_rate_limit", "select event_id, count(*) over w as in_window, count(*) over w > 2 as over_limit, least(60.0, 0.5 * pow(2.0, greatest(event_id % 9 - 1, 0)))::double as delay from {events} window w as (partition by user_id % 10 order by event_id range between 59 preceding and current row)")
def _(t):
    calls = t("events").select("event_id", (F.col("user_id") % 10).alias("key"))
    return E.rate_limited(calls, "key", "event_id", 2, 60).select("event_id", "in_window", "over_limit", E.retry_delays(F.col("event_id") % 9, 0.5, 60.0).alias("delay"))


QUERIES, ORACLES = P.queries, P.oracles
