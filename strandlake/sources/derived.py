"""Inputs in the shape of the domain (events, leaves, trees, traces, ...), derived from the given tables.

Each recipe is one SELECT over {tables} and other recipes, in SQL that Spark and DuckDB read alike, so that a query and its
oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strandlake.sources.files import scratch

ATTEMPT = ["doc_id", "doc_attempt", "task_name", "model_id", "selector_mode"]

RECIPES = {
    "leaf_score": """
select l_orderkey * 64 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as event_index,
  o_custkey as doc_id, o_orderkey % 3 as doc_attempt, o_orderstatus as task_name, concat('m', cast(l_suppkey % 2 as string)) as model_id, o_orderpriority as selector_mode,
  l_shipdate as timestamp_utc, concat(case when l_partkey % 10 = 0 then 'LEAF_BASELINE_' else 'leaf_' end, cast(l_linenumber as string)) as leaf_id,
  concat('node_', cast(l_linenumber as string)) as node_id, case when l_linenumber = 7 then null when l_returnflag = 'R' then 1 else 0 end as verification,
  case when l_partkey % 17 = 0 then null else cast(l_quantity * 40 as int) end as length_tokens_total, cast(l_quantity * 30 as int) as length_tokens_exec,
  case when l_linestatus = 'F' and l_returnflag = 'A' then 'length' when l_linestatus = 'F' and l_returnflag = 'N' then 'max_gen_toks_reached'
       when l_linestatus = 'O' and l_returnflag = 'A' then 'repeated_exec_block_loop' when l_linestatus = 'O' and l_returnflag = 'N' and l_partkey % 3 = 0 then 'repeated_steer_block_loop'
       when l_partkey % 11 = 0 then 'missing_steer_or_think_close' else 'think_end' end as stop_reason,
  concat('answer ', cast(l_partkey % 5 as string)) as text_preview
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "leaf_metric": """
select event_index as leaf_event_index, 'raw_answer_acc' as metric_name, cast(coalesce(verification, 0) as double) as metric_value, case when verification = 1 then 'True' else 'False' end as metric_text from {leaf_score} where event_index % 5 <> 0
union all select event_index, 'answer_reward', case when length_tokens_exec % 4 = 0 then 1.0 else 0.0 end, case when length_tokens_exec % 4 = 0 then '1.0' else '0' end from {leaf_score} where event_index % 7 <> 0
union all select event_index, 'format_valid', case when event_index % 3 = 0 then 0.0 else 1.0 end, case when event_index % 3 = 0 then 'no' else 'yes' end from {leaf_score}
union all select event_index, 'boxed_present', cast(null as double), case when event_index % 4 = 0 then 'False' else ' Y ' end from {leaf_score}
union all select event_index, 'structure_issues', cast(null as double), case when event_index % 6 = 0 then '[''no_think'', ''empty_block'']' when event_index % 6 = 1 then 'unpaired' else '[]' end from {leaf_score}""",
    "event_log": """
select event_id as event_index, 3 as event_version, concat('run_', cast(user_id % 2 as string)) as run_id, user_id as doc_id, dayofmonth(ts) % 2 as doc_attempt, 'aime' as task_name,
  concat('m', cast(user_id % 3 as string)) as model_id, case when user_id % 2 = 0 then 'random' else 'diverse' end as selector_mode, ts as timestamp_utc,
  case event_type when 'signup' then 'doc_started' when 'view' then 'node_created' when 'click' then 'leaf_scored' when 'purchase' then 'doc_finished' else 'vllm_request' end as event_type,
  props as payload_json, value
from {events}""",
    "nodes": """
select user_id as doc_id, rn as node_id, case when rn = 1 then null else cast(floor(rn / 2) as bigint) end as parent_node_id, value, event_type, event_id as event_index
from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from {events})""",
    "requests": """
select o_orderkey as event_index, concat('req_', cast(o_orderkey as string)) as request_id, o_custkey as doc_id, o_orderkey % 3 as doc_attempt, o_orderstatus as task_name, concat('m', cast(o_orderkey % 2 as string)) as model_id,
  o_orderpriority as selector_mode, concat('node_', cast(o_orderkey % 5 as string)) as node_id, cast(floor(o_totalprice / 1000) as bigint) as prompt_tokens,
  case when o_orderkey % 4 = 0 then concat('decode:', cast(o_orderkey % 9 as string)) else concat('prefill:', cast(o_orderkey % 9 as string)) end as stream_id, o_orderdate as timestamp_utc
from {orders}""",
    "responses": """
select event_index + 1000000 as event_index, request_id, doc_id, doc_attempt, task_name, model_id, selector_mode, case when l_returnflag = 'R' then 'ok' else 'error' end as status, l_extendedprice / 10000 as latency_seconds, cast(l_quantity as bigint) as output_token_count, l_shipdate as timestamp_utc
from {requests} join (select * from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) as first_line from {lineitem}) where first_line = 1 and l_returnflag <> 'A') on l_orderkey = event_index""",
    "choices": """
select r.event_index as response_event_index, c.choice_index, concat('text ', cast(r.output_token_count as string), case when c.choice_index = 0 then '</steer>' else '' end) as text, case when r.output_token_count % 3 = 0 then 'length' else 'stop' end as finish_reason
from {responses} r cross join (select 0 as choice_index union all select 1 as choice_index) c where r.status = 'ok'""",
    "pools": """
select event_index, concat('bp_', cast(doc_id % 7 as string)) as branch_point_id, doc_id, doc_attempt, task_name, model_id, selector_mode, node_id, 2 + event_index % 3 as num_candidates from {requests} where event_index % 2 = 0""",
    "selectors": """
select event_index, concat('bp_', cast(doc_id % 7 as string)) as branch_point_id, doc_id, doc_attempt, task_name, model_id, selector_mode, case when event_index % 3 = 0 then 'cluster_across' else 'random' end as active_selector_mode from {requests} where event_index % 3 <> 1""",
    "rl_rows": """
select doc_id, concat('row_', cast(doc_id as string)) as id, text as prompt, source as dataset_source,
  case doc_id % 4 when 0 then concat('org/', source, '_filtered') when 1 then concat('org/', source, '_Cleaned') when 2 then '' else concat('hub/', source) end as original_dataset,
  cast(n_chars % 17 as double) / 16 as passrate, n_chars % 5 as total_correct_rollouts, cast(4 as bigint) as total_rollouts,
  case n_chars % 6 when 0 then '12' when 1 then '\\frac{{1}}{{2}}' when 2 then '3/4' when 3 then '5\\%' when 4 then ' x^2+1 ' else '  ' end as answer,
  case when doc_id % 3 = 0 then 'Math' when doc_id % 3 = 1 then 'code' else ' MATH ' end as label_a, case when doc_id % 5 = 0 then 'Code' else 'math' end as label_b, n_chars, lang
from {documents}""",
    "traces": """
select doc_id, lang, concat('<think>', body, case when doc_id % 7 = 0 then '' else '</think>' end, ' \\boxed{{', cast(n_chars as string), '}}') as trace, n_chars
from (select doc_id, lang, n_chars, regexp_replace(concat('<steer>', replace(text, '\n', '</exec>\n<steer>'), '</exec>'), '([.])( [A-Z])', '\\1</steer><exec>\\2', 'g') as body from {documents})""",
    "candidates": """
select doc_id % 1000 as candidate_id, cast(floor(doc_id / 20) as bigint) as pool_id, doc_id, text, label from {documents} join {embeddings} on vec_id = doc_id""",
    "steps": """
select concat('run_', cast(doc_id % 3 as string)) as run_name, doc_id % 12 as step, doc_id, text, n_chars from {documents}""",
    "checkpoints": """
select p_partkey as checkpoint_id, concat('checkpoint-', cast(p_partkey * 10 as string)) as checkpoint_label, case when p_partkey % 9 = 0 then null else p_partkey * 10 end as checkpoint_step,
  case when p_partkey % 11 = 0 then null else cast(p_size as double) / 50 end as aime24, cast(p_partkey % 31 as double) / 31 as aime25, cast(p_partkey % 7 as double) / 7 as math500 from {part}""",
}
TABLES = set("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


#: Where derived tables are that were computed once for many queries.
STORED: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Writes derived tables, so that queries of this session read them instead of deriving them again."""
    for name in names:
        path = scratch(spark)
        table(spark, sf_dir, name).write.parquet(path)
        STORED[sf_dir, name] = path


def needs(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", RECIPES[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived one, which is read where store() has put it."""
    if (sf_dir, name) in STORED:
        return spark.read.parquet(STORED[sf_dir, name])
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = RECIPES[name]
    if name == "traces":  # Spark's regexp_replace replaces all and names groups by $
        text = text.replace("\\1</steer><exec>\\2', 'g')", "$1</steer><exec>$2')").replace("\\boxed", "\\\\boxed")
    if name == "rl_rows":
        text = text.replace("\\", "\\\\")
    if name == "traces":
        text = text.replace("'\n'", "'\\n'").replace("</exec>\n<steer>", "</exec>\\n<steer>")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs(name)})


def duck(sql: str) -> str:
    """SQL over {names} of derived tables as one statement for DuckDB, each derived table a common table expression."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in needs(name):
            visit(n)
        order.append(name)

    for n in sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))):
        visit(n)
    flat = lambda s: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", s).replace("{{", "{").replace("}}", "}")
    own = flat(sql).strip()
    ctes = ", ".join(f"{n} as ({flat(RECIPES[n])})" for n in order)
    if not ctes:
        return own
    if own.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {own[15:]}"
    return f"with {ctes}, {own[5:]}" if own.lower().startswith("with ") else f"with {ctes} {own}"
