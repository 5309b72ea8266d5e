"""Queries over rollout trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import tree as R
from strandlake.plans.base import Plans

P = Plans()
C = F.col
WALK = """with recursive w as (select doc_id, node_id, parent_node_id, value, 0 as depth, cast(node_id as varchar) as path, cast(null as bigint) as branch, value as path_sum from {nodes} where parent_node_id is null
  union all select n.doc_id, n.node_id, n.parent_node_id, n.value, w.depth + 1, concat(w.path, '/', n.node_id), coalesce(w.branch, n.node_id), w.path_sum + n.value from {nodes} n join w on n.doc_id = w.doc_id and n.parent_node_id = w.node_id),
  t as (select w.*, not exists (select 1 from {nodes} c where c.doc_id = w.doc_id and c.parent_node_id = w.node_id) as is_leaf from w)"""
#: Values from the deepest level up: level n holds the nodes of depth n or more.
_LEVELS = ", v12 as (select doc_id, node_id, parent_node_id, depth, is_leaf, value as v from t where depth >= 12)" + "".join(
    f", v{d} as (select t.doc_id, t.node_id, t.parent_node_id, t.depth, t.is_leaf, case when t.is_leaf then t.value else m.m end as v from t left join (select doc_id, parent_node_id, avg(v) as m from v{d + 1} where depth = {d + 1} group by 1, 2) m on m.doc_id = t.doc_id and m.parent_node_id = t.node_id where t.depth = {d} union all select * from v{d + 1})"
    for d in range(11, -1, -1)
)
_EDGES = ", e as (select *, case when count(*) over p > 1 then (v - (sum(v) over p - v) / (count(*) over p - 1)) / (stddev_pop(v) over p + 1e-6) else 0 end as a from v0 where parent_node_id is not null window p as (partition by doc_id, parent_node_id))"


def walked(t):
    return R.walked(t("nodes"), "doc_id", "value")


@P.query("e06_paths", WALK + " select doc_id, node_id, parent_node_id, depth, path, branch, round(path_sum, 6) as path_sum, is_leaf from t")
def _(t):
    return walked(t).select("doc_id", "node_id", "parent_node_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "branch", F.round("path_sum", 6).alias("path_sum"), "is_leaf")


@P.query("e04_edge_paths", WALK + " select doc_id, node_id as leaf_id, (i - 1)::int as step, string_split(path, '/')[i]::bigint as node_id from (select *, unnest(range(2, len(string_split(path, '/')) + 1)) as i from t where is_leaf)")
def _(t):
    return R.edge_paths(walked(t), "doc_id")


@P.query("e05_first_branch", WALK + " select branch, count(*) as nodes, count(distinct doc_id) as docs from t group by 1")
def _(t):
    return walked(t).groupBy("branch").agg(F.count("*").alias("nodes"), F.count_distinct("doc_id").alias("docs"))


@P.query("e07_depths", WALK + " select depth, count(*) as n from t group by 1")
def _(t):
    return walked(t).groupBy("depth").agg(F.count("*").alias("n"))


@P.query("e08_path_sums", WALK + " select doc_id, round(max(path_sum), 9) as most, round(avg(path_sum), 9) as mean from t where is_leaf group by 1")
def _(t):
    return walked(t).filter("is_leaf").groupBy("doc_id").agg(F.round(F.max("path_sum"), 9).alias("most"), F.round(F.avg("path_sum"), 9).alias("mean"))


_VAR = """, b as (select doc_id, coalesce(cast(branch as varchar), 'no_branch') as branch, avg(value) as m, var_pop(value) as v, count(*) as n from t where is_leaf group by all),
  c as (select *, sum(m * n) over (partition by doc_id) / sum(n) over (partition by doc_id) as centre from b)
  select doc_id, leaf_count, round(variance + 1e-10, 6) as variance, round(bp1 + 1e-10, 6) as bp1, round(bp1_weighted + 1e-10, 6) as bp1_weighted, round(bp2 + 1e-10, 6) as bp2, round(bp2_weighted + 1e-10, 6) as bp2_weighted from (select doc_id, count(*) as leaf_count, var_pop(value) as variance from t where is_leaf group by 1)
  join (select doc_id, var_pop(m) as bp1, sum(n * (m - centre) ** 2) / sum(n) as bp1_weighted, avg(v) as bp2, sum(v * n) / sum(n) as bp2_weighted from c group by 1) using (doc_id)"""


@P.query("d16_branch_variance", WALK + _VAR)
def _(t):
    return R.branch_variance(walked(t), "doc_id", "node_value").select("doc_id", "leaf_count", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("variance", "bp1", "bp1_weighted", "bp2", "bp2_weighted")])


@P.query("d17_diagnostics_mean", WALK + _VAR.replace("select doc_id, leaf_count,", ", d as (select doc_id, leaf_count,", 1).replace(", d as", " , d as", 1) + ") select doc_id % 2 as mode, round(avg(variance), 5) as variance, round(avg(bp1), 5) as bp1, round(avg(bp2), 5) as bp2 from d group by 1")
def _(t):
    out = R.branch_variance(walked(t), "doc_id", "node_value")
    return out.groupBy((C("doc_id") % 2).alias("mode")).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("variance", "bp1", "bp2")])


@P.query("e12_node_values", WALK + _LEVELS + " select doc_id, node_id, round(v, 9) as node_value from v0")
def _(t):
    return walked(t).select("doc_id", "node_id", F.round("node_value", 9).alias("node_value"))


@P.query("e13_inter_advantage", "select event_id, round(case when count(*) over p > 1 then (value - avg(value) over p) / (stddev_pop(value) over p + 1e-6) else 0 end, 6) as inter from {events} window p as (partition by user_id)")
def _(t):
    return R.inter_advantage(t("events"), "user_id", "value").select("event_id", F.round("inter", 6).alias("inter"))


@P.query("e14_intra_advantage", WALK + _LEVELS + _EDGES + """, x as (select doc_id, node_id as leaf_id, string_split(path, '/')[i]::bigint as node_id from (select *, unnest(range(2, len(string_split(path, '/')) + 1)) as i from t where is_leaf))
  select l.doc_id, l.node_id as leaf_id, round(l.value, 6) as reward, round(coalesce(m, 0), 5) + 0.0 as intra from (select * from t where is_leaf) l left join (select doc_id, leaf_id, avg(a) as m from x join e using (doc_id, node_id) group by 1, 2) y on y.doc_id = l.doc_id and y.leaf_id = l.node_id""")
def _(t):
    return R.intra_advantage(walked(t), "doc_id").select("doc_id", "leaf_id", F.round("reward", 6).alias("reward"), (F.round("intra", 5) + 0.0).alias("intra"))


@P.query("e14_edge_advantage", WALK + _LEVELS + _EDGES + " select doc_id, node_id, parent_node_id, round(a, 5) as edge_advantage from e")
def _(t):
    return R.edge_advantage(walked(t), "doc_id").withColumn("edge_advantage", F.round("edge_advantage", 5))


def leaf_tokens(t):
    """Rows with two stretches: offsets 0 and n % 7 + 1, of n % 7 + 4 tokens of which every third is masked; without offsets where doc_id % 9 = 0."""
    n = (C("n_chars") % 7).cast("int")
    empty = F.array().cast("array<int>")
    rows = t("documents").select("doc_id", "source", n.alias("n"), F.when(C("doc_id") % 9 == 0, empty).otherwise(F.array(F.lit(0), n + 1)).alias("offsets"), F.array(F.lit(0.5), -n / 10.0).alias("edges"), (n / 4.0).alias("inter"))
    rows = rows.withColumn("mask", F.transform(F.sequence(F.lit(0), C("n") + 3), lambda i: F.when(i % 3 == 2, 0).otherwise(1)))
    return R.token_advantages(rows, "offsets", "edges", "inter", "mask")


TOKENS = """(select doc_id, source, n, i, case when doc_id % 9 = 0 or i % 3 = 2 then 0.0 else 0.5 * (case when i >= n + 1 then -n / 10 else 0.5 end) + 0.5 * n / 4 end as a
  from (select *, unnest(range(0, n + 4)) as i from (select doc_id, source, (n_chars % 7)::int as n from {documents})))"""


@P.query("e15_token_advantage", f"select doc_id, count(*) as tokens, round(sum(a), 6) as total, round(max(a), 6) as most from {TOKENS} group by 1")
def _(t):
    a = F.aggregate("token_advantage", F.lit(0.0), lambda x, y: x + y)
    return leaf_tokens(t).select("doc_id", F.size("token_advantage").cast("long").alias("tokens"), F.round(a, 6).alias("total"), F.round(F.array_max("token_advantage"), 6).alias("most"))


@P.query("d30_advantage_summary", f"select round(avg(a), 6) as a_mean, round(avg(abs(a)), 6) as a_mean_abs from {TOKENS}")
def _(t):
    rows = leaf_tokens(t).select(F.explode("token_advantage").alias("a"))
    return R.advantage_summary(rows, ["a"]).select(F.round("a_mean", 6).alias("a_mean"), F.round("a_mean_abs", 6).alias("a_mean_abs"))


@P.query("d31_segment_advantage", f"""select source, case when i >= n + 1 then 1 else 0 end::bigint as parent, case when i >= n + 1 then 2 else 1 end::bigint as child, min(case when i >= n + 1 then n + 1 else 0 end)::int as begin, max(case when i >= n + 1 then n + 4 else n + 1 end)::int as end,
  count(*) as token_count, count(distinct doc_id) as leaf_count, round(sum(a) / count(*), 6) as mean_advantage from {TOKENS} where doc_id % 9 <> 0 group by 1, 2, 3""")
def _(t):
    rows = leaf_tokens(t).withColumn("path", F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long")))
    return R.segment_advantages(rows, ["source"], "offsets", "token_advantage", "path").withColumn("mean_advantage", F.round("mean_advantage", 6))


@P.query("e16_frontier", """with o as (select doc_id, node_id from {nodes} n where event_type <> 'purchase' and not exists (select 1 from {nodes} c where c.doc_id = n.doc_id and c.parent_node_id = n.node_id))
  select doc_id, node_id from o union all select doc_id, node_id from {nodes} where parent_node_id is null and doc_id not in (select doc_id from o)""")
def _(t):
    return R.frontier(t("nodes"), "doc_id", C("event_type") == "purchase")


@P.query("e17_earliest_best", "select doc_id, min(case when event_type = 'leaf_scored' then 0 else 1 end)::int as rank, coalesce(min(event_index) filter (event_type = 'leaf_scored'), min(event_index)) as event_index from {event_log} group by 1")
def _(t):
    return R.earliest_best(t("event_log"), ["doc_id"], C("event_type") == "leaf_scored", "event_index")


@P.query("i20_branch_offsets", "select event_index, greatest(0, least(coalesce(case when event_index % 3 = 0 then prompt_tokens end, prompt_tokens - 100), 300))::bigint as offset from {requests}")
def _(t):
    return R.branch_offsets(t("requests"), F.when(C("event_index") % 3 == 0, C("prompt_tokens")), C("prompt_tokens"), F.lit(100), F.lit(300)).select("event_index", C("offset").cast("long").alias("offset"))


@P.query("c01_node_rows", """select n.doc_id, n.node_id, n.event_index, coalesce(e.event_type, 'Root') as edge_text, coalesce(c.n, 0) as child_count from {nodes} n left join {nodes} e on e.doc_id = n.doc_id and e.node_id = n.parent_node_id
  left join (select doc_id, parent_node_id, count(*) as n from {nodes} group by 1, 2) c on c.doc_id = n.doc_id and c.parent_node_id = n.node_id""")
def _(t):
    nodes = t("nodes").withColumn("node_id", C("node_id").cast("long"))
    edge = nodes.select("doc_id", C("node_id").alias("parent_node_id"), C("event_type").alias("edge_text"))
    children = nodes.groupBy("doc_id", C("parent_node_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    return nodes.join(edge, ["doc_id", "parent_node_id"], "left").join(children, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "event_index", F.coalesce("edge_text", F.lit("Root")).alias("edge_text"), F.coalesce("child_count", F.lit(0)).alias("child_count"))


@P.query("c17_advantage_rows", "select event_index, round(coalesce(m, 0), 6) as sibling_mean from {nodes} n left join (select doc_id, parent_node_id, avg(value) as m from {nodes} group by 1, 2) c on c.doc_id = n.doc_id and c.parent_node_id = n.node_id")
def _(t):
    nodes = t("nodes").withColumn("node_id", C("node_id").cast("long"))
    adv = nodes.groupBy("doc_id", C("parent_node_id").alias("node_id")).agg(F.avg("value").alias("m"))
    return nodes.join(adv, ["doc_id", "node_id"], "left").select("event_index", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("sibling_mean"))


QUERIES, ORACLES = P.queries, P.oracles
