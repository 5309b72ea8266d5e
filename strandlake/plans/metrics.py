"""Queries over runs: summaries, curves, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.operators import metrics as M
from strandlake.plans.base import Plans
from strandlake.plans.text import CLASS, FLAGS, leaf_flags

P = Plans()
C = F.col
CLASSES = ["Correct", "Wrong boxed answer", "Missing boxed answer", "Malformed steer/think boundary", "Length limit / truncation", "Tag structure violation", "Other incorrect"]


@P.query("d09_failure_summary", f"""select selector_mode, count(*) as leaf_count, count(*) filter (right_) as right_count, avg(length_tokens_total) filter (right_) as right_length, avg(length_tokens_total) filter (not right_) as wrong_length,
  {", ".join(f"count(*) filter (c = '{c}') as {M.column_name(c)}" for c in CLASSES)} from (select *, {CLASS} as c from {FLAGS}) group by 1""")
def _(t):
    c = C
    rows = leaf_flags(t).withColumn("class", X.primary_failure(c("right"), c("stop_reason"), c("issues"), c("boxed"), c("answer"), c("valid"))).withColumn("length", c("length_tokens_total"))
    return M.failure_summary(rows, ["selector_mode"], CLASSES)


_BODY = r"regexp_extract_all(trace, '(?is)<exec>(.*?)</exec>', 1)"


@P.query("d10_text_density", rf"""select lang, count(*) as leaf_count, sum(length(trace))::bigint as total_chars, sum(len(regexp_extract_all(trace, '(?i)\bthe\b')))::bigint as word_count, sum(len({_BODY}))::bigint as exec_block_count,
  sum(coalesce(list_sum(list_transform({_BODY}, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))), 0))::bigint as exec_block_chars, sum(len(regexp_extract_all(trace, '(?i)\bthe\b'))) * 1e6 / sum(length(trace)) as per_million_chars from {{traces}} group by 1""")
def _(t):
    return M.text_density(t("traces"), ["lang"], "trace", "the")


@P.query("d11_mean_and_error", "select run_name, step, avg(n_chars) as mean, coalesce(stddev_samp(n_chars) / sqrt(count(n_chars)), 0) as stderr, avg(n_chars) filter (doc_id % 2 = 0) as mean_if, avg(n_chars) filter (doc_id % 2 <> 0) as mean_if_not from {steps} group by all")
def _(t):
    return M.mean_and_error(t("steps"), ["run_name", "step"], "n_chars", C("doc_id") % 2 == 0)


@P.query("d12_correlation", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 9) as r, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from {lineitem} group by 1")
def _(t):
    out = M.correlation(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("r", 9).alias("r"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@P.query("d18_length_summary", "select selector_mode, count(length_tokens_total) as n, coalesce(avg(length_tokens_total), 0) as mean, coalesce(median(length_tokens_total), 0) as median, round(coalesce(stddev_pop(length_tokens_total), 0), 6) as std from {leaf_score} group by 1")
def _(t):
    return M.length_summary(t("leaf_score"), ["selector_mode"], "length_tokens_total").withColumn("std", F.round("std", 6))


@P.query("d19_percentiles", "select source, sum(n_chars)::bigint as total, min(n_chars) as min, max(n_chars) as max, avg(n_chars) as mean, round(stddev_pop(n_chars), 6) as std, " + ", ".join(f"quantile_cont(n_chars::double, {q}) as p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " from {documents} group by 1")
def _(t):
    return M.percentile_summary(t("documents"), ["source"], "n_chars").withColumn("std", F.round("std", 6))


@P.query("e11_moving_average", "select run_name, step, x, avg(x) over (partition by run_name order by step rows between 2 preceding and 2 following) as smooth from (select run_name, step, avg(n_chars) as x from {steps} group by all)")
def _(t):
    return M.moving_average(t("steps").groupBy("run_name", "step").agg(F.avg("n_chars").alias("x")), ["run_name"], "step", "x", 5)


@P.query("e18_ecdf", "select doc_id, dataset_source, passrate, row_number() over (partition by dataset_source order by passrate, doc_id) / count(*) over (partition by dataset_source) as ecdf from {rl_rows}")
def _(t):
    return M.ecdf(t("rl_rows").select("doc_id", "dataset_source", "passrate"), ["dataset_source"], "passrate", "doc_id")


@P.query("e19_histogram", """with b as (select dataset_source, least(floor(passrate * 10), 9)::int as bin from {rl_rows}), c as (select dataset_source, bin, count(*) as n from b group by all union all select null, bin, count(*) from b group by 2)
  select dataset_source, bin, n, n / sum(n) over (partition by dataset_source) as share from c""")
def _(t):
    return M.histogram(t("rl_rows"), "dataset_source", "passrate", 10).select("dataset_source", "bin", "n", "share")


@P.query("e20_checkpoint_ranking", "select checkpoint_id, checkpoint_label, aime_mean, row_number() over (order by aime_mean desc, math500 desc, coalesce(checkpoint_step, 1000000000000000000) desc, checkpoint_id) as rank from (select *, (aime24 + aime25) / 2 as aime_mean from {checkpoints} where aime24 is not null)")
def _(t):
    return M.checkpoint_ranking(t("checkpoints")).select("checkpoint_id", "checkpoint_label", "aime_mean", "rank")


@P.query("c20_completeness", "select checkpoint_id, case when aime24 is null then 'aime24' else '' end as missing, aime24 is not null as complete from {checkpoints}")
def _(t):
    return M.completeness(t("checkpoints"), ["aime24", "aime25", "math500"]).select("checkpoint_id", "missing", "complete")


@P.query("e22_remaining", "select event_id, greatest(max(value) over (partition by user_id order by event_id rows between unbounded preceding and current row) - value, 0) as done from {events}")
def _(t):
    return M.remaining_estimate(t("events"), ["user_id"], "event_id", "value").select("event_id", "done")


@P.query("d25_rollout_summary", """with o as (select doc_id, count(distinct nullif(doc_attempt, 0)) as c, sum(value) as d, max(value) as m, count(*) as n, count(nullif(doc_attempt, 0)) as w, count(*) filter (selector_mode = 'random') as r from {event_log} group by 1)
  select round(sum(d) / sum(n), 6) as depth_mean, max(m) as depth_max, sum(w) / sum(n) as clustered_ratio, avg(c) as clusters_per_prompt, sum(r) / sum(n) as random_ratio from o""")
def _(t):
    return M.rollout_summary(t("event_log").withColumn("cluster", F.nullif("doc_attempt", F.lit(0))), "doc_id", "cluster", "value", "selector_mode").withColumn("depth_mean", F.round("depth_mean", 6))


@P.query("d26_finite_summary", "select event_type, round(avg(x), 9) as mean, max(x) as max, min(x) as min from (select event_type, case when event_id % 10 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double when event_id % 13 = 0 then null else value end as x from {events}) where x is not null and not isnan(x) and not isinf(x) group by 1")
def _(t):
    x = F.when(C("event_id") % 10 == 0, F.lit(float("nan"))).when(C("event_id") % 11 == 0, F.lit(float("inf"))).when(C("event_id") % 13 == 0, F.lit(None)).otherwise(C("value"))
    return M.finite_summary(t("events").withColumn("x", x), ["event_type"], "x").withColumn("mean", F.round("mean", 9))


@P.query("d27_diversity", """with o as (select doc_id, count(text_preview) as g, count(distinct text_preview) as d, avg(verification) as r, bool_and(verification = 0) as z from {leaf_score} group by 1)
  select sum(g)::bigint as given, sum(d)::bigint as distinct_answers, sum(d) / sum(g) as ratio, round(avg(r), 9) as rate_mean, max(r) as rate_max, min(r) as rate_min, count(*) filter (z) as zero_prompts, count(*) filter (z) / count(*) as zero_ratio from o""")
def _(t):
    return M.diversity(t("leaf_score"), "doc_id", "text_preview", "verification").withColumn("rate_mean", F.round("rate_mean", 9))


def _blocks(tag: str) -> str:
    return rf"regexp_extract_all(trace, '(?is)<{tag}>(.*?)(?:</{tag}>|$)', 1)"


def _words(tag: str) -> str:
    return rf"coalesce(list_sum(list_transform({_blocks(tag)}, lambda x: len(regexp_extract_all(x, '\S+')))), 0)"


@P.query("d28_block_structure", f"""select lang, {", ".join(f"sum(len({_blocks(g)}))::bigint as {g}_blocks, sum({_words(g)})::bigint as {g}_words" for g in ("steer", "exec"))}, avg(len({_blocks("exec")})) as exec_blocks_mean,
  coalesce(sum({_words("exec")}) / nullif(sum(len({_blocks("exec")})), 0), 0) as words_per_exec from {{traces}} group by 1""")
def _(t):
    return M.block_structure(t("traces"), ["lang"], "trace")


@P.query("d29_repetition", """select count(*) as n, count(*) filter (f) as forced, count(*) filter (f) / count(*) as forced_ratio, count(*) filter (f and kind = 'exec') as exec_forced, count(*) filter (f and kind = 'steer') as steer_forced,
  avg(x) filter (kind = 'exec') as exec_mean, avg(x) filter (kind = 'steer') as steer_mean from (select stop_reason like 'repeated_%' as f, case when event_index % 2 = 0 then 'exec' else 'steer' end as kind, length_tokens_exec as x from {leaf_score})""")
def _(t):
    rows = t("leaf_score").select(C("stop_reason").startswith("repeated_").alias("f"), F.when(C("event_index") % 2 == 0, "exec").otherwise("steer").alias("kind"), C("length_tokens_exec").alias("x"))
    return M.repetition(rows, "kind", "f", "x")


@P.query("d32_group_sizes", """with r as (select *, sum(case when p = kind then 0 else 1 end) over (order by event_id) as run from (select event_id, event_type as kind, lag(event_type) over (order by event_id) as p from {events}))
  select min(event_id) as begin, kind, count(*) as n from r group by run, kind having count(*) <> 1""")
def _(t):
    return M.group_sizes(t("events").select("event_id", C("event_type").alias("kind")), "event_id", "kind", 1)


@P.query("d33_avg_at_k", "select doc_id, avg(verification) as avg_at_k, count(*) as k from {leaf_score} where verification is not null group by 1")
def _(t):
    return M.avg_at_k(t("leaf_score").filter("verification is not null"), ["doc_id"], "verification")


@P.query("d34_metric_means", """with o as (select leaf_event_index, metric_name, avg(try_cast(metric_text as double)) as m, min(metric_text) as x from {leaf_metric} group by all)
  select metric_name, round(avg(m), 9) as mean, min(x) filter (m is null) as text, count(*) as docs from o group by 1""")
def _(t):
    return M.metric_means(t("leaf_metric"), "leaf_event_index", "metric_name", "metric_text").withColumn("mean", F.round("mean", 9))


@P.query("d36_majority_name", "select label, coalesce(arg_min(name, (-n, name)) filter (name is not null), concat('Cluster ', label)) as majority from (select label, case when label = 3 or trim(text) = '' then null else text end as name, count(*) as n from {candidates} group by all) group by 1")
def _(t):
    return M.majority_name(t("candidates").withColumn("name", F.when(C("label") == 3, "nan").otherwise(C("text"))), "label", "name")


@P.query("d37_source_mix", "select label, string_agg(concat(source, '=', n), ',' order by source) as mix from (select label, source, count(*) as n from {candidates} join (select doc_id, source from {documents}) using (doc_id) group by all) group by 1")
def _(t):
    out = M.source_mix(t("candidates").join(t("documents").select("doc_id", "source"), "doc_id"), "label", "source")
    return out.select("label", F.array_join(F.transform(F.map_entries("mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("mix"))


@P.query("d38_text_frequencies", """with o as (select text, label, count(*) as n from {candidates} group by all), m as (select text, string_agg(concat(label, 'x', n), ',' order by n desc, label) as clusters from o group by 1)
  select text, occurrences, attempts, clusters from (select text, count(*) as occurrences, count(distinct pool_id) as attempts from {candidates} group by 1) join m using (text)""")
def _(t):
    return M.text_frequencies(t("candidates"), "text", "pool_id", "label")


@P.query("d39_validation", r"select count(*) as n, count(distinct doc_id) as ids, min(n_chars) as min, max(n_chars) as max, sum(len(regexp_extract_all(text, '(?i)\bthe\b')))::bigint as keywords, count(*) filter (contains(text, '  ')) as double_spaces from {documents}")
def _(t):
    return M.validation(t("documents"), "doc_id", "text", "n_chars")


@P.query("d42_partial_run", "select avg(verification) as mean, count(verification) as completed, count(verification) = 60000 as complete from {leaf_score}")
def _(t):
    return M.partial_run(t("leaf_score"), "verification", 60000)


@P.query("f17_null_aware_order", """select checkpoint_id, row_number() over (order by aime24 asc nulls last, checkpoint_id) as lowest, row_number() over (order by aime24 desc nulls last, checkpoint_id) as highest, row_number() over (order by math500 desc, checkpoint_id) as most from {checkpoints}""")
def _(t):
    return M.null_aware_order(t("checkpoints"), "aime24", "math500", "checkpoint_id").select("checkpoint_id", "lowest", "highest", "most")


@P.query("d13_least_squares", "select l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from {lineitem} group by 1")
def _(t):
    out = M.least_squares(t("lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")
    return out.select("l_linestatus", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@P.query("d15_leaf_variance", "select doc_id, doc_attempt, round(coalesce(var_pop(verification), 0) + 0.000000000001, 9) as verification_variance, round(coalesce(var_pop(length_tokens_total), 0) + 0.00001, 3) as length_tokens_total_variance from {leaf_score} group by 1, 2")
def _(t):
    out = M.leaf_variance(t("leaf_score"), ["doc_id", "doc_attempt"], "verification", "length_tokens_total")
    return out.select("doc_id", "doc_attempt", F.round(C("verification_variance") + 1e-12, 9).alias("verification_variance"), F.round(C("length_tokens_total_variance") + 0.00001, 3).alias("length_tokens_total_variance"))


_SERIES = "try_cast(case when doc_id % 5 = 0 then 'n/a' when doc_id % 7 = 0 then null else concat(' ', cast(n_chars as varchar), '.5') end as double)"


@P.query("d20_series_summary", f"select source, count(x) as count, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, min(x) as min, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, max(x) as max from (select source, {_SERIES} as x from {{documents}}) group by 1")
def _(t):
    x = F.when(C("doc_id") % 5 == 0, "n/a").when(C("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), C("n_chars").cast("string"), F.lit(".5")))
    return M.series_summary(t("documents").withColumn("x", x), ["source"], "x").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@P.query("d41_union_means", """with e as (select doc_id, 'chars' as key, cast(n_chars as varchar) as value from {documents} union all select doc_id, 'lang', lang from {documents} where doc_id % 2 = 1 union all select doc_id, source, case when doc_id % 3 = 0 then 'none' else cast(doc_id as varchar) end from {documents})
  select key, round(avg(try_cast(value as double)), 6) as mean, case when avg(try_cast(value as double)) is null then arg_min(value, doc_id) end as text, count(value) as n from e group by 1""")
def _(t):
    d = t("documents")
    m = F.map_concat(F.create_map(F.lit("chars"), C("n_chars").cast("string")), F.when(C("doc_id") % 2 == 1, F.create_map(F.lit("lang"), C("lang"))).otherwise(F.create_map().cast("map<string,string>")), F.create_map(C("source"), F.when(C("doc_id") % 3 == 0, "none").otherwise(C("doc_id").cast("string"))))
    return M.union_means(d.select("doc_id", m.alias("m")), "m", "doc_id").withColumn("mean", F.round("mean", 6))


QUERIES, ORACLES = P.queries, P.oracles
