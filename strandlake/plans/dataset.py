"""Queries that build datasets: filters, allocation, sampling, splits, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.operators import dataset as D
from strandlake.plans.base import Plans

P = Plans()
C = F.col
TRAINABLE = ["plain_scalar_or_simple_fraction", "exact_symbolic_numeric_expression"]
_LABELS = "[lower(trim(label_a)), lower(trim(label_b))]"
_MATH = f"list_contains({_LABELS}, 'math') and trim(prompt) <> '' and trim(answer) <> ''"
_HASH = "sha256(concat_ws('|', '{0}', cast({1} as varchar)))"
_FAMILY = "regexp_replace(list_extract(string_split(coalesce(nullif(original_dataset, ''), dataset_source), '/'), -1), '(?i)_(filtered|cleaned)$', '')"


def math_rows(t):
    rows = t("rl_rows")
    return rows.filter(D.is_math_row(X.labels(F.array("label_a", "label_b")), C("prompt"), F.array("answer"), "Math"))


@P.query("b01_math_rows", f"select doc_id, id from {{rl_rows}} where {_MATH}")
def _(t):
    return math_rows(t).select("doc_id", "id")


@P.query("b02_token_range", r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as token_count from {documents} where len(regexp_extract_all(text, '\S+')) between 50 and 200")
def _(t):
    return D.in_token_range(t("documents"), F.regexp_count("text", F.lit(r"\S+")), 50, 200).select("doc_id", "token_count")


@P.query("b03_answer_classes", "select doc_id, answer_class, row_number() over (order by doc_id) - 1 as index from (select doc_id, case when n_chars % 6 in (0, 2) then 'plain_scalar_or_simple_fraction' else 'exact_symbolic_numeric_expression' end as answer_class from {rl_rows} where n_chars % 6 in (0, 1, 2, 4))")
def _(t):
    return D.of_classes(t("rl_rows"), X.answer_class(C("answer")), TRAINABLE, "doc_id").select("doc_id", "answer_class", "index")


@P.query("b05_allow_list", "select doc_id, n_chars from {documents} where doc_id in (select doc_id from {labels} where quality = 0)")
def _(t):
    return D.allow_listed(t("documents"), t("labels").filter("quality = 0"), "doc_id").select("doc_id", "n_chars")


@P.query("b06_slice", "select doc_id, n_chars from {documents} order by n_chars desc, doc_id offset 25 limit 50")
def _(t):
    return D.sliced(t("documents").select("doc_id", "n_chars").withColumn("neg", -C("n_chars")), ["neg", "doc_id"], 25, 50).drop("neg")


_SKIP = "case when n_chars > 4000 then 'over_limit' when source = 'src3' then 'invalid' when n_chars < 400 then 'short' when lang = 'fr' then 'bad_blocks' end"


@P.query("b07_skip_reasons", f"select coalesce({_SKIP}, 'kept') as reason, count(*) as n from {{documents}} group by 1")
def _(t):
    reason = D.skip_reason((C("n_chars") > 4000, "over_limit"), (C("source") == "src3", "invalid"), (C("n_chars") < 400, "short"), (C("lang") == "fr", "bad_blocks"))
    return t("documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@P.query("b08_unprocessed", "select doc_id from {documents} where doc_id not in (select doc_id from {labels})")
def _(t):
    return D.unprocessed(t("documents").select("doc_id"), t("labels"), "doc_id")


@P.query("b09_without_system", "select conv_id, count(*) as n, string_agg(role, ',' order by turn) as roles from {conversations} where role <> 'system' group by 1")
def _(t):
    m = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    kept = F.filter("m", lambda x: x["role"] != "system")
    return m.select("conv_id", F.size(kept).cast("long").alias("n"), F.array_join(F.transform(kept, lambda x: x["role"]), ",").alias("roles")).filter("n > 0")


@P.query("b14_export", rf"select doc_id, row_number() over (order by doc_id) - 1 as index, {_FAMILY} as source_family, dataset_source as data_source, regexp_replace(prompt, '(?i)^\s*(user|human|assistant)\s*:\s*', '') as content, answer as truth, passrate from {{rl_rows}} where {_MATH}")
def _(t):
    out = D.exported(D.numbered(math_rows(t), "doc_id"))
    return out.select("doc_id", C("extra_info.index").alias("index"), C("extra_info.source_family").alias("source_family"), "data_source", C("prompt")[0]["content"].alias("content"), C("reward_model.ground_truth")[0].alias("truth"), C("extra_info.passrate").alias("passrate"))


@P.query("b16_train_eval", f"select doc_id, case when row_number() over (order by {_HASH.format(7, 'doc_id')}, doc_id) <= greatest(1, least((select count(*) from {{documents}}) - 1, round_even((select count(*) from {{documents}}) * 0.125, 0))) then 'eval' else 'train' end as split from {{documents}}")
def _(t):
    return D.train_eval(t("documents").select("doc_id"), "doc_id", 0.125, 7)


@P.query("b17_supervision", """with last as (select conv_id, max(turn) as stop from {conversations} where role = 'assistant' group by 1)
  select conv_id, string_agg(text, chr(10) order by turn) filter (turn < stop) as prompt, max(text) filter (turn = stop) as completion from {conversations} join last using (conv_id) group by 1""")
def _(t):
    m = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last = F.array_max(F.filter(F.transform("m", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull()))
    m = m.withColumn("last", last).filter("last is not null")
    prompt = F.array_join(F.transform(F.slice("m", F.lit(1), C("last")), lambda x: x["text"]), "\n")
    return m.select("conv_id", F.nullif(prompt, F.lit("")).alias("prompt"), F.get("m", C("last"))["text"].alias("completion"))


@P.query("b18_supervised_rows", "select doc_id from {documents} where contains(substr(text, 2), 'x')")
def _(t):
    # the mask of a text's letters "x" from the second character on
    masks = t("documents").select("doc_id", F.transform(F.split("text", ""), lambda c: F.when(c == "x", 1).otherwise(0)).alias("m"))
    return D.supervised(masks, "m").select("doc_id")


_BAL = """with cap as (select source, count(*) as cap from {documents} group by 1), lv as (select max(l) as level from (select unnest(range(0, (select max(cap) from cap) + 1)) as l) where (select sum(least(cap, l)) from cap) <= 150),
  base as (select source, least(cap, level) as b, cap > level as more from cap, lv), share as (select source, b + case when more and row_number() over (partition by more order by source) <= 150 - (select sum(b) from base) then 1 else 0 end as n from base)"""


@P.query("f01_allocation", f"{_BAL} select source, n::bigint as n from share")
def _(t):
    counts = t("documents").groupBy("source").agg(F.count("*").alias("capacity"))
    return D.allocated(counts, "source", "capacity", 150, "n").select("source", "n")


@P.query("f02_balanced_sample", f"{_BAL} select doc_id, source from (select *, row_number() over (partition by source order by {_HASH.format(42, 'doc_id')}, doc_id) as r from {{documents}}) join share using (source) where r <= n")
def _(t):
    return D.balanced(t("documents").select("doc_id", "source"), "source", "doc_id", 150, 42).select("doc_id", "source")


@P.query("f03_fraction_per_bucket", f"select doc_id, lang from {{documents}} qualify row_number() over (partition by lang order by {_HASH.format(3, 'doc_id')}, doc_id) <= round_even(count(*) over (partition by lang) * 0.25, 0)")
def _(t):
    return D.fraction_per_bucket(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.25, 3)


@P.query("f04_evenly_spaced", """with r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as a, count(*) over (partition by source) as n from {documents})
  select doc_id, source from r where n <= 7 or a in (select round_even(i * (n - 1) / 6, 0) from (select unnest(range(0, 7)) as i))""")
def _(t):
    return D.evenly_spaced(t("documents").select("doc_id", "source"), "source", ["doc_id"], 7)


@P.query("f05_sample_per_step", f"select step, doc_id from {{steps}} qualify row_number() over (partition by step order by {_HASH.format(5, 'doc_id')}, doc_id) <= 10")
def _(t):
    return D.sample_per_group(t("steps").select("step", "doc_id"), "step", "doc_id", 10, 5)


@P.query("f06_proportional_sample", f"""select doc_id, lang from (select *, row_number() over (partition by lang order by {_HASH.format(9, 'doc_id')}, doc_id) as r, count(*) over (partition by lang) as n, count(*) over () as total from {{documents}}) where r <= greatest(1, round_even(100 * n / total, 0))""")
def _(t):
    docs = t("documents").select("doc_id", "lang")
    return D.proportional(docs, "lang", "doc_id", 100, 9)


@P.query("f09_shortlist_size", "select event_index, least(num_candidates, greatest(3, ceil(log2(num_candidates) + 1)))::bigint as k from {pools}")
def _(t):
    return t("pools").select("event_index", D.shortlist_size(C("num_candidates"), 3).cast("long").alias("k"))


@P.query("f13_priority_merge", """select doc_id, priority, n_chars from (select doc_id, 0 as priority, n_chars from {documents} where doc_id % 3 = 0 union all select doc_id, 1, n_chars from {documents} where doc_id % 2 = 0) qualify row_number() over (partition by doc_id order by priority) = 1 order by priority, doc_id limit 400""")
def _(t):
    d = t("documents").select("doc_id", "n_chars")
    return D.merged_first_wins([d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0")], "doc_id", "doc_id", 400)


_BEFORE = r"(select doc_id, length(array_to_string(string_split(text, ' the ')[1:i], ' the '))::int as place from (select *, unnest(range(1, len(string_split(text, ' the ')))) as i from {documents}))"


@P.query("f15_candidate_points", f"select doc_id, place from {_BEFORE} where place between 100 and 400")
def _(t):
    return D.windows_of_text(t("documents").select("doc_id", "text"), "text", " the ", 100, 400).select("doc_id", "place")


@P.query("f16_doc_seed", "select doc_id, xor((11 * 1000003) & 2147483647, (doc_id * 2654435761) & 2147483647)::bigint as seed from {documents}")
def _(t):
    return t("documents").select("doc_id", D.doc_seed(11, C("doc_id")).cast("long").alias("seed"))


@P.query("f18_uniform_sample", f"select doc_id from (select doc_id from {{documents}} order by {_HASH.format(1, 'doc_id')}, doc_id limit 50)")
def _(t):
    return t("documents").select("doc_id").orderBy(D.hash_order(1, C("doc_id")), "doc_id").limit(50)


@P.query("g03_first_wins", "select * from (select source, lang, doc_id from {documents}) qualify row_number() over (partition by source order by doc_id) = 1")
def _(t):
    return D.first_of_each(t("documents").select("source", "lang", "doc_id"), "source", ["doc_id"])


@P.query("g04_text_counts", "select text, n, row_number() over (order by n desc, text) as item_id from (select text, count(*) as n from {candidates} group by 1)")
def _(t):
    return D.text_counts(t("candidates"), "text")


@P.query("g05_equal_texts", r"select pool_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as clean, min(doc_id) as first_id, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from {candidates} where trim(text) <> '' group by 1, 2")
def _(t):
    return D.equal_texts(t("candidates"), "pool_id", "doc_id", "text").withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@P.query("g06_overlay", "select doc_id, case when doc_id % 4 = 0 then 'new' else lang end as lang, case when doc_id % 4 = 0 then n_chars + 1 else n_chars end as n_chars from {documents}")
def _(t):
    base = t("documents").select("doc_id", "lang", "n_chars")
    new = t("documents").filter("doc_id % 4 = 0")
    new = new.select("doc_id", F.lit("old").alias("lang"), "n_chars", F.lit(0).alias("pos")).union(new.select("doc_id", F.lit("new"), C("n_chars") + 1, F.lit(1)))
    return D.overlaid(base, new, "doc_id", "pos")


@P.query("d21_source_audit", f"""select 'dataset_source' as name, dataset_source as value, count(*) as n from {{rl_rows}} group by 2 union all select 'original_dataset', original_dataset, count(*) from {{rl_rows}} group by 2
  union all select 'labels', array_to_string(list_sort({_LABELS}), ','), count(*) from {{rl_rows}} group by 2 union all select 'family', {_FAMILY}, count(*) from {{rl_rows}} group by 2""")
def _(t):
    rows = t("rl_rows").withColumns({"labels": F.array_join(X.labels(F.array("label_a", "label_b")), ","), "family": X.source_family(C("original_dataset"), C("dataset_source"))})
    return D.counts_by(rows, "dataset_source", "original_dataset", "labels", "family")


@P.query("d22_counts", "select 'source' as name, source as value, count(*) as n from {documents} group by 2 union all select 'lang', lang, count(*) from {documents} group by 2")
def _(t):
    return D.counts_by(t("documents"), "source", "lang")


QUERIES, ORACLES = P.queries, P.oracles
