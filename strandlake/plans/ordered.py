"""Queries over Arrow functions, ordered folds, nested joins, files and streams."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import answers as A
from strandlake.functions import text as X
from strandlake.operators import dataset as D
from strandlake.operators import metrics as M
from strandlake.operators import replay as R
from strandlake.operators import tree as TR
from strandlake.plans.base import Plans
from strandlake.plans.text import BLOCKS
from strandlake.sources import derived, files
from strandlake.sources.files import scratch
from strandlake.streaming import events as S

P = Plans()
C = F.col


@P.query("h07_completion_check")
def _(t):
    return t("traces").select("doc_id", A.udf_completion_check("trace").alias("r")).select("doc_id", "r.reason", "r.steer_count", "r.exec_count", "r.answer")


@P.query("b04_structure_split", None)
def _(t):
    return t("traces").select(A.udf_completion_check("trace").alias("r")).groupBy("r.reason").agg(F.count("*").alias("n"))


@P.query("h10_boxed_answers", r"select doc_id, concat('\boxed{{', n_chars, '}}') as value from {traces}")
def _(t):
    return t("traces").select("doc_id", F.array_join(A.udf_boxed_answers("trace"), "|").alias("value"))


@P.query("h12_candidate_answer", "select doc_id, cast(n_chars as varchar) as value from {traces}")
def _(t):
    return t("traces").select("doc_id", A.udf_candidate_answer("trace").alias("value"))


@P.query("h12_marker_answer", "select doc_id, case when doc_id % 2 = 0 then concat('-', n_chars) else lang end as value from {documents}")
def _(t):
    text = F.concat(F.lit("so the answer is: "), F.when(C("doc_id") % 2 == 0, F.concat(F.lit("-"), C("n_chars").cast("string"), F.lit(" or 7"))).otherwise(F.concat(F.lit("$"), C("lang"), F.lit("$ <|end|>"))))
    return t("documents").select("doc_id", A.udf_candidate_answer(text).alias("value"))


@P.query("h25_bare_edges", r"select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as value from {candidates}")
def _(t):
    return t("candidates").select("doc_id", A.udf_bare_edges(F.concat(F.lit("</steer> <exec> "), C("text"), F.lit(" </thi"))).alias("value"))


@P.query("h26_similarity")
def _(t):
    blocks = F.transform(X.segments(C("trace")), lambda b: X.normal_block(b["text"]))
    return t("traces").select("doc_id", F.round(A.udf_neighbour_similarity(blocks), 9).alias("value"))


@P.query("h36_token_count", r"select doc_id, len(regexp_extract_all(text, '\p{{L}}{{1,4}}|[0-9]{{1,3}}|[^\p{{L}}0-9\s]'))::int as n from {documents}")
def _(t):
    return t("documents").select("doc_id", A.udf_token_count("text").alias("n"))


#: Numbers, polynomials, sets and roots that are equal in other words, and numbers that are not.
@P.query("h49_answer_equivalence", "select doc_id, doc_id % 5 <> 4 as same from {documents}")
def _(t):
    k, n, m = C("doc_id") % 5, C("n_chars"), C("n_chars") % 1000
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    given = F.when(k == 0, of(n)).when(k == 1, of("\\boxed{(x+", n, ")^2}")).when(k == 2, of("\\{", n, ", ", n + 1, "\\}")).when(k == 3, of("\\sqrt{", m * m * 2, "}")).otherwise(of(m))
    gold = F.when(k == 0, of("\\dfrac{", n * 2, "}{2}")).when(k == 1, of("x^2 + ", n * 2, "x + ", n * n)).when(k == 2, of("\\{", n + 1, ",", n, ".0\\}")).when(k == 3, of(m, "\\sqrt2")).otherwise(of(m + 1))
    return t("documents").select("doc_id", A.udf_same_answer(given, gold).alias("same"))


@P.query("e21_repeat_runs")
def _(t):
    blocks = F.transform(X.segments(C("trace")), lambda s: X.normal_block(s["text"]))
    return t("traces").select("doc_id", F.array_join(F.transform(A.udf_repeat_runs(blocks), lambda n: n.cast("string")), ",").alias("runs"))


@P.query("b15_cleaned_payload", "select conv_id, count(*) filter (role <> 'system') + 1 as n, concat('done ', conv_id) as last from {conversations} group by 1")
def _(t):
    m = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", C("text").alias("content")))).alias("m"))
    prompt = F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    out = F.concat(prompt, F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("done "), C("conv_id").cast("string")).alias("content"))))
    return m.select("conv_id", out.alias("messages")).select("conv_id", F.size("messages").cast("long").alias("n"), F.element_at("messages", -1)["content"].alias("last"))


@P.query("j05_replay", """with s as (select doc_id, max(event_index) filter (event_type = 'doc_started') as start, count(*) filter (event_type = 'doc_started') as restarts from {event_log} group by 1)
  select doc_id, count(*) filter (event_type = 'node_created' and event_index > coalesce(start, -1))::int as nodes, count(*) filter (event_type = 'leaf_scored' and event_index > coalesce(start, -1))::int as leaves, count(*) filter (event_type = 'vllm_request' and event_index > coalesce(start, -1))::int as requests,
  bool_or(event_type = 'doc_finished' and event_index > coalesce(start, -1)) as finished, max(restarts)::int as restarts from {event_log} join s using (doc_id) group by 1""")
def _(t):
    return R.replayed(t("event_log"), "doc_id", "event_index")


@P.query("c12_before_after", "select doc_id, n_chars as after_chars, n_chars + 1 as before_chars from {documents}")
def _(t):
    after = t("documents").select("doc_id", C("n_chars").alias("after_chars"))
    before = t("documents").select("doc_id", C("n_chars").alias("chars"), F.lit(0).alias("pos")).union(t("documents").select("doc_id", C("n_chars") + 1, F.lit(1)))
    return R.paired(before, after, "doc_id", "pos").select("doc_id", "after_chars", C("before.chars").alias("before_chars"))


@P.query("c13_anomalies", "select doc_id, case when doc_id % 10 = 0 then 'missing_original' when doc_id % 10 = 1 then 'ambiguous_original' else 'invalid' end as anomaly from {documents} where doc_id % 10 in (0, 1) or n_chars < 300")
def _(t):
    new = t("documents").select("doc_id", "n_chars")
    old = t("documents").filter("doc_id % 10 <> 0").select("doc_id", "lang")
    old = old.unionAll(old.filter("doc_id % 10 = 1"))
    return R.with_anomalies(new, old, "doc_id", C("n_chars") >= 300)[1]


@P.query("c15_hydration", "select event_index, coalesce(string_agg(concat(choice_index, ':', replace(text, ' ', '+')), '|' order by choice_index) filter (choice_index is not null), '') as choices from {responses} left join {choices} on response_event_index = event_index group by 1")
def _(t):
    tokens = t("choices").select("response_event_index", "choice_index", F.posexplode(F.split("text", " ")).alias("token_index", "token_text"))
    out = R.hydrated(t("responses").select("event_index"), t("choices"), tokens)
    flat = F.array_join(F.transform("choices", lambda c: F.concat(c["choice_index"].cast("string"), F.lit(":"), F.array_join(c["tokens"], "+"))), "|")
    return out.select("event_index", F.coalesce(flat, F.lit("")).alias("choices"))


#: Steps are looked for by the first letter of their text, which repeats and is often missing behind the last one found.
@P.query("c19_alignment", r"""with recursive s as (select conv_id, turn::int as step, lower(substr(text, 1, 1)) as k, row_number() over (partition by conv_id order by turn) as i from {conversations} where turn % 2 = 0),
  p as (select conv_id, turn::int * 2 as place, lower(substr(text, 1, 1)) as k from {conversations} where turn % 4 <> 2 union all select conv_id, turn::int * 2 + 1, lower(substr(role, 1, 1)) from {conversations}),
  w as (select conv_id, 0::bigint as i, null::int as step, null::int as place, -1 as cursor from (select distinct conv_id from s)
    union all select w.conv_id, s.i, s.step, n.place, coalesce(n.place, w.cursor) from w join s on s.conv_id = w.conv_id and s.i = w.i + 1 left join lateral (select min(p.place) as place from p where p.conv_id = s.conv_id and p.k = s.k and p.place > w.cursor) n on true)
  select conv_id, step, place from w where i > 0""")
def _(t):
    key = lambda c: F.lower(F.substr(c, F.lit(1), F.lit(1))).alias("text")
    steps = t("conversations").filter("turn % 2 = 0").select("conv_id", C("turn").cast("int").alias("step"), key("text"))
    turn = C("turn").cast("int") * 2
    pairs = t("conversations").filter("turn % 4 <> 2").select("conv_id", turn.alias("place"), key("text")).unionAll(t("conversations").select("conv_id", (turn + 1).alias("place"), key("role")))
    return R.aligned(steps, pairs, "conv_id")


@P.query("c21_variants", "select doc_id as point, n_chars as baseline, n_chars * 2 as intervention from {documents}")
def _(t):
    d = t("documents")
    both = d.select(C("doc_id").alias("point"), F.lit("baseline").alias("variant"), C("n_chars").alias("x")).union(d.select("doc_id", F.lit("intervention"), C("n_chars") * 2))
    return R.variants(both, "point", "variant", "x", ("baseline", "intervention"))


@P.query("i24_delta_streams", """with p as (select event_id, user_id, lag(event_id % 10) over w as before, row_number() over w as i, count(*) over (partition by user_id) as n from {events} window w as (partition by user_id order by event_id)),
  o as (select user_id, string_agg(case when before is null then cast(event_id as varchar) else concat(before, ',', event_id) end, ',' order by event_id) as input from p group by 1)
  select event_id, case when before is null then cast(event_id as varchar) else concat(before, ',', event_id) end as part, (2 * i - 1 - case when before is null then 1 else 2 end)::bigint as begin, case when i = n then input end as input from p join o using (user_id)""")
def _(t):
    rows = t("events").select("event_id", "user_id", F.array("event_id").alias("delta"), F.array(C("event_id") % 10).alias("used"))
    parts = R.stream_parts(rows, "user_id", "event_id", "delta", "used")
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    inputs = R.rebuilt_stream(parts, "user_id", "event_id", last).select("event_id", text("input").alias("input"))
    return parts.select("event_id", text("part").alias("part"), "begin").join(inputs, "event_id", "left")


@P.query("k05_cluster_names", r"""with w as (select label, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) as w from {candidates}), tf as (select label, w, count(*) as tf from w where w <> '' group by all),
  idf as (select w, ln(1.0 + (select count(distinct label) from {candidates})) - ln(1.0 + count(*)) as idf from tf group by 1), r as (select label, w, row_number() over (partition by label order by round(tf * idf, 9) desc, w) as r from tf join idf using (w))
  select label, string_agg(w, ' ' order by r) as name from r where r <= 3 group by 1""")
def _(t):
    return R.named_clusters(t("candidates"), "label", "text")


@P.query("k09_transform_hook", "select doc_id, case when doc_id % 10 = 0 then lang else upper(lang) end as value, case when doc_id % 10 = 0 then 'ValueError: no' end as value_error from {documents}")
def _(t):
    def call(text: str) -> str:
        if text.endswith("!"):
            raise ValueError("no")
        return text.upper()

    rows = t("documents").select("doc_id", F.when(C("doc_id") % 10 == 0, F.concat("lang", F.lit("!"))).otherwise(C("lang")).alias("x"))
    return R.transformed(rows, "x", call, "value").select("doc_id", F.regexp_replace("value", "!$", "").alias("value"), "value_error")


@P.query("k10_splice_points", r"""with b as (select doc_id, regexp_extract_all(trace, '(?is)<steer>.*?</steer>|<exec>.*?</exec>') as raw from {traces}), n as (select doc_id, len(list_filter(raw, lambda x: trim(regexp_replace(regexp_replace(x, '^<[a-zA-Z]+>|</[a-zA-Z]+>$', '', 'g'), '\s+', ' ', 'g')) <> '')) as n from b),
  c as (select doc_id, n, i, floor(n * i / 3)::bigint + 1 as place, floor(n * (i + 1) / 3)::bigint as upto, ('0x' || sha256(concat('11|', doc_id, '|', i))[1:8])::bigint as h from n, (select unnest(range(0, 3)) as i)),
  p as (select distinct doc_id, n, place + h % greatest(upto - place, 1) as point from c)
  select doc_id, point::int as point, case when point / n <= 0.25 then 'early' when point / n >= 0.75 then 'late' else 'mid' end as bucket, concat(doc_id, '-', sha1(concat(doc_id, '|', point))[1:12]) as splice_id from p where point > 0 and point < n""")
def _(t):
    rows = t("traces").select("doc_id", X.segments(C("trace")).alias("blocks"))
    return R.splice_points(rows, "doc_id", "blocks", 3, 11).select("doc_id", "point", "bucket", "splice_id")


@P.query("k11_splices", "select conv_id, string_agg(case when k = 2 then concat(role, ',new') else role end, ',' order by turn) as roles from (select *, row_number() over (partition by conv_id order by turn) as k from {conversations}) group by 1 having count(*) >= 2")
def _(t):
    m = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("b")).filter(F.size("b") >= 2)
    return m.select("conv_id", F.array_join(R.spliced(C("b"), F.lit(2), F.array(F.lit("new"))), ",").alias("roles"))


@P.query("e23_preferred_progress", "select run_id, doc_id, event_index from {event_log} qualify row_number() over (partition by doc_id order by event_type = 'doc_finished' desc, doc_attempt desc, timestamp_utc desc, event_index) = 1")
def _(t):
    return R.preferred_progress(t("event_log"), "doc_id", [(C("event_type") == "doc_finished").desc(), C("doc_attempt").desc(), C("timestamp_utc").desc(), C("event_index")]).select("run_id", "doc_id", "event_index")


@P.query("a02_multi_object_lines", "select doc_id, 0 as position, concat('{{\"a\": ', doc_id, '}}') as object, cast(null as varchar) as error from {documents} union all select doc_id, 1, case when doc_id % 3 > 0 then concat('{{\"b\": \"}}{{\"}}') end, case when doc_id % 3 = 0 then concat('no object at offset ', length(concat('{{\"a\": ', doc_id, '}}'))) end from {documents}")
def _(t):
    line = F.concat(F.lit('{"a": '), C("doc_id").cast("string"), F.lit("}"), F.when(C("doc_id") % 3 == 0, "[1]").otherwise('{"b": "}{"}'))
    return files.decode_lines(t("documents").select("doc_id", line.alias("line")), "line").select("doc_id", "position", "object", "error")


def on_path(name: str, sql: str | None = None):
    """A query that needs the session and the folder itself."""

    def add(f):
        P.queries[name] = f
        if sql:
            P.oracles[name] = derived.duck(sql)
        return f

    return add


@on_path("a05_pruned_scan", "select doc_id, n_chars from {documents} where n_chars is not null")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "n_chars"], "n_chars")


@on_path("a01_jsonl_round_trip", "select conv_id, turn, role, text, cast(turn as varchar) as extra_turn from {conversations}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_jsonl(derived.table(spark, sf_dir, "conversations"), path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", "text", F.variant_get("_extra", "$.turn", "string").alias("extra_turn"))


@on_path("a04_line_count", "select count(*) as n from {conversations}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_jsonl(derived.table(spark, sf_dir, "conversations").select("conv_id", "turn"), path)
    n = files.count_lines(spark, path) + files.count_lines(spark, f"{path}-none")
    return spark.createDataFrame([(n,)], "n long")


@on_path("a06_csv_round_trip", "select event_id, event_type, value from {events}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_both(derived.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    a = spark.read.option("header", "true").schema("event_id long, event_type string, value double").csv(f"{path}.csv")
    return a.intersect(spark.read.parquet(f"{path}.parquet"))


@on_path("a12_step_folders", "select step::int as step, count(*) as n from {steps} group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = derived.table(spark, sf_dir, "steps").select("doc_id", C("step").alias("s"))
    rows.withColumn("batch_0_step", F.concat(F.lit("step_"), C("s").cast("string"))).write.partitionBy("batch_0_step").parquet(path)
    return files.steps_of_runs(spark, path).groupBy("step").agg(F.count("*").alias("n"))


@on_path("a15_cache_hits", "select case when doc_id % 2 = 0 then 'hit' else 'miss' end as kind, count(*) as n from {documents} group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", C("doc_id").cast("string").alias("k"))
    cache = docs.filter("doc_id % 2 = 0").select(F.sha2(C("k").cast("binary"), 256).alias("cache_key"), F.lit(1).alias("cached"))
    hits, misses = files.cached(docs, cache, "k")
    return hits.select(F.lit("hit").alias("kind")).union(misses.select(F.lit("miss"))).groupBy("kind").agg(F.count("*").alias("n"))


@on_path("a16_tensor_keys", "select p_name from {part} where regexp_matches(p_name, 'red|blue') group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.kept_tensors(derived.table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "red|blue")


@on_path("a16_tensor_rewrite", "select concat('layer.', p_partkey, '.lora_A') as name, [2] as shape, (p_partkey % 3)::int as part, p_size::double as first, p_partkey::double as second from {part} where p_size % 2 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        names = [f"layer.{k}.{'lora_A' if size % 2 == 0 else 'weight'}" for k, size in zip(group.column("p_partkey").to_pylist(), group.column("p_size").to_pylist())]
        data = {n: struct.pack("<2d", size, k) for n, k, size in zip(names, group.column("p_partkey").to_pylist(), group.column("p_size").to_pylist())}
        content = files.tensor_file({n: {"dtype": "F64", "shape": [2]} for n in names}, data, {"format": "pt"})
        return pa.table({"path": pa.array([str(group.column("part")[0].as_py())]), "content": pa.array([content], pa.binary())})

    part = derived.table(spark, sf_dir, "part").select("p_partkey", "p_size", (C("p_partkey") % 3).alias("part"))
    rows = files.tensor_rows(files.rewritten_tensors(part.groupBy("part").applyInArrow(build, "path string, content binary"), "lora_"))

    @F.pandas_udf("first double, second double")
    def numbers(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([struct.unpack("<2d", x) for x in data], columns=["first", "second"])

    return rows.withColumn("v", numbers("data")).select("name", "shape", C("path").cast("int").alias("part"), "v.first", "v.second")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.expr("case event_type when 'signup' then 'doc_started' when 'view' then 'node_created' when 'click' then 'leaf_scored' when 'purchase' then 'doc_finished' else 'vllm_request' end")
    return rows.select(C("event_id").alias("event_index"), F.concat(F.lit("run_"), (C("user_id") % 2).cast("string")).alias("run_id"), C("user_id").alias("doc_id"), kind.alias("event_type"), "value")


@on_path("j02_fan_out", "select case when event_type in ('doc_started', 'doc_finished') then 'lifecycle' when event_type = 'leaf_scored' then 'leaf_score' else event_type end as name, count(*) as n, max(event_index) as last_event_index from {event_log} group by 1 union all select 'event_log', count(*), max(event_index) from {event_log}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    S.fan_out(event_stream(spark, sf_dir), f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    parts = [spark.read.parquet(f"{out}/tables/{n}").agg(F.count("*").alias("n"), F.max("event_index").alias("last_event_index")).select(F.lit(n).alias("name"), "n", "last_event_index") for n in ["event_log", *sorted(set(S.TABLES.values()))]]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    return total


def finished(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """What a streaming aggregate holds once it has read all there is."""
    name, out = f"q_{uuid.uuid4().hex}", scratch(spark)
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@on_path("j04_live_progress", "select run_id, doc_id, max(event_index) as event_index, arg_max(event_type, event_index) as event_type, count(*) as events from {event_log} group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(S.live_progress(event_stream(spark, sf_dir)), "complete", spark)


@on_path("j08_follow", "select event_type, count(*) as n, max(event_index) as last_event_index from {event_log} group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"q_{uuid.uuid4().hex}"
    S.follow(event_stream(spark, sf_dir), name, scratch(spark)).awaitTermination()
    return spark.table(name)


#: Equal blocks only, which SQL can say: a run goes on with a block that one of the three before it equals.
@on_path("j07_repeat_detector", r"""with raw as (select doc_id, unnest(regexp_extract_all(trace, '(?s)<exec>(.*?)</exec>', 1)) as s, generate_subscripts(regexp_extract_all(trace, '(?s)<exec>(.*?)</exec>', 1), 1) as i from {traces}),
  b as (select doc_id, i, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) as s from raw), f as (select doc_id, i, coalesce(s <> '' and (s = lag(s) over w or s = lag(s, 2) over w or s = lag(s, 3) over w), false) as again from b window w as (partition by doc_id order by i))
  select doc_id as stream_id, coalesce(max(i), 0)::int as blocks, coalesce(max(i) - max(i) filter (not again) + 1, 0)::int as run from (select doc_id from {traces}) left join f using (doc_id) group by 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each trace comes in pieces of 97 characters, which cut tags and blocks anywhere
    traces = derived.table(spark, sf_dir, "traces").select(C("doc_id").alias("stream_id"), "trace")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("trace") / 97)), lambda i: F.struct(i.alias("event_index"), F.substr("trace", i.cast("int") * 97 + 1, F.lit(97)).alias("chunk")))
    path = scratch(spark)
    traces.select("stream_id", F.explode(pieces).alias("p")).select("stream_id", "p.*").write.parquet(path)
    rows = S.read_events(spark, path, spark.read.parquet(path).schema, 1000)
    return finished(S.repeat_detector(rows, 1.0), "update", spark)


@on_path("a08_sampled_shards", "select doc_id, source, shard::int as shard from (select *, doc_id % 8 as shard from {documents}) where shard in (select s from (select unnest(range(0, 8)) as s) order by sha256(concat('5|shard=', s)) limit 3)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    derived.table(spark, sf_dir, "documents").select("doc_id", "source", (C("doc_id") % 8).alias("shard")).write.partitionBy("shard").parquet(path)
    return files.sampled_shards(spark, path, 3, 5).select("doc_id", "source", C("shard").cast("int").alias("shard"))


@P.query("a07_shuffle_buffer", "with n as (select doc_id, row_number() over (order by doc_id) as i from {documents}), m as (select doc_id, i, i + ('0x' || sha256(concat('3|', doc_id))[1:8])::bigint % 100 as j from n) select doc_id, row_number() over (order by j, i) as place from m")
def _(t):
    return D.buffer_shuffled(t("documents").select("doc_id"), "doc_id", 100, 3)


@on_path("a03_jsonl_append", "select conv_id, turn, role, cast(null as varchar) as note from {conversations} union all select conv_id, turn, role, 'again' from {conversations} where turn = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark), derived.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    files.write_jsonl(rows.withColumn("note", F.lit(None).cast("string")), path)
    files.write_jsonl(rows.filter("turn = 0").withColumn("note", F.lit("again")), path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, note string").drop("_extra")


@on_path("a09_event_store", "select event_index, doc_id, event_type, value from {event_log}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.table(spark, sf_dir, "event_log").select("run_id", "event_index", "doc_id", "event_type", "value").withColumn("store", C("doc_id") % 4)
    rows = files.event_rows(files.event_store(log, "store"))
    return rows.select("event_index", F.from_json("row_json", "doc_id long, event_type string, value double").alias("r")).select("event_index", "r.*")


@P.query("a13_dotenv", "select concat('N_', upper(replace(n_name, ' ', '_'))) as key, concat(n_name, ' = ', n_regionkey) as value from {nation}")
def _(t):
    key = F.concat(F.lit("N_"), F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))))
    value = F.concat("n_name", F.lit(" = "), C("n_regionkey").cast("string"))
    lines = F.array(F.lit("# settings"), F.concat(key, F.lit("=old")), F.lit(""), F.lit("no setting"), F.concat(F.lit("  "), key, F.lit(' = "'), value, F.lit('" ')))
    return files.dotenv(t("nation").select(F.posexplode(lines).alias("position", "line")), "line", "position")


@on_path("a14_manifest", "select count(*) as rows, max(n_chars) as longest, cast(null as varchar) as note, list_sort(list(distinct lang)) as langs from {documents}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = scratch(spark), derived.table(spark, sf_dir, "documents")
    files.write_manifest(spark, path, docs.agg(F.count("*").alias("rows"), F.max("n_chars").alias("longest"), F.lit(None).cast("string").alias("note"), F.sort_array(F.collect_set("lang")).alias("langs")))
    return spark.read.schema("rows long, longest long, note string, langs array<string>").json(path)


@on_path("j10_stage_resume", "select * from (values ('one', true, true, true), ('two', false, true, false)) as t(stage, after_run, same_settings, after_change)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch(spark), scratch(spark)
    derived.table(spark, sf_dir, "nation").write.parquet(f"{out}/one")
    first = files.Manifest(spark, path)
    first.finish("one", [{"limit": 1}])
    after = [files.Manifest(spark, path).finished(s, [{"limit": 1}, {"k": 2}][:n], f"{out}/{s}") for n, s in ((1, "one"), (2, "two"))]
    derived.table(spark, sf_dir, "region").write.parquet(f"{out}/two")
    first.finish("two", [{"limit": 1}, {"k": 2}])
    same = [files.Manifest(spark, path).finished(s, [{"limit": 1}, {"k": 2}][:n], f"{out}/{s}") for n, s in ((1, "one"), (2, "two"))]
    changed = [files.Manifest(spark, path).finished(s, [{"limit": 1}, {"k": 3}][:n], f"{out}/{s}") for n, s in ((1, "one"), (2, "two"))]
    return spark.createDataFrame([(s, a, b, c) for s, a, b, c in zip(("one", "two"), after, same, changed)], "stage string, after_run boolean, same_settings boolean, after_change boolean")


def event_files(spark: SparkSession, sf_dir: str, path: str, parts: int, part: int) -> None:
    """Adds a part of the events to a folder that a stream reads."""
    rows = derived.table(spark, sf_dir, "event_log").select("event_index", "run_id", "doc_id", "event_type", "value")
    rows.filter(C("event_index") % parts == part).coalesce(1).write.mode("append").parquet(path)


_KINDS = "case when event_type in ('doc_started', 'doc_finished') then 'lifecycle' when event_type = 'leaf_scored' then 'leaf_score' else event_type end"


@on_path("j01_event_log", "select event_index, doc_id, event_type, row_number() over (order by event_index) as place from {event_log}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch(spark), scratch(spark)
    for part in range(2):
        event_files(spark, sf_dir, path, 2, part)
        S.append_log(S.read_events(spark, path, spark.read.parquet(path).schema), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return D.ranked(spark.read.parquet(f"{out}/log").select("event_index", "doc_id", "event_type"), [C("event_index")], "place")


@on_path("j03_incremental", f"select event_index % 3 as part, {_KINDS} as name, count(*) as n from {{event_log}} group by 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch(spark), scratch(spark)
    for part in range(3):  # each run sees what is new since the one before
        event_files(spark, sf_dir, path, 3, part)
        S.fan_out(S.read_events(spark, path, spark.read.parquet(path).schema), f"{out}/tables", f"{out}/checkpoint").awaitTermination()
    tables = [spark.read.parquet(f"{out}/tables/{n}").groupBy(C("batch").cast("long").alias("part")).agg(F.count("*").alias("n")).select("part", F.lit(n).alias("name"), "n") for n in sorted(set(S.TABLES.values()))]
    total = tables[0]
    for x in tables[1:]:
        total = total.unionAll(x)
    return total


@on_path("a10_event_append", f"select {_KINDS} as name, count(*) as n, count(distinct event_index) as ids from {{event_log}} group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch(spark), scratch(spark)
    event_files(spark, sf_dir, path, 1, 0)
    for attempt in range(2):  # a batch that is run again, as after a failure, replaces what it wrote
        S.fan_out(S.read_events(spark, path, spark.read.parquet(path).schema), f"{out}/tables", f"{out}/checkpoint{attempt}").awaitTermination()
    tables = [spark.read.parquet(f"{out}/tables/{n}").agg(F.count("*").alias("n"), F.count_distinct("event_index").alias("ids")).select(F.lit(n).alias("name"), "n", "ids") for n in sorted(set(S.TABLES.values()))]
    total = tables[0]
    for x in tables[1:]:
        total = total.unionAll(x)
    return total


@on_path("a11_background_writer", "select event_index % 4 as batch, count(*) as n from {event_log} group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch(spark), scratch(spark)
    for part in range(4):
        event_files(spark, sf_dir, path, 4, part)
    S.append_log(S.read_events(spark, path, spark.read.parquet(path).schema, 1), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    written = spark.read.parquet(f"{out}/log")
    # a micro-batch for each file; which comes first is the source's to say
    per = written.groupBy("batch", (C("event_index") % 4).alias("part")).agg(F.count("*").alias("n"))
    return per.groupBy(C("part").alias("batch")).agg(F.sum("n").alias("n"), F.count("*").alias("batches")).filter("batches = 1").drop("batches")


@P.query("h11_last_box", r"select doc_id, case doc_id % 4 when 0 then n_chars::varchar when 1 then concat('{{', lang, '}}') when 2 then concat(source, ' ') end as value from {documents}")
def _(t):
    k = C("doc_id") % 4
    box = lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    end = F.when(k == 0, F.concat(box(C("lang")), box(C("n_chars").cast("string")))).when(k == 1, box(F.concat(F.lit("{"), C("lang"), F.lit("}")))).when(k == 2, F.concat(box(C("lang")), F.lit(" $\\boxed "), C("source"), F.lit(" $"))).otherwise(F.concat(box(C("lang")), F.lit("\\boxed{"), C("source")))
    return t("documents").select("doc_id", A.udf_last_box(F.concat("text", end)).alias("value"))


@P.query("g08_answer_sets", "select doc_id, case doc_id % 3 when 0 then true when 1 then lang = 'en' else false end as same from {documents}")
def _(t):
    k = C("doc_id") % 3
    left = F.when(k == 0, F.concat(F.lit("\\text{ "), F.upper("lang"), F.lit("}"))).when(k == 1, F.concat(F.lit("\\boxed{\\mathrm{"), C("lang"), F.lit("}}"))).otherwise(C("source"))
    right = F.when(k == 0, C("lang")).when(k == 1, F.lit("EN")).otherwise(F.concat("source", F.lit("x")))
    return t("documents").select("doc_id", F.arrays_overlap(A.udf_variants(left), A.udf_variants(right)).alias("same"))


@P.query("i15_run_ids", "select event_id, strftime(ts, 'run_%Y%m%d_%H%M%S') as run_id from {events}")
def _(t):
    return t("events").select("event_id", files.run_id("run", C("ts")).alias("run_id"))


@on_path("k13_registered", "select doc_id, n_chars::varchar as answer, true as same from {traces} where doc_id % 2 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    A.register(spark)
    sql = "select doc_id, strandlake_last_box(trace) as answer, strandlake_same_answer(strandlake_last_box(trace), concat(cast(n_chars as string), '.0')) as same from {rows} where doc_id % 2 = 0"
    return spark.sql(sql, rows=derived.table(spark, sf_dir, "traces"))


@P.query("c14_sections_with_think", "select d.doc_id, d.source, t.n_chars as think_chars from {documents} d left join (select doc_id, n_chars from {documents} where doc_id % 3 > 0) t using (doc_id)")
def _(t):
    thinks = t("documents").filter("doc_id % 3 > 0").select("doc_id", C("n_chars").alias("think_chars"))
    return R.with_think(t("documents").select("doc_id", "source"), thinks, "doc_id")


@P.query("d35_run_outputs", """with f as (select * from {event_log} where event_type = 'doc_finished' qualify row_number() over (partition by doc_id order by doc_attempt desc, event_index desc) = 1)
  select selector_mode, count(*) as docs, round(avg(value), 6) as mean, round(median(value), 6) as median from f group by 1""")
def _(t):
    return M.run_outputs(t("event_log"), "selector_mode", "value").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@P.query("d40_curation_summary", """select count(*) as n, count(*) filter (n_chars > 512) as changed, max(n_chars) as before_max, max(least(n_chars, 512)) as after_max, count(*) filter (n_chars > 1024) as far_over from {documents}""")
def _(t):
    return M.curation_summary(t("documents"), "n_chars", 512)


@P.query("f11_sanitized_picks", """with r as (select pool_id, doc_id, text, row_number() over (partition by pool_id, text order by doc_id) as dup from {candidates}), o as (select *, row_number() over (partition by pool_id order by dup, doc_id) as place, count(*) over (partition by pool_id) as n from r)
  select pool_id, slot, doc_id from o join (select unnest(range(0, 4)) as slot) on place = slot % n + 1""")
def _(t):
    return R.sanitized_picks(t("candidates"), "pool_id", "doc_id", "text", 4)


@P.query("f12_top_bottom_clusters", """with s as (select label, count(*) as n from {candidates} group by 1), r as (select *, row_number() over (order by n desc, label) as a, row_number() over (order by n, label) as b from s)
  select label, n, case when a <= 3 then 'top' else 'bottom' end as side, doc_id from r join (select label, doc_id, row_number() over (partition by label order by doc_id) as k from {candidates}) using (label) where (a <= 3 or b <= 3) and k <= 3""")
def _(t):
    return R.top_and_bottom(t("candidates"), "label", "doc_id", 3, 3)


@P.query("h05_trace_shapes", BLOCKS + """, j as (select doc_id, string_agg(concat('<', kind, '>', text, '</', kind, '>'), chr(10) order by k) as joined from b group by 1)
  select d.doc_id, case d.doc_id % 4 when 0 then trace when 1 then coalesce(joined, concat('a ', d.text)) when 2 then concat('a ', d.text) else d.text end as value from {documents} d join {traces} t using (doc_id) left join j using (doc_id)""")
def _(t):
    k = C("doc_id") % 4
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    messages = F.array(message("assistant", F.lit("first")), message("assistant", C("text")), message("user", F.lit("x")))
    blocks = F.when(k == 1, X.segments(C("trace"))).otherwise(F.slice(X.segments(F.lit("")), 1, 0))
    value = X.trace_of(F.when(k == 0, C("trace")), blocks, F.when((k == 1) | (k == 2), F.concat(F.lit("a "), "text")), messages)
    return t("documents").select("doc_id", "text").join(t("traces").select("doc_id", "trace"), "doc_id").select("doc_id", value.alias("value"))


#: Traces that end anywhere, a third of them inside a closing tag.
_CUT = "case when doc_id % 3 = 0 and contains(trace, '</exec>') then substr(trace, 1, strpos(trace, '</exec>') + doc_id % 8 - 1) else substr(trace, 1, 40 + doc_id % 500) end"


@P.query("h27_boundaries", rf"""select doc_id, case when regexp_matches(x, '<(?:steer|exec)>\s*$') then x when regexp_extract(x, '(?s)^.*<(/?exec)>', 1) = 'exec' then concat(regexp_replace(x, '(?:</exec|</exe|</ex|</e|</|<)$', ''), '</exec>', chr(10))
  when regexp_matches(x, '</exec>\s*$') then concat(regexp_replace(x, '\s+$', ''), chr(10)) else x end as value from (select doc_id, {_CUT} as x from {{traces}})""")
def _(t):
    return t("traces").select("doc_id", X.at_boundary(F.expr(_CUT.replace("strpos(trace, '</exec>')", "instr(trace, '</exec>')"))).alias("value"))


@P.query("h37_first_tokens", r"select doc_id, rtrim(substr(text, 1, length(regexp_extract(text, '^(?:\s*(?:\p{{L}}{{1,4}}|[0-9]{{1,3}}|[^\p{{L}}0-9\s])){{0,9}}')))) as value from {documents}")
def _(t):
    return t("documents").select("doc_id", A.udf_first_tokens("text", F.lit(9)).alias("value"))


@P.query("h46_previous_steps", "select conv_id, turn, coalesce(string_agg(role, ' >> ') over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '') as chain from {conversations}")
def _(t):
    return R.previous_chain(t("conversations"), ["conv_id"], "turn", "role", 2).select("conv_id", "turn", "chain")


@P.query("i21_branch_index_json", """select doc_id, source as data_source, case when doc_id % 3 = 0 then concat('tree:', lang) else concat('t', doc_id) end as branch_tree_id, concat('n', n_chars % 7) as leaf_node_id, (n_chars % 7)::int as branch_depth, case when n_chars % 7 > 1 then concat('n', n_chars % 7 - 1) end as parent_branch_id,
  list_transform(range(0, n_chars % 7 + 1), lambda i: concat('n', i)) as path_node_ids from {documents}""")
def _(t):
    depth = (C("n_chars") % 7).cast("int")
    path = F.transform(F.sequence(F.lit(0), depth), lambda i: F.concat(F.lit("n"), i.cast("string")))
    index = TR.branch_index(C("lang"), F.when(C("doc_id") % 3 > 0, F.concat(F.lit("t"), C("doc_id").cast("string"))), path, F.transform(F.slice(path, F.lit(2), depth), lambda _: F.lit(0)))
    rows = t("documents").select("doc_id", C("source").alias("data_source"), TR.index_json(index).alias("json"))
    out = rows.withColumn("i", TR.index_of_json(C("json")))
    return out.select("doc_id", "data_source", "i.branch_tree_id", "i.leaf_node_id", "i.branch_depth", "i.parent_branch_id", "i.path_node_ids")


@P.query("i23_flat_metrics", "select checkpoint_id, aime25 as score from {checkpoints}")
def _(t):
    m = F.create_map(F.lit("avg_at_32,none"), C("aime25"), F.lit("stderr,none"), F.lit(0.0), F.lit("alias"), F.lit(1.0))
    return t("checkpoints").select("checkpoint_id", R.one_metric(m, "avg_at_").alias("score"))


@P.query("k12_window_check", BLOCKS + r""", w as (select doc_id, k - 1 as i, kind, text, len(regexp_extract_all(text, '\S+')) > 12 as long from b where k <= 2 + (doc_id % 5 = 0)::int),
  e as (select doc_id, count(*) as n, max(text) filter (i = 0) as first, string_agg(concat_ws('|', case when kind <> case when i % 2 = 0 then 'steer' else 'exec' end then concat('order@', i) end, case when long then concat('long@', i) end), '|' order by i) filter (long or kind <> case when i % 2 = 0 then 'steer' else 'exec' end) as errors from w group by 1)
  select doc_id, case when coalesce(n, 0) <> 2 then 'pair_count' when doc_id % 5 = 1 then 'first_steer' else coalesce(string_split(errors, '|')[1], 'ok') end as value from {traces} left join e using (doc_id)""")
def _(t):
    rows = t("traces").select("doc_id", F.slice(X.segments(C("trace")), F.lit(1), F.when(C("doc_id") % 5 == 0, 3).otherwise(2)).alias("blocks"))
    wanted = F.when(C("doc_id") % 5 == 1, "another plan").otherwise(F.get("blocks", F.lit(0))["text"])
    return rows.select("doc_id", X.window_check(C("blocks"), 1, wanted, 12).alias("value"))


@P.query("j12_completed_rows", "select conv_id from {conversations} group by 1 having count(*) = 6")
def _(t):
    rows = t("conversations").groupBy("conv_id").agg(F.collect_list("text").alias("g"))
    return S.completed_rows(rows, "g", 6).select("conv_id")


QUERIES, ORACLES = P.queries, P.oracles
