"""Queries over numbers, JSON, spans, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import arrays as A
from strandlake.functions import numeric as N
from strandlake.functions import text as X
from strandlake.operators import embed as V
from strandlake.plans.base import Plans

P = Plans()
C = F.col


@P.query("i01_probability", "select event_id, round(case when lp <= -1e9 then 0 else exp(lp) end, 9) as p from (select event_id, case when event_id % 9 = 0 then -1e9 else -value / 10 end as lp from {events})")
def _(t):
    lp = F.when(C("event_id") % 9 == 0, -1e9).otherwise(-C("value") / 10)
    return t("events").select("event_id", F.round(N.probability(lp), 9).alias("p"))


@P.query("i02_top_logprobs", "select event_id, concat('a=', event_id, '|b=', event_id % 5) as pairs from {events}")
def _(t):
    m = F.create_map(F.lit("b"), C("event_id") % 5, F.lit("a"), C("event_id"))
    return t("events").select("event_id", F.array_join(F.transform(N.top_logprobs(m, "map"), lambda p: F.concat(p["token"], F.lit("="), p["logprob"].cast("string"))), "|").alias("pairs"))


@P.query("i03_entropy", """with p as (select event_id, unnest([0.1 * (event_id % 7), 0.05 * (event_id % 11), 0.3]) as p, 0.1 * (event_id % 7) + 0.05 * (event_id % 11) + 0.3 as s from {events}),
  q as (select event_id, p / greatest(s, 1) as p, s from p union all select distinct event_id, greatest(1 - s, 0), s from p) select event_id, round(sum(case when p > 0 then -p * ln(p) else 0 end), 6) as h from q group by 1""")
def _(t):
    probs = F.array((C("event_id") % 7) * 0.1, (C("event_id") % 11) * 0.05, F.lit(0.3))
    return t("events").select("event_id", F.round(N.entropy(probs), 6).alias("h"))


@P.query("i04_ranked_alternatives", "select event_id, case when event_id % 3 > 1 then concat('x=', event_id % 3, '|y=1') else 'x=1|y=1' end as best from {events}")
def _(t):
    pair = lambda k, v: F.struct(F.lit(k).alias("token"), v.cast("long").alias("logprob"))
    pairs = F.array(pair("y", F.lit(1)), pair("x", F.lit(1)), pair("x", C("event_id") % 3))
    return t("events").select("event_id", F.array_join(F.transform(N.ranked_alternatives(pairs), lambda p: F.concat(p["token"], F.lit("="), p["logprob"].cast("string"))), "|").alias("best"))


@P.query("i05_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1")
def _(t):
    a, b = t("embeddings"), t("embeddings").select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(N.cosine(C("embedding"), C("other")), 6).alias("similarity"))


@P.query("i06_normalized", "select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first, 1.0 as norm from {embeddings}")
def _(t):
    v = N.normalized(C("embedding"))
    return t("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(C("v")[0], 6).alias("first"), F.round(F.sqrt(N.dot(C("v"), C("v"))), 6).alias("norm"))


@P.query("i07_quantized", "select event_id, round_even(value / 7, 4) as q from {events}")
def _(t):
    return t("events").select("event_id", N.quantized(C("value") / 7).alias("q"))


@P.query("i08_json_path", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from {events}")
def _(t):
    return t("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@P.query("i09_json_array_length", "select conv_id, count(*)::int as n from {conversations} group by 1")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list("role")).alias("j")).select("conv_id", F.json_array_length("j").alias("n"))


@P.query("i10_json_explode", "select event_id, k as key, cast(json_extract(props, concat('$.', k)) as bigint) as value from (select *, unnest(json_keys(props)) as k from {events})")
def _(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@P.query("i11_json_metric", """select event_id, case event_id % 3 when 0 then (event_id % 2)::double when 1 then event_id * 0.5 end as number, case event_id % 3 when 0 then case when event_id % 2 = 1 then 'True' else 'False' end when 1 then cast(event_id * 0.5 as varchar) else 'text' end as text
  from (select event_id from {events}) where event_id % 3 <> 1 or event_id % 2 = 1""")
def _(t):
    e = C("event_id")
    j = F.when(e % 3 == 0, F.when(e % 2 == 1, "true").otherwise("false")).when(e % 3 == 1, (e * 0.5).cast("string")).otherwise('"text"')
    number, text = N.metric_of_json(C("v"))
    return t("events").filter((e % 3 != 1) | (e % 2 == 1)).select("event_id", F.parse_json(j).alias("v")).select("event_id", number.alias("number"), text.alias("text"))


@P.query("i12_content_hash", "select doc_id, sha256(concat(lang, chr(31), text)) as hash, sha1(text)[1:12] as short from {documents}")
def _(t):
    return t("documents").select("doc_id", N.content_hash(C("lang"), C("text")).alias("hash"), N.short_id(C("text")).alias("short"))


@P.query("i13_ratio", "select event_index, round(length_tokens_exec / nullif(length_tokens_total - 400, 0), 9) as ratio, length_tokens_total - length_tokens_exec as delta from {leaf_score}")
def _(t):
    return t("leaf_score").select("event_index", F.round(N.ratio(C("length_tokens_exec"), C("length_tokens_total") - 400), 9).alias("ratio"), (C("length_tokens_total") - C("length_tokens_exec")).alias("delta"))


@P.query("i14_iso_seconds", "select event_id, epoch_us(date_trunc('second', ts)) / 1000000 - case when event_id % 2 = 0 then 0 else 7200 end as seconds from {events}")
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(C("event_id") % 2 == 0, "").otherwise("+02:00"))
    return t("events").select("event_id", N.iso_seconds(text).alias("seconds"))


@P.query("i16_step_of_path", "select checkpoint_id, checkpoint_id * 10 as step from {checkpoints}")
def _(t):
    return t("checkpoints").select("checkpoint_id", N.step_of_path(F.concat(F.lit("/runs/x/"), C("checkpoint_label"), F.lit("/db"))).alias("step"))


#: Places of a word in a text as spans, widened so that some touch and overlap.
def word_spans(t):
    return t("documents").withColumn("spans", F.transform(A.word_ends(C("text"), " the "), lambda e: F.struct(e.alias("start"), (e + 30).alias("end"))))


SPANS = """with s as (select doc_id, length(array_to_string(string_split(text, ' the ')[1:i], ' the '))::int as a, length(array_to_string(string_split(text, ' the ')[1:i], ' the '))::int + 30 as b from (select *, unnest(range(1, len(string_split(text, ' the ')))) as i from {documents})),
  f as (select *, case when a > max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) or row_number() over (partition by doc_id order by a) = 1 then 1 else 0 end as new from s),
  g as (select doc_id, a, b, sum(new) over (partition by doc_id order by a) as k from f), m as (select doc_id, k, min(a) as a, max(b) as b from g group by 1, 2)"""


@P.query("i17_coalesced_spans", SPANS + " select d.doc_id, coalesce(string_agg(concat(a, '-', b), '|' order by a) filter (a is not null), '') as spans from (select doc_id from {documents}) d left join m using (doc_id) group by 1")
def _(t):
    return word_spans(t).select("doc_id", F.array_join(F.transform(A.coalesced_spans(C("spans")), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), "|").alias("spans"))


_TOK = "(select doc_id, unnest(range(0, length(text) // 25 + 1)) * 25 as p from {documents})"


#: Spans of a text don't touch, so those that begin before a place and those that end there decide.
@P.query("c18_overlap_masks", SPANS + f""", k as (select doc_id, p, p + 25 as q from {_TOK})
  select k.doc_id, sum(case when m.a is not null and m.b > k.p then 1 else 0 end)::bigint as masked from k asof left join m on k.doc_id = m.doc_id and k.q > m.a group by 1""")
def _(t):
    tokens = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 25)), lambda i: F.struct((i * 25).alias("start"), (i * 25 + 25).alias("end")))
    mask = A.overlapping(tokens, A.coalesced_spans(C("spans")))
    return word_spans(t).select("doc_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("masked"))


@P.query("i18_span_masks", SPANS + """, k as (select doc_id, length(text) as n, ceil(length(text) / 3) as thirds from {documents}),
  c as (select doc_id, least(a, n) as a, least(b, n) as b from m join k using (doc_id)), i as (select doc_id, sum((b - a) - (floor((b + 2) / 3) - floor((a + 2) / 3))) as kept from c group by 1)
  select doc_id, coalesce(kept, 0)::bigint as kept, (n - thirds - coalesce(kept, 0))::bigint as excluded from k left join i using (doc_id)""")
def _(t):
    mask = F.transform(F.slice(F.sequence(F.lit(0), F.length("text")), F.lit(1), F.length("text")), lambda i: F.when(i % 3 == 0, 0).otherwise(1))
    total = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = word_spans(t).withColumn("merged", A.coalesced_spans(C("spans"))).withColumn("mask", mask)
    return rows.select("doc_id", total(A.masked(C("mask"), C("merged"), True)).alias("kept"), total(A.masked(C("mask"), C("merged"), False)).alias("excluded"))


@P.query("i19_steer_mask", r"select doc_id, len(regexp_extract_all(trace, '(?is)<steer>(.*?)</steer>', 1)[1])::bigint as masked from {traces} where len(regexp_extract_all(trace, '(?is)<steer>(.*?)</steer>')) > 0")
def _(t):
    first = F.regexp_extract(C("trace"), r"(?is)<steer>(.*?)</steer>", 1)
    at = F.locate("<steer>", C("trace")) + 6
    tokens = F.transform(F.sequence(F.lit(0), at + F.length(first)), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    mask = A.overlapping(tokens, F.array(F.struct(at.alias("start"), (at + F.length(first)).alias("end"))))
    return t("traces").filter(F.size(X.tag_bodies(C("trace"), "steer")) > 0).select("doc_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("masked"))


@P.query("i22_supervision", "select doc_id, sum(case when i = 9 then 1 when i % 2 = 0 and i >= doc_id % 5 then 1 else 0 end)::bigint as n from (select doc_id, unnest(range(0, 10)) as i from {documents}) group by 1")
def _(t):
    seq = F.sequence(F.lit(0), F.lit(9))
    a = F.transform(seq, lambda i: F.when(i % 2 == 0, 1).otherwise(0))
    o = F.transform(seq, lambda i: F.when(i < C("doc_id") % 5, 1).otherwise(0))
    return t("documents").select("doc_id", F.aggregate(N.supervision(a, o), F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))


@P.query("k08_hash_vectors", """with b as (select doc_id, i, ('0x' || sha256(concat('0:', lang))[2 * i + 1:2 * i + 2])::int / 127.5 - 1 as x from (select doc_id, lang, unnest(range(0, 8)) as i from {documents}))
  select doc_id, round(max(x) filter (i = 0) / sqrt(sum(x * x)), 6) as first, round(max(x) filter (i = 7) / sqrt(sum(x * x)), 6) as last from b group by 1""")
def _(t):
    rows = V.unique_then(t("documents").select("doc_id", "lang"), "lang", lambda u: u.withColumn("v", N.hash_vector(C("lang"), 8)))
    return rows.select("doc_id", F.round(C("v")[0], 6).alias("first"), F.round(C("v")[7], 6).alias("last"))


@P.query("f08_diverse_selection")
def _(t):
    return V.diverse(t("embeddings"), "label", "vec_id", "embedding", 5)


_CENTRE = "c as (select label, i, avg(embedding[i]::double) as x from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from {embeddings} where label <> 0) group by 1, 2)"


@P.query("k03_noise_assignment", f"""with {_CENTRE}, d as (select vec_id, c.label, round(sum((embedding[i]::double - x) ** 2), 9) as d from {{embeddings}} e join c on true where e.label = 0 group by 1, 2)
  select vec_id, label = 0 as noise_assigned, case when label = 0 then (select arg_min(d.label, (d.d, d.label)) from d where d.vec_id = e.vec_id) else label end as assigned from {{embeddings}} e""")
def _(t):
    return V.assign_noise(t("embeddings"), "label", "embedding", noise=0).select("vec_id", "noise_assigned", "assigned")


@P.query("f07_near_centroid", """with c as (select label, i, avg(embedding[i]::double) as x from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from {embeddings}) group by 1, 2)
  select label, vec_id, row_number() over (partition by label order by d, vec_id) as place from (select label, vec_id, round(sum((embedding[i]::double - x) ** 2), 9) as d from {embeddings} join c using (label) group by 1, 2) qualify row_number() over (partition by label order by d, vec_id) <= 10""")
def _(t):
    return V.near_centroid(t("embeddings"), "label", "vec_id", "embedding", 10)


@P.query("k07_cluster_ids", "select pool_id, label, n, row_number() over (partition by pool_id order by n desc, label) - 1 as cluster_id from (select pool_id, label, count(*) as n from {candidates} group by all)")
def _(t):
    return V.cluster_ids(t("candidates"), ["pool_id"], "label")


@P.query("k06_coverage", "select count(*) as items, count(*) filter (label <> 3) as assigned, count(*) filter (label <> 3) / count(*) as rate, count(*) filter (label <> 3) / count(*) > 0.7 as ok from {candidates}")
def _(t):
    c = t("candidates")
    return V.assignment_coverage(c.select("doc_id"), c.filter("label <> 3").select("doc_id", C("label").cast("string").alias("cluster_name")), "doc_id", 0.7)


_H = "sha256(concat('7|', cast(doc_id as varchar)))"


@P.query("f10_selectors", f"""with s as (select *, {_H} as h, count(*) over (partition by pool_id, label) as n from {{candidates}}), r as (select *, row_number() over (partition by pool_id, label order by h, doc_id) as k, first_value(label) over (partition by pool_id order by n desc, label) as big from s)
  select pool_id, doc_id, row_number() over (partition by pool_id order by h, doc_id) <= 3 as random, row_number() over (partition by pool_id order by k, n desc, label) <= 3 as across, row_number() over (partition by pool_id order by (label <> big)::int, h, doc_id) <= 3 as within from r""")
def _(t):
    return V.selectors(t("candidates"), "pool_id", "doc_id", "label", 3, 7)


@P.query("k01_density_clusters")
def _(t):
    return V.density_clusters(t("embeddings"), "vec_id", "embedding", 5, 400)


@P.query("k04_projection")
def _(t):
    return V.projected(t("embeddings"), "vec_id", "embedding")


@P.query("k02_titled_clusters")
def _(t):
    rows = t("candidates").select("doc_id", F.concat(F.lit("cluster "), C("label").cast("string")).alias("title"), "text")
    first = rows.select("doc_id", V.text_id("title", "text").alias("__id")).join(t("embeddings").select(C("vec_id").alias("doc_id"), "embedding"), "doc_id")
    first = first.groupBy("__id").agg(F.min_by("embedding", "doc_id").alias("vector"))
    return V.clustered_texts(rows, ["title", "text"], lambda u: u.join(first, "__id"), 5).select("doc_id", "cluster")


@P.query("c16_back_join", "select doc_id, min(doc_id) over (partition by lang, source) as first_id, count(*) over (partition by lang, source) as copies from {documents}")
def _(t):
    rows = t("documents").select("doc_id", F.concat_ws("|", "lang", "source").alias("key"))
    facts = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return V.unique_then(rows, "key", lambda u: u.join(facts, "key")).drop("key")


QUERIES, ORACLES = P.queries, P.oracles
