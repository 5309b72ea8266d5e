"""Queries see whole texts: cases in which a prefix would go unseen by the other tests."""

import random
import time
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import answers as A
from strandlake.functions import arrays, matching
from strandlake.functions import text as X
from strandlake.operators import density
from strandlake.plans import ordered, text, values
from strandlake.sources import derived


def test_repeat_runs_over_whole_traces(spark, monkeypatch):
    same, begin = [f"step {i} " + chr(97 + i) * 40 for i in range(14)], "the same beginning " * 8  # over 120 characters
    blocks = {1: [*same, "again and again", "again and again", "again and again"], 2: [begin + "x" * 300, begin + "y" * 300]}
    rows = [(i, "<think>" + "".join(f"<{k}>{b}</{k}>" for b, k in zip(bs, ["steer", "exec"] * 10)) + "</think>") for i, bs in blocks.items()]
    traces = spark.createDataFrame(rows, "doc_id long, trace string")
    monkeypatch.setattr(derived, "table", lambda spark, sf_dir, name: traces)
    got = {r["doc_id"]: r["runs"] for r in ordered.P.queries["e21_repeat_runs"](spark, "").collect()}
    assert got == {i: ",".join(map(str, A.repeat_runs(bs))) for i, bs in blocks.items()}
    assert got[1].endswith("1,2,3") and len(got[1].split(",")) == 17 and got[2] == "1,1"


@pytest.mark.parametrize("least", [0.0, 0.5, 0.9, 1.0])
def test_resembles_is_similarity(least):
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = "".join(x for x in a if rng.random() < 0.9) + rng.choice(["", "a", "bc"])
        assert A.resembles(a, b, least) == (A.similarity(a, b) >= least)


def test_arrays_by_brute_force(spark):
    rng = random.Random(4)
    span = lambda n: sorted(rng.randrange(n) for _ in range(2))
    rows = [(i, [rng.randrange(9) for _ in range(rng.randrange(6))], [span(40) for _ in range(rng.randrange(7))], [(j, j + rng.randrange(1, 4)) for j in range(rng.randrange(30))], rng.randrange(45)) for i in range(60)]
    rows += [(60, None, [], [], 0), (61, [], None, None, 3), (62, [1], [[5, 400], [0, 2], [2, 3]], [(1, 2)], 9)]
    df = spark.createDataFrame(rows, "id int, x array<int>, s array<struct<start:int,end:int>>, t array<struct<start:int,end:int>>, n int").repartition(3)
    mask = F.transform(F.slice(F.sequence(F.lit(1), F.col("n") + 1), F.lit(1), F.col("n")), lambda i: i)
    out = df.select("*", arrays.running(F.col("x")).alias("r"), arrays.coalesced_spans(F.col("s")).alias("c"), arrays.overlapping(F.col("t"), F.col("s")).alias("o"), mask.alias("m"), arrays.masked(mask, F.col("s"), True).alias("k"), arrays.masked(mask, F.col("s"), False).alias("e"))
    for r in out.collect():
        assert r["r"] == (None if r["x"] is None else [sum(r["x"][: i + 1]) for i in range(len(r["x"]))])
        s = [tuple(x) for x in r["s"] or []]
        some = [x for x in s if x[0] < x[1]]
        if r["s"] is not None:
            inside = lambda p: any(a <= p < b for a, b in s)
            merged = []
            for a, b in sorted(s):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            assert [tuple(x) for x in r["c"]] == merged
            assert r["k"] == [v if inside(i) else 0 for i, v in enumerate(r["m"])] and r["e"] == [0 if inside(i) else v for i, v in enumerate(r["m"])]
            assert r["o"] == [int(any(a < e and b < f for b, e in some)) for a, f in ((x[0], x[1]) for x in r["t"])]


def test_many_spans_take_little_time(spark):
    import time

    began = time.time()
    seq = F.sequence(F.lit(0), F.lit(200_000))
    spans = F.transform(seq, lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end")))
    row = spark.range(1).select(F.size(arrays.coalesced_spans(spans)).alias("a"), F.array_max(arrays.running(seq.cast("array<int>"))).isNotNull().alias("b"), F.size(F.filter(arrays.overlapping(spans, spans), lambda x: x == 1)).alias("c")).first()
    assert (row["a"], row["c"]) == (200_001, 200_001) and time.time() - began < 30


def test_boxes_of_any_depth_and_number(spark):
    deep = "\\boxed{" + "{" * 50 + "x" + "}" * 50 + "}"
    many = "{a}" * 100_000
    rows = [("a" + deep, True), (many + "\\boxed{1}", True), (many, False), ("\\boxed{" + many, False), ("\\boxed{a{b}", False), ("}}{\\boxed{a}", True), ("\\boxed{\\boxed{x}", True), (None, None), ("", False), ("\\boxed {x}", False)]
    got = spark.createDataFrame(rows, "x string, want boolean").select("want", X.has_boxed(F.col("x")).alias("got"), F.size(X.structure_issues(F.col("x"))).alias("n")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert all(bool(A.boxed_answers(x)) == w for x, w in rows if x is not None)


@pytest.mark.parametrize("depth", [0, 1, 4, 6, 40])
def test_wrappers_are_peeled_until_none_is_left(spark, depth):
    kinds = ["\\text{", "\\boxed{ ", "\\mathrm{"]
    wrapped = " " + "".join(kinds[i % 3] for i in range(depth)) + "12" + "".join("}" if i % 2 else " }" for i in range(depth))
    odd = ["\\text{}", "\\text{\\text{}}", "\\text{ }", "\\text{a}b}", "\\text{a", "a}", "\\text{a\nb}", "\\text{\\frac{1}{2}}", "}", "\\text{\\boxed{a} }}"]
    rows = spark.createDataFrame([(x,) for x in [wrapped, *odd]], "x string").select("x", X.unwrapped(F.col("x")).alias("u"), X.wrapper_variants(F.col("x")).alias("v"), X.answer_class(F.col("x")).alias("c")).collect()
    for r in rows:
        assert r["u"] == A.peeled_to_the_end(r["x"]) and r["v"] == A.peeled(r["x"]), r
    assert rows[0]["u"] == "12" and rows[0]["c"] == "plain_scalar_or_simple_fraction"


def test_last_box():
    cases = {"a": None, "\\boxed{1} \\boxed{2}": "2", "\\boxed{\\boxed{3}}": "3", "x \\boxed 7$ y": "7", "\\boxed{1} \\boxed{2": None, "\\boxed{a{b}c}": "a{b}c", "\\boxed2": None, "\\boxed{1} \\boxed": None}
    assert {k: A.last_box(k) for k in cases} == cases


def test_capitalized_by_its_sql(spark, tmp_path):
    """capitals of one letter, lower case without regard to what stands around, and white space as in the SQL."""
    letters = [chr(i) for i in range(1, 0x3000) if chr(i).isalpha() or chr(i).isspace()]
    texts = ["ßeiung", "\n ßx", "ŉa", "ﬁn", "ᾳα", "ΑΣ ΒΣ", "İX", "\u00a0ab", "\u3000ab", "\x0bab", "", "  ", None, *[c + "bC" for c in letters], *["B" + c for c in letters]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text.QUERIES["h31_capitalized"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(c.execute(text.ORACLES["h31_capitalized"]).fetchall())
    assert len(got) == len(want) == len(texts)
    assert [(texts[r["doc_id"]], r["value"], want[r["doc_id"]]) for r in got if r["value"] != want[r["doc_id"]]] == []
    assert want[0] == "\n ẞeiung"


@pytest.mark.parametrize("large", [-1, 300, 1 << 40])
def test_similarity_is_difflibs(monkeypatch, large):
    """by searches, by ranks, and by both."""
    monkeypatch.setattr(matching, "LARGE", large)
    rng = random.Random(large)
    for _ in range(1000):
        letters = rng.choice(["ab", "abc", "abcdefgh", "aé€😀"])
        a, other = ("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2))
        b = rng.choice([other, "".join(x for x in a if rng.random() < 0.8) + other[:20]])
        want, least = SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0, rng.random()
        assert matching.similarity(a, b) == want and matching.similarity(a, b, least) == max(least, want)


def test_similarity_of_long_blocks():
    """searches and ranks need a small part of the time that looking at all equal pairs of characters takes."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    a, b = (" ".join(rng.choice(words) for _ in range(1000)) for _ in range(2))
    began = time.process_time()
    got = matching.similarity(a, b)
    middle = time.process_time()
    assert got == SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert (middle - began) * 4 < time.process_time() - middle
    assert matching.neighbour_similarity([a, b, a[:500], "", a[:500]]) == max(got, matching.similarity(b, a[:500]))
    assert matching.neighbour_similarity([b, a, a]) == 1.0


def test_titled_clusters_of_whole_texts(spark, tmp_path):
    """texts that differ only at their ends, after thousands of words, are texts of their own, in clusters numbered by the order of whole texts."""
    rng = np.random.default_rng(5)
    same = "same " * 4000
    texts = [f"{same}{i * 37 % 60:02}" for i in range(60)] + [f"{same}07"] * 3 + [None, "", "same"] * 4
    where = rng.integers(0, 3, len(texts))
    vectors = rng.normal(size=(len(texts), 4)) / 10 + where[:, None] * [[9.0, 0, 0, 0]]
    vectors = vectors.astype(np.float32)
    docs = spark.createDataFrame([(i, x, "en", "a", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(vectors.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["doc_id"]: r["cluster"] for r in values.QUERIES["k02_titled_clusters"](spark, str(tmp_path)).collect()}
    first, of = {}, {}
    for i, x in enumerate(texts):
        of[i] = f"cluster {i % 2}" + ("" if x is None else f" :: {x}")
        first.setdefault(of[i], i)
    found = dict(zip(sorted(first), density.labels(vectors[[first[x] for x in sorted(first)]], 5).tolist()))
    assert got == {i: found[x] for i, x in of.items()}
    assert len(first) == 67 and len(set(found.values()) - {-1}) == 3
