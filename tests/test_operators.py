"""Operators on hand-made rows with hand-computed results."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import answers as A
from strandlake.functions import arrays
from strandlake.functions import numeric as N
from strandlake.functions import text as X
from strandlake.operators import dataset as D
from strandlake.operators import metrics as M
from strandlake.operators import replay as R
from strandlake.operators import tree as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("v")).first()["v"]


# trees: root -> a, b; a has leaves 1 and 0, b has leaves 0 and 0
NODES = [("t", 1, None, 0.0), ("t", 2, 1, 0.0), ("t", 3, 1, 0.0), ("t", 4, 2, 1.0), ("t", 5, 2, 0.0), ("t", 6, 3, 0.0), ("t", 7, 3, 0.0)]


def tree(spark, rows, value="value"):
    return T.walked(spark.createDataFrame(rows, "tree string, node_id long, parent_node_id long, value double"), "tree", value)


def test_branch_variance(spark):
    r = T.branch_variance(tree(spark, NODES), "tree", "node_value").first()
    assert (r["bp1"], r["bp1_weighted"], r["bp2"]) == pytest.approx((0.0625, 0.0625, 0.125))
    lengths = [(t, n, p, {4: 10.0, 5: 20.0, 6: 30.0, 7: 40.0}.get(n, 0.0)) for t, n, p, _ in NODES]
    r = T.branch_variance(tree(spark, lengths), "tree", "node_value").first()
    assert (r["bp1"], r["bp2"]) == pytest.approx((100.0, 25.0))


def test_node_values_and_advantages(spark):
    w = tree(spark, NODES)
    assert {r["node_id"]: r["node_value"] for r in w.collect()} == {1: 0.25, 2: 0.5, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0, 7: 0.0}
    edges = {r["node_id"]: r["edge_advantage"] for r in T.edge_advantage(w, "tree").collect()}
    assert edges[2] == pytest.approx(0.5 / 0.250001) and edges[6] == 0.0
    intra = {r["leaf_id"]: r["intra"] for r in T.intra_advantage(w, "tree").collect()}
    assert intra[4] == pytest.approx((edges[2] + edges[4]) / 2)


@pytest.mark.parametrize("rows", [[("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], [("t", 1, None, 0.0), ("t", 2, 9, 0.0)]])
def test_broken_trees_fail(spark, rows):
    with pytest.raises(Exception, match="cycle|unknown parent"):
        tree(spark, rows).collect()


def test_leaf_on_the_root_is_its_own_branch(spark):
    w = tree(spark, [("t", 1, None, 1.0)])
    r = T.branch_variance(w, "tree", "node_value").first()
    assert (r["leaf_count"], r["variance"], r["bp1"], r["bp2"]) == (1, 0.0, 0.0, 0.0)


def test_inter_advantage_of_one_is_zero(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0)], "p string, r double")
    assert sorted((r["p"], round(r["inter"], 3)) for r in T.inter_advantage(rows, "p", "r").collect()) == [("a", 0.0), ("b", -1.0), ("b", 1.0)]


GOOD = "<think><steer>Weigh it.</steer><exec>All told.</exec></think> \\boxed{41500}"
ISSUES = [
    (GOOD, []),
    ("\\boxed{1}", ["expected_single_complete_think_block"]),
    ("<think>a</think><think>b</think>", ["expected_single_complete_think_block", "missing_boxed_answer"]),
    ("x" + GOOD, ["non_whitespace_before_think_block"]),
    ("<think> </think>\\boxed{1}", ["empty_think_block", "missing_steer_exec_blocks"]),
    ("<think><exec>a</exec><steer>b</steer></think>\\boxed{1}", ["steer_exec_not_interleaved", "steer_exec_must_start_with_steer"]),
    ("<think><steer>a</steer> z <exec> </exec></think>\\boxed{1}", ["non_whitespace_outside_steer_exec", "empty_steer_exec_block"]),
    ("<think><steer>a</ste</steer></think>\\boxed{{2}", ["control_tag_inside_steer_exec_block", "unequal_steer_exec_block_counts", "unpaired_steer_exec_tags", "missing_boxed_answer"]),
    ("<think><steer>a</think> \\boxed{1}", ["non_whitespace_outside_steer_exec", "incomplete_steer_exec_tags"]),
    ("<think><steer>a</steer><exec>b</exec></think> <exec> \\boxed{\\frac{1}{2}}", ["steer_exec_outside_think_block"]),
]


@pytest.mark.parametrize(("text", "issues"), ISSUES)
def test_structure_issues(spark, text, issues):
    assert one(spark, X.structure_issues, text) == issues


def test_text_functions(spark):
    assert one(spark, lambda c: X.word_count(c, "hold"), 'Hold, hold. "HOLD"! uphold holding holds hold_on hold2') == 3
    for text in ("Go by parts</steer>", "<steer>Go by parts</steer>", "Go by parts</ste "):
        assert one(spark, X.without_steer_suffix, text) == "Go by parts"
    assert one(spark, X.unmatched, "<steer>a</steer><steering>b</steering><exec>c</exec>") == 1
    assert [tuple(p) for p in one(spark, X.index_pairs, "<steer>A</steer><exec>B</exec>")] == [("A", "B")]
    assert one(spark, X.strip, "\n  a \n") == "a"
    assert one(spark, lambda c: X.preview(c, 8), "one two  three") == "one t..."
    assert one(spark, X.numbered_options, "1. a\n  b\n2. c")[0]["text"] == "a b"
    assert one(spark, X.literal_list, "['a', 'b']") == ["a", "b"] and one(spark, X.literal_list, "bare") == ["bare"] and one(spark, X.literal_list, " ") == []


@pytest.mark.parametrize(("text", "cls"), [("1,234.5", "plain_scalar_or_simple_fraction"), ("$\\boxed{3/4}$", "plain_scalar_or_simple_fraction"), ("3/0", "other"), ("5\\%", "other"), ("\\frac{1}{2}", "exact_symbolic_numeric_expression"), ("x^2", "exact_symbolic_numeric_expression"), ("blue", "other"), ("1e-5", "plain_scalar_or_simple_fraction")])
def test_answer_class(spark, text, cls):
    assert one(spark, X.answer_class, text) == cls


def test_boxes_and_candidates():
    assert A.boxed_answers("\\boxed{a\\boxed{b}} \\boxed{{c} \\boxed{d}") == ["\\boxed{a\\boxed{b}}", "\\boxed{b}", "\\boxed{d}"]
    assert A.candidate_answer("$1$ answer is 7 then \\boxed{9}") == "9"
    assert A.candidate_answer("the answer is: 12 or 13") == "12"
    assert A.candidate_answer("so $x$ and $y$") == "y"
    assert A.candidate_answer(" plain ") == "plain"
    assert A.last_box("\\boxed 5$ x") == "5" and A.last_box("none") is None


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("<think><steer>a</steer>\n<exec>b</exec></think>7<|im_end|>", "ok"),
        ("a", "missing_open_think"),
        ("<think>a", "missing_close_think"),
        ("<think>a</think> ", "empty_final_answer"),
        ("<think>a</think><exec>", "final_answer_control_tag"),
        ("<think>a</think>7", "expected_steer_open"),
        ("<think><steer>a</think>7", "missing_steer_close"),
        ("<think><steer> </steer></think>7", "empty_steer_block"),
        ("<think><steer>a</steer></think>7", "missing_steer_exec_pair"),
        ("<think><steer>a</steer><exec>b</exec><steer>c</steer></think>7", "unbalanced_steer_exec_blocks"),
    ],
)
def test_completion_check(text, reason):
    assert A.completion_check(text)[0] == reason


def test_rewards():
    assert A.reward(GOOD, "41,500", True) == pytest.approx(1.1)
    assert A.reward("\\boxed{\\frac{1}{2}}", "0.5", False) == 1.0
    assert A.reward("no box", "1", True) == pytest.approx(0.1)
    assert A.same_answer("\\boxed{\\text{No}}", "no") and not A.same_answer("2", "3")
    assert A.repeat_runs(["aaaa", "aaaa", "zz", "aaaa"]) == [1, 2, 1, 2]
    assert A.bare_edges("</steer> plan </ste") == "plan"
    assert A.similarity("", "a") == 0.0


def test_allocation_examples():
    assert D.allocate({"a": 10, "b": 2}, 6) == {"a": 4, "b": 2}
    assert D.allocate({"a": 8, "b": 2}, 6) == {"a": 4, "b": 2}
    with pytest.raises(ValueError):
        D.allocate({"a": 1}, 2)


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 50), min_size=1), st.integers(0, 200))
def test_allocation_properties(capacity, target):
    if sum(capacity.values()) < target:
        return
    got = D.allocate(capacity, target)
    assert sum(got.values()) == target and all(got[s] <= c for s, c in capacity.items())
    free = [got[s] for s in capacity if got[s] < capacity[s]]
    assert not free or max(got.values()) - min(free) <= 1


@pytest.mark.parametrize("size", [1, 7, 40, 95, 200])
def test_proportional_in_turn(spark, size):
    rows = spark.createDataFrame([(i, "abcdefgh"[min(7, i.bit_length())] if i % 11 else None) for i in range(100)], "id long, s string")
    counts = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    share = {s: min(counts[s], max(1, round(size * counts[s] / 100))) for s in names}
    while sum(share.values()) != min(size, 100):
        step = 1 if sum(share.values()) < size else -1
        able = [s for s in names if (share[s] < counts[s] if step > 0 else share[s] > 1)]
        if not able:
            break
        for s in able[: abs(min(size, 100) - sum(share.values()))]:
            share[s] += step
    got = {r["s"]: r["count"] for r in D.proportional(rows, "s", "id", size, 1).groupBy("s").count().collect()}
    assert got == share


def test_allocated_is_allocate(spark):
    capacity = {f"s{i}": i * 7 % 13 for i in range(40)}
    rows = spark.createDataFrame(list(capacity.items()), "s string, n long")
    for target in (0, 1, 39, 100, sum(capacity.values())):
        assert {r["s"]: r["got"] for r in D.allocated(rows, "s", "n", target, "got").collect()} == D.allocate(capacity, target)
    with pytest.raises(ValueError):
        D.allocated(rows, "s", "n", 10_000, "got")


def test_sampling_sizes(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(100)], "id long, s string")
    got = D.balanced(rows, "s", "id", 50, 1).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 30, "b": 20}
    split = D.train_eval(rows, "id", 0.25, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 75, "eval": 25}
    numbered = D.numbered(rows, "id", ranges=4).orderBy("id").collect()
    assert [r["index"] for r in numbered] == list(range(100))


def test_allow_list(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert D.allow_listed(rows, rows.filter("id = 1"), "id").count() == 1
    with pytest.raises(Exception, match="missing ids"):
        D.allow_listed(rows, spark.createDataFrame([(3,)], "id long"), "id").collect()


def test_null_ids_are_never_skipped(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert D.unprocessed(rows, spark.createDataFrame([(1,), (None,)], "id long"), "id").count() == 2


def test_spans_and_vectors(spark):
    df = spark.createDataFrame([([(5, 8), (0, 2), (2, 4)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(arrays.coalesced_spans(F.col("s")).alias("v")).first()["v"]] == [(0, 4), (5, 8)]
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert v.select(N.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == pytest.approx(0.96)
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>").select(N.cosine(F.col("a"), F.col("b"))).collect()
    assert spark.range(1).select(N.probability(F.lit(-1e9)).alias("p")).first()["p"] == 0.0


def test_metric_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 5.0)], "g string, x double, y double")
    assert [r["r"] for r in M.correlation(df, ["g"], "x", "y").collect()] == [None, None]
    assert {r["g"]: r["stderr"] for r in M.mean_and_error(df, ["g"], "y", F.col("y") > 3).collect()}["a"] == 0.0
    assert M.length_summary(df.filter("false"), ["g"], "x").count() == 0


def test_alignment_is_monotone(spark):
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "q")], "k long, step int, text string")
    pairs = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 2, "b"), (1, 3, "a")], "k long, place int, text string")
    assert [r["place"] for r in R.aligned(steps, pairs, "k").orderBy("step").collect()] == [0, 2, 3, None]


def test_missing_before_row_fails(spark):
    a = spark.createDataFrame([(1, 1)], "id long, x int")
    with pytest.raises(Exception, match="no row before"):
        R.paired(spark.createDataFrame([], "id long, y int, pos int"), a, "id", "pos").collect()
