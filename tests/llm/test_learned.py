"""Learned operators: held-out accuracy, edge cases, and the parts that learn."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from strandlake.llm import boosting, common, fitting, lm_scoring, quality, toxicity

ODD = ["", " \n", "a", "you idiot", "é" * 5000, "!!! $$$", "word " * 30000]


@pytest.fixture(scope="module")
def labelled():
    d = "/root/testdata/sf0.1"
    docs, labels = (ds.dataset(f"{d}/{t}.parquet").to_table().to_pandas() for t in ("documents", "labels"))
    return docs.merge(labels, on="doc_id")


@pytest.mark.parametrize(("module", "label", "mod", "held", "least"), [(toxicity, "toxic", 4, 2, 0.9), (quality, "quality", 5, 0, 0.98)])
def test_held_out(labelled, module, label, mod, held, least):
    out = labelled.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == held)
    train, test = labelled[~out], labelled[out]
    model = module.train(pa.array(train.text.tolist()), train[label].to_numpy(float), np.ones(len(train)))
    got, y = model.score(pa.array(test.text.tolist())) >= module.LIMIT, test[label].to_numpy() == 1
    assert (got & y).sum() / y.sum() >= least and (got & y).sum() / got.sum() >= least
    scores = model.score(pa.array([*ODD, None, *ODD], pa.string()))
    assert ((scores >= 0) & (scores <= 1)).all() and (scores[: len(ODD)] == scores[len(ODD) + 1 :]).all()
    assert scores[0] == scores[len(ODD)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nothing_to_learn(module):
    assert (module.train(pa.array([], pa.string()), np.zeros(0), np.zeros(0)).score(pa.array(["x"])) == 0).all()
    assert (module.train(pa.array(["a", "b"]), np.ones(2), np.ones(2)).score(pa.array(["x", None])) == 1).all()


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxicity"), (quality, "quality")])
def test_rows_and_columns_stay(spark, module, column):
    rows = spark.createDataFrame([(1, None, "x", 1.0), (None, "a", None, 2.0), (2, "b", "y", 3.0), (2, "b", "y", 3.0)], f"doc_id long, text string, `odd.name` string, {column} double")
    out = module.score(rows, module.Model(0.25))
    assert sorted(out.columns) == sorted(rows.columns) and [r[column] for r in out.collect()] == [0.25] * 4
    assert module.score(rows.filter("false"), module.Model(0.25)).count() == 0
    assert module.reject(rows, module.Model(0.9)).columns == rows.columns


def test_sample_is_bounded_and_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None), (4, 0), (4, 7)], "doc_id long, toxic int")
    rows = fitting.labelled(docs, labels, "toxic", toxicity.HELD_OUT, 20).collect()
    assert len(rows) == 40 and {r["y"] for r in rows} == {0, 1}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows)
    sizes = {r["y"]: r["size"] for r in rows}
    assert sizes[1] == sum(i % 4 == 0 and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))
    model = fitting.trained(fitting.labelled(docs.filter("false"), labels, "toxic", toxicity.HELD_OUT, 20), toxicity.train)
    assert model.trees is None


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    raw = boosting.boost(x, y, np.ones(600), trees=80).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.95
    knots, values = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.interp([1, 2, 3, 4], knots, values).tolist() == [0, 0.5, 0.5, 1]


def test_attention_gradients():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(rng.choice(["a", "BB!!", "ccc", "dd|"], rng.integers(0, 90))) for _ in range(30)])
    y = rng.integers(0, 2, 30).astype(float)
    weight = rng.uniform(0.5, 2, 30)
    model = quality.train(texts, y, weight, epochs=2)
    x, begin = quality.passages(texts)
    x = model.normal(x)
    f = model.forward(x, begin)
    assert np.allclose(np.add.reduceat(f["a"], begin[:-1]), 1) and len(f["p"]) == 30

    def loss():
        p = model.forward(x, begin)["p"]
        return -np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    grad = model.gradients(x, begin, y, weight)
    assert grad.keys() == model.weights.keys()
    for name, w in model.weights.items():
        for i in rng.choice(w.size, min(w.size, 6), replace=False):
            at = np.unravel_index(i, w.shape)
            kept = w[at]
            w[at] = kept + 1e-5
            more = loss()
            w[at] = kept - 1e-5
            less = loss()
            w[at] = kept
            assert grad[name][at] == pytest.approx((more - less) / 2e-5, abs=1e-6), name


def slow_boost(x, y, weight, trees, depth, rate, bins, ridge):
    """The same trees by trying every cut of every feature in every node."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))) for j in range(x.shape[1])]
    p = np.average(y, weights=weight)
    out = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-out))
        g, h = weight * (y - q), weight * q * (1 - q)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            new = []
            for rows in nodes:
                value = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
                best = (1e-6, None)
                for j, cuts in enumerate(edges):
                    for t in cuts:
                        left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                        gain = value(left) + value(right) - value(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
                new += best[1] if best[1] is not None else (rows, rows[:0])
            nodes = new
        for rows in nodes:
            out[rows] += rate * g[rows].sum() / (h[rows].sum() + ridge)
    return out


def test_boosting_by_brute_force():
    rng = np.random.default_rng(3)
    x, weight = rng.normal(size=(120, 3)).round(1), rng.uniform(0.5, 2, 120)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=120) > 1).astype(float)
    got = boosting.boost(x, y, weight, trees=5, depth=2, rate=0.3, bins=8, ridge=1.0).raw(x)
    assert np.allclose(got, slow_boost(x, y, weight, 5, 2, 0.3, 8, 1.0))


def test_queries_learn_from_what_they_may(spark, tmp_path):
    """Labels of held-out rows change no score."""
    rows = [(i, f"you idiot number {i} shut up moron" if i % 3 == 0 else f"a calm text about the number {i} and the garden", "en", "s", 1) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    held = lambda i, mod, rest: zlib.crc32(str(i).encode()) % mod == rest
    for module, op, mod, rest in ((toxicity, toxicity.op1_toxicity, 4, 2), (quality, quality.op7_quality, 5, 0)):
        for d in "ab":
            flip = lambda i, d=d, mod=mod, rest=rest: d == "b" and held(i, mod, rest)
            marks = [(i, int((i % 3 != 0) != flip(i)), int((i % 3 == 0) != flip(i))) for i in range(240)]
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/{d}/labels.parquet")
        a, b = ({r["doc_id"]: r for r in op(spark, f"{tmp_path}/{d}").collect()} for d in "ab")
        assert {i: r["score"] for i, r in a.items()} == {i: r["score"] for i, r in b.items()} and len(a) == 240
        assert all(r["held_out"] == held(i, mod, rest) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in a.items())
        right = np.mean([r["predicted"] == (int(i % 3 == 0) if module is toxicity else int(i % 3 != 0)) for i, r in a.items() if r["held_out"]])
        assert right > 0.95 if module is toxicity else right >= 0


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    rows = fitting.labelled(docs, labels, "toxic", "false", 100, 500).collect()
    assert 0 < sum(len(r["text"]) for r in rows if r["y"] == 1) <= 500 and {r["size"] for r in rows} == {50}
    assert len(fitting.labelled(docs, labels, "toxic", "false", 100, 1).collect()) == 2  # one text of each class at least
    named = docs.select(docs.doc_id.cast("string").alias("doc_id"), "text")
    assert len(fitting.labelled(named.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "toxic"), "toxic", "false", 100).collect()) == 100


def test_language_models_by_brute_force(spark):
    rows = [(1, "a b a b", True), (2, "a c, B", False), (3, "", True), (4, None, False), (5, "zz", False), (5, "zz", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    m = lm_scoring.fit(docs, "target", most=3)
    words = [w for _, t, _ in rows for w in (t or "").lower().replace(",", "").split()]
    top = sorted(set(words), key=lambda w: (-words.count(w), w))[:2]
    assert top == ["a", "b"] and m.vocab.size == 4
    counts = {}
    for own in (True, False):
        c = np.zeros((5, 4))
        ids = {}
        for _, t, target in rows:
            last = 4
            for w in (t or "").lower().replace(",", "").split():
                h = lm_scoring.words_of(pa.array([w]))
                i = int(m.vocab.tokens(h)[0])
                ids[w] = i
                if target or not own:
                    c[last, i] += 1
                last = i
        counts[own] = c
    assert np.allclose(m.target, lm_scoring.losses(counts[True]).ravel()) and np.allclose(m.background, lm_scoring.losses(counts[False]).ravel())
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, m, keep=["doc_id"]).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[3]["difference"] == 0.0
    assert got[1]["n_tokens"] == 4 and got[1]["difference"] == pytest.approx(got[1]["background_loss"] - got[1]["target_loss"]) and got[1]["difference"] > got[2]["difference"]
    assert np.allclose(np.exp(-lm_scoring.losses(counts[True])).sum(1), 1)


def test_targets_beyond_the_broadcast_bound(spark):
    docs = spark.createDataFrame([(i, "x", "t") for i in (1, 2, 3, None)], "doc_id long, text string, target string")
    ids = spark.createDataFrame([(1,), (3,)], "doc_id long")
    for most in (100, 1):
        assert sorted((r["doc_id"] or 0, r["target"]) for r in lm_scoring.with_target(docs, ids, most).collect()) == [(0, False), (1, True), (2, False), (3, True)]


def test_word_counts_merge(spark, monkeypatch):
    docs = spark.createDataFrame([("a b c",), ("a b",), ("A",)] * 50, "text string").coalesce(1)
    assert sorted(r["n"] for r in lm_scoring.word_counts(docs).collect()) == [50, 100, 150]
    assert common.slices(pa.array([], pa.string())).__next__ and list(common.slices(pa.array([], pa.string()))) == []
