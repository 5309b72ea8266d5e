"""Operators do the whole job: cases in which less of it would go unseen by the other tests."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import html, lm_scoring, simhash


@pytest.mark.parametrize("n", [46, 65, 100, 512, 513, 600])
def test_forest_of_a_dense_cloud(n):
    rng = random.Random(n)
    base, near = rng.getrandbits(64), set()
    while len(near) < n:  # two bits off at most: all within four of one another
        near.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    far = [x ^ (1 << 64) - 1 for x in sorted(near)[:3]]  # their complements: a cloud of their own
    fps = np.unique(np.array([*near, *far], np.uint64))
    got = simhash.forest(fps, 4)
    assert all(i != j and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in got)
    assert len(got) == n - 1 + 2  # a spanning tree of each cloud
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in got:
        assert root(i) != root(j)
        parent[root(i)] = root(j)


def test_forest_of_mixed_density_by_brute_force():
    rng = random.Random(5)
    fps = set()
    for size in (1, 3, 60, 200, 700):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(close, label[None], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    got = simhash.forest(fps, 4)
    assert len(got) == len(fps) - len(set(label.tolist())) and all(close[i, j] and label[i] == label[j] for i, j in got)


@pytest.mark.parametrize("part", [1, 20_000, 4 << 20])
def test_language_models_of_the_whole_vocabulary(spark, monkeypatch, part):
    rng = random.Random(part)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts[:6] = ["same rarest", "same rarer", "", None, "..", "the the the"]
    rows = [(i if i != 9 else None, t, i % 3 == 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(lm_scoring, "PART_BYTES", part)
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    tokens = [(t or "").replace(".", "").split() for t in texts]
    ids = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
    assert len(ids) > lm_scoring.VOCABULARY + 1
    loss = {}
    for own in (True, False):
        counts = np.zeros((len(ids) + 1, len(ids)))
        for t, (_, _, target) in zip(tokens, rows):
            for a, b in zip([None, *t], t):
                counts[len(ids) if a is None else ids[a], ids[b]] += target or not own
        loss[own] = lm_scoring.losses(counts)
    got = {r["doc_id"]: r for r in lm_scoring.corpus_scores(docs, "target", keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for t, (i, _, _) in zip(tokens, rows):
        want = [np.mean([loss[own][len(ids) if a is None else ids[a], ids[b]] for a, b in zip([None, *t], t)] or [0.0]) for own in (True, False)]
        assert got[i]["n_tokens"] == len(t) and np.allclose([got[i]["target_loss"], got[i]["background_loss"], got[i]["difference"]], [*want, want[1] - want[0]])
    assert got[0]["background_loss"] != got[1]["background_loss"] or got[0]["target_loss"] != got[1]["target_loss"]


def test_held_out_scores_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts[:8] = ["only once here", "twice in the corpus", "twice in the corpus", "again again again", "", None, "...", "end"]
    rows = [(i if i != 9 else None, t, i % 3 == 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    tokens = [(t or "").replace(".", "").split() for t in texts]
    words = {w for t in tokens for w in t}
    got = {r["doc_id"]: r for r in lm_scoring.corpus_scores(docs, "target", keep=["doc_id"], held_out=True).collect()}
    assert len(got) == len(rows)
    for k, (t, (i, _, _)) in enumerate(zip(tokens, rows)):
        want = []
        for own in (True, False):
            rest = [x for j, (x, r) in enumerate(zip(tokens, rows)) if j != k and (r[2] or not own)]
            pairs = [p for x in rest for p in zip([None, *x], x)]
            one, both, before = (Counter(y) for y in ([w for x in rest for w in x], pairs, [a for a, _ in pairs]))
            unigram = lambda w: (one[w] + 1) / (sum(one.values()) + len(words))
            loss = [-math.log((both[a, b] + lm_scoring.PRIOR * unigram(b)) / (before[a] + lm_scoring.PRIOR)) for a, b in zip([None, *t], t)]
            want.append(np.mean(loss or [0.0]))
        assert got[i]["n_tokens"] == len(t) and np.allclose([got[i]["target_loss"], got[i]["background_loss"], got[i]["difference"]], [*want, want[1] - want[0]])


def test_op8_keeps_every_word(spark, tmp_path):
    rows = [(i, f"common start w{i % 2000} end", "en") for i in range(3000)] + [(4000, "common start w0 end", "en"), (4001, "common start w1 end", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(0, 1500), 4000]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in lm_scoring.op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[0]["background_loss"] < got[1500]["background_loss"] - 1  # w0 occurs in other texts too, w1500 in none
    assert got[0]["target_loss"] < got[1]["target_loss"] - 1  # w0 occurs in another text of the target, w1 in no other
    assert got[4001]["target_loss"] < got[1]["target_loss"] - 1  # which it is for a text that is not of the target


BODY = "<p>First, a sentence of the story, long enough to count.</p><p>Second, and more of it, with commas.</p>"
TEXT = "First, a sentence of the story, long enough to count.\nSecond, and more of it, with commas."
NAV = "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>More</a></ul>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "elementor-widget elementor-widget-theme-post-content"])
@pytest.mark.parametrize("inner", [f"<article><h1>T</h1>{BODY}</article>", f"<main>{BODY}</main>", BODY, f"<h1>T</h1>{BODY}", f"<article><div class=sidebar-left>{BODY}</div></article>"])
def test_wrappers_named_like_boilerplate(name, inner):
    page = f"<body>{NAV}<div class='{name}'>{inner}<div class=sidebar><p>side, side</p></div></div><div id=comments><p>nice</p></div></body>"
    assert html.extract(page) == ("T\n" if "<h1>" in inner else "") + TEXT


def test_boilerplate_stays_out():
    long = "<p>wow, nice, yes, great, thanks, and so on, and on, and on.</p>" * 20
    assert html.extract(f"<body><div class=post>{BODY}</div><div id=comments>{long}</div></body>") == TEXT
    assert html.extract(f"<body><div class=post>{BODY}</div><section id=comments><article class=comment>{long}</article></section></body>") == TEXT
    assert html.extract(f"<body><article>{BODY}</article><div class=sidebar>{long}</div></body>") == TEXT
    assert html.extract("<body><div class=popup><p>all there is</p></div></body>") == "all there is"
    assert html.extract("<body><div class=comments><p>all there is</p></div></body>") == "all there is"
