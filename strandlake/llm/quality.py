"""Quality: attention-based multiple-instance learning over the passages of a text.

Every passage (PASSAGE white-space words; the last may be shorter) is encoded: rates of character classes, repetition and word
shapes, then a learned tanh layer. Gated attention weighs the passages of a text, and a logistic unit scores the weighted sum.
Only labels of whole documents are learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common
from strandlake.llm.fitting import labelled, trained
from strandlake.llm.words import Words, not_space

#: Labelled rows of each class that are learned from, at most.
SAMPLE = 3000
#: A text is kept from this score on.
LIMIT = 0.3
PASSAGE = 24
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin (n+1 places). A text without words has one passage of zeros."""
    raw, at = common.buffers(texts)
    words, n = Words(raw, at, not_space()), len(texts)
    n_words = np.diff(words.first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(n_pass)])
    of_word = begin[words.doc] + (np.arange(len(words)) - words.first[words.doc]) // PASSAGE
    size = np.bincount(of_word, minlength=begin[-1]).astype(float)
    each = np.maximum(1, size)
    length = (words.end - words.start).astype(float)
    n_bytes = np.maximum(1, np.bincount(of_word, length, begin[-1]))

    def byte_rate(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.bincount(of_word, total[words.end] - total[words.start], begin[-1]) / n_bytes

    def word_rate(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, mask, begin[-1]) / each

    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    sign = ~letter & ~digit & (raw > 32)
    twice = np.zeros(len(raw), bool)
    if len(raw):
        twice[1:] = sign[1:] & (raw[1:] == raw[:-1])
    h = words.hashes()
    before = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[: len(h) - k]) & (words.doc[k:] == words.doc[: len(h) - k])])
    keys = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # the passage, and 40 bits of the word
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=begin[-1]) / each
    last = raw[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    initial = raw[words.start] if len(h) else np.zeros(0, np.uint8)
    x = [byte_rate(upper), byte_rate(sign), byte_rate(raw == 33), byte_rate(np.isin(raw, np.frombuffer(b"#$%&*", np.uint8))), byte_rate(raw == 124), byte_rate(digit), byte_rate(raw >= 128), byte_rate(twice)]
    x += [n_bytes / each / 10, np.sqrt(np.maximum(0, np.bincount(of_word, length**2, begin[-1]) / each - (n_bytes / each) ** 2)) / 10, word_rate(length == 1), word_rate(before(1)), word_rate(before(2)), distinct]
    x += [word_rate((initial >= 65) & (initial <= 90)), word_rate(np.isin(last, np.frombuffer(b".,;:?", np.uint8))), word_rate(np.isin(last, np.frombuffer(b"!#$%&*|", np.uint8))), size / PASSAGE]
    return np.stack([np.asarray(v, float) for v in x], 1), begin


@dataclass
class Model:
    """weights None: no label of one class was there, and every text gets `prior`."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        e = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-np.clip(e @ w["U"], -30, 30)))
        s = (v * u) @ w["a"]
        n = np.diff(begin)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, begin[:-1]), n))
        a = s / np.repeat(np.add.reduceat(s, begin[:-1]), n)
        z = np.add.reduceat(a[:, None] * e, begin[:-1])
        return {"e": e, "v": v, "u": u, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))}

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss of texts, by each of the weights."""
        w, f, n = self.weights, self.forward(x, begin), np.diff(begin)
        g = weight * (f["p"] - y) / len(y)
        grad = {"c": f["z"].T @ g, "b": g.sum(keepdims=True)}
        gz = np.repeat(g[:, None] * w["c"], n, 0)
        ga = (gz * f["e"]).sum(1)
        gs = f["a"] * (ga - np.repeat(np.add.reduceat(f["a"] * ga, begin[:-1]), n))
        grad["a"] = (f["v"] * f["u"]).T @ gs
        gv, gu = gs[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2), gs[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
        grad["V"], grad["U"] = f["e"].T @ gv, f["e"].T @ gu
        ge = (f["a"][:, None] * gz + gv @ w["V"].T + gu @ w["U"].T) * (1 - f["e"] ** 2)
        grad["E"], grad["e"] = x.T @ ge, ge.sum(0)
        return grad

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        out = []
        for a, b in common.slices(texts):
            x, begin = passages(texts.slice(a, b - a))
            out.append(self.forward(self.normal(x), begin)["p"])
        return np.concatenate(out).round(9) if out else np.zeros(0)  # matrix products differ in the last bits by what else is in a batch


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, width: int = 16, gate: int = 8, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the weighted logistic loss of documents, in a fixed order of batches."""
    y = np.asarray(y, float)
    total = float(weight.sum())
    prior = float((weight * y).sum() / total) if total else 0.0
    if not len(y) or y.min() == y.max():
        return Model(prior)
    parts = [passages(texts.slice(a, b - a)) for a, b in common.slices(texts)]
    x = np.concatenate([p[0] for p in parts])
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    rng, d = np.random.default_rng(7), x.shape[1]
    model = Model(prior, x.mean(0), x.std(0) + 1e-3, {"E": rng.normal(0, d**-0.5, (d, width)), "e": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gate)), "U": rng.normal(0, width**-0.5, (width, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, width**-0.5, width), "b": np.zeros(1)})
    x, w = model.normal(x), model.weights
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            n = np.diff(begin)[docs]
            rows = np.repeat(begin[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            xb, bb = x[rows], np.concatenate([[0], np.cumsum(n)])
            grad = model.gradients(xb, bb, y[docs], weight[docs])
            step += 1
            for k, v in grad.items():
                v = v + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v**2
                w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return trained(labelled(docs, labels, "quality", HELD_OUT, sample), train)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, into: str = "quality") -> DataFrame:
    """Adds a double from 0 to 1 to every row; null texts count as empty, equal texts score alike. A column named `into` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return common.map_text(df, lambda: lambda texts: [shared.value.score(texts)], [T.StructField(into, T.DoubleType())], text, keep)


def reject(df: DataFrame, model: Model, limit: float = LIMIT, text: str = "text") -> DataFrame:
    """df without the rows that score below limit; all columns stay as they are."""
    into = common.unused("score", df.columns)
    return score(df, model, text, df.columns, into).filter(F.col(into) >= limit).drop(into)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= LIMIT).cast("int").alias("predicted"))
