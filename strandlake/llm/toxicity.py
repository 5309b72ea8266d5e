"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

The features are lexicon densities (a fixed list of insults, and words and word beginnings that the labelled sample shows
mostly in toxic texts), how close lexicon words stand to a second person, and rates of capitals, punctuation, repetition and
obfuscation. Scores of the calibration come from folds whose lexicon and trees have not seen the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common
from strandlake.llm.boosting import Trees, boost, isotonic
from strandlake.llm.fitting import labelled, trained
from strandlake.llm.words import HashSet, Words, letters, lower, not_space

#: Labelled rows of each class that are learned from, at most.
SAMPLE = 4000
#: A text is toxic from this score on.
LIMIT = 0.3
#: Beginnings of words, in bytes, that the learned lexicon looks at; 0: whole words.
LENGTHS = (0, 4, 5, 6, 7, 9)
#: Share of the toxic texts that hold a lexicon entry, at least, for the three strengths of the lexicon.
TIERS = (0.001, 0.005, 0.02)
#: Insults and threats.
INSULTS = """idiot moron stupid loser pathetic scum trash clown worthless disgusting fool dumb jerk bastard bitch asshole crap
shit fuck fucking whore slut retard retarded imbecile vermin filth filthy garbage hate kill die ugly creep pig coward
dummkopf arschloch scheisse scheiße hurensohn trottel depp abschaum widerlich dumm
connard salaud merde putain idiote imbécile débile ordure crétin
estúpido estúpida imbécil mierda puta cabrón gilipollas basura asqueroso tonto""".split()
#: Words for the second person.
YOU = "you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
NEAR = 5


def word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
    return Words(np.frombuffer(b" ".join(data) + b" ", np.uint8), at, letters()).hashes()


@dataclass
class Lexicon:
    """For each length of LENGTHS: hashes, how much likelier toxic texts hold them (log), and their strength."""

    sets: list[HashSet] = field(default_factory=list)
    odds: list[np.ndarray] = field(default_factory=list)
    tier: list[np.ndarray] = field(default_factory=list)


class Sample:
    """The distinct entries of each labelled text, to learn lexicons of any subset of texts from."""

    def __init__(self, texts: pa.Array):
        self.n, self.keys, self.doc, self.key = len(texts), [], [], []
        for n in LENGTHS:  # one length at a time: the entries of all at once would be six times the memory
            docs, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for begin, end in common.slices(texts):
                buf, at = common.buffers(texts.slice(begin, end - begin))
                words = Words(lower(buf, True), at, letters())
                h = words.prefixes(n) if n else words.hashes()
                order = np.lexsort((h, words.doc))
                h, doc = h[order], words.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                docs.append((doc[new] + begin).astype(np.int32)), hashes.append(h[new])
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            keys, key, times = np.unique(h, return_inverse=True, return_counts=True)
            often = times >= 3  # no rarer entry can enter a lexicon
            use = often[key]
            self.keys.append(keys[often]), self.doc.append(doc[use]), self.key.append((np.cumsum(often) - 1)[key[use]].astype(np.int32))

    def lexicon(self, y: np.ndarray, rows: np.ndarray) -> Lexicon:
        out, n1, n0 = Lexicon(), max(1, int(y[rows].sum())), max(1, int((1 - y[rows]).sum()))
        for keys, doc, key in zip(self.keys, self.doc, self.key, strict=True):
            use = rows[doc]
            one = np.bincount(key[use], y[doc[use]], len(keys))
            none = np.bincount(key[use], 1 - y[doc[use]], len(keys))
            odds = np.log((one + 0.5) / (n1 + 1)) - np.log((none + 0.5) / (n0 + 1))
            good = np.flatnonzero((one >= 3) & (one >= TIERS[0] * n1) & (odds >= 1.5))
            out.sets.append(HashSet(keys[good])), out.odds.append(odds[good].astype(np.float32))
            out.tier.append(np.searchsorted(np.array(TIERS) * n1, one[good], "right").astype(np.int8))
        return out


_INSULTS, _YOU = HashSet(word_hashes(INSULTS), 12), HashSet(word_hashes(YOU), 12)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features for each text; a text without words has zeros."""
    raw, at = common.buffers(texts)
    n, buf = len(texts), lower(raw, True)
    words, lumps = Words(buf, at, letters()), Words(raw, at, not_space())
    per_doc = lambda i, w=None: np.bincount(words.doc[i], w, n)
    odds, tier = np.zeros(len(words), np.float32), np.zeros(len(words), np.int8)
    for size, s, o, t in zip(LENGTHS, lexicon.sets, lexicon.odds, lexicon.tier, strict=True):
        i, k = s.find(words.prefixes(size) if size else words.hashes())
        odds[i], tier[i] = np.maximum(odds[i], o[k]), np.maximum(tier[i], np.where(o[k] >= 3, t[k], 0))
    insult = np.zeros(len(words), bool)
    insult[_INSULTS.find(words.hashes())[0]] = True
    you = np.zeros(len(words), bool)
    you[_YOU.find(words.hashes())[0]] = True
    marked = np.flatnonzero(insult | (tier >= 2))
    near = np.zeros(len(marked))
    for i in range(-NEAR, NEAR + 1):
        j = np.clip(marked + i, 0, max(0, len(words) - 1))
        near = np.maximum(near, (you[j] & (words.doc[j] == words.doc[marked])).astype(float))
    hit = np.flatnonzero(odds > 0)
    n_words = np.maximum(1, np.diff(words.first)).astype(float)
    n_bytes = np.maximum(1, np.diff(at)).astype(float)
    n_lumps = np.maximum(1, np.diff(lumps.first)).astype(float)
    best = np.zeros(n, np.float32)
    np.maximum.at(best, words.doc[hit], odds[hit])
    out = [best, per_doc(hit, odds[hit]) / n_words, per_doc(hit, odds[hit])]
    for level in (1, 2, 3):
        i = np.flatnonzero(tier >= level)
        out += [per_doc(i), per_doc(i) / n_words]
    i = np.flatnonzero(insult)
    out += [per_doc(i), per_doc(i) / n_words, np.bincount(words.doc[marked], near, n), per_doc(np.flatnonzero(you)) / n_words]

    def rate(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]) / n_bytes

    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    sign = (raw > 32) & (raw < 127) & ~letter & ~digit
    twice, within = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) > 2:
        twice[1:] = sign[1:] & (raw[1:] == raw[:-1])
        within[1:-1] = letter[:-2] & letter[2:] & (digit | np.isin(raw, np.frombuffer(b"@$*!+#", np.uint8)))[1:-1]
    single = np.zeros(len(words), bool)
    short = (words.end - words.start) == 1
    if len(words) > 2:
        single[1:-1] = short[:-2] & short[1:-1] & short[2:]
    out += [rate(upper), rate(sign), rate(raw == 33), rate(twice), rate(digit), rate(raw >= 128), per_doc(np.flatnonzero(single)) / n_words]
    total = np.concatenate([[0], np.cumsum(within, dtype=np.int64)])
    out += [(total[at[1:]] - total[at[:-1]]) / n_lumps]
    h = words.hashes()
    same = np.flatnonzero(np.concatenate([[False], (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])])) if len(words) else np.zeros(0, np.int64)
    out += [per_doc(same) / n_words, np.log1p(np.diff(words.first)), np.diff(at) / n_words]
    return np.stack([np.asarray(x, float) for x in out], 1)


@dataclass
class Model:
    """lexicon and trees None: no label of one class was there, and every text gets `prior`."""

    prior: float
    lexicon: Lexicon | None = None
    trees: Trees | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = np.concatenate([self.trees.raw(features(texts.slice(a, b - a), self.lexicon)) for a, b in common.slices(texts)] or [np.zeros(0)])
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, folds: int = 3) -> Model:
    """A model of labelled texts. Equal texts share a fold."""
    y = np.asarray(y, float)
    total = float(weight.sum())
    if len(y) < 2 * folds or y.min() == y.max():
        return Model(float((weight * y).sum() / total) if total else 0.0)
    sample = Sample(texts)
    fold = np.array([hash_of(t) for t in texts.to_pylist()]) % folds
    x, raw, seen = None, np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(folds):
        own, rest = np.flatnonzero(fold == k), fold != k
        lexicon = sample.lexicon(y, rest)
        got = _features(texts.take(pa.array(own)), lexicon)
        x = np.zeros((len(y), got.shape[1])) if x is None else x
        x[own] = got
    for k in range(folds):
        own, rest = fold == k, fold != k
        if own.any() and rest.any() and 0 < y[rest].sum() < rest.sum():
            raw[own], seen[own] = boost(x[rest], y[rest], weight[rest]).raw(x[own]), True
    trees = boost(x, y, weight)
    if not seen.any():
        raw, seen = trees.raw(x), np.ones(len(y), bool)
    knots, values = isotonic(raw[seen], y[seen], weight[seen])
    return Model(float((weight * y).sum() / total), sample.lexicon(y, np.ones(len(y), bool)), trees, knots, values)


def _features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    parts = [features(texts.slice(a, b - a), lexicon) for a, b in common.slices(texts)]
    return np.concatenate(parts) if parts else features(texts, lexicon)


def hash_of(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode())


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return trained(labelled(docs, labels, "toxic", HELD_OUT, sample), train)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, into: str = "toxicity") -> DataFrame:
    """Adds a double from 0 to 1 to every row; null texts count as empty, equal texts score alike. A column named `into` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return common.map_text(df, lambda: lambda texts: [shared.value.score(texts)], [T.StructField(into, T.DoubleType())], text, keep)


def reject(df: DataFrame, model: Model, limit: float = LIMIT, text: str = "text") -> DataFrame:
    """df without the rows that score limit or more; all columns stay as they are."""
    into = common.unused("score", df.columns)
    return score(df, model, text, df.columns, into).filter(F.col(into) < limit).drop(into)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= LIMIT).cast("int").alias("predicted"))
