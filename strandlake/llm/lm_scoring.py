"""Cross-entropy difference of documents under matched target and background bigram models.

Both models share one vocabulary, one order and one smoothing: bigrams with a Dirichlet prior of weight PRIOR, which is the model of
single words with one added. A score is the mean over a document's tokens of background loss less target loss, in nats: positive
where the target model expects the text better.

corpus_scores(), which op8 runs, keeps every word and bigram of all documents. The corpus is cut into parts of bounded size, stored
in a table that is bucketed by part, so that no later step moves texts. A part sends its sorted distinct n-grams with their
counts, cut by ranges of their hashes, to the tasks of the ranges; each of these sums what it got and answers every part with
whole counts in the order in which that part had sent its own, so that answers need no keys. What a task holds is one part or one
range of hashes; only three sums reach the driver. fit() and score() are for other texts: models of a vocabulary of chosen size,
gathered in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common
from strandlake.llm.words import BASE, U, HashSet, Words, letters, lower, mixed

#: Known words of a model that fit() gathers, unless told otherwise.
VOCABULARY = 1023
#: Occurrences that the prior distribution of a context counts as.
PRIOR = 8.0
#: Bytes of text in a part of the corpus, or one text; and what a row counts as besides.
PART_BYTES, ROW_BYTES = 8 << 20, 64
#: The context of a text's first word, in place of a word's hash.
START = U(0)
#: The last two bits of an n-gram's key tell words (0), bigrams (1) and the beginnings of texts (2) apart.
KIND, BIGRAM, BEGINNING = U(2**64 - 4), U(1), U(2)
#: Ids of the target's documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Distinct words that a task holds before it passes them on.
HELD = 1_000_000


def words_of(texts: pa.Array) -> Words:
    buf, at = common.buffers(texts)
    return Words(lower(buf, True), at, letters())


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, of = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(of, np.concatenate(counts), len(k)).astype(np.int64)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the 64-bit hash of every word of all texts, as a signed long, and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def passed() -> pa.RecordBatch:
            k, n = _merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in common.slices(texts):
                k, n = np.unique(words_of(texts.slice(a, b - a)).hashes(), return_counts=True)
                keys.append(k), counts.append(n)
                held += len(k)
                if held > 2 * HELD:
                    k, n = _merged(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD:
                        yield passed()
                        keys, counts, held = [], [], 0
        if held:
            yield passed()

    return df.select(common.col(text).cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    known: HashSet
    ids: np.ndarray  # the token of each key of known

    @property
    def size(self) -> int:
        """Tokens: known words, and one for all others."""
        return len(self.ids) + 1

    def tokens(self, words: Words) -> np.ndarray:
        out = np.full(len(words), len(self.ids), np.int64)
        i, k = self.known.find(words.hashes())
        out[i] = self.ids[k]
        return out

    def cells(self, words: Words) -> np.ndarray:
        """context * size + token of every word; the context of a first word is the token `size`."""
        now = self.tokens(words)
        before = np.concatenate([[0], now[:-1]]) if len(now) else now
        first = words.first[:-1]
        before[first[first < words.first[1:]]] = self.size
        return before * self.size + now


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The most frequent words; of equally frequent ones those of smaller hashes."""
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]
    keys = np.array(top, np.int64).view(U)
    order = np.argsort(keys)
    return Vocabulary(HashSet(keys, 16), order.astype(np.int64))


def bigram_counts(df: DataFrame, vocab: Vocabulary, target: str, text: str = "text") -> DataFrame:
    """(cell, n, target_n): occurrences of each (context, token) in all texts, and in those whose column `target` is true."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        cells = (v.size + 1) * v.size
        both = np.zeros((2, cells), np.int64)
        for batch in batches:
            texts, own = batch.column(0), batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in common.slices(texts):
                words = words_of(texts.slice(a, b - a))
                cell = v.cells(words)
                both[0] += np.bincount(cell, minlength=cells)
                both[1] += np.bincount(cell[own[a:b][words.doc]], minlength=cells)
        at = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[0][at]), pa.array(both[1][at])], ["cell", "n", "target_n"])

    counted = df.select(common.col(text).cast("string").alias("text"), common.col(target).cast("boolean").alias("own")).mapInArrow(run, "cell int, n long, target_n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("target_n").alias("target_n"))


def losses(counts: np.ndarray) -> np.ndarray:
    """-log P(token | context); counts: contexts x tokens."""
    counts = counts.astype(float)
    unigram = (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
    return -np.log((counts + PRIOR * unigram) / (counts.sum(1, keepdims=True) + PRIOR))


@dataclass
class Models:
    vocab: Vocabulary
    target: np.ndarray  # loss of each cell
    background: np.ndarray


def fit(df: DataFrame, target: str, text: str = "text", most: int = VOCABULARY) -> Models:
    """Models of the texts whose boolean column `target` is true, and of all texts."""
    vocab = vocabulary(word_counts(df, text), most)
    got = bigram_counts(df, vocab, target, text).toArrow()
    shape = (vocab.size + 1, vocab.size)
    all_, own = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1], np.int64)
    at = got.column("cell").to_numpy()
    all_[at], own[at] = got.column("n").to_numpy(), got.column("target_n").to_numpy()
    return Models(vocab, losses(own.reshape(shape)).ravel(), losses(all_.reshape(shape)).ravel())


def score(df: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, target_loss and background_loss (means for a token, in nats) and difference to every row.

    A null or empty text, or one without words, has no tokens and zeros. Columns with one of the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)

    def make():
        def fn(texts: pa.Array) -> list:
            m = shared.value
            words = words_of(texts)
            cell, n = m.vocab.cells(words), np.diff(words.first)
            each = np.maximum(1, n)
            t, b = (np.bincount(words.doc, x[cell], len(texts)) / each for x in (m.target, m.background))
            return [n, t, b, b - t]

        return fn

    names = {"n_tokens": T.LongType(), "target_loss": T.DoubleType(), "background_loss": T.DoubleType(), "difference": T.DoubleType()}
    return common.map_text(df, make, [T.StructField(k, v) for k, v in names.items()], text, keep)


def _parted(df: DataFrame, target: str, text: str, keep: list[str], buckets: int) -> DataFrame:
    """Columns k0, k1, ... (those to keep), text, own and part, in a table bucketed by part."""
    source = df.select(*[common.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.col(text).cast("string").alias("text"), F.coalesce(common.col(target).cast("boolean"), F.lit(False)).alias("own"))
    names = [*source.columns, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in common.slices(texts):
                size = len(common.buffers(texts.slice(a, b - a))[0]) + ROW_BYTES * (b - a)
                if held and held + size > PART_BYTES:
                    part, held = part + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.full(b - a, part))], names)

    out, name = source.mapInArrow(run, T.StructType([*source.schema, T.StructField("part", T.LongType())])), f"strandlake_{uuid.uuid4().hex}"
    out.write.option("parquet.block.size", 16 << 20).option("path", common.shared_dir(df.sparkSession)).bucketBy(buckets, "part").saveAsTable(name, format="parquet")
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"drop table {name}")  # only its name: the files are in the shared folder, and the relation knows its buckets
    return table


def _bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token as hashes, which text it stands in, and whether it is the last there."""
    before, now, doc, last = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for a, b in common.slices(texts):
        words = words_of(texts.slice(a, b - a))
        if len(words):
            h = words.hashes()
            context, ends = np.concatenate([[START], h[:-1]]), np.zeros(len(h), bool)
            some = words.first[:-1] < words.first[1:]
            context[words.first[:-1][some]] = START
            ends[words.first[1:][some] - 1] = True
            before.append(context), now.append(h), doc.append(words.doc + a), last.append(ends)
    return np.concatenate(before), np.concatenate(now), np.concatenate(doc), np.concatenate(last)


def _pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mixed(before * U(BASE) + now)


@dataclass
class Grams:
    """The n-grams of a part of the corpus."""

    keys: np.ndarray  # sorted and distinct
    is_word: np.ndarray  # of each key
    rank: np.ndarray  # of each key that is a word, among those
    word: np.ndarray  # place in keys of each token's word
    pair: np.ndarray  # and of its bigram
    doc: np.ndarray
    first: np.ndarray  # whether a token is the first of its text
    counts: list[np.ndarray]  # of the keys, in all texts and in the target's; of the words as last ones, in both

    @staticmethod
    def of(texts: pa.Array, own: np.ndarray) -> Grams:
        before, now, doc, last = _bigrams(texts)
        m, first, mine = len(now), before == START, own[doc]
        keys, at = np.unique(np.concatenate([now & KIND, _pair(before, now) & KIND | BIGRAM, np.full(int(first.sum()), BEGINNING)]), return_inverse=True)
        is_word = keys & ~KIND == 0
        rank = np.cumsum(is_word) - 1
        ends, count = rank[at[:m][last]], lambda i, size, by=None: np.bincount(i, by, size).astype(U)
        counts = [count(at, len(keys)), count(at, len(keys), np.concatenate([mine, mine, mine[first]])), count(ends, int(is_word.sum())), count(ends, int(is_word.sum()), mine[last])]
        return Grams(keys, is_word, rank, at[:m], at[m : 2 * m], doc, first, counts)

    def loss(self, n: np.ndarray, ends: np.ndarray, tokens: int, kinds: int, less: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Of each token, from the whole counts of the keys, and of the words as last ones. What follows a word is all its occurrences
        but those. less: what of each of these counts is not to be regarded, for each token."""
        n = n.astype(float)
        pair, word, followed = n[self.pair], n[self.word], n[self.word] - ends.astype(float)[self.rank[self.word]]
        begun = n[np.searchsorted(self.keys, BEGINNING)] if self.first.any() else 0.0
        if less:
            pair, word, followed, begun, tokens = (x - y for x, y in zip((pair, word, followed, begun, tokens), less))
        context = np.where(self.first, begun, np.concatenate([followed[:1], followed[:-1]]))
        return -np.log((pair + PRIOR * (word + 1) / (tokens + kinds)) / (context + PRIOR))

    def within(self) -> tuple[np.ndarray, ...]:
        """For each token, how often its own text has its bigram, its word, and its word with another one behind it; its beginnings (1) and tokens."""
        pair, word = (self._again(x) for x in (self.pair, self.word))
        last = np.zeros(int(self.doc[-1]) + 1 if len(self.doc) else 0, np.int64)
        last[self.doc] = self.word  # of equal places the last one stays
        return pair, word, word - (self.word == last[self.doc]), np.ones(len(self.doc), np.int64), np.bincount(self.doc)[self.doc]

    def _again(self, at: np.ndarray) -> np.ndarray:
        _, of, n = np.unique(self.doc * len(self.keys) + at, return_inverse=True, return_counts=True)
        return n[of]


def _packed(x: np.ndarray) -> bytes:
    """Numbers, their bytes in planes (those of small numbers are mostly zeros), compressed."""
    return pa.compress(np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True) if len(x) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view(U).reshape(n) if n else np.zeros(0, U)


_COUNTS = ["n", "own_n", "ends", "own_ends"]
_SENT = "part long, bucket int, size int, words int, keys binary, n binary, own_n binary, ends binary, own_ends binary"
_TOLD = "part long, bucket int, size int, words int, n binary, own_n binary, ends binary, own_ends binary, tokens long, own_tokens long, kinds long"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the keys: rising with them."""
    return (keys >> U(32)) * U(buckets) >> U(32)


def _sent(buckets: int):
    """What a part sends: a row for each range of keys that it has."""

    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("own").to_numpy().astype(bool)
        grams = Grams.of(rows.column("text").cast(pa.large_string()).combine_chunks(), own)
        which = _bucket(grams.keys, buckets)
        begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
        words = np.concatenate([[0], np.cumsum(grams.is_word)])
        out = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(which)]):
            u, v = int(words[a]), int(words[b])
            keys = grams.keys[a:b]
            counts = [_packed(x[a:b]) for x in grams.counts[:2]] + [_packed(x[u:v]) for x in grams.counts[2:]]
            out.append((rows.column("part")[0].as_py(), int(which[a]), b - a, v - u, _packed(np.diff(keys, prepend=U(0))), *counts))
        del grams
        common.trim()
        schema = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("words", pa.int32()), ("keys", pa.binary()), *((c, pa.binary()) for c in _COUNTS)])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what all parts sent of one range of keys: to each part the whole counts of its keys, in its order; and in a row of part -1
    the tokens, those of the target, and the distinct words of the range."""
    held = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
    if held is None:
        return
    sent = [held.column(c).to_pylist() for c in ("part", "bucket", "size", "words", "keys", *_COUNTS)]
    del held
    each = [np.cumsum(_unpacked(k, n), dtype=U) for k, n in zip(sent[4], sent[2])]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    is_word = np.concatenate(each) & ~KIND == 0
    total = [np.bincount(i, np.concatenate([_unpacked(x, n) for x, n in zip(c, size)]), len(keys)).astype(U) for c, size, i in zip(sent[5:], (sent[2], sent[2], sent[3], sent[3]), (at, at, at[is_word], at[is_word]))]
    own = keys & ~KIND == 0
    names, types = ["part", "bucket", "size", "words", *_COUNTS, "tokens", "own_tokens", "kinds"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)
    yield row(-1, None, None, None, None, None, None, None, int(total[0][own].sum()), int(total[1][own].sum()), int(own.sum()))
    begin = 0
    for part, bucket, size, words in zip(*sent[:4]):
        i = at[begin : begin + size]
        w = i[is_word[begin : begin + size]]
        yield row(part, bucket, size, words, *(_packed(t[j]) for t, j in zip(total, (i, i, w, w))), None, None, None)
        begin += size
    del sent, each, keys, at, is_word, total
    common.trim()


def corpus_scores(df: DataFrame, target: str, text: str = "text", keep: list[str] | None = None, held_out: bool = False) -> DataFrame:
    """What score() adds, under models of all words and bigrams of df itself; target model: rows whose column `target` is true.

    held_out: a text is scored by the models of all other texts (another row's copy of it is another text), so that the target's
    own texts have no advantage.
    """
    names = {"n_tokens": T.LongType(), "target_loss": T.DoubleType(), "background_loss": T.DoubleType(), "difference": T.DoubleType()}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = _parted(df, target, text, kept, n)
    buckets = max(n, docs.select("part").distinct().count() // 2)  # so many keys of a part that a task's share is bounded
    sent = docs.select("text", "own", "part").groupBy("part").applyInArrow(_sent(buckets), _SENT)
    told = common.stored(sent.repartitionById(buckets, "bucket").mapInArrow(_told, _TOLD))
    total = told.filter("part = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "own_tokens", "kinds")]).first()
    tokens, kinds = (total["tokens"], total["own_tokens"]), total["kinds"]
    out = T.StructType([*docs.schema[: len(kept)], *(T.StructField(k, v) for k, v in names.items())])

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        mine = rows.column("own").to_numpy().astype(bool)
        grams = Grams.of(rows.column("text").cast(pa.large_string()).combine_chunks(), mine)
        told = told.sort_by("bucket")
        size, words = (told.column(c).to_pylist() for c in ("size", "words"))
        n, own_n, ends, own_ends = (np.concatenate([np.zeros(0, U), *(_unpacked(x, k) for x, k in zip(told.column(c).to_pylist(), by))]) for c, by in zip(_COUNTS, (size, size, words, words)))
        if len(n) != len(grams.keys):
            raise ValueError("the answers don't fit the part")
        each = np.bincount(grams.doc, minlength=len(rows))
        mean = lambda loss: np.bincount(grams.doc, loss, len(rows)) / np.maximum(1, each)
        less = grams.within() if held_out else None
        all_ = mean(grams.loss(n, ends, tokens[0], kinds, less))
        own = mean(grams.loss(own_n, own_ends, tokens[1], kinds, less and tuple(x * mine[grams.doc] for x in less)))
        scored = pa.table([*rows.columns[: len(kept)], *(pa.array(x) for x in (each, own, all_, all_ - own))], names=[f.name for f in out])
        del grams, less, n, own_n, ends, own_ends
        common.trim()
        return scored

    answers = told.filter("part >= 0").select("part", "bucket", "size", "words", *_COUNTS)
    scored = docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, out)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *names)


def with_target(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """docs with a boolean column `target`: whether its doc_id is in ids (one column of distinct ids)."""
    known = ids.select(F.col(ids.columns[0]).alias("doc_id"), F.lit(True).alias("__own"))
    known = F.broadcast(known) if known.limit(most + 1).count() <= most else known
    return docs.join(known, "doc_id", "left").select(*[common.col(c) for c in docs.columns if c != "target"], F.coalesce("__own", F.lit(False)).alias("target"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled as of quality and not toxic. Background: all documents. Each is scored by the others."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    good = common.table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct()
    return corpus_scores(with_target(docs, good), "target", keep=["doc_id"], held_out=True)
