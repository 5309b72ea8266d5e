"""Token counts of every prefix of a text, by dynamic programming.

The tokenizer never joins tokens across white space, so a text is a row of lumps (what stands between white space), and a lump a
row of words (runs of letters, single digits, runs of signs). Going through a word once, the encoding of each of its prefixes is
found from those of shorter ones (see merges.py). Counts of all prefixes of a lump are stored as a table; a text's table is that of
its lumps and the sums before them, so that questions on totals (its last cell), truncation and budgets need no encoding. A
worker computes the tables of all lumps at once that a batch of texts brings along, and remembers them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandlake.llm import common
from strandlake.llm.merges import END, Batch, Merges, Prefix, byte_names
from strandlake.llm.words import Words, lower

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Lumps and words that a worker remembers, and the longest lump in bytes that goes with others at once.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes of text that are counted at once.
BATCH = 4 << 20
_LUMPS = re.compile(r"[^ \n\t\r]+")
#: How a tokenizer file that Counter can follow cuts words, and the same cut for ASCII.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A)


class Counter:
    """Counts of texts and of all their prefixes, as the library gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        #: Whether this file cuts words and merges them in the way that the tables follow; if not, only whole texts are counted.
        self.by_lump = self._known(spec)
        if self.by_lump:
            self.names = str.maketrans(byte_names())
            self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
            self.words: dict[str, array] = {}
            self.normal: dict[str, str] = {}
            self.batch = Batch(self.merges)
            self.forget()

    def _known(self, spec: dict) -> bool:
        model, cut, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        kinds = [x["type"] for x in cut.get("pretokenizers", [])]
        return (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == END and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and kinds == ["Split", "ByteLevel"] and cut["pretokenizers"][0]["pattern"] == {"Regex": PATTERN} and cut["pretokenizers"][0]["invert"] and not cut["pretokenizers"][1]["add_prefix_space"]
            and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> array:
        """Counts of all prefixes of a word of ASCII, each by itself."""
        if (known := self.words.get(word)) is None:
            if len(word) < 4 and word[0] == "'" and len(word) > 1:  # perhaps a shortened word, whose beginnings are cut otherwise
                known = array("I", [sum(self.word(w)[-1] for w in _ASCII.findall(word[:n])) if n < len(word) else Prefix(self.merges).grown(word)[-1] for n in range(1, len(word) + 1)])
            else:
                known = Prefix(self.merges).grown(word)
            if len(word) <= LONGEST:
                if len(self.words) > REMEMBERED:
                    self.words.clear()
                self.words[word] = known
        return known

    def table(self, lump: str) -> array:
        """Counts of all prefixes of a lump, from one to all of its characters."""
        if lump.isascii() and not (self.special and self.specials.search(lump)):
            return self._ascii(lump.lower())
        out, base, at = array("I"), 0, 0
        for m in [*self.specials.finditer(lump), None] if self.special else [None]:
            text = lump[at : m.start()] if m else lump[at:]
            # inside a special string, its beginning is text like any other
            counts = self._counts(text + m[0] if m else text)
            out.extend(base + n for n in counts[: len(counts) - 1 if m else None])
            if m:
                base += (counts[len(text) - 1] if text else 0) + 1
                out.append(base)
                at = m.end()
        return out

    def _counts(self, text: str) -> array:
        return self._ascii(text.lower()) if text.isascii() else self._any(text)

    def _ascii(self, text: str) -> array:
        out, base, at = array("I"), 0, 0
        for m in _ASCII.finditer(text):
            out.extend(base for _ in range(m.start() - at))  # white space of other kinds
            own = self.word(m[0])
            out.extend(own if not base else (base + n for n in own))
            base, at = base + own[-1], m.end()
        out.extend(base for _ in range(len(text) - at))
        return out

    def _cut(self, text: str) -> list[tuple[str, int, int]]:
        """The library's words of a normalised text, as names of bytes, and where they stand."""
        return [(w, a, b) for w, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _ends(self, text: str) -> int:
        """Tokens of a normalised text."""
        return sum(Prefix(self.merges).grown(w)[-1] for w, _, _ in self._cut(text))

    def _any(self, text: str) -> array:
        """Clusters (a character and the marks that may join it) are normalised by themselves; a prefix that ends inside one is looked
        at as what is before it and that part of the cluster."""
        normalize = self.library.normalizer.normalize_str
        normalize, simple = self.library.normalizer.normalize_str, not any(map(joins, text))
        begin = None if simple else [i for i, c in enumerate(text) if not i or not joins(c)]
        clusters = text if simple else [text[a:b] for a, b in zip(begin, [*begin[1:], len(text)])]
        normal = [self.normal.get(c) or self._normal(c) for c in clusters]
        upto = list(accumulate(map(len, normal), initial=0))
        normal = "".join(normal)
        # of each place in the normalised text: the tokens up to there, and where the word that holds it begins
        count, start, grown = [0], [0], {}
        for name, a, b in self._cut(normal):
            base = count[-1]
            while len(count) <= a:  # white space of other kinds
                start.append(len(count))
                count.append(base)
            word = normal[a:b]
            if len(name) == b - a:
                ends = self.word(name) if simple and name.isascii() else self._grown(name, a, grown)
            else:
                own = self._grown(name, a, grown)
                ends = [own[n - 1] for n in accumulate(len(c.encode()) for c in word)]
            if word[0] == "'" and b - a > 1 and word[1].isalpha():
                ends = [*(self._ends(word[:n]) for n in range(1, b - a)), ends[-1]]
            count += [base + n for n in ends]
            start += [a] * (b - a)
        while len(count) <= len(normal):
            start.append(len(count))
            count.append(count[-1])
        if simple:
            return array("I", [count[n] for n in upto[1:]])
        out = array("I")
        for k, cluster in enumerate(clusters):
            for n in range(1, len(cluster)):
                out.append(self._inside(normal, upto[k], start[upto[k]], count, grown, normalize(cluster[:n])))
            out.append(count[upto[k + 1]])
        return out

    def _grown(self, name: str, at: int, grown: dict[int, Prefix]) -> array:
        grown[at] = prefix = Prefix(self.merges)
        return prefix.grown(name)

    def _normal(self, cluster: str) -> str:
        if len(self.normal) > REMEMBERED:
            self.normal.clear()
        return self.normal.setdefault(cluster, self.library.normalizer.normalize_str(cluster))

    def _inside(self, normal: str, at: int, begin: int, count: list[int], grown: dict[int, Prefix], more: str) -> int:
        """Tokens of the first `at` characters and `more`; begin: where the word that holds the last of them begins."""
        before = count[begin]
        if at - begin <= 8:
            return before + self._ends(normal[begin:at] + more)
        (_, _, size), *rest = self._cut(normal[at - 1] + more)  # whether the word goes on
        if size == 1:
            return count[at] + sum(Prefix(self.merges).grown(w)[-1] for w, _, _ in rest)
        prefix, n = grown[begin], len(normal[begin:at].encode())
        kept = max(0, n - self.merges.longest)  # no token reaches further back
        name = more[: size - 1].encode().decode("latin-1").translate(self.names)
        longer = Prefix(self.merges, prefix.symbols[kept:n], prefix.token[kept : n + 1], prefix.count[kept : n + 1])
        return before + longer.grown(name)[-1] + sum(Prefix(self.merges).grown(w)[-1] for w, _, _ in rest)

    def forget(self) -> None:
        """Remembered lumps: by hash the place in begin, where their tables stand in cells, and in last, what their last cells hold."""
        self.at: dict[int, int] = {}
        self.begin, self.last, self.cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def remembered(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: list[int]) -> None:
        """Computes and stores the tables of lumps that are not known yet; start, end: their bytes in buf."""
        size = end - start
        at = np.concatenate([[0], np.cumsum(size)])
        raw = buf[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        data, lump = lower(raw, True), np.repeat(np.arange(len(size)), size)
        # odd: what is not ASCII or a letter of Latin-1, white space of other kinds, what may be special or a shortened word, long lumps
        after, before = np.append(data[1:], 0), np.concatenate([[0], data[:-1]])
        latin = (data == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        odd = (data >= 0x80) & ~latin & ~((before == 0xC3) & (data < 0xC0)) | (data == 0xC3) & ~latin | (data == 11) | (data == 12)
        odd |= (data == 39) & np.isin(after, np.frombuffer(b"stmdrvl", np.uint8)) | (data == 60) & (after == 124)
        odd[at[1:][size > 0] - 1] |= data[at[1:][size > 0] - 1] == 0xC3
        alone = np.bincount(lump, odd, len(size)) > 0
        alone |= size > LONGEST
        use = ~alone[lump]
        data, lump = data[use], lump[use]
        letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
        digit = (data >= 48) & (data <= 57)
        kind = letter + 2 * digit
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | digit[1:] | (lump[1:] != lump[:-1])
        words = Words(data, np.array([0, len(data)]), np.ones(256, bool))
        words.start = np.flatnonzero(first)
        words.end = np.append(words.start[1:], len(data))
        long = words.end - words.start
        _, one, of = np.unique(words.hashes(), return_index=True, return_inverse=True)  # each word once
        begin = np.concatenate([[0], np.cumsum(long[one])])
        counts = self.batch.grown(data[np.repeat(words.start[one] - begin[:-1], long[one]) + np.arange(begin[-1])], long[one])
        word = np.repeat(np.arange(len(long)), long)
        cells = counts[begin[of][word] + np.arange(len(data)) - words.start[word]].astype(np.int64)
        total = counts[begin[1:] - 1][of]
        base = np.cumsum(total) - total  # tokens before a word, those of all lumps
        lump_of = lump[words.start]
        new = np.concatenate([[True], lump_of[1:] != lump_of[:-1]]) if len(lump_of) else np.zeros(0, bool)
        cells += (base - np.repeat(base[new], np.diff(np.append(np.flatnonzero(new), len(new)))))[word]
        char = np.append(data[1:] & 0xC0 != 0x80, True)[: len(data)]  # ends of characters
        cells, lump = cells[char].astype(np.uint32), lump[char]
        chars = np.bincount(lump, minlength=len(size))
        own = [cells]
        for i in np.flatnonzero(alone).tolist():
            own.append(np.frombuffer(self.table(buf[start[i] : end[i]].tobytes().decode()), np.uint32))
        where = np.cumsum(chars) - chars
        where[alone] = len(cells) + np.cumsum([0, *map(len, own[1:])])[:-1]
        chars[alone] = [len(x) for x in own[1:]]
        flat, known = np.concatenate(own), len(self.at)
        self.at.update(zip(hashes, range(known, known + len(hashes))))
        self.begin.append(where + sum(map(len, self.cells))), self.last.append(flat[where + chars - 1].astype(np.int64)), self.cells.append(flat)

    def totals(self, texts: pa.Array | list[str]) -> list[int]:
        """The last cells of the texts' tables, which are the sums of those of their lumps."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_lump:
            return self.whole([t or "" for t in texts.to_pylist()])
        if len(self.at) > REMEMBERED or sum(map(len, self.cells)) > 16 * REMEMBERED:
            self.forget()
        buf, at = common.buffers(texts)
        words = Words(buf, at, _lump_bytes())
        keys, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        keys = keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            i = first[new]
            self.remembered(buf, words.start[i], words.end[i], [keys[j] for j in new])
        self.last = [last := np.concatenate(self.last)]
        place = np.fromiter((self.at[k] for k in keys), np.int64, len(keys))
        return np.bincount(words.doc, last[place][of], len(texts)).astype(np.int64).tolist()


def _lump_bytes() -> np.ndarray:
    x = np.ones(256, bool)
    x[[32, 10, 9, 13]] = False
    return x


def joins(c: str) -> bool:
    """Whether a character may change with what is before it when texts are normalised: marks, vowels and finals of Hangul."""
    return c >= "\u0300" and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")


@dataclass
class Prefixes:
    """Exact counts of all prefixes of one text."""

    text: str
    tables: list[array] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # characters up to the end of each lump
    totals: list[int] = field(default_factory=list)  # tokens up to there

    @staticmethod
    def of(text: str, counter: Counter) -> Prefixes:
        if not counter.by_lump:
            raise ValueError("this tokenizer joins tokens across white space")
        found = list(_LUMPS.finditer(text))
        known: dict[str, array] = {}
        tables = [known[m[0]] if m[0] in known else known.setdefault(m[0], counter.table(m[0])) for m in found]
        return Prefixes(text, tables, [m.start() for m in found], [m.end() for m in found], list(accumulate(t[-1] for t in tables)))

    def all(self) -> np.ndarray:
        """The whole table: tokens of the first 0, 1, ... characters."""
        out, at, before = np.zeros(len(self.text) + 1, np.int64), 0, 0
        for table, start, end, total in zip(self.tables, self.starts, self.ends, self.totals):
            out[at : start + 1] = before
            out[start + 1 : end + 1] = before + np.frombuffer(table, np.uint32)
            at, before = end + 1, total
        out[at:] = before
        return out

    def count(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        k = bisect_right(self.ends, n_chars)
        before = self.totals[k - 1] if k else 0
        if k < len(self.starts) and self.starts[k] < n_chars:
            return before + self.tables[k][n_chars - self.starts[k] - 1]
        return before

    def truncated(self, budget: int) -> int:
        """The most characters that a prefix of at most `budget` tokens has."""
        k = bisect_right(self.totals, budget)
        if k == len(self.ends):
            return len(self.text)
        best = self.starts[k]
        # a lump of no tokens changes nothing; a longer prefix of a lump may have fewer tokens than a shorter one
        for i in range(k, len(self.ends)):
            before = self.totals[i - 1] if i else 0
            if before > budget:
                break
            fit = np.flatnonzero(np.frombuffer(self.tables[i], np.uint32) <= budget - before)
            best = max(best, self.starts[i], self.starts[i] + int(fit[-1]) + 1 if len(fit) else 0)
        return best


_counters: dict[str, Counter] = {}


def counter(path: str | None = None) -> Counter:
    """One counter for each tokenizer file and worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counted(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens to every row; a null text counts as empty and has none. A column named n_tokens is replaced."""

    def make():
        c = counter(path)
        return lambda texts: [c.totals(texts)]

    return common.map_text(df, make, [T.StructField("n_tokens", T.LongType())], text, keep, BATCH)


def with_prefixes(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the stored counts to every row: prefix_tokens (tokens of the first 0, 1, ... characters), and lump_ends (characters) with
    lump_tokens (tokens up to there)."""

    def make():
        c = counter(path)

        def fn(texts: pa.Array) -> list:
            p = [Prefixes.of(t or "", c) for t in texts.to_pylist()]
            return [[x.all().astype(np.int32) for x in p], [x.ends for x in p], [x.totals for x in p]]

        return fn

    ints = T.ArrayType(T.IntegerType())
    return common.map_text(df, make, [T.StructField("prefix_tokens", ints), T.StructField("lump_ends", ints), T.StructField("lump_tokens", T.ArrayType(T.LongType()))], text, keep)


def within(df: DataFrame, budget: int, path: str | None = None, text: str = "text") -> DataFrame:
    """df with each text cut to its longest prefix of at most `budget` tokens; null stays null."""

    def make():
        c = counter(path)
        cut = lambda t: t if t is None else t[: Prefixes.of(t, c).truncated(budget)]
        return lambda texts: [[cut(t) for t in texts.to_pylist()]]

    into = common.unused("cut", df.columns)
    out = common.map_text(df, make, [T.StructField(into, T.StringType())], text, [c for c in df.columns if c != text])
    return out.select(*[common.col(into if c == text else c).alias(c) for c in df.columns])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = counted(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"), keep=["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
