"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled character map (identity where a model has none), and every
normalised byte records the byte of the text that it comes from; pieces then project to spans of the original bytes. BPE never
joins across the start of a word if no piece of the model holds a word mark behind anything but word marks, so each word is encoded
once and remembered; a model without that property is given whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from strandlake.llm import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MARK_BYTES = MARK.encode()
#: Words that a task remembers in a generation, and the longest that it does.
REMEMBERED, LONGEST = 150_000, 48


class CharMap:
    """A compiled character map: the size of a double-array trie (4 bytes), the trie, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.text[begin : self.text.index(b"\0", begin)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Normalizer:
    def __init__(self, spec: proto.NormalizerSpec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def plain(self) -> bool:
        """Nothing changes but spaces, each by itself."""
        return not self.map.units and self.escape and not self.trim and not self.suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and the end, the byte of the text that it comes from."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain():
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, 3, 1)
            come = np.repeat(np.arange(len(raw)), width)
            out, come = data.replace(b" ", MARK_BYTES), np.append(come, len(raw))
            return (MARK_BYTES + out, np.concatenate([np.zeros(3, np.int64), come])) if self.prefix else (out, come)
        space = MARK_BYTES if self.escape else b" "
        parts, come, at, blank = [], [], 0, self.trim
        pieces = []
        while at < len(data):
            got = self.map.longest(data, at)
            if got is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got = n, data[at : at + n]
            pieces.append((at, got[1]))
            at += got[0]
        for begin, piece in pieces:
            for i, b in enumerate(piece):
                if b == 32 and self.trim and blank:
                    continue
                new = space if b == 32 else bytes([b])
                blank = b == 32
                parts.append(new)
                come += [begin] * len(new)
        out = b"".join(parts)
        end = len(data)
        if self.trim:
            while out.endswith(space):
                out, end = out[: -len(space)], come[len(out) - len(space)]
                come = come[: len(out)]
        if self.prefix and out:
            first = come[0] if come else 0
            out, come = (out + space, come + [end] * len(space)) if self.suffix else (space + out, [first] * len(space) + come)
        return out, np.array([*come, end], np.int64)


class Codec:
    """encode() gives the library's ids; spans() the bytes of the text behind each of them."""

    def __init__(self, path: str):
        self.model = proto.ModelProto()
        with open(path, "rb") as f:
            self.model.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = Normalizer(self.model.normalizer_spec, self.model.trainer_spec.treat_whitespace_as_suffix)
        kinds = proto.ModelProto.SentencePiece
        names = [p.piece for p in self.model.pieces]
        self.sizes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in self.model.pieces], np.int64)
        self.text = [str(i) for i in range(len(names))]
        own = not any(p.type == kinds.USER_DEFINED for p in self.model.pieces)
        inside = any(MARK in p.piece.lstrip(MARK) for p in self.model.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN))
        bpe = self.model.trainer_spec.model_type == proto.TrainerSpec.BPE and self.model.trainer_spec.byte_fallback
        self.by_word = own and not inside and bpe and self.normalizer.plain() and not any(self.model.denormalizer_spec.precompiled_charsmap)
        if self.by_word:
            bare = proto.ModelProto()
            bare.CopyFrom(self.model)
            bare.normalizer_spec.add_dummy_prefix = False
            self.bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
            lines = not any("\n" in n for n in names)
            self.word = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Word -> its ids as bytes: those met since the last change of generation, and those met before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]
        first = MARK if self.normalizer.prefix else ""
        words = [self.word.findall(first + t.replace(" ", MARK)) if t else [] for t in texts]
        young, old = self.young, self.old
        new = []
        for w in {w for ws in words for w in ws}.difference(young):
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = ids
        for w, ids in zip(new, self.bare.encode(new, num_threads=1), strict=True):
            young[w] = np.array(ids, np.int32).tobytes()
        out = [np.frombuffer(b"".join([young[w] for w in ws]), np.int32) for ws in words]
        for w in new:
            if len(w) > LONGEST:
                del young[w]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) if x else "" for x in ids]

    def all_spans(self, texts: list[str], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """spans() of many texts, one after another: begins and ends."""
        unknown = any((x == self.library.unk_id()).any() for x in ids)  # whose pieces have any length
        if unknown or not self.normalizer.plain():
            got = [self.spans(t, x) for t, x in zip(texts, ids, strict=True)] or [np.zeros((0, 2), np.int64)]
            return np.concatenate([x[:, 0] for x in got]), np.concatenate([x[:, 1] for x in got])
        data = [t.encode() for t in texts]
        size = np.array([len(x) for x in data], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        raw, lead = np.frombuffer(b"".join(data), np.uint8), 3 * self.normalizer.prefix
        come = np.append(np.repeat(np.arange(len(raw)), 1 + 2 * (raw == 32)), len(raw))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        n = np.array([len(x) for x in ids], np.int64)
        of, width = np.repeat(np.arange(len(ids)), n), self.sizes[flat]
        ends = np.cumsum(width)
        spaces = np.concatenate([[0], np.cumsum(raw == 32)])
        normal = size + 2 * (spaces[at[1:]] - spaces[at[:-1]]) + lead * (size > 0)
        if (np.bincount(of, width, len(ids)) != normal).any():
            raise ValueError("the ids don't spell the texts")
        before = lead * np.cumsum(size > 0)[of]  # marks put before this text and all earlier ones
        begins = come[np.maximum(ends - width - before, at[of] + 2 * spaces[at[of]])]
        return begins - at[of], come[ends - before] - at[of]

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(begin, end) bytes of the text for each id; pieces made of nothing in the text are empty spans.

        Raises ValueError if the ids don't spell the normalised text.
        """
        normal, come = self.normalizer(text)
        ids = np.asarray(ids, np.int64)
        if (ids == self.library.unk_id()).any():
            return self._spans_by_piece(normal, come, text)
        ends = np.cumsum(self.sizes[ids]) if len(ids) else np.zeros(0, np.int64)
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the ids don't spell the text")
        return np.stack([come[ends - self.sizes[ids]], come[ends]], 1) if len(ids) else np.zeros((0, 2), np.int64)

    def _spans_by_piece(self, normal: bytes, come: np.ndarray, text: str) -> np.ndarray:
        at, out = 0, []
        for piece in self.library.encode(text, out_type=str):
            size = len(piece.encode())
            if normal[at : at + size] != piece.encode():
                raise ValueError("the pieces don't spell the text")
            out.append((come[at], come[at + size]))
            at += size
        return np.array(out, np.int64).reshape(-1, 2)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model file and worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """Adds ids, begins and ends (bytes of the original text for each id) and decoded to every row; null counts as empty.
    verify: instead of decoded, round_trip: whether that is the text.

    path: of a model file that all executors have; None: the public model, found on each executor. A column of df with one of
    the new names is replaced.
    """

    def make():
        c = codec(path or model_path())

        def fn(texts: pa.Array) -> list:
            rows = [t or "" for t in texts.to_pylist()]
            ids = c.arrays(rows)
            begins, ends = c.all_spans(rows, ids)
            cut = np.cumsum([len(x) for x in ids])[:-1]
            begins, ends = begins.astype(np.int32), ends.astype(np.int32)
            back = c.decode(lists := [x.tolist() for x in ids])
            return [lists, np.split(begins, cut), np.split(ends, cut), [a == b for a, b in zip(back, rows)] if verify else back]

        fn.close = c.forget
        return fn

    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("ids", ints), T.StructField("begins", ints), T.StructField("ends", ints), T.StructField("round_trip", T.BooleanType()) if verify else T.StructField("decoded", T.StringType())]
    return common.map_text(df, make, fields, text, keep)


def digests(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and covered_bytes (bytes of the text that some piece's span holds)."""

    def make():
        c = codec(path or model_path())

        def fn(texts: pa.Array) -> list:
            rows = [t or "" for t in texts.to_pylist()]
            arrays, name, sha = c.arrays(rows), c.text, lambda x: hashlib.sha256(x.encode()).hexdigest()
            begins, ends = c.all_spans(rows, arrays)
            total = np.concatenate([[0], np.cumsum(ends - begins)])
            at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
            ids = [x.tolist() for x in arrays]
            return [[len(x) for x in ids], [sha(",".join([name[i] for i in x])) for x in ids], [sha(t) for t in c.decode(ids)], total[at[1:]] - total[at[:-1]]]

        fn.close = c.forget
        return fn

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("covered_bytes", T.LongType())]
    return common.map_text(df, make, fields, text, keep)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
