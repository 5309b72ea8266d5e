"""Telephony audio: mu-law, A-law and IMA ADPCM payloads, decoded and resampled with numpy.

Payloads are kept as WAV files of one channel at 8 kHz whose data bytes are the payload itself (format 7, mu-law codes), so the
store is lossless. mu-law and A-law are expanded by tables of 256 samples; ADPCM blocks are decoded in step with one another:
one numpy operation advances all blocks of a batch by a sample. Decoded samples are resampled to 16 kHz, 16 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import common

RATE = 8000
BLOCK = 64
#: Bytes of a payload that are decoded at once, a multiple of BLOCK.
PIECE = 1 << 20
CODECS = ("mulaw", "alaw", "adpcm")
FORMAT_TAG = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
#: Changes of the step index by code, of IMA ADPCM.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: The 89 quantizer steps of IMA ADPCM.
STEPS = np.array(
    """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279
    307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026
    4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767""".split(),
    np.int64,
)


def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, (size + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (one row each): 2 bytes first sample, 1 byte step index, 1 unused, then low nibbles first.

    An index beyond the table counts as its last; a block of 64 bytes has 121 samples.
    """
    n, width = blocks.shape
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = sample
    for k in range(2 * (width - 4)):
        byte = blocks[:, 4 + k // 2]
        code = ((byte >> 4) if k % 2 else (byte & 15)).astype(np.int64)
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        sample = np.clip(np.where(code & 8, sample - change, sample + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[1 + k] = sample
    return out.T


def decode(payload: np.ndarray, codec: str, block: int = BLOCK) -> np.ndarray:
    """16-bit samples of payload bytes. ADPCM payloads must be whole blocks."""
    if codec == "adpcm":
        if len(payload) % block:
            raise ValueError(f"{len(payload)} bytes are no whole blocks of {block}")
        return adpcm(payload.reshape(-1, block)).reshape(-1)
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def resample(pcm: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate, by the mean of neighbours (halves go down); the last sample of each clip is held. at: where clips begin and end."""
    out = np.empty((len(pcm), 2), np.int16)
    if len(pcm):
        after = np.append(pcm[1:], pcm[-1])
        if at is not None:
            after[at[1:] - 1] = pcm[at[1:] - 1]
        out[:, 0] = pcm
        out[:, 1] = (pcm.astype(np.int32) + after) >> 1
    return out.reshape(-1)


def wav(data: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A WAV file of one channel whose data chunk is exactly `data`."""
    bits, align = {"pcm": (16, 2), "adpcm": (4, BLOCK)}.get(codec, (8, 1))
    per_second = rate * BLOCK // (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else rate * align
    fmt = struct.pack("<HHIIHH", FORMAT_TAG[codec], 1, rate, per_second, align, bits)
    fmt += struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)) if codec == "adpcm" else b"" if codec == "pcm" else b"\0\0"
    units = len(data) // align * (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else len(data) // align
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, units)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data bytes of a WAV file with any order of chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
            codec = {v: k for k, v in FORMAT_TAG.items()}[tag]
        if name == b"data":
            return codec, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(data: bytes) -> bytes:
    """data and zero bytes, up to a positive multiple of BLOCK."""
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def features(payloads: list[bytes]) -> list[str]:
    """For each payload and codec: samples at 16 kHz, peak, mean square (whole number), sign changes and CRC-32 of the resampled PCM."""
    all_bytes = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    out: list[list[str]] = [[] for _ in payloads]
    for codec in CODECS:
        at = begin // BLOCK * (1 + 2 * (BLOCK - 4)) if codec == "adpcm" else begin
        pcm = resample(decode(all_bytes, codec), at)
        at = at * 2
        wide = pcm.astype(np.int64)
        change = np.zeros(len(pcm), np.int64)
        change[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        change[at[:-1]] = 0
        energy, changes, peak = (f.reduceat(x, at[:-1]) for f, x in ((np.add, wide * wide), (np.add, change), (np.maximum, np.abs(wide))))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            out[i].append(f"{codec}:n={b - a},peak={peak[i]},power={energy[i] // (b - a)},changes={changes[i]},crc={zlib.crc32(pcm[a:b].tobytes()):08x}")
    return [";".join(x) for x in out]


def long_features(payload: bytes, piece: int = PIECE) -> str:
    """features() of one payload in pieces, with nothing kept of a piece but its last sample and the sums."""
    out = []
    for codec in CODECS:
        n, peak, energy, changes, crc, below, held = 0, 0, 0, 0, 0, False, np.zeros(0, np.int16)
        for at in range(0, len(payload), piece):
            now = np.concatenate([held, decode(np.frombuffer(payload[at : at + piece], np.uint8), codec)])
            part = resample(now)
            if at + piece < len(payload):  # the last sample waits for its neighbour
                part = part[:-2]
            wide, signs = part.astype(np.int64), part < 0
            changes += int((signs[1:] != signs[:-1]).sum()) + bool(n and signs[0] != below)
            n, peak, energy, crc = n + len(part), max(peak, int(np.abs(wide).max())), energy + int((wide * wide).sum()), zlib.crc32(part.tobytes(), crc)
            below, held = signs[-1], now[-1:]
        out.append(f"{codec}:n={n},peak={peak},power={energy // n},changes={changes},crc={crc:08x}")
    return ";".join(out)


def decoded(df: DataFrame, audio: str = "audio", codec: str = "mulaw", keep: list[str] | None = None) -> DataFrame:
    """Adds pcm_wav: the payloads of a binary column, decoded, resampled to 16 kHz and stored as a WAV file of 16-bit PCM.

    A null payload gives null, an empty one a file without samples; ADPCM payloads are first padded to whole blocks. A column
    of df named pcm_wav is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != "pcm_wav"]
    source = df.select(*[common.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.col(audio).cast("binary").alias("audio"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("pcm_wav", T.BinaryType())])

    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        x = padded(x) if codec == "adpcm" and x else x
        return wav(resample(decode(np.frombuffer(x, np.uint8), codec)).astype("<i2").tobytes() if x else b"", "pcm", 2 * RATE)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([one(part.column(len(keep))[0].as_py())], pa.binary())], schema.names)

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "pcm_wav")


def stored_payloads(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Stores each text's payload as a mu-law WAV file, reads it back and describes what was read; and stores its samples, resampled
    to 16 kHz, as a WAV file of 16-bit PCM.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, pcm_bytes and pcm_sha256 of the
    second file, and with_media both files as media and pcm_wav. A null text counts as empty; equal texts give equal values.
    """
    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "pcm_bytes": T.LongType(), "pcm_sha256": T.StringType()}
    if with_media:
        kinds |= {"media": T.BinaryType(), "pcm_wav": T.BinaryType()}

    def make():
        def fn(texts: pa.Array) -> list:
            data = [(t or "").encode() for t in texts.to_pylist()]
            files = [wav(padded(x)) for x in data]
            back = [read_wav(f)[2] for f in files]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            pcm = [wav(resample(decode(np.frombuffer(x, np.uint8), "mulaw")).astype("<i2").tobytes(), "pcm", 2 * RATE) for x in back]
            found = features(back) if sum(map(len, back)) <= 2 * PIECE else [long_features(x) for x in back]
            out = [[len(x) for x in data], [len(x) for x in back], [sha(x) for x in back], [zlib.crc32(x[-BLOCK:]) for x in back], [len(f) for f in files], [sha(f) for f in files], found, [len(f) for f in pcm], [sha(f) for f in pcm]]
            return out + [files, pcm] * with_media

        return fn

    return common.map_text(df, make, [T.StructField(k, v) for k, v in kinds.items()], text, keep)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_payloads(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
