"""The columns that the corpus queries return, computed anew from the texts by plain code."""

import hashlib
import zlib

import numpy as np
import pytest

from strandlake.llm import common, pieces, sharding, simhash, telephony

from .test_exact import slow_adpcm, slow_fingerprint, slow_groups


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_op2(spark, sf, docs):
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    roots = slow_groups(fps)
    least = {r: min(i for i, q in zip(ids, roots) if q == r) for r in set(roots)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots)}


def test_op5(spark, sf, docs):
    library = pieces.codec(pieces.model_path()).library
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.op5_sentencepiece(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for i, t in docs.items() for x in [library.encode(t)]}


def test_op9(spark, sf, docs):
    rows = sharding.op9_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def slow_samples(payload, codec):
    """G.711 by its bits, ADPCM block by block."""
    if codec == "adpcm":
        return [x for i in range(0, len(payload), 64) for x in slow_adpcm(payload[i : i + 64])]
    out = []
    for b in payload:
        if codec == "mulaw":
            b ^= 0xFF
            size = (((b & 15) * 2 + 33) << (b >> 4 & 7)) - 33
            out.append((-size if b & 128 else size) * 4)
        else:
            b ^= 0x55
            e, m = b >> 4 & 7, b & 15
            size = (m * 2 + 1 if e == 0 else (m * 2 + 33) << e - 1) * 8
            out.append(size if b & 128 else -size)
    return out


def slow_feature(payload):
    out = []
    for codec in telephony.CODECS:
        pcm = slow_samples(payload, codec)
        up = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for x in (a, (a + b) >> 1)]
        changes = sum((a < 0) != (b < 0) for a, b in zip(up, up[1:]))
        crc = zlib.crc32(np.array(up, "<i2").tobytes())
        out.append(f"{codec}:n={len(up)},peak={max(map(abs, up))},power={sum(x * x for x in up) // len(up)},changes={changes},crc={crc:08x}")
    return ";".join(out)


def test_op10(spark, sf, docs):
    got = {r["doc_id"]: r for r in telephony.op10_telephony(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, t in list(docs.items())[:60]:
        data = t.encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"] == slow_feature(payload) and r["media_bytes"] == 58 + len(payload) and r["pcm_bytes"] == 44 + 4 * len(payload)


@pytest.mark.parametrize("piece", [64, 128, 192, 1 << 20])
def test_long_payloads_in_pieces(piece):
    rng = np.random.default_rng(5)
    for n in (64, 128, 192, 640, 1024):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert telephony.long_features(payload, piece) == telephony.features([payload])[0] == slow_feature(payload)
