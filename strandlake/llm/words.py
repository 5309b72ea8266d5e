"""Words of many texts at once, on numpy arrays of UTF-8 bytes: boundaries, hashes, hashes of prefixes and of word windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them at least."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=U)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that low and high bits are all usable."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: A fixed random value for each byte.
BYTE = mixed(np.arange(1, 257, dtype=U) * U(BASE))


def lower(buf: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with latin also the capitals of Latin-1."""
    out = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    if latin and len(buf) > 1:
        after = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:] += after.astype(np.uint8) * np.uint8(32)
    return out


def letters() -> np.ndarray:
    """Which bytes belong to words: ASCII letters, digits and all that is not ASCII."""
    x = np.zeros(256, bool)
    x[48:58] = x[65:91] = x[97:123] = x[128:] = True
    return x


def not_space() -> np.ndarray:
    """Which bytes are neither U+0020 nor U+0009 to U+000D."""
    x = np.ones(256, bool)
    x[[32, 9, 10, 11, 12, 13]] = False
    return x


class Words:
    """The words of all texts in buf; at: where texts begin, and the end. A word never crosses texts."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, kind: np.ndarray):
        inside = kind[buf]
        first, last = inside.copy(), inside.copy()
        if len(buf):
            cut = at[(at > 0) & (at < len(buf))]
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.buf, self.at, self.n_docs = buf, at, len(at) - 1
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words before each text, and which text a word belongs to.
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self._sum = None

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sum is None:
            self._sum = np.zeros(len(self.buf) + 1, U)
            np.cumsum(BYTE[self.buf] * powers(BASE, len(self.buf)), out=self._sum[1:])
        return mixed((self._sum[end] - self._sum[start]) * powers(INVERSE, len(self.buf) + 1)[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self._hash(self.start, self.end)

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word, or of the whole shorter word."""
        return self._hash(self.start, np.minimum(self.start + n, self.end))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, whole texts' borders not regarded."""
    if len(h) < n:
        return np.zeros(0, U)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    return mixed((total[n:] - total[:-n]) * powers(INVERSE, len(h) + 1)[: len(h) - n + 1] + U(n))


class HashSet:
    """Membership of many 64-bit hashes in a sorted set, behind a bitmap that turns nearly all others away."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.unique(np.asarray(keys, U))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are in the set, and their positions in keys."""
        maybe = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[k] == h[maybe]
        return maybe[ok], k[ok]
