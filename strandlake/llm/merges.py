"""Byte-pair merging with word ends: the encodings of all prefixes of a word, found from those of shorter ones.

The last token of a prefix is the one that ends there and that merging leaves apart from the last token of the prefix before it.
Neighbours decide that alone, and exactly one token fits, so that the count of a prefix is that of the shorter one and one. As the
last symbol of a word has a mark, each prefix has two answers: if the word goes on, and if it ends there.
"""

from __future__ import annotations

from array import array

import numpy as np

from strandlake.llm.words import BASE, BYTE, U, HashSet, mixed

#: Fixed value: the mark of a word's end.
END = "</w>"
#: Pairs of tokens that are remembered.
PAIRS = 100_000
_SLOTS = 21


def byte_names() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible, else the next one from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}


class Merges:
    """Byte-pair merging with word ends, and which neighbouring tokens it leaves apart."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.ranks: dict[tuple[str, str], int] = {}
        #: Of a token that is no single symbol: when it comes about, and out of what.
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.ranks[left, right] = i
            self.made.setdefault(left + right, (i, left, right))
        alone = {t for t in vocab if self.alone(t)}
        #: Tokens inside a word, and those at its end without their mark.
        self.inner = {t: t for t in alone if not t.endswith(END)}
        self.last = {t.removesuffix(END) for t in alone if t.endswith(END)}
        self.longest = max((len(t.removesuffix(END)) for t in vocab), default=1)
        #: Sizes of the token at the end of so many symbols, the likely ones first.
        self.sizes = [sorted(range(1, n + 1), key=lambda k: (2, 3, 1).index(k) if k < 4 else k) for n in range(self.longest + 1)]
        #: What is known of (token before, token inside) and (token before, token at the end).
        self.inside: dict[tuple[str, str], bool] = {}
        self.ending: dict[tuple[str, str], bool] = {}

    def alone(self, token: str) -> bool:
        """Whether merging a token's symbols gives that token again."""
        if token not in self.made:
            return len(token.removesuffix(END)) == 1
        rank, left, right = self.made[token]
        return self.alone(left) and self.alone(right) and self.meets(left, right) == rank

    def meets(self, left: str, right: str) -> int | None:
        """The rank of the first merge across the border of two neighbours, each of which is merged as if alone; None: they stay apart.

        Merges come about by rising rank, and from left to right where ranks are equal. Looking back from the end, the parts
        that touch the border are taken to pieces, the later one first; a pair of them merges if it does so before either is
        used up by its own side.
        """
        x, y, found = left, right, None
        x_used = y_used = len(self.ranks)
        while True:
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_used and rank <= y_used:
                found = rank
            a, b = self.made.get(x), self.made.get(y)
            if a is None and b is None:
                return found
            if b is None or a is not None and a[0] > b[0]:
                x_used, x = a[0], a[2]
            else:
                y_used, y = b[0], b[1]

    def fits(self, before: str, token: str, end: bool) -> bool:
        """Whether a token may follow another; before: empty at a word's start."""
        known = self.ending if end else self.inside
        if len(known) > PAIRS:
            known.clear()
        known[before, token] = out = not before or self.meets(before, token + END if end else token) is None
        return out


class Prefix:
    """A word that grows: for each length the last token and the count of its encoding if the word goes on."""

    def __init__(self, merges: Merges, symbols: str = "", token: list[str] | None = None, count: array | None = None):
        self.merges, self.symbols, self.token, self.count = merges, symbols, token or [""], count or array("I", [0])

    def grown(self, word: str) -> array:
        """Goes on with the characters of `word`, each of which stands for a byte; the counts of all prefixes from here as whole words."""
        m = self.merges
        inner, last, inside, ending, fits, longest = m.inner, m.last, m.inside.get, m.ending.get, m.fits, m.longest
        token, count, out, first = self.token, self.count, array("I"), len(self.symbols)
        word = self.symbols = self.symbols + word
        for i in range(first + 1, len(word) + 1):
            done = ended = 0
            sizes = m.sizes[min(i, longest)]
            for size in sizes:
                if (t := word[i - size : i]) in last:
                    k = ending(pair := (token[i - size], t))
                    if fits(*pair, True) if k is None else k:
                        ended = count[i - size] + 1
                        break
            for size in sizes:
                if (t := word[i - size : i]) in inner:
                    k = inside(pair := (token[i - size], t))
                    if fits(*pair, False) if k is None else k:
                        done, found = count[i - size] + 1, inner[t]
                        break
            if not (done and ended):
                raise ValueError("no token fits")
            token.append(found), count.append(done), out.append(ended)
        return out


class Batch:
    """What Prefix finds, for many words at once, which go step by step together, on numpy arrays."""

    def __init__(self, merges: Merges):
        self.merges, byte = merges, {c: b for b, c in byte_names().items()}
        self.names = sorted(merges.inner.keys() | merges.last)
        hashes = np.zeros(len(self.names), U)
        for i, name in enumerate(self.names):
            h = 0
            for c in name:
                h = (h * BASE + int(BYTE[byte[c]])) & (1 << 64) - 1
            hashes[i] = h
        self.known, order = HashSet(hashes), np.argsort(hashes)
        if len(self.known.keys) != len(order):
            raise ValueError("two tokens have the same hash")
        self.names = [self.names[i] for i in order.tolist()]  # by place in known
        #: Whether a token may stand inside a word, and at its end.
        self.may = [np.array([n in t for n in self.names]) for t in (merges.inner, merges.last)]
        #: Pairs of tokens: one in each slot, the latest.
        self.pairs, self.fit = np.zeros(1 << _SLOTS, np.int64), np.zeros(1 << _SLOTS, bool)

    def fits(self, before: np.ndarray, token: np.ndarray, end: int) -> np.ndarray:
        """Whether tokens may follow others; before: a place in names and one, or 0 at a word's start."""
        pair = before.astype(np.int64) << 24 | token.astype(np.int64) << 1 | end
        slot = (mixed(pair.astype(U)) >> U(64 - _SLOTS)).astype(np.int64)
        out = (before == 0) | self.fit[slot]
        if len(new := np.flatnonzero((before > 0) & (self.pairs[slot] != pair))):
            keys, first, of = np.unique(pair[new], return_index=True, return_inverse=True)
            at = new[first]
            found = np.array([self.merges.meets(self.names[b - 1], self.names[t] + END if end else self.names[t]) is None for b, t in zip(before[at].tolist(), token[at].tolist())], bool)
            out[new] = found[of]
            self.pairs[slot[at]], self.fit[slot[at]] = keys, found
        return out

    def grown(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """data: the bytes of words, one after another; size: of each. The counts of the prefixes that end at each byte, as whole words."""
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(data))
        order = np.argsort(-size, kind="stable")
        begin, size, longest = begin[order], size[order], min(self.merges.longest, int(size.max(initial=0)))
        at, h, token = np.arange(len(data)), np.zeros(len(data), U), []
        for n in range(1, longest + 1):  # the token of n bytes that begins at each place, or -1
            go = left[at] >= n
            at = at[go]
            h = h[go] * U(BASE) + BYTE[data[at + n - 1]]
            i, k = self.known.find(h)
            own = np.full(len(data), -1, np.int32)
            own[at[i]] = k
            token.append(own)
        last = [np.zeros(len(size), np.int32)]
        count, out = [np.zeros(len(size), np.int32)], np.zeros(len(data), np.int32)
        for i in range(1, int(size.max(initial=0)) + 1):
            going = int(np.searchsorted(-size, -i, "right"))
            last.append(np.zeros(going, np.int32)), count.append(np.zeros(going, np.int32))
            for end in (0, 1):
                todo = np.arange(going)
                for n in self.merges.sizes[min(i, longest)]:
                    t = token[n - 1][begin[todo] + i - n]
                    may = np.flatnonzero((t >= 0) & self.may[end][t])
                    ok = may[self.fits(last[i - n][todo[may]], t[may], end)]
                    hit = todo[ok]
                    if end:
                        out[begin[hit] + i - 1] = count[i - n][hit] + 1
                    else:
                        last[i][hit], count[i][hit] = t[ok] + 1, count[i - n][hit] + 1
                    todo = np.delete(todo, ok)
                    if not len(todo):
                        break
                if len(todo):
                    raise ValueError("no token fits")
        return out
