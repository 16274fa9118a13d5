"""An n-gram trie in Elias-Fano sequences: flat bytes that numpy maps without copying.

A level has the words that follow each context of the level above.  Words are numbers; within a
context they ascend, and a context's words start after the last one of the context before it, so that
a level is one ascending sequence.  Pointers, which never descend either, say where a context's words
begin.  Both are Elias-Fano coded: the low bits of each number packed side by side, the high bits as a
bit vector with one one per number and one zero per step.  Probabilities are codes of a byte.

A word is looked up by a successor search relative to its context: the context's last predecessor
gives the offset, the first number from offset plus word on is found through the zeros of the high
bits, and is a hit if it is equal and before the next context's pointer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONES = U(0x0101010101010101)
_TOPS = U(0x8080808080808080)
#: Place of the r-th one in each byte.
_IN_BYTE = np.zeros((256, 8), np.uint64)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_at)] = _at
_IN_BYTE = _IN_BYTE.ravel()


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one of the given rank in each 64-bit word, which has that many."""
    x = word - ((word >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    upto = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    passed = (((rank * _ONES) | _TOPS) - upto) & _TOPS
    byte = (((passed >> U(7)) * _ONES) >> U(56)) << U(3)
    left = rank - (((upto << U(8)) >> byte) & U(255))
    return byte + _IN_BYTE[(((word >> byte) & U(255)) << U(3)) + left]


class Sequence:
    """Numbers that never descend, Elias-Fano coded."""

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        if n >> 32:
            raise ValueError("a sequence holds less than 2**32 numbers")
        last = int(values[-1]) if n else 0
        low = max(0, (last // n).bit_length() - 1) if n else 0
        lows = np.zeros((n * low >> 6) + 2, np.uint64)
        if low:
            part, bit = values & U((1 << low) - 1), np.arange(n, dtype=np.uint64) * U(low)
            at, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
            np.add.at(lows, at, part << shift)
            np.add.at(lows, at + 1, (part >> U(1)) >> (U(63) - shift))
        high = np.zeros(-(-(n + (last >> low) + 1) // 64) * 64, np.uint8)
        high[(values >> U(low)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        return np.array([n, low, len(lows), len(words), last], np.int64).tobytes() + lows.tobytes() + words.tobytes() + before.astype(np.uint32).tobytes() + b"\0" * (len(words) % 2 * 4)

    def __init__(self, data: np.ndarray):
        """Views of the given 64-bit words; nothing is copied but the counters, two per 64 high bits."""
        self.n, self.low, lows, words, self.last = map(int, data[:5].view(np.int64))
        self.lows, self.words = data[5 : 5 + lows], data[5 + lows : 5 + lows + words]
        self.ones = data[5 + lows + words :].view(np.uint32)[:words].astype(np.int64)
        self.zeros = np.arange(words, dtype=np.int64) * 64 - self.ones
        self.mask = U((1 << self.low) - 1)

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.uint64) * U(self.low)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        return ((self.lows[word] >> shift) | ((self.lows[word + 1] << U(1)) << (U(63) - shift))) & self.mask

    def _one(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank, "right") - 1
        return word * 64 + _select(self.words[word], (rank - self.ones[word]).astype(np.uint64)).astype(np.int64)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank, "right") - 1
        return word * 64 + _select(~self.words[word], (rank - self.zeros[word]).astype(np.uint64)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        high = (self._one(at) - at).astype(np.uint64)
        return (high << U(self.low)) | self._low(at) if self.low else high

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Where the first number is that is not below each value; n if there is none."""
        out = np.full(len(values), self.n, np.int64)
        some = np.flatnonzero(values <= U(self.last)) if self.n else np.zeros(0, np.int64)
        if not len(some):
            return out
        values = values[some].astype(np.uint64)
        high, low = (values >> U(self.low)).astype(np.int64), values & self.mask
        end = self._zero(high) - high
        begin = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - high + 1, 0)
        # Numbers with these high bits stand in [begin, end); their low bits ascend.
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        out[some] = begin
        return out


def _ascending(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each context's words moved behind the last one of the context before; ``starts`` has an end, too."""
    last = words[starts[1:] - 1].astype(np.uint64) + U(1)
    offset = np.cumsum(last) - last
    return words.astype(np.uint64) + np.repeat(offset, np.diff(starts))


class Trie:
    """Three levels: first words with a code each, second words with two, third words with one."""

    @staticmethod
    def pack(first: np.ndarray, starts: np.ndarray, second: np.ndarray, below: np.ndarray, third: np.ndarray, codes: list[np.ndarray]) -> bytes:
        """``starts`` and ``below`` say where the second and third words of each context begin (one more
        entry than contexts); ``codes`` are bytes: one array for the first level, two for the second, one for the third."""
        if not len(first):
            return b""
        parts = [Sequence.pack(first), Sequence.pack(starts), Sequence.pack(_ascending(second, starts)), Sequence.pack(below), Sequence.pack(_ascending(third, below))]
        parts += [c.astype(np.uint8).tobytes() + b"\0" * (-len(c) % 8) for c in codes]
        ends = np.cumsum([len(p) // 8 for p in parts]) + len(parts)
        return ends.astype(np.int64).tobytes() + b"".join(parts)

    def __init__(self, data):
        """``data``: bytes, or a mapped file's array of bytes."""
        data = np.frombuffer(data, np.uint64) if isinstance(data, bytes) else data.view(np.uint64)
        self.empty = not len(data)
        if self.empty:
            return
        ends = data[:9].view(np.int64)
        part = [data[a:b] for a, b in zip([9, *ends[:-1]], ends, strict=True)]
        self.first, self.starts, self.second, self.below, self.third = map(Sequence, part[:5])
        self.first_code, *self.second_codes, self.third_code = (p.view(np.uint8) for p in part[5:])

    @classmethod
    def map(cls, path: str) -> Trie:
        """A trie in a local file, of which only what is looked up is read."""
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def _find(level: Sequence, pointers: Sequence, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each word among those of its context, or -1; a context of -1 has no words."""
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(context >= 0)
        if not len(some):
            return out
        begin, end = pointers[context[some]].astype(np.int64), pointers[context[some] + 1].astype(np.int64)
        offset = np.where(begin > 0, level[np.maximum(begin - 1, 0)] + U(1), U(0))
        value = offset + words[some].astype(np.uint64)
        at = level.successor(value)
        hit = at < end
        hit[hit] = level[at[hit]] == value[hit]
        out[some[hit]] = at[hit]
        return out

    def roots(self, words: np.ndarray) -> np.ndarray:
        """The place of each word on the first level, or -1."""
        if self.empty:
            return np.full(len(words), -1, np.int64)
        words = words.astype(np.uint64)
        at = self.first.successor(words)
        hit = at < self.first.n
        hit[hit] = self.first[at[hit]] == words[hit]
        return np.where(hit, at, -1)

    def seconds(self, root: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.full(len(words), -1, np.int64) if self.empty else self._find(self.second, self.starts, root, words)

    def thirds(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.full(len(words), -1, np.int64) if self.empty else self._find(self.third, self.below, context, words)


def coded(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code at each place; 0 where nothing was found."""
    out = np.zeros(len(at), np.uint8)
    out[at >= 0] = codes[at[at >= 0]]
    return out
