"""A compressed full-text index: suffix order, Burrows-Wheeler transform, wavelet matrix, and
backward search of many texts at once. All of it is numpy inside one task, on one shard."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` codes at least; codes of `bits` bits, 0 parts texts."""
    n = len(codes)
    take = 64 // bits
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(take, np.uint64)])
    for k in range(take):
        packed = (packed << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(packed)
    ranked = packed[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    known = take
    while known < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - known] = rank[known:] + 1 if known < n else 0
        pair = rank * np.int64(n + 1) + second
        order = np.argsort(pair)
        ranked = pair[order]
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        known *= 2
    return order


class WaveletMatrix:
    """A sequence of small numbers as one bit vector per bit, with counts every 64 bits."""

    def __init__(self, codes: np.ndarray, bits: int):
        n = len(codes)
        self.bits, self.words, self.ones, self.zeros = bits, [], [], []
        symbols = np.arange(1 << bits, dtype=np.int64)
        at = np.zeros(1 << bits, np.int64)
        for level in range(bits - 1, -1, -1):
            bit = ((codes >> level) & 1).astype(bool)
            padded = np.zeros(((n >> 6) + 1) << 6, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            count = np.bitwise_count(words).astype(np.int64)
            ones = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int32)
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(int(n - bit.sum()))
            codes = np.concatenate([codes[~bit], codes[bit]])
            at = self._down(len(self.words) - 1, at, ((symbols >> level) & 1).astype(bool))
        self.first = at

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)
        return np.where(bit, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        to = at
        for k in range(self.bits):
            to = self._down(k, to, ((symbol >> (self.bits - 1 - k)) & 1).astype(bool))
        return to - self.first[symbol]


class FMIndex:
    """Index of texts, each with the document that holds it; several: held by more than one."""

    def __init__(self, texts: list[str], documents: np.ndarray, several: np.ndarray, depth: int):
        raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.lengths = lengths
        ends = self.begin + lengths
        inner = np.ones(len(raw), bool)
        inner[ends] = False
        alphabet = np.unique(raw[inner])
        self.codes = np.zeros(len(raw), np.uint8 if len(alphabet) < 255 else np.uint16 if len(alphabet) < 65535 else np.uint32)
        self.codes[inner] = np.searchsorted(alphabet, raw[inner]) + 1
        bits = max(1, int(len(alphabet)).bit_length())
        order = suffix_order(self.codes, depth, bits)
        self.matrix = WaveletMatrix(self.codes[order - 1], bits)  # of suffix 0 the last separator
        count = np.bincount(self.codes, minlength=1 << bits)
        self.before = np.concatenate([[0], np.cumsum(count)[:-1]])
        # the first row after which an interval from each row on holds two documents
        n = len(raw)
        owner = np.repeat(np.arange(len(texts)), lengths + 1)[order]
        rows = np.arange(n)
        change = np.full(n + 1, n, np.int64)
        change[1:n] = np.where(documents[owner[1:]] != documents[owner[:-1]], rows[1:], n)
        change = np.minimum.accumulate(change[::-1])[::-1]
        many = np.minimum.accumulate(np.where(several[owner], rows, n)[::-1])[::-1]
        self.second = np.minimum(change[1:], many).astype(np.int32 if n < 1 << 31 else np.int64)

    def shared_windows(self, size: int, segment: int = 3000) -> tuple[np.ndarray, np.ndarray]:
        """(text, begin) of windows of `size` characters that a second document holds. Together
        they cover every character that lies in any such window, and no other."""
        text, end, length = self.matching_statistics(size, segment)
        whole = length == size
        return text[whole], end[whole] - size

    def matching_statistics(self, size: int, segment: int = 3000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, length): the longest match before `end` that a second document holds, up to `size`
        characters, at as many ends as decide for every character whether it lies in a match of `size`.

        Each text is streamed against the index: a window is read backwards from its end as
        long as a second document has what was read. Where that stops, no window over
        the rest can be shared, so the next one begins behind it. From a shared window the next
        is taken a whole length on, and where a run of them ends, its last window is found by halving.
        """
        per_text = np.maximum(0, -(-(self.lengths - size + 1) // segment))
        text = np.repeat(np.arange(len(per_text)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        x = self.begin[text] + nth * segment
        stop = np.minimum(x + segment, self.begin[text] + self.lengths[text] - size + 1)
        n, total = len(x), len(self.codes)
        at, low, high = x + size - 1, np.zeros(n, np.int64), np.full(n, total, np.int64)
        good, bad, behind = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        found_text, found_end, found_length = [], [], []
        state = [text, x, stop, at, low, high, good, bad, behind]
        while len(state[0]):
            text, x, stop, at, low, high, good, bad, behind = state
            m = len(x)
            c = self.codes[at].astype(np.int64)
            both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low, high])) + np.tile(self.before[c], 2)
            low, high = both[:m], both[m:]
            shared = (high > low) & (self.second[np.minimum(low, total - 1)] < high)
            done = shared & (at == x)
            failed = ~shared
            at = at - 1
            turn = np.flatnonzero(done | failed)
            if len(turn):
                d, xs, g, b, t = done[turn], x[turn], good[turn], bad[turn], behind[turn]
                here = at[turn] + 2  # behind the place where reading stopped
                found_text.append(text[turn])
                found_end.append(xs + size)
                found_length.append(np.where(d, size, xs + size - here))
                g2 = np.where(d, xs, g)
                b2 = np.where(d, b, np.where(g >= 0, xs, -1))
                t2 = np.where(d, t, here)
                last = stop[turn] - 1
                ahead = np.where(xs >= last, last + 1, np.minimum(xs + size, last))
                nxt = np.where(b2 < 0, np.where(d, ahead, here), (g2 + b2) // 2)
                over = (b2 >= 0) & (b2 - g2 <= 1)  # the run's last window is known
                nxt = np.where(over, t2, nxt)
                fresh = over | (~d & (g < 0))
                good[turn], bad[turn], behind[turn] = np.where(fresh, -1, g2), np.where(fresh, -1, b2), t2
                x[turn], at[turn], low[turn], high[turn] = nxt, nxt + size - 1, 0, total
            state = [text, x, stop, at, low, high, good, bad, behind]
            if len(turn) and (gone := x >= stop).any():
                state = [s[~gone] for s in state]
        if not found_text:
            return (np.empty(0, np.int64),) * 3
        text, end, length = map(np.concatenate, (found_text, found_end, found_length))
        return text, end - self.begin[text], length


def united(begin: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Begins of windows to maximal runs [begin, end)."""
    begin = np.unique(begin)
    cuts = np.flatnonzero(np.diff(begin) > size) + 1
    return [(int(p[0]), int(p[-1]) + size) for p in np.split(begin, cuts) if len(p)]
