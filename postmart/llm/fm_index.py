"""An FM-index over words: suffixes sorted by doubling, ranks by a wavelet matrix, places by sampled suffixes."""

from __future__ import annotations

import numpy as np

#: Every so many words a suffix position is kept.
SAMPLED = 4


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (numbers from 0 up) in order, the end counting as smallest.

    The first sort looks at three numbers at once where they fit into 63 bits.  Every further round doubles the length
    that is compared, and only for suffixes that are not told apart yet."""
    n = len(text)
    bits = max(1, int(text.max(initial=0) + 1).bit_length())
    seen = max(1, min(3, 63 // bits))
    padded = np.r_[text.astype(np.int64) + 1, np.zeros(seen, np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(seen):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff(np.r_[head, n]))  # rank: position of the first of equals
    rank = np.empty(n + 1, np.int64)
    rank[order] = first + 1
    rank[n] = 0
    where = np.flatnonzero(np.r_[np.diff(first) == 0, False] | np.r_[False, np.diff(first) == 0])
    while len(where):
        group, ids = first[where], order[where]
        later = rank[np.minimum(ids + seen, n)]
        by = np.lexsort((later, group))
        group, later, ids = group[by], later[by], ids[by]
        order[where] = ids
        new = np.r_[True, (group[1:] != group[:-1]) | (later[1:] != later[:-1])]
        head = np.flatnonzero(new)
        first[where] = where[np.repeat(head, np.diff(np.r_[head, len(where)]))]
        rank[ids] = first[where] + 1
        same = first[where]
        where = where[np.r_[same[1:] == same[:-1], False] | np.r_[False, same[1:] == same[:-1]]]
        seen *= 2
    return order


class Wavelet:
    """Wavelet matrix: for each bit of the numbers, from the highest, one bit row with counts of ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        # Where each number's entries begin once all bits are sorted.
        size = np.bincount(values, minlength=1 << self.levels) if self.n else np.zeros(1 << self.levels, np.int64)
        turned = np.zeros(1 << self.levels, np.int64)
        for k in range(self.levels):
            turned |= ((np.arange(1 << self.levels) >> k) & 1) << (self.levels - 1 - k)
        self.begin = np.zeros(1 << self.levels, np.int64)
        self.begin[turned] = np.cumsum(size[turned]) - size[turned]
        self.size = size

    def _ones(self, row: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = self.words[row][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[row][block] + np.bitwise_count(below)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number stands before its position."""
        at = at.astype(np.int64)
        for row in range(self.levels):
            ones = self._ones(row, at)
            one = (value >> (self.levels - 1 - row)) & 1 == 1
            at = np.where(one, self.zeros[row] + ones, at - ones)
        return at - self.begin[value]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number at each position, how often it stands before it)."""
        at, value = at.astype(np.int64), np.zeros(len(at), np.int64)
        for row in range(self.levels):
            ones = self._ones(row, at)
            one = (self.words[row][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at = np.where(one, self.zeros[row] + ones, at - ones)
            value = (value << 1) | one
        return value, at - self.begin[value]


class FMIndex:
    """Index of some documents, given as the numbers (from 1) of all their words and the words of each document.

    A separator 0 follows each document; separators sort by position, so no comparison runs into the next
    document."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, vocabulary: int):
        docs = len(counts)
        ends = np.cumsum(counts + 1) - 1
        text = np.empty(len(words) + docs, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner], text[~inner] = words, 0
        self.starts, self.size = ends - counts, len(text)
        told_apart = text + docs - 1
        told_apart[ends] = np.arange(docs)
        suffixes = suffix_array(told_apart)
        self.transformed = Wavelet(text[suffixes - 1], vocabulary)
        self.before = np.r_[0, np.cumsum(self.transformed.size)]
        # Sampled positions; the first word of each document too, so that no walk goes over a separator.
        kept = suffixes % SAMPLED == 0
        kept |= text[suffixes - 1] == 0
        self.kept, self.kept_before, self.positions = kept, np.r_[0, np.cumsum(kept)], suffixes[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase, by backward search.  ``phrases`` are rows of numbers, padded
        at the end; a phrase with a number of 0 or less occurs nowhere."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size)
        width = phrases.shape[1] if len(phrases) else 0
        inside = np.arange(width) < lengths[:, None]
        high[(lengths == 0) | ((phrases <= 0) & inside).any(axis=1)] = 0
        for k in range(width - 1, -1, -1):
            open_ = np.flatnonzero((k < lengths) & (low < high))
            if len(open_):
                value = phrases[open_, k]
                low[open_] = self.before[value] + self.transformed.rank(value, low[open_])
                high[open_] = self.before[value] + self.transformed.rank(value, high[open_])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: walk back to a sampled one."""
        place, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            kept = self.kept[at]
            done = left[kept]
            place[done] = self.positions[self.kept_before[at[kept]]] + steps[done]
            left, at = left[~kept], at[~kept]
            steps[left] += 1
            value, rank = self.transformed.access(at)
            at = self.before[value] + rank
        return place

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word in the text) of each occurrence."""
        low, high = self.search(phrases, lengths)
        times = high - low
        which = np.repeat(np.arange(len(phrases)), times)
        rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        return which, self.locate(rows)
