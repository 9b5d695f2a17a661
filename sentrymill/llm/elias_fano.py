"""Elias-Fano sequences and an n-gram trie of two levels, in memory-mapped files, queried by arrays."""

from __future__ import annotations

import os

import numpy as np

STEP = 16 / 65535


class EliasFano:
    """A non-decreasing sequence: low bits packed at their width, high bits in unary with rank samples.

    The k-th zero of the high bits ends the run of elements whose high part is k, so a successor
    search looks only at the elements that share the query's high part.
    """

    def __init__(self, folder: str, name: str, values: np.ndarray):
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low = max(0, (top // max(n, 1)).bit_length() - 1)
        self.buckets = (top >> self.low) + 1
        low = (values & np.uint64((1 << self.low) - 1)).astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        ones = high + np.arange(n)
        words = np.zeros((n + self.buckets) // 64 + 2, np.uint64)
        np.bitwise_or.at(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        packed = np.zeros(n * self.low // 64 + 2, np.uint64)
        if self.low:
            at = np.arange(n, dtype=np.int64) * self.low
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(packed, at >> 6, low << shift)
            over = shift + np.uint64(self.low) > np.uint64(64)
            np.bitwise_or.at(packed, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        zeros = 64 * np.arange(len(rank)) - rank
        self.words, self.packed, self.ones, self.zeros = (_mapped(folder, f"{name}.{k}", a) for k, a in (("high", words), ("low", packed), ("ones", rank), ("zeros", zeros)))

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the high bits."""
        ranks = self.ones if ones else self.zeros
        w = np.searchsorted(ranks, k, "right") - 1
        left, at = k - ranks[w], np.zeros(len(k), np.uint64)
        word = self.words[w] if ones else ~self.words[w]
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((word >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= count
            left, at = left - count * go, at + np.uint64(width) * go
        return w * 64 + at.astype(np.int64)

    def starts(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a smaller high part."""
        capped = np.minimum(high, self.buckets)
        return np.where(capped > 0, self._select(np.maximum(capped - 1, 0), False) - np.maximum(capped - 1, 0), 0)

    def _run(self, at: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Length of the run of ones from bit `at` on, where the elements of a high part begin."""
        w, shift = at >> 6, (at & 63).astype(np.uint64)
        after = np.minimum(w + 1, len(self.words) - 1)
        window = (self.words[w] >> shift) | np.where(shift > 0, self.words[after] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        free = ~window
        run = np.bitwise_count((free & (~free + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        long = np.flatnonzero(free == 0)
        if len(long):
            run[long] = self.starts(high[long] + 1) - self.starts(high[long])
        return run

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low
        shift = (at & 63).astype(np.uint64)
        first, rest = self.packed[at >> 6] >> shift, self.packed[(at >> 6) + 1]
        both = np.where(shift > 0, first | (rest << ((np.uint64(64) - shift) & np.uint64(63))), first)
        return both & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self.lows(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of the least element >= x among positions first..last-1, whether it equals x)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = (x >> np.uint64(self.low)).astype(np.int64), x & np.uint64((1 << self.low) - 1)
        lo = self.starts(high)
        hi = lo + self._run(lo + np.minimum(high, self.buckets), high)
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        end = hi
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, self.n - 1)
            less = (self.lows(mid) < low) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        at = np.minimum(lo, self.n - 1)
        return lo, (lo < end) & (high < self.buckets) & (self.lows(at) == low)


def _mapped(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r", shape=values.shape)


class Trie:
    """Contexts, each with its successors, and a quantised log10 probability for each successor.

    contexts and words: sorted vocabularies of 64-bit word hashes. pointers: where each context's
    successors start. successors: word ranks, monotone within a context and made so throughout
    by the context's rank times the vocabulary. codes: 16 bits each, -16 to 0 in log10.
    """

    def __init__(self, folder: str, first: np.ndarray, second: np.ndarray, probability: np.ndarray):
        """(first, second) distinct and sorted; probability: smoothed, of the second after the first."""
        contexts, at = np.unique(first, return_index=True)
        vocabulary, rank = np.unique(second, return_inverse=True)
        self.width = np.uint64(max(1, len(vocabulary)))
        order = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff([*at, len(first)]))
        self.contexts, self.words = EliasFano(folder, "contexts", contexts), EliasFano(folder, "words", vocabulary)
        self.pointers = EliasFano(folder, "pointers", np.concatenate([at, [len(first)]]).astype(np.uint64))
        self.successors = EliasFano(folder, "successors", order * self.width + rank.astype(np.uint64))
        self.codes = _mapped(folder, "codes", encode(probability)) if len(probability) else np.zeros(0, np.uint16)

    def look_up(self, firsts: np.ndarray, i: np.ndarray, seconds: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Codes of the pairs (firsts[i], seconds[j]); 0 for those that the trie lacks."""
        out = np.zeros(len(i), np.uint16)
        if not self.contexts.n or not len(i):
            return out
        context, known = self.contexts.successor(firsts)
        rank, met = self.words.successor(seconds)
        context = np.minimum(context, self.contexts.n - 1)
        first, last = self.pointers.get(context).astype(np.int64), self.pointers.get(context + 1).astype(np.int64)
        ask = np.flatnonzero(known[i] & met[j])
        c = i[ask]
        at, found = self.successors.successor(context[c].astype(np.uint64) * self.width + rank[j[ask]].astype(np.uint64), first[c], last[c])
        out[ask[found]] = self.codes[at[found]]
        return out


def encode(probability: np.ndarray) -> np.ndarray:
    """log10 of probabilities in 65535 steps from -16 to 0, as 1..65535."""
    return np.clip(np.rint((np.log10(probability) + 16) / STEP), 1, 65535).astype(np.uint16)
