"""FM-index over integer symbols: suffix array, Burrows-Wheeler transform in a wavelet matrix, samples."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only suffixes still tied are sorted again.

    Rounds follow the longest repeat, so texts should have unique symbols between their documents.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.ones(n, bool)
    first[1:] = text[order[1:]] != text[order[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    width = 1
    tied = ~(first & np.r_[first[1:], True])
    while tied.any():
        at = np.flatnonzero(tied)
        suffix = order[at]
        follow = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied[at] = ~(new & np.r_[new[1:], True])
        width *= 2
    return order


class WaveletMatrix:
    """rank(symbol, i) for many symbols and places at once, in one step for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.set: list[np.ndarray] = []
        for shift in range(self.bits - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            self.set.append(bit)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        begin, at = np.zeros(len(symbols), np.int64), places.astype(np.int64)
        for level in range(self.bits):
            bit = (symbols >> (self.bits - 1 - level)) & 1 == 1
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[begin], ones[at]
            begin, at = np.where(bit, zeros + a, begin - a), np.where(bit, zeros + b, at - b)
        return at - begin

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        at, out = places.astype(np.int64), np.zeros(len(places), np.int64)
        for level in range(self.bits):
            bit = self.set[level][at]
            ones = self.ones[level][at]
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out


class FMIndex:
    """Index of documents given as arrays of symbols from 1 to size; every document ends with a 0.

    Positions are sampled at each document's start and every STEP symbols, so that locating never steps
    over a document's border.
    """

    STEP = 8

    def __init__(self, documents: list[np.ndarray], size: int):
        lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = np.r_[0, np.cumsum(lengths + 1)][:-1]
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        sort_as = np.empty(len(text), np.int64)
        is_end = np.zeros(len(text), bool)
        is_end[self.starts + lengths] = True
        text[~is_end] = np.concatenate(documents) if len(documents) else text[:0]
        # Ends sort apart from each other, so no repeat runs over a border.
        sort_as[is_end] = np.arange(int(is_end.sum())) - len(documents)
        sort_as[~is_end] = text[~is_end]
        order = suffix_array(sort_as)
        before = text[order - 1]
        self.counts = np.r_[0, np.cumsum(np.bincount(text, minlength=size + 1))]
        self.tree = WaveletMatrix(before, size + 1)
        offset = np.arange(len(text)) - np.repeat(self.starts, lengths + 1)
        sampled = offset % self.STEP == 0
        self.is_sampled = sampled[order]
        self.samples = order[self.is_sampled]
        self.sample_rank = np.cumsum(self.is_sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) rows of the suffixes that start with each phrase (one in a row, all of one length,
        symbols above 0), by backward search; phrases drop out as soon as their range is empty."""
        n = len(self.is_sampled)
        begin, end = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            both = self.tree.rank(np.r_[symbol, symbol], np.r_[begin[live], end[live]])
            begin[live] = self.counts[symbol] + both[: len(live)]
            end[live] = self.counts[symbol] + both[len(live):]
            empty = begin[live] >= end[live]
            end[live[empty]] = begin[live[empty]]
            live = live[~empty]
            if not len(live):
                break
        return begin, end

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, offset) of each suffix row: step back to a sampled one and add the steps."""
        position, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.astype(np.int64), np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.is_sampled[here]
            position[live[done]] = self.samples[self.sample_rank[here[done]]] + steps[live[done]]
            live, here = live[~done], here[~done]
            if len(live):
                symbol = self.tree.access(here)
                at[live] = self.counts[symbol] + self.tree.rank(symbol, here)
                steps[live] += 1
        document = np.searchsorted(self.starts, position, side="right") - 1
        return document, position - self.starts[document]
