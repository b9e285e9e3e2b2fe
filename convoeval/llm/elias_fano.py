"""Monotone sequences and n-gram levels in Elias-Fano form, over bytes that may be mapped."""

from __future__ import annotations

import struct

import numpy as np


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each value, one after the other."""
    if not bits or not len(values):
        return np.zeros(8, np.uint8)
    values = values & np.uint64((1 << bits) - 1)
    start = np.arange(len(values)) * bits
    word, shift = start >> 6, (start & 63).astype(np.uint64)
    out = np.zeros(int(word[-1]) + 2, "<u8")
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    over = np.flatnonzero(shift > 64 - bits)  # at most one value reaches into the next word
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    size = (len(values) * bits + 7) // 8
    return np.concatenate([out.view(np.uint8)[:size], np.zeros(8, np.uint8)])


class Monotone:
    """A non-decreasing sequence: low bits side by side, high parts in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low = n, bits, low
        self.eight = np.ndarray(len(low) - 7, "<u8", low, 0, (1,))  # the eight bytes from each place on
        ones = np.unpackbits(high, bitorder="little").astype(bool)
        # Rank and select, derived from the bit vector when it is opened.
        self.ones = np.flatnonzero(ones).astype(np.int64)
        zeros = np.flatnonzero(~ones).astype(np.int64)
        self.ends = zeros - np.arange(len(zeros))  # values whose high part is at most h
        self.starts = np.concatenate([[0], self.ends])

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 1, bool)
        unary[high + np.arange(n)] = True
        parts = _pack(values, bits), np.packbits(unary, bitorder="little")
        head = struct.pack("<QQQQ", n, bits, len(parts[0]), len(parts[1]))
        return head + parts[0].tobytes() + parts[1].tobytes()

    @classmethod
    def open(cls, raw, at: int) -> tuple[Monotone, int]:
        n, bits, low, high = struct.unpack_from("<QQQQ", raw, at)
        at += 32
        a, b = np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low)
        return cls(n, bits, a, b), at + low + high

    def _low(self, i: np.ndarray) -> np.ndarray:
        start = i * self.bits
        at, shift = start >> 3, (start & 7).astype(np.uint64)
        out = self.eight[at] >> shift
        if self.bits > 57:  # a value may lie on nine bytes
            ninth = self.low[at + 8].astype(np.uint64)
            out |= np.where(shift > 0, ninth << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self.ones[i] - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i) if self.bits else high

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Of each ``x``, the place of the first value that is not smaller."""
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = high < len(self.ends)
        high = np.where(inside, high, 0)
        at, end = np.where(inside, self.starts[high], self.n), np.where(inside, self.ends[high], self.n)
        todo = np.flatnonzero(at < end)
        wanted = x & np.uint64((1 << self.bits) - 1)
        while len(todo) and self.bits:  # by halves: of a common context, many values have one high part
            middle = (at[todo] + end[todo]) >> 1
            less = self._low(middle) < wanted[todo]
            at[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[at[todo] < end[todo]]
        return at


class BigramTrie:
    """Contexts, and for each a range of successors with the codes of their probabilities.

    Successors ascend within a range only, so each is stored plus the last value of the range
    before: the whole level is then one monotone sequence, and a successor is searched for at its
    code plus that value, which is what the range is relative to.
    """

    def __init__(self, raw, at: int = 0):
        self.contexts, at = Monotone.open(raw, at)
        self.pointers, at = Monotone.open(raw, at)
        self.level, at = Monotone.open(raw, at)
        self.backoff = np.frombuffer(raw, np.uint8, self.contexts.n, at)
        self.codes = np.frombuffer(raw, np.uint8, self.level.n, at + self.contexts.n)

    @staticmethod
    def encode(context: np.ndarray, first: np.ndarray, successor: np.ndarray, backoff: np.ndarray, codes: np.ndarray) -> bytes:
        """``context`` ascends; ``first`` is where its range begins, ``successor`` ascends in it."""
        last = np.concatenate([first[1:], [len(successor)]]) - 1 if len(first) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(successor[last] + np.uint64(1), dtype=np.uint64)])[:-1].astype(np.uint64)
        relative = successor + np.repeat(base, last - first + 1) if len(first) else successor
        pointers = np.concatenate([first, [len(successor)]]).astype(np.uint64)
        levels = Monotone.encode(context), Monotone.encode(pointers), Monotone.encode(relative)
        return b"".join(levels) + backoff.astype(np.uint8).tobytes() + codes.astype(np.uint8).tobytes()

    def find_contexts(self, context: np.ndarray) -> np.ndarray:
        """The place of each context, -1 if it is not in the trie."""
        at = self.contexts.successor(context)
        known = at < self.contexts.n
        known[known] = self.contexts[at[known]] == context[known]
        return np.where(known, at, -1)

    def find(self, place: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of each successor in the range of its context, -1 if it is not there."""
        out = np.full(len(place), -1, np.int64)
        rows = np.flatnonzero(place >= 0)
        if not len(rows):
            return out
        lo = self.pointers[place[rows]].astype(np.int64)
        hi = self.pointers[place[rows] + 1].astype(np.int64)
        base = np.where(lo > 0, self.level[np.maximum(lo - 1, 0)] + np.uint64(1), np.uint64(0))
        x = successor[rows] + base
        at = self.level.successor(x)
        known = (at >= lo) & (at < hi)
        known[known] = self.level[at[known]] == x[known]
        out[rows[known]] = at[known]
        return out
