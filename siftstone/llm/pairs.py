"""A lookup of symbol pairs in bulk, for the tokenizer operators."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Maps pairs (left, right) of symbol numbers to a value, for whole arrays at once.

    An open-addressing table with linear probing; pairs that are absent give `absent`.
    """

    def __init__(self, left, right, value, absent: int):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        key = (left << np.uint64(32)) | right
        bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 6))))
        self.shift, self.mask, self.absent = np.uint64(64 - bits), (1 << bits) - 1, absent
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, absent, np.int64)
        todo = np.arange(len(key))
        at = self._slot(key)
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.values[slots] = key[put], np.asarray(value)[put]
            left_over = np.ones(len(key), bool)
            left_over[put] = False
            todo = todo[left_over[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key):
        return ((key * _MIX) >> self.shift).astype(np.int64)

    def get(self, left, right):
        """Values for arrays of pairs; a negative symbol belongs to no pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], self.absent)
        more = np.flatnonzero((found != key) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out
