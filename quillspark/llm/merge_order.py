"""Which tokens of a merging vocabulary may stand side by side.

A vocabulary that encodes by merging the best pair first has a property that makes its encoding a
programme over prefixes: a sequence of tokens is the encoding of its text if and only if each token
and each pair of neighbours encodes to itself. For merges inside a stretch whose ends nothing crosses
happen in the same order as they would in the stretch alone; and the first merge that crossed an end
of a token would also cross it in the pair alone.

Each token has the time of the merge that makes it: merges of a smaller time go first, and of those of
one time the leftmost. Symbols that no merge makes are their own left and right part.
"""

from __future__ import annotations

import numpy as np

from .arrowkit import U64, mix

ABSENT = np.int64(1) << np.int64(40)
_KEPT = 20  # bits of the number of pairs whose answers are kept


class Table:
    """An open-addressing hash table of 64-bit keys that is probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys have the same hash")
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, ABSENT)
        todo = np.arange(len(keys))
        place = self._place(keys)
        while len(todo):
            free = self.values[place] == ABSENT
            slot, first = np.unique(place[free], return_index=True)
            chosen = todo[free][first]
            self.keys[slot], self.values[slot] = keys[chosen], values[chosen]
            rest = ~np.isin(todo, chosen)
            todo, place = todo[rest], place[rest]
            place = np.where(self.values[place] != ABSENT, (place + 1) & ((1 << self.bits) - 1), place)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        out = self.values[place]
        open_ = np.flatnonzero((self.keys[place] != keys) & (out != ABSENT))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.values[place[open_]]
            open_ = open_[(self.keys[place[open_]] != keys[open_]) & (out[open_] != ABSENT)]
        return out


class MergeOrder:
    """``left`` and ``right`` of each token's last merge, the tokens that pairs make, and the merges' times (by default the tokens' numbers)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: Table, time: np.ndarray | None = None):
        self.left, self.right, self.joined = left, right, joined
        self.time = np.arange(len(left)) if time is None else time
        if (self.time[left] > self.time).any() or (self.time[right] > self.time).any():
            raise ValueError("a token is made from one of a later merge")
        self.asked, self.answers = np.full(1 << _KEPT, ~U64(0)), np.zeros(1 << _KEPT, bool)

    def valid(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the encoding of each pair's joined text is the pair itself.

        Merges are undone from the latest back: while the neighbours at the boundary could not have
        merged before either was used up by its own later merge, the boundary stands.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), ABSENT, np.int64) if limit is None else limit.copy()
        while len(at):
            joined = self.joined.get(a.astype(U64) << U64(32) | b.astype(U64))
            made = joined != ABSENT
            bad = made & (self.time[np.where(made, joined, 0)] < limit)
            good[at[bad]] = False
            later = self.time[a] > self.time[b]
            undo_a = self.right[a]
            undo_b = self.left[b]
            atom_a, atom_b = undo_a == a, undo_b == b
            take_a = (later & ~atom_a) | (~later & atom_b & ~atom_a)
            take_b = ~take_a & ~atom_b
            limit = np.where(take_a, self.time[a], np.where(take_b, self.time[b] + 1, limit))
            a, b = np.where(take_a, undo_a, a), np.where(take_b, undo_b, b)
            go = ~bad & (take_a | take_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``valid`` without a limit; answers are kept in a table of fixed size, where a later pair takes the place of an earlier one."""
        pairs = a.astype(U64) << U64(32) | b.astype(U64)
        slot = (mix(pairs) >> U64(64 - _KEPT)).astype(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != pairs)
        if len(new):
            fresh, at = np.unique(pairs[new], return_inverse=True)
            out[new] = self.valid(fresh >> U64(32), fresh & U64(0xFFFFFFFF))[at]
            self.asked[slot[new]], self.answers[slot[new]] = pairs[new], out[new]
        return out
