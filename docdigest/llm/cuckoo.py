"""Cuckoo filters whose insertions, lookups and deletions go over whole arrays."""

from __future__ import annotations

import io

import numpy as np

from docdigest.llm.common import mix64

#: Fingerprints of a bucket, share of the slots that may be taken, rounds of moving fingerprints before the rest is listed.
SLOTS, LOAD, ROUNDS = 4, 0.9, 300


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Of rows in order of ``keys``, each one's place among its equals."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


class CuckooFilter:
    """16-bit fingerprints of 64-bit values, each in one of two buckets; what finds no slot is listed beside them.

    A value that was inserted is found until it is deleted, however many others share its fingerprint; one that was not is found with
    a chance of about 8 in 65,536. Only values that were inserted may be deleted, as often as they were inserted.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: np.ndarray | None = None) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    @classmethod
    def sized(cls, values: int) -> CuckooFilter:
        """Empty, with room for so many values."""
        buckets = 1
        while buckets * SLOTS * LOAD < values:
            buckets *= 2
        return cls(buckets)

    @property
    def room(self) -> int:
        return int(self.table.size * LOAD)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def _other(self, print_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix64(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = mix64(values.astype(np.uint64))
        print_ = np.maximum(x >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = (x & np.uint64(len(self.table) - 1)).astype(np.int64)
        return print_, first, self._other(print_, first)

    @staticmethod
    def _listed(print_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b).astype(np.uint64) << np.uint64(16) | print_.astype(np.uint64)

    def insert(self, values: np.ndarray, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        print_, at, _ = self._places(values)
        for _ in range(ROUNDS):
            if not len(at):
                return
            order = np.argsort(at, kind="stable")
            print_, at = print_[order], at[order]
            rank, taken = _rank(at), self.table[at] != 0
            free = SLOTS - taken.sum(1)
            fits = rank < free
            slot = np.take_along_axis(np.argsort(taken, axis=1, kind="stable"), np.minimum(rank, SLOTS - 1)[:, None], 1)[:, 0]
            self.table[at[fits], slot[fits]] = print_[fits]
            left, first = ~fits, rank[~fits] == free[~fits]
            print_, at = print_[left], at[left]
            # the first that is left of each bucket takes the place of one inside; all that are out go to their other bucket
            inside = rng.integers(0, SLOTS, int(first.sum()))
            out = self.table[at[first], inside]
            self.table[at[first], inside] = print_[first]
            print_[first] = out
            at = self._other(print_, at)
        self.stash = np.sort(np.append(self.stash, self._listed(print_, at, self._other(print_, at))))

    def contains(self, values: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(values)
        found = (self.table[a] == print_[:, None]).any(1) | (self.table[b] == print_[:, None]).any(1)
        return found | np.isin(self._listed(print_, a, b), self.stash) if len(self.stash) else found

    def delete(self, values: np.ndarray) -> None:
        """Takes one fingerprint out for each value."""
        print_, at, other = self._places(values)
        for _ in range(2):
            order = np.lexsort((print_, at))
            print_, at, other = print_[order], at[order], other[order]
            rank, same = _rank(at, print_), self.table[at] == print_[:, None]
            there = same.sum(1) > rank
            slot = np.take_along_axis(np.argsort(~same, axis=1, kind="stable"), np.minimum(rank, SLOTS - 1)[:, None], 1)[:, 0]
            self.table[at[there], slot[there]] = 0
            print_, at, other = print_[~there], other[~there], at[~there]
        gone = np.sort(self._listed(print_, at, other))
        place = np.searchsorted(self.stash, gone) + (_rank(gone) if len(gone) else 0)
        self.stash = np.delete(self.stash, place)

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.save(held, self.table, allow_pickle=False)
        np.save(held, self.stash, allow_pickle=False)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        held = io.BytesIO(data)
        table, stash = (np.load(held, allow_pickle=False) for _ in range(2))
        return cls(len(table), table, stash)
