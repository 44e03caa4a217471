"""Minimal acyclic transducers: sorted terms as an automaton without two equal states, whose paths add up to the terms' places in the order."""

from __future__ import annotations

import io

import numpy as np


class Transducer:
    """A finite set of byte strings that gives each its ordinal among them, from 0 in lexicographic order.

    ``keys`` has state * 256 + byte of each edge, ascending; ``target`` the state an edge leads to; ``skip`` how many terms of
    its state sort before those behind it; ``final`` whether a term ends in a state. The last state is the root.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray) -> None:
        self.keys, self.target, self.skip, self.final = keys, target, skip, final

    @classmethod
    def build(cls, terms) -> Transducer:
        """Of distinct terms in ascending order. Only the last term's path is open; a state that is closed is looked up among those that lead to the same ends."""
        known: dict[tuple, int] = {}
        edges: list[list[tuple[int, int]]] = []
        final: list[bool] = []
        below: list[int] = []

        def close(ends: bool, out: list[tuple[int, int]]) -> int:
            like = (ends, *out)
            at = known.get(like)
            if at is None:
                at = known[like] = len(edges)
                edges.append(out)
                final.append(ends)
                below.append(ends + sum(below[t] for _, t in out))
            return at

        open_, last = [[False, []]], b""

        def shorten(n: int) -> None:
            while len(open_) > n + 1:
                ends, out = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], close(ends, out)))

        for term in terms:
            n = 0
            for a, b in zip(last, term):
                if a != b:
                    break
                n += 1
            if term <= last and (last or open_[0][0]):
                raise ValueError("terms must be distinct and ascending")
            shorten(n)
            open_.extend([False, []] for _ in range(len(term) - n))
            open_[-1][0], last = True, term
        shorten(0)
        close(*open_[0])
        keys, target, skip = [], [], []
        for state, out in enumerate(edges):
            before = int(final[state])
            for byte, to in out:
                keys.append(state * 256 + byte)
                target.append(to)
                skip.append(before)
                before += below[to]
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(skip, np.int64), np.array(final, bool))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Each term's ordinal, -1 where it is unknown. All terms walk side by side, a byte a step, until they end or fall off."""
        out = np.full(len(terms), -1, np.int64)
        if not len(self.final) or not terms:
            return out
        data = np.frombuffer(b"".join(terms), np.uint8)
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        at = np.cumsum(size) - size
        who, state, place, step = np.arange(len(terms)), np.full(len(terms), len(self.final) - 1, np.int64), np.zeros(len(terms), np.int64), 0
        while len(who):
            ended = size[who] == step
            if ended.any():
                stop = ended & self.final[state]
                out[who[stop]] = place[stop]
                who, state, place = who[~ended], state[~ended], place[~ended]
            if not len(who) or not len(self.keys):
                break
            key = state * 256 + data[at[who] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[edge] == key
            edge = edge[on]
            who, state, place = who[on], self.target[edge].astype(np.int64), place[on] + self.skip[edge]
            step += 1
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        for part in (self.keys, self.target, self.skip, self.final):
            np.save(held, part, allow_pickle=False)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        held = io.BytesIO(data)
        return cls(*(np.load(held, allow_pickle=False) for _ in range(4)))
