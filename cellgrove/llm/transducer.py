"""Minimal acyclic transducers from sorted terms to their ordinals, and streaming of text through them.

States are frozen as soon as the next sorted term leaves them, and equal ones are
merged, so that the automaton is minimal at every moment of its making. A
transition puts out how many terms come before all that lie behind it; the sum along
a path is the term's place among the sorted terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Odd multiplier of the transition table's hash (2**64 over the golden ratio).
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Bytes of terms, which are runs of A-Z, a-z and all of UTF-8 beyond ASCII.
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
IS_TERM = np.zeros(256, bool)
IS_TERM[_LETTERS] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Transducer:
    """Transitions in an open-addressed table: key (state * 256 + byte, -1: none), target, output."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray
    root: int

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets (-1: none) and outputs of one byte from each state."""
        key = (state.astype(np.int64) << 8) | byte
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        hit = found == key
        return np.where(hit, self.targets[slot], -1), np.where(hit, self.outputs[slot], 0)

    def ordinals(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinal of each stretch of ``text``, or -1; all stretches advance together."""
        out = np.full(len(starts), -1, np.int64)
        alive = np.argsort(-lengths, kind="stable")
        state, total = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        at = 0
        while len(alive):
            # stretches are in order of falling length, so the ended ones are last
            going = int(np.searchsorted(-lengths[alive], -at, side="left"))
            done = self.final[state[going:]]
            out[alive[going:][done]] = total[going:][done]
            alive, state, total = alive[:going], state[:going], total[:going]
            state, more = self.step(state, text[starts[alive] + at])
            keep = state >= 0
            alive, state, total = alive[keep], state[keep], (total + more)[keep]
            at += 1
        return out


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def build(terms: Iterable[bytes]) -> Transducer:
    """The transducer of terms that come sorted by bytes, without repeats or empty ones."""
    known: dict[tuple, int] = {}
    behind: list[int] = []  # terms behind each frozen state
    path: list[list] = [[False, []]]
    last = b""

    def freeze(node: list) -> int:
        final, edges = node
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(behind)
            behind.append(final + sum(behind[t] for _, t in edges))
        return known[key]

    def shorten(to: int) -> None:
        while len(path) > to + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    for term in terms:
        same = 0
        while same < min(len(last), len(term)) and last[same] == term[same]:
            same += 1
        shorten(same)
        path += [[False, []] for _ in term[same:]]
        path[-1][0] = True
        last = term
    shorten(0)
    root = freeze(path[0])

    moves = []
    for (final, edges), state in known.items():
        before = int(final)
        for byte, target in edges:
            moves.append((state << 8 | byte, target, before))
            before += behind[target]
    table = np.array(moves, np.int64).reshape(-1, 3)
    size = 1 << max(4, (2 * len(table)).bit_length())
    keys, targets, outputs = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)
    slot, todo = _slots(table[:, 0], size), np.arange(len(table))
    while len(todo):
        free = todo[keys[slot[todo]] < 0]
        _, one = np.unique(slot[free], return_index=True)
        won = free[one]
        keys[slot[won]], targets[slot[won]], outputs[slot[won]] = table[won, 0], table[won, 1], table[won, 2]
        todo = np.setdiff1d(todo, won, assume_unique=True)
        slot[todo] = (slot[todo] + 1) & (size - 1)
    final = np.zeros(len(behind), bool)
    final[[state for (is_final, _), state in known.items() if is_final]] = True
    return Transducer(keys, targets, outputs, final, root)


def stretches(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in ``text`` (bytes)."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = IS_TERM[text]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def blocks(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, never cut inside a term."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and IS_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]
