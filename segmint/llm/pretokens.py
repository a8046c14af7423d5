"""Arrays of pre-tokens and bounded tables of their ids, shared by the
vocabularies: a pre-token is a run of bytes with a 64-bit hash."""

from __future__ import annotations

import re

import numpy as np

from .common import mix, worker_state

BASE = 0x9E3779B97F4A7C15
#: Powers that a worker keeps for its next batch.
KEPT_POWERS = 4 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    state = worker_state()
    have = state.get("powers")
    if have is None or len(have[0]) < n:
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if n <= KEPT_POWERS:
            state["powers"] = have
    return have[0][:n], have[1][:n]


#: A space between two other characters: a pre-token begins there, whatever
#: lies before. Longer texts are cut at such places.
SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
PIECE = 1 << 20


def cut_long(texts: list[bytes], size: int = PIECE) -> tuple[list[bytes], list[int]]:
    """(pieces, text that each belongs to): texts of more than ``size`` bytes
    in pieces of about that size, or up to the next safe place."""
    pieces, owner = [], []
    for k, t in enumerate(texts):
        lo = 0
        while len(t) - lo > size:
            cut = SAFE_CUT.search(t, lo + size)
            if cut is None:
                break
            pieces.append(t[lo : cut.start()])
            owner.append(k)
            lo = cut.start()
        pieces.append(t[lo:] if lo else t)
        owner.append(k)
    return pieces, owner


class Runs:
    """Runs of bytes: ``data``, ``starts``, ``sizes``, ``hashes``, and
    ``first`` (index of the first run of each text, and the number of all)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray):
        up, down = powers(len(data))
        run = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)]
        self.data, self.starts, self.sizes = data, starts, ends - starts
        self.hashes = mix((run[ends] - run[starts]) * down[starts] + self.sizes.astype(np.uint64))
        self.first = np.searchsorted(starts, begins)

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[which]
        return self.data[ragged(self.starts[which], sizes)], sizes


class Table:
    """Known pre-tokens: sorted hashes with number and place of their ids.
    Bounded: beyond ``limit`` pre-tokens it starts anew."""

    def __init__(self, merges, limit: int = 1_500_000):
        self.merges, self.limit = merges, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.counts = np.empty(0, np.int32)
        self.places = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def rows(self, p: Runs, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the distinct hashes ``u`` (ascending; ``at``: where in
        ``p``), which are entered if they are unknown."""
        new = self.unknown(u)
        if new.any():
            if len(self.hashes) + new.sum() > self.limit:
                self.clear()
                new[:] = True
            ids, counts = self.merges.encode_flat(*p.bytes_of(at[new]))
            where = np.searchsorted(self.hashes, u[new])
            places = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, ids])
            self.hashes = np.insert(self.hashes, where, u[new])
            self.counts = np.insert(self.counts, where, counts.astype(np.int32))
            self.places = np.insert(self.places, where, places)
        return np.searchsorted(self.hashes, u)

    def texts(self, p: Runs) -> list[np.ndarray]:
        """uint32 ids of each text of ``p``."""
        u, at, inverse = np.unique(p.hashes, return_index=True, return_inverse=True)
        rows = self.rows(p, u, at)[inverse]
        counts = self.counts[rows]
        ids = self.pool[ragged(self.places[rows], counts)].astype(np.uint32, copy=False)
        ends = np.r_[0, np.cumsum(counts)][p.first]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def unknown(self, u: np.ndarray) -> np.ndarray:
        return ~within(self.hashes, u)[0]


def within(table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``u`` are in the ascending ``table``, where)."""
    if not len(table):
        return np.zeros(len(u), bool), np.zeros(len(u), np.int64)
    at = np.minimum(np.searchsorted(table, u), len(table) - 1)
    return table[at] == u, at
