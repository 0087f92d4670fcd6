"""Byte-pair merges on many sequences at once, as ragged numpy arrays.

All sequences lie end to end in one array of symbols. A round finds every sequence's lowest-rank pair and merges its
occurrences, left to right, in all sequences simultaneously; finished sequences leave. If merging the occurrences of a
sequence would give, at any moment, a pair of lower rank than theirs, only the first is merged in that round, so the
order is that of merging one pair at a time.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(2**62)
_EMPTY = np.int64(-1)


class PairTable:
    """(left, right) -> (rank, merged symbol), an open-addressed hash table in flat arrays."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        bits = int(np.ceil(np.log2(max(len(keys), 1) * 4 + 16)))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.at = np.zeros(1 << bits, np.int32)
        self.rank = np.append(np.asarray(rank, np.int64), NONE)
        self.merged = np.append(np.asarray(merged, np.int32), 0)
        left_over = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left_over):
            s = slot[left_over]
            free = self.keys[s] == _EMPTY
            self.keys[s[free]] = keys[left_over[free]]
            won = free & (self.keys[s] == keys[left_over])
            self.at[s[won]] = left_over[won]
            left_over = left_over[~won]
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Index into ``rank`` and ``merged`` of each pair; the last entry stands for pairs that never merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], np.int32(len(self.rank) - 1))
        rest = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (held != _EMPTY)]
        return out


def _pairs(sym, seq, table: PairTable):
    """Per position the table entry of the pair it begins; the last of a sequence begins none."""
    at = np.full(len(sym), len(table.rank) - 1, np.int32)
    if len(sym) > 1:
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        at[inner] = table.find(sym[inner], sym[inner + 1])
    return at


def _alternate(hit):
    """Of adjacent hits keep the first, third ... so that no symbol is merged twice."""
    at = np.flatnonzero(hit)
    run = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
    first = at[run][np.cumsum(run) - 1] if len(at) else at
    out = np.zeros(len(hit), bool)
    out[at[(at - first) % 2 == 0]] = True
    return out


def _merge(sym, seq, at, hit, table: PairTable):
    """The arrays after merging each hit position with the next, and which of the new positions are merged ones."""
    sym = np.where(hit, table.merged[at], sym)
    stay = np.ones(len(sym), bool)
    stay[1:] = ~hit[:-1]
    where = np.flatnonzero(stay)
    sym, seq, at, new = sym[where], seq[where], at[where], hit[where]
    touch = new.copy()
    touch[:-1] |= new[1:]
    t = np.flatnonzero(touch)
    at[t] = len(table.rank) - 1
    inner = t[t < len(sym) - 1]
    inner = inner[seq[inner] == seq[inner + 1]]
    at[inner] = table.find(sym[inner], sym[inner + 1])
    return sym, seq, at, touch


def merge_sequences(sym: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, lengths) after all merges; ``sym`` holds the sequences end to end."""
    n = len(lengths)
    seq = np.repeat(np.arange(n), lengths)
    sym = sym.astype(np.int32)
    at = _pairs(sym, seq, table)
    done_sym, done_seq = [], []
    while len(sym):
        rank = table.rank[at]
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(seq))))
        over = best == NONE
        if over.any():
            done_sym.append(sym[over])
            done_seq.append(seq[over])
            stay = ~over
            sym, seq, at, rank, best = sym[stay], seq[stay], at[stay], rank[stay], best[stay]
            if not len(sym):
                break
        hit = _alternate(rank == best)
        moved = _merge(sym, seq, at, hit, table)
        limit = np.full(n, NONE)
        limit[seq] = best
        early = moved[1][moved[3] & (table.rank[moved[2]] < limit[moved[1]])]
        chain = np.flatnonzero(hit[:-2] & hit[2:] & (seq[:-2] == seq[2:]))  # for a moment the first meets an unmerged next
        low = table.rank[table.find(table.merged[at[chain]], sym[chain + 2])] < best[chain]
        early = np.unique(np.concatenate([early, seq[chain[low]]]))
        if len(early):
            at_hit = np.flatnonzero(hit)
            first = np.ones(len(at_hit), bool)
            first[1:] = seq[at_hit][1:] != seq[at_hit][:-1]
            hit[at_hit[~first & np.isin(seq[at_hit], early)]] = False
            moved = _merge(sym, seq, at, hit, table)
        sym, seq, at, _ = moved
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=n)


def spans_flat(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans end to end, and their lengths."""
    size = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    return data[at], size
