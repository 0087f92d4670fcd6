"""Token counts of a piece vocabulary (byte-pair pieces with byte fallback), without building tokens.

Spaces become the vocabulary's space mark, one is put in front, and since no piece has that mark after another
character, a text falls apart into pre-tokens (spaces and what follows) that merge on their own. The distinct pre-tokens of
a batch are merged together by ``merge_sequences``; what survives is counted, a character outside the vocabulary with
one token for each of its UTF-8 bytes. Counts of pre-tokens seen before are kept in arrays of bounded size.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import in_batches, lean, slices, span_hashes
from .merging import PairTable, merge_sequences, spans_flat

SPACE_MARK = "▁"
KNOWN = 1_000_000  # pre-tokens whose counts a task remembers


@cache
def vocabulary(path: str) -> tuple[PairTable, np.ndarray, np.ndarray]:
    """(pairs that merge, symbol of each code point, tokens each symbol counts as), from a piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = {i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    if any(model.is_unused(i) for i in range(len(model))):
        raise ValueError("unused pieces are not supported")
    piece = {model.id_to_piece(i): i for i in range(len(model)) if i not in special}
    if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in piece):
        raise ValueError("a piece has a space mark after another character")
    symbol = dict(piece)
    for c in sorted({c for p in piece for c in p}):
        symbol.setdefault(c, len(model) + len(symbol))
    top = max(symbol.values()) + 1
    cost = np.ones(top + 5, np.int64)  # the last four stand for unknown characters of 1 to 4 bytes
    cost[top : top + 5] = range(5)
    of_char = np.full(0x110000, -1, np.int32)
    for c, i in symbol.items():
        if len(c) == 1:
            of_char[ord(c)] = i
            if c not in piece:
                cost[i] = len(c.encode())
    unknown = np.flatnonzero(of_char < 0)
    of_char[unknown] = top + 1 + (unknown > 0x7F) + (unknown > 0x7FF) + (unknown > 0xFFFF)
    level = {s: r for r, s in enumerate(sorted({-model.get_score(i) for i in piece.values()}))}
    rows = [
        (symbol[p[:j]], symbol[p[j:]], level[-model.get_score(i)], i)
        for p, i in piece.items() for j in range(1, len(p)) if p[:j] in symbol and p[j:] in symbol
    ]
    return PairTable(*(np.array(x) for x in zip(*rows))), of_char, cost


def code_points(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and how many each span of bytes has."""
    head = (data & 0xC0) != 0x80
    at = np.flatnonzero(head)
    b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    one, two, three, four = b[at], b[at + 1] & 0x3F, b[at + 2] & 0x3F, b[at + 3] & 0x3F
    cp = np.where(one < 0x80, one, np.where(one < 0xE0, (one & 0x1F) << 6 | two, np.where(
        one < 0xF0, (one & 0xF) << 12 | two << 6 | three, (one & 7) << 18 | two << 12 | three << 6 | four)))
    sums = np.concatenate(([0], np.cumsum(head)))
    ends = np.cumsum(lengths)
    return cp, sums[ends] - sums[ends - lengths]


class Counter:
    """Token counts of texts; remembers pre-tokens between batches."""

    def __init__(self, path: str):
        self.table, self.of_char, self.cost = vocabulary(path)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.mark = self.of_char[ord(SPACE_MARK)]

    def _merged(self, data, starts, ends):
        flat, size = spans_flat(data, starts, ends)
        cp, chars = code_points(flat, size)
        sym = np.where(cp == 32, self.mark, self.of_char[cp])
        sym, length = merge_sequences(sym, chars, self.table)
        sums = np.concatenate(([0], np.cumsum(self.cost[sym])))
        at = np.concatenate(([0], np.cumsum(length)))
        return sums[at[1:]] - sums[at[:-1]]

    def count(self, column) -> list[int]:
        column = pc.fill_null(column, "")
        spaced = pc.binary_join_element_wise(" ", pc.replace_substring(column, SPACE_MARK, " "), "")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, spaced)
        out: list[int] = []
        for lo, hi, data, offsets in slices(column):
            space = data == 32
            start = space.copy()
            start[1:] &= ~space[:-1]
            filled = offsets[:-1][offsets[1:] > offsets[:-1]]
            start[filled] = True
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(data))
            h, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            n = np.zeros(len(h), np.int64)
            at = np.searchsorted(self.known, h)
            old = at < len(self.known)
            old[old] = self.known[at[old]] == h[old]
            n[old] = self.counts[at[old]]
            new = np.flatnonzero(~old)
            n[new] = self._merged(data, starts[first[new]], ends[first[new]])
            if len(self.known) + len(new) <= KNOWN:
                self.known = np.insert(self.known, at[new], h[new])
                self.counts = np.insert(self.counts, at[new], n[new])
            sums = np.concatenate(([0], np.cumsum(n[back])))
            first_of = np.searchsorted(starts, offsets)
            out += (sums[first_of[1:]] - sums[first_of[:-1]]).tolist()
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    No begin, end or added special tokens; strings of special tokens inside texts are ordinary text. Null texts count as
    empty: no bytes, no tokens. Repeated rows are counted one by one; an id may be null; an empty table gives an empty
    one. Columns other than the two named are not read. ``path`` must be readable on every executor.
    """

    @lean
    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            n = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(pc.fill_null(batch.column(1), "")), pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = in_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
