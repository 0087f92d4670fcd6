"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, weighted shingle similarity.

An item of n words is fingerprinted over windows of nearly its size: the largest of a row of fixed widths that is at most
0.8 n, at its start, middle and end. An insertion shifts what follows it out of such a window, and a piece of an item can
be shorter than it; so items of ``LONG`` words or more also have windows of at most 0.45 n, at least one of which a text
with three quarters of the item holds whole or nearly so. Every window of such a width in every text gets its 64-bit SimHash from running sums,
one subtraction per bit. Fingerprints within ``RADIUS`` of an item's agree in one of four 16-bit blocks up to
RADIUS // 4 bits, so four lookups of the blocks' neighbourhoods find all of them. Each is verified: the weight of the item's
5-word shingles that occur at that place in the text, over the weight of all of them, where a shingle weighs as much as
it has letters.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER_BYTE, in_batches, lean, mixed, slices, span_hashes, word_spans

RADIUS = 11
LONG = 16  # words; of a shorter item no inner insertion leaves three quarters of the shingles
BLOCKS, BITS = 4, 16
SHINGLE = 5
LEAST = 0.75
ITEMS = 20_000  # items of a pass; more are taken in several passes over the texts
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[128:] = True
WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _words(data, offsets):
    """Word hashes, letters per word and each text's first word; words are runs of letters and digits of any script."""
    starts, ends, first = word_spans(data, offsets, ~WORD_BYTES)
    return span_hashes(data, starts, ends, LOWER_BYTE), (ends - starts).astype(np.int64), first


def _shingles(h, size):
    """(hash, weight) of the shingles of a stretch of words; a stretch shorter than five words is one shingle."""
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out, weight = np.full(n, k, np.uint64), np.zeros(n, np.int64)
    for j in range(k):
        out += h[j : j + n] * _MIX[j]
        weight += size[j : j + n]
    return mixed(out), weight


def _width(top: float) -> int:
    """The largest width of the row 1, 2, 3, ... (steps of a half) that is at most ``top``, 1 at least."""
    w = 1
    while max(w + 1, w * 3 // 2) <= top:
        w = max(w + 1, w * 3 // 2)
    return w


def _windows(n: int, share: float) -> list[tuple[int, int]]:
    """(width, first word) of windows of at most that share of an item of ``n`` words: at its start, middle and end."""
    w = _width(share * n)
    return sorted({(w, 0), (w, (n - w) // 2), (w, n - w)})


def _running(x, block: int = 32):
    """Running sums down the rows, in place: inside blocks of rows first, so that all steps are long and contiguous."""
    n = -(-len(x) // block) * block
    if len(x) <= block:
        np.cumsum(x, axis=0, dtype=x.dtype, out=x)
        return x
    padded = np.zeros((n, x.shape[1]), x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, block, x.shape[1])
    for j in range(1, block):
        blocks[:, j] += blocks[:, j - 1]
    blocks[1:] += _running(blocks[:-1, -1].copy())[:, None]
    return padded[: len(x)]


def _sums(h, size, kind=np.int16):
    """Running sums, per bit, of the words' signed weights (a word weighs its letters, 12 at most).

    Sums may wrap; differences over fewer than 2^15 / 12 words do not, wider windows take the wider ``kind``.
    """
    weight = np.minimum(size, 12).astype(kind)[:, None]
    out = np.zeros((len(h) + 1, 64), kind)
    out[1:] = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    out[1:] *= 2 * weight
    out[1:] -= weight
    return _running(out)


def _simhash(sums, width: int, step: int = 4096):
    """The fingerprint of every window of ``width`` words."""
    out = np.empty(max(0, len(sums) - width), np.uint64)
    for i in range(0, len(out), step):
        e = min(i + step, len(out))
        above = (sums[i + width : e + width] - sums[i:e]) > 0
        out[i:e] = np.packbits(above.reshape(-1), bitorder="little").view(np.uint64)
    return out


NARROW = 2**15 // 12 - 1  # the widest window whose sums fit 16 bits


class Index:
    """The items of a pass: fingerprints by window width, their block neighbourhoods, and shingles for verification."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.parts, self.length = [], [], []
        by_width: dict[int, list] = {}
        by_half: dict[int, list] = {}
        for lo, _, data, offsets in slices(pa.array([t for _, t in items], pa.large_string())):
            h, size, first = _words(data, offsets)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                n = int(b - a)
                if not n:
                    continue
                item = len(self.ids)
                grams, weight = _shingles(h[a:b], size[a:b])
                grams, at = np.unique(grams, return_index=True)
                self.ids.append(items[lo + i][0])
                self.parts.append((grams, weight[at]))
                self.length.append(n)
                sums = _sums(h[a:b], size[a:b], np.int32)
                for windows, into in ((_windows(n, 0.8), by_width), (_windows(n, 0.45) if n >= LONG else [], by_half)):
                    for w, at in windows:
                        into.setdefault(w, []).append((_simhash(sums[at : at + w + 1], w)[0], item, at))
        self.widths = {w: self._blocks(rows) for w, rows in by_width.items()}
        self.halves = {w: self._blocks(rows) for w, rows in by_half.items()}

    @staticmethod
    def _blocks(rows):
        fp, item, at = (np.array(x, kind) for x, kind in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        near = [sum(1 << b for b in c) for d in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), d)]
        tables = []
        for k in range(BLOCKS):
            block = (fp >> np.uint64(BITS * k)).astype(np.int64) & 0xFFFF
            value = (block[:, None] ^ np.array(near)[None, :]).ravel()
            row = np.repeat(np.arange(len(fp)), len(near))
            order = np.argsort(value, kind="stable")
            begin = np.searchsorted(value[order], np.arange((1 << BITS) + 1)).astype(np.int32)
            tables.append((np.diff(begin) > 0, begin, row[order].astype(np.int32)))
        return fp, item, at, tables

    def candidates(self, h, size, first):
        """(text, item, word at which the item would begin), each once."""
        widths = sorted({*self.widths, *self.halves})
        sums = {k: _sums(h, size, k) for k in {np.int16 if w <= NARROW else np.int32 for w in widths}}
        found = []
        for w in widths:
            if len(h) < w:
                continue
            got = _simhash(sums[np.int16 if w <= NARROW else np.int32], w)
            blocks = got.view(np.uint16).reshape(-1, BLOCKS)
            for fp, item, at, tables in (x[w] for x in (self.widths, self.halves) if w in x):
                pairs = []
                for k, (used, begin, row) in enumerate(tables):
                    hit = np.flatnonzero(used[blocks[:, k]])
                    v = blocks[hit, k].astype(np.int64)
                    n = (begin[v + 1] - begin[v]).astype(np.int64)
                    pos = np.repeat(hit, n)
                    r = row[np.repeat(begin[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    ok = np.bitwise_count(got[pos] ^ fp[r]) <= RADIUS
                    pairs.append(np.stack([pos[ok], r[ok]]))
                pos, r = np.concatenate(pairs, axis=1)
                text = np.searchsorted(first, pos, "right") - 1
                inside = pos + w <= first[text + 1]
                found.append(np.stack([text, item[r], pos - at[r]])[:, inside])
        return np.unique(np.concatenate(found, axis=1), axis=1).T.tolist() if found else []

    def matches(self, column) -> list[dict[int, float]]:
        """Per text the items it holds, with their similarity."""
        out: list[dict[int, float]] = [{} for _ in range(len(column))]
        for lo, _, data, offsets in slices(column, 1 << 18):
            h, size, first = _words(data, offsets)
            for text, item, begin in self.candidates(h, size, first):
                n = self.length[item]
                grams, weight = self.parts[item]
                a, b = max(first[text], begin - n // 4), min(first[text + 1], begin + n + n // 4)
                same = np.isin(grams, _shingles(h[a:b], size[a:b])[0]) if b > a else np.zeros(len(grams), bool)
                share = float(weight[same].sum() / weight.sum())
                if share >= LEAST and share > out[lo + text].get(item, 0.0):
                    out[lo + text][item] = share
        return [{self.ids[i]: s for i, s in m.items()} for m in out]


def _passes(items: DataFrame, id_col: str, text_col: str):
    """Item lists of bounded size."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        "id IS NOT NULL AND text IS NOT NULL").distinct()
    n = max(1, -(-rows.count() // ITEMS))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id", "text")
        yield [(r.id, r.text) for r in part.collect()]  # about ITEMS rows


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", out: str = "matches") -> DataFrame:
    """``docs`` with ``out``: the items each text holds, array<struct<item_id, similarity>>, ordered by item.

    An item is held when the weighted share of its shingles found at one place of the text is 0.75 or more; an item
    shorter than five words must stand there whole. Whatever is returned has been verified; what is looked at are places
    whose fingerprint comes within ``RADIUS`` bits of one of the item's, which the tests compare with an exact version
    (0.98 at least of items with inserted, replaced or deleted words, of cut ones and of bare pieces). Letters compare without ASCII case, punctuation is ignored. Null and
    empty texts hold nothing; items without an id, text or word are held by nothing; repeated rows of either table are
    judged alike. A column of ``docs`` named ``out`` is replaced, the others are kept. Empty tables are fine.
    """
    keep = [c for c in docs.columns if c != out]
    kind = "array<struct<item_id:bigint,similarity:double>>"
    found = docs.select(*keep).withColumn(out, F.array().cast(kind))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
    for part in _passes(items, item_id, item_text):

        @lean
        def run(batches, part=part):
            index = Index(part)
            for batch in batches:
                old = batch.column(batch.num_columns - 2).to_pylist()
                new = index.matches(batch.column(batch.num_columns - 1))
                merged = []
                for o, m in zip(old, new):
                    for x in o:
                        m[x["item_id"]] = max(x["similarity"], m.get(x["item_id"], 0.0))
                    merged.append([{"item_id": i, "similarity": s} for i, s in sorted(m.items())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(merged, arrow)], names=[*keep, out])

        rows = in_batches(found.select(*keep, out, F.col(text_col).cast("string").alias("__text")))
        found = rows.mapInArrow(run, found.select(*keep, out).schema)
    return found


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, item_id, similarity) of every item in every text; see ``with_matches``."""
    found = with_matches(docs.select(id_col, "text"), items)
    return found.select(id_col, F.explode("matches").alias("m")).select(id_col, "m.item_id", "m.similarity")
