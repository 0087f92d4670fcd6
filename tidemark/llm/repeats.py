"""Removal of repeated byte strings: a sparse suffix array by a common-prefix-aware distributed merge sort.

A string of ``SPAN`` = 400 bytes that starts at two places is a repeat, wherever the two places are. Sorting a suffix for
every byte would move hundreds of times the input, so only *anchors* are sorted: in every 400-byte string the leftmost
of its first 177 positions whose 16-gram has the least hash. Equal strings have their anchor at the same offset, and
share at least the 224 bytes from there on.

1. Anchors whose 224 bytes stand nowhere else are dropped (a hash exchange).
2. Each task sorts the suffixes of the rest, up to 400 bytes to the right and then 176 to the left, collapses the equal
   ones, cuts the sorted run at splitters taken from a sample, and sends each piece front-coded: the length of the prefix
   shared with the suffix before it, and what follows.
3. A range merges its runs by a loser tree that keeps, with every loser, the prefix it shares with the winner; known
   prefixes are never compared again. Neighbours that share less than 224 bytes part the order into groups, and inside a
   group the 400-byte strings at equal offsets from the anchor are compared.
4. A group that is larger than a range is cut by a splitter. Its pieces exchange the fingerprints of the strings that
   stay single in them.

Bytes are compared as they are, in the bytes of the UTF-8 text; fingerprints of strings have 64 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from .arrays import in_batches, lean, lean_groups, mixed, slices, span_hashes, starts_of, text_bytes
from .filters import bit_filter, passes

SPAN = 400
GRAM = 16
REACH = 177  # positions of a string its anchor is chosen from
SHARED = SPAN - REACH + 1  # bytes that equal strings share from their anchor on
LEFT = REACH - 1
BUCKET_BYTES = 8 << 20  # text per bucket of the hash exchange
RANGE_ROWS = 25_000  # suffixes of a range, on average
MOST_RANGES = 8192
SAMPLES = 6  # sampled suffixes per range
SENT = 500_000


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(position, least d, greatest d, text): strings start d bytes before their anchor; positions are in ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none
    at = np.arange(n - GRAM + 1)
    h = span_hashes(data, at, at + GRAM)
    h = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)  # ties go to the left
    m = -(-len(h) // REACH) * REACH
    padded = np.full(m, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    rows = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(np.arange(n) + SPAN <= offsets[1:][text])
    p = (np.minimum(back[start], ahead[start + REACH - 1]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    cut = starts_of(p)
    first, last = start[cut[:-1]], start[cut[1:] - 1]
    p = p[cut[:-1]]
    return p, p - last, p - first, text[p]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text): texts long enough to hold a repeat; the key is a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.filter(F.octet_length(text) >= SPAN).select(F.xxhash64(text).alias("key"), text.alias("text"))


def _by_key(key, pos):
    """(key, packed positions) per key."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    cut = starts_of(key)
    return key[cut[:-1]], [pos[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]


PLACES = "key long, places binary"


def _shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, places): packed positions of the anchors whose next 224 bytes stand somewhere else as well.

    Bytes repeated inside a task are known at once; the task then sends one of the places only, marked, so that bytes
    repeated in very many texts do not meet in one task.
    """

    @lean
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            hs, ks, ps = [], [], []
            for lo, _, data, offsets in slices(batch.column(1)):
                p, _, _, text = anchors(data, offsets)
                own = keys[lo + text]
                new = np.array([k not in seen for k in keys[lo : lo + len(offsets) - 1].tolist()], bool)
                _, first = np.unique(keys[lo : lo + len(offsets) - 1], return_index=True)
                once = np.zeros(len(new), bool)
                once[first] = True
                keep = (new & once)[text] if len(text) else np.zeros(0, bool)
                if len(seen) < SENT:
                    seen.update(keys[lo : lo + len(offsets) - 1].tolist())
                p, text, own = p[keep], text[keep], own[keep]
                hs.append(span_hashes(data, p, p + SHARED))
                ks.append(own)
                ps.append(p - offsets[text])
            h, key, pos = np.concatenate(hs), np.concatenate(ks), np.concatenate(ps)
            order = np.argsort(h, kind="stable")
            h, key, pos = h[order], key[order], pos[order]
            cut = starts_of(h)
            size = np.diff(cut)
            many = np.repeat(size > 1, size)
            lead = np.zeros(len(h), bool)
            lead[cut[:-1]] = len(h) > 0
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rows = []
            at = starts_of(bucket[lead])
            sent = [x[lead] for x in (h, key, pos, many)]
            for a, b in zip(at[:-1], at[1:]):
                rows.append((int(bucket[lead][a]), None, *(x[a:b].astype(k).tobytes() for x, k in zip(
                    sent, (np.uint64, np.int64, np.int32, np.uint8)))))
            if many.any():
                for k, places in zip(*_by_key(key[many], pos[many])):
                    rows.append((int(np.uint64(np.int64(k).view(np.uint64)) % np.uint64(buckets)), int(k), None, None, places, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 4))] if rows else
                [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 4)],
                names=["bucket", "key", "h", "keys", "places", "many"])

    @lean_groups
    def meet(_, table):
        direct = table.filter(pc.is_valid(table.column("key")))
        sent = table.filter(pc.is_null(table.column("key")))
        out = [direct.select(["key", "places"])]
        if len(sent):
            h, key, pos, many = (np.concatenate([np.frombuffer(x, k) for x in sent.column(c).to_pylist()]) for c, k in (
                ("h", np.uint64), ("keys", np.int64), ("places", np.int32), ("many", np.uint8)))
            order = np.lexsort((many, pos, key, h))
            h, key, pos, many = h[order], key[order], pos[order], many[order]
            new = np.ones(len(h), bool)  # a copy of a text sent by another task is the same place
            new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
            marked = np.maximum.reduceat(many, np.flatnonzero(new))
            h, key, pos, many = h[new], key[new], pos[new], marked
            cut = starts_of(h)
            size = np.diff(cut)
            shared = np.repeat((size > 1) | (np.add.reduceat(many, cut[:-1]) > 0), size)
            k, places = _by_key(key[shared], pos[shared])
            out.append(pa.table({"key": pa.array(k, pa.int64()), "places": pa.array(places, pa.binary())}))
        return pa.concat_tables(out)

    sent = in_batches(texts).mapInArrow(run, "bucket long, key long, h binary, keys binary, places binary, many binary")
    return sent.groupBy("bucket").applyInArrow(meet, PLACES)


def _chosen_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text), once per key, of the keys in ``wanted``; a filter of fixed size keeps most others from the shuffle."""
    words = bit_filter(wanted.select("key").distinct())

    @lean
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            keep = []
            for k in keys:
                keep.append(k not in sent and bool(passes(words, k)))
                if keep[-1] and len(sent) < SENT:
                    sent.add(k)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_batches(texts).mapInArrow(run, "key long, text string").dropDuplicates(["key"])


class Run:
    """A sorted run being read: front-coded entries, decoded one after the other."""

    def __init__(self, blob: bytes):
        raw = memoryview(zstandard.decompress(blob))
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        at, cols = 8, []
        for kind in (np.int64, np.int32, np.uint16, np.uint16, np.uint8, np.uint8, np.uint8, np.uint8):
            cols.append(np.frombuffer(raw, kind, n, at))
            at += np.dtype(kind).itemsize * n
        self.key, self.pos, self.shared, self.rest, self.left, self.low, self.high, self.many = (c.tolist() for c in cols)
        self.raw, self.at, self.i, self.n = bytes(raw[at:]), 0, -1, n
        self.right = b""

    def next(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            return False
        i, a = self.i, self.at
        b = a + self.rest[i]
        self.right = self.right[: self.shared[i]] + self.raw[a:b]
        self.at = b + self.left[i]
        self.before = self.raw[b : self.at]
        return True

    @property
    def common(self) -> int:
        """Prefix shared with the entry before it in the run."""
        return self.shared[self.i]


def front_coded(entries) -> bytes:
    """A sorted list of (right, left reversed, key, position, least d, greatest d, many) as a run."""
    shared, last = [], b""
    body = []
    for e in entries:
        c = common_prefix(last, e[0], 0)
        shared.append(c)
        body += [e[0][c:], e[1]]
        last = e[0]
    cols = list(zip(*entries))
    parts = [np.array([len(entries)], np.int64).tobytes()]
    for values, kind in ((cols[2], np.int64), (cols[3], np.int32), (shared, np.uint16), ([len(r) - c for r, c in zip(cols[0], shared)], np.uint16),
                         ([len(x) for x in cols[1]], np.uint8), (cols[4], np.uint8), (cols[5], np.uint8), (cols[6], np.uint8)):
        parts.append(np.array(values, kind).tobytes())
    return zstandard.compress(b"".join(parts + body), 1)


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    step = 16
    while start < n:
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            k = min(len(x), len(y))
            differ = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return start + k - (differ.bit_length() + 7) // 8 if differ else start + k
        start += step
        step *= 2
    return n


class LoserTree:
    """Merges sorted runs; each loser keeps the prefix it shares with the entry that beat it."""

    def __init__(self, runs: list[Run]):
        self.runs = [r for r in runs if r.next()]
        self.k = len(self.runs)
        self.common = [0] * self.k  # prefix shared with the last winner that passed by
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, build=True)

    def _beats(self, a: int, b: int) -> bool:
        """Is run ``a``'s entry the smaller one? Both prefixes are relative to the same entry; updates the loser's."""
        x, y = self.common[a], self.common[b]
        if x != y:
            return x > y  # the one closer to the last winner; the loser's prefix with the winner stays
        r, s = self.runs[a], self.runs[b]
        c = common_prefix(r.right, s.right, x)
        first = (r.right[c:], r.before) <= (s.right[c:], s.before) if c < SPAN else r.before <= s.before
        self.common[b if first else a] = c
        return first

    def _play(self, i: int, build: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if build and other < 0:
                self.tree[node] = i
                return
            if not self._beats(i, other) if other >= 0 else False:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        """(right, left reversed, key, position, least d, greatest d, many, prefix shared with the one before)."""
        left = self.k
        while left:
            i = self.tree[0]
            r = self.runs[i]
            j = r.i
            yield r.right, r.before, r.key[j], r.pos[j], r.low[j], r.high[j], r.many[j], self.common[i]
            if r.next():
                self.common[i] = r.common
            else:
                left -= 1
                self.runs[i], self.common[i] = Ended, -1
            self._play(i)


class Ended:
    right, before = b"", b""


def _entries(batch):
    """Sorted distinct suffixes of a batch, and the byte ranges covered by those that stand in it more than once."""
    keys = batch.column(0).to_pylist()
    places = [np.frombuffer(b"".join(x), np.int32) for x in batch.column(2).to_pylist()]
    rows = []
    for lo, _, data, offsets in slices(batch.column(1)):
        p, low, high, text = anchors(data, offsets)
        wanted = np.concatenate([places[lo + i] + offsets[i] for i in range(len(offsets) - 1)])
        use = np.isin(p, wanted)
        raw = data.tobytes()
        for q, a, b, t in zip(p[use].tolist(), low[use].tolist(), high[use].tolist(), text[use].tolist()):
            start, end = int(offsets[t]), int(offsets[t + 1])
            rows.append((raw[q : min(end, q + SPAN)], raw[max(start, q - LEFT) : q][::-1], keys[lo + t], q - start, a, b))
    rows.sort()
    out, covered, i = [], [], 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == rows[i][1]:
            j += 1
        out.append((*rows[i], int(j > i + 1)))
        if j > i + 1:
            covered += [(key, pos - b, pos - a + SPAN) for _, _, key, pos, a, b in rows[i:j]]
        i = j
    return out, covered


def _splitters(joined: DataFrame, ranges: int, total: int) -> list[tuple[bytes, bytes]]:
    """Bounds between ranges, from a sample of at most SAMPLES suffixes per range, taken by a hash of their place."""
    rate = np.uint64(min(1.0, SAMPLES * ranges / max(total, 1)) * 2**32)

    @lean
    def run(batches):
        for batch in batches:
            found, _ = _entries(batch)
            keep = [e for e in found if mixed(np.array([hash((e[2], e[3])) & (2**63 - 1)], np.uint64))[0] >> np.uint64(32) < rate]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in keep], pa.binary()), pa.array([e[1] for e in keep], pa.binary())],
                                             names=["a", "b"])

    sample = sorted((bytes(r.a), bytes(r.b)) for r in in_batches(joined).mapInArrow(run, "a binary, b binary").collect())
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


def _repeated(entries, open_before: bytes | None, open_after: bytes | None):
    """Byte ranges covered by repeats inside a range's groups, and what groups cut by a splitter must still compare.

    entries: the merged order, with prefixes. Returns ((key, start, end) rows, (fingerprint, key, start, several) rows).
    """
    covered, pending = [], []
    rows = list(entries)
    if not rows:
        return covered, pending
    group = np.cumsum([1] + [int(e[7] < SHARED) for e in rows[1:]])
    cut_groups = {int(g) for g, e in ((group[0], rows[0]), (group[-1], rows[-1]))
                  if e[0][:SHARED] in (open_before, open_after)}
    cut = starts_of(group)
    at = 0
    while at < len(cut) - 1:
        end = at + 1
        while end < len(cut) - 1 and cut[end + 1] - cut[at] <= 4000:
            end += 1
        part, own = rows[cut[at] : cut[end]], group[cut[at] : cut[end]]
        at = end
        m = np.zeros((len(part), LEFT + SPAN), np.uint8)
        for i, e in enumerate(part):
            m[i, LEFT : LEFT + len(e[0])] = np.frombuffer(e[0], np.uint8)
            m[i, LEFT - len(e[1]) : LEFT] = np.frombuffer(e[1][::-1], np.uint8)
        sums = np.zeros((len(part), LEFT + SPAN + 1), np.uint64)
        np.cumsum(_TABLE[m] * _UP, axis=1, out=sums[:, 1:])
        d = np.arange(REACH)
        low, high = np.array([e[4] for e in part]), np.array([e[5] for e in part])
        valid = (d >= low[:, None]) & (d <= high[:, None])
        i, j = np.nonzero(valid)
        h = (sums[i, LEFT + SPAN - j] - sums[i, LEFT - j]) * _DOWN[LEFT - j]
        full = mixed(h)
        tag = mixed(full + own[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(tag, kind="stable")
        runs = starts_of(tag[order])
        size = np.diff(runs)
        several = np.zeros(len(tag), bool)
        several[order] = np.repeat(size > 1, size)
        many = np.array([e[6] for e in part], bool)
        sure = several | many[i]
        # entries that stand for several equal ones were covered where they were collapsed
        hit = np.flatnonzero(several & ~many[i])
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (i[hit][1:] != i[hit][:-1]) | (j[hit][1:] != j[hit][:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            for a, b in zip(hit[first], hit[last]):
                e = part[i[a]]
                covered.append((e[2], e[3] - int(j[b]), e[3] - int(j[a]) + SPAN))
        waits = np.flatnonzero(np.isin(own, list(cut_groups)))
        if len(waits):
            waiting = np.isin(i, waits)
            lead = np.zeros(len(tag), bool)
            lead[order[runs[:-1]]] = True
            for x in np.flatnonzero(waiting & lead):
                e = part[i[x]]
                fp = int((full[x] + np.uint64(j[x])).view(np.int64))
                pending.append((fp, None, None, True) if sure[x] else (fp, e[2], e[3] - int(j[x]), False))
    return covered, pending


_STEP = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP = np.multiply.accumulate(np.array([1] + [_STEP] * (LEFT + SPAN - 1), np.uint64))
_DOWN = np.multiply.accumulate(np.array([1] + [pow(_STEP, -1, 2**64)] * (LEFT + SPAN - 1), np.uint64))
FOUND = "fp long, key long, low long, high long, several boolean"


def _found(covered, pending):
    rows = [(None, *c, None) for c in covered] + [(fp, key, start, None, several) for fp, key, start, several in pending]
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("fp", "key", "low", "high", "several"), cols, kinds)})


def covered_ranges(texts: DataFrame, total_bytes: int) -> DataFrame:
    """(key, low, high): byte ranges of the texts that repeats cover; texts (key, text) count once each."""
    places = settle(_shared_anchors(texts, max(32, total_bytes // BUCKET_BYTES)))
    total = int(places.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // 4
    by_key = places.groupBy("key").agg(F.collect_list("places").alias("places"))  # a text's anchors, never longer than it
    joined = settle(_chosen_texts(texts, places).join(by_key, "key").select("key", "text", "places"))
    ranges = min(MOST_RANGES, max(16, total // RANGE_ROWS))
    splitters = _splitters(joined, ranges, total)
    bounds = [s[0][:SHARED] for s in splitters]

    @lean
    def cut(batches):
        for batch in batches:
            entries, covered = _entries(batch)
            keys = [(e[0], e[1]) for e in entries]
            rows, a = [], 0
            for r in range(len(splitters) + 1):
                b = bisect_left(keys, splitters[r], a) if r < len(splitters) else len(entries)
                if b > a:
                    rows.append((r, front_coded(entries[a:b])))
                a = b
            if covered:
                rows.append((-1 - covered[0][0] % ranges, np.array(covered, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["range", "run"])

    @lean_groups
    def merge(key, table):
        r, blobs = key[0].as_py(), table.column("run").to_pylist()
        if r < 0:
            rows = np.concatenate([np.frombuffer(x, np.int64) for x in blobs]).reshape(-1, 3)
            return _found(rows.tolist(), [])
        tree = LoserTree([Run(x) for x in blobs])
        return _found(*_repeated(tree, bounds[r - 1] if r else None, bounds[r] if r < len(bounds) else None))

    found = settle(in_batches(joined).mapInArrow(cut, "range long, run binary").groupBy("range").applyInArrow(merge, FOUND))
    sure = found.filter("fp IS NULL").select("key", "low", "high")
    waiting = found.filter("fp IS NOT NULL")
    again = waiting.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("several").alias("s")).filter("c > 1 OR s").select("fp")
    late = waiting.filter("key IS NOT NULL").join(again, "fp", "left_semi").select("key", "low", (F.col("low") + SPAN).alias("high"))
    return sure.union(late)


WHOLE = "array<struct<low:bigint,high:bigint>>"


def _cut_texts(texts: DataFrame, per_text: DataFrame) -> DataFrame:
    """(key, removed, kept) of the texts with ranges: the maximal removed spans, in order, and the bytes that are left."""

    @lean
    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            removed, kept = [], []
            for i, got in enumerate(batch.column(2).to_pylist()):
                body = data[offsets[i] : offsets[i + 1]]
                depth = np.zeros(len(body) + 1, np.int32)
                for r in got:
                    depth[r["low"]] += 1
                    depth[r["high"]] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append([{"low": lo, "high": hi} for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())])
                kept.append(body[~gone].tobytes())
            spans = pa.array(removed, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array(kept, pa.binary())], names=["key", "removed", "kept"])

    both = _chosen_texts(texts, per_text).join(per_text, "key").select("key", "text", "ranges")
    return in_batches(both).mapInArrow(cut, f"key long, removed {WHOLE}, kept binary")


def _judged(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, text): (id, key, n_bytes, sha) per row, ``times`` per key, and the cuts of texts that occur once."""
    about = settle(rows.select("id", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")))
    total = about.agg(F.sum("n_bytes")).first()[0] or 0
    copies = about.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    texts = _keyed(rows, "text")
    ranges = settle(covered_ranges(texts, total))
    per_text = ranges.join(copies.filter("times = 1").select("key"), "key", "left_semi").groupBy("key").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges"))
    return about, copies, _cut_texts(texts, per_text)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``removed`` (the maximal removed spans in bytes, end exclusive) and ``kept``, the bytes left.

    What is removed is told at ``without_repeats``, which gives counts and digests of the same cuts. ``kept`` is binary, as
    a cut may part a character. Only the id and text columns are read; others may have any name.
    """
    rows = _named(docs, id_col, text_col)
    _, copies, cuts = _judged(rows)
    size = F.octet_length("text").cast("long")
    all_gone = (F.col("times") > 1) & (size >= SPAN)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), size.alias("high")))
    out = rows.withColumn("key", F.xxhash64("text")).join(copies, "key").join(cuts, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(all_gone, whole).otherwise(F.coalesce("removed", F.array().cast(WHOLE))).alias("removed"),
        F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes left.

    Every byte inside a 400-byte string that also starts anywhere else, in the same text or another, is removed, judged
    on the input. Null texts are empty. A repeated row is another place, so a text of 400 bytes or more that occurs twice
    loses everything. Texts below 400 bytes lose nothing. An id may be null; an empty table gives an empty one. Only the
    id and text columns are read; others may have any name. ``deduplicated`` gives the spans and bytes themselves.
    """
    about, copies, cuts = _judged(_named(docs, id_col, text_col))
    # digests, not bytes, meet the rows
    width = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    changed = cuts.select("key", width.alias("removed"), F.size("removed").alias("spans"), F.sha2("kept", 256).alias("kept"))
    all_gone = (F.col("times") > 1) & (F.col("n_bytes") >= SPAN)
    out = about.join(copies, "key").join(changed, "key", "left")
    return out.select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
