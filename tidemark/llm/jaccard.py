"""Exact set-similarity join on word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

Two texts link when their sets of distinct 5-word shingles have a Jaccard similarity of at least ``percent`` / 100.

1. Every set gets a 64-bit fingerprint and a parity bitmap whose width follows its size; equal sets are one node.
2. Sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each in any common order. The order puts
   shingles of many texts last (a count sketch of fixed size tells them), so a passage of many texts makes no crowd.
   A *tile* is the nodes that have such a shingle in common, in size bands of ratio t: only equal or neighbouring
   bands can link. Tiles of one node vanish at once, tiles with the same nodes are one tile.
3. Bit counts bound the overlap from above: each element of the symmetric difference flips one bit, so
   2 |A and B| <= |A| + |B| - popcount(xor). Pairs that may still reach t meet in an exact intersection.
4. First every tile's nodes are compared with the tile's least node only. A tile whose nodes are then in one component
   is settled, so a crowd of near copies costs one comparison each. In the others the pairs *between* components are
   compared, the most promising first, until no untested pair can join two components. Large tiles are cut into blocks.

No pair that could join two components is left out here; only pairs inside a component that is known already are.

5. Where links are asked for, each component's pairs are then compared in full: in its tiles, or all with all where that
   is less work. Pairs the bitmaps allow are made distinct and verified in cells of two blocks, to which each set is sent
   once. The links of a set are multiplied out by the copies of the sets it links with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from .arrays import fingerprint, in_batches, lean, lean_groups, mixed, shingle_sets, starts_of
from .filters import bit_filter, passes
from .graph import components

SKETCH = 1 << 20  # counters of the count sketch
PARTS = 16  # pieces a task's sketch is sent in
BUCKET_ROWS = 400_000  # postings of a bucket, on average
SEND_ROWS = 2_000_000  # postings a task holds before it sends them
SEEN = 500_000  # sets a task remembers in order not to send a copy again
BLOCK = 1024  # nodes of a tile's block
CELL_GROUPS = 4096
FIRST_PAIRS = 64  # pairs first tested between two components of a tile


def parity_bitmap(values: np.ndarray) -> bytes:
    """One bit per hash value modulo the width, flipped by each element; the width is 64 or more, about the set's size."""
    width = max(64, 1 << int(len(values)).bit_length())
    odd = np.bincount((values % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def xor_count(a: bytes, b: bytes) -> int:
    """Bits that differ between two parity bitmaps; the wider one is folded to the width of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def band_of(n: int, percent: int) -> int:
    """Size band; sizes within the ratio of the similarity are in equal or neighbouring bands."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def may_reach(na: int, nb: int, differing: int, percent: int) -> bool:
    """Can sets of these sizes, with at least so many elements in only one of them, reach the similarity?"""
    common = min((na + nb - differing) // 2, na, nb)
    return 100 * common >= percent * (na + nb - common)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row its id, set size, fingerprint and bitmap, and per task the pieces of its count sketch."""

    @lean
    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n, fp, bits, seen = [], [], [], set()
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                fp.append(fingerprint(s))
                bits.append(None if not len(s) or fp[-1] in seen else parity_bitmap(s))
                if bits[-1]:
                    seen.add(fp[-1])
                    np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bits, pa.binary()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if counts.any():
            parts = np.split(counts.astype(np.uint32), PARTS)
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, ids), none, none, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names, ids = ["id", "n", "fp", "bits", "part", "counts"], pa.int64()
    return in_batches(rows).mapInArrow(run, "id long, n long, fp long, bits binary, part int, counts binary")


def _crowding(described: DataFrame) -> np.ndarray:
    """For each sketch counter 0, or for one far above the mean the bit length of its count: a fixed 1 MB."""

    @lean
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(counts, np.uint32).astype(np.int64)
                sums[part] = sums[part] + c if part in sums else c
        for part, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([c.tobytes()], pa.binary())],
                                             names=["part", "counts"])

    parts = in_batches(described.filter("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part"))
    counts = np.zeros(SKETCH, np.int64)
    step = SKETCH // PARTS
    for row in parts.mapInArrow(add, "part int, counts binary").collect():  # PARTS rows of 128 kB
        counts[row.part * step : (row.part + 1) * step] = np.frombuffer(row.counts, np.int64)
    mean = counts.mean()
    level = np.frexp(counts.astype(float))[1].astype(np.uint8)
    level[counts <= mean + 8 * np.sqrt(mean) + 8] = 0
    return level


def _postings(docs: DataFrame, text_col: str, level: np.ndarray, percent: int, buckets: int) -> DataFrame:
    """(bucket, packed postings): for each set the shingles of its prefix, with the set's fingerprint and size band."""

    def packed(held):
        token, node, band = (np.concatenate(x) for x in zip(*held))
        bucket = (token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.lexsort((node, token, bucket))
        token, node, band, bucket = token[order], node[order], band[order], bucket[order]
        at = starts_of(bucket)
        cut = list(zip(at[:-1], at[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[at[:-1]].astype(np.int64)), *(
                pa.array([x[lo:hi].tobytes() for lo, hi in cut], pa.binary()) for x in (token, node, band))],
            names=["bucket", "token", "node", "band"])

    @lean
    def run(batches):
        seen: set[int] = set()
        held, rows = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                n, fp = len(s), fingerprint(s)
                if not n or fp in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(fp)
                keep = n - -(-percent * n // 100) + 1
                crowd = level[(s >> np.uint64(44)).astype(np.int64)]
                token = s[np.argsort(crowd, kind="stable")[:keep]]
                held.append((token, np.full(keep, fp, np.int64), np.full(keep, band_of(n, percent), np.uint8)))
                rows += keep
                if rows > SEND_ROWS:
                    yield packed(held)
                    held, rows = [], 0
        if held:
            yield packed(held)

    return in_batches(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(
        run, "bucket long, token binary, node binary, band binary")


def _tiles(postings: DataFrame) -> DataFrame:
    """(tile, node, band): the nodes of each token that more than one node has; a tile is named by its nodes."""

    @lean_groups
    def run(key, table):
        token, node, band = (
            np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
            for c, kind in (("token", np.uint64), ("node", np.int64), ("band", np.uint8)))
        order = np.lexsort((node, token))
        token, node, band = token[order], node[order], band[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node, band = token[new], node[new], band[new]
        at = starts_of(token)
        size = np.diff(at)
        name = np.add.reduceat(mixed(node.view(np.uint64)), at[:-1]) + size.astype(np.uint64)
        keep = size > 1
        _, first = np.unique(name, return_index=True)
        once = np.zeros(len(name), bool)
        once[first] = True
        keep &= once
        rows = np.repeat(keep, size)
        return pa.table({"tile": pa.array(np.repeat(mixed(name), size)[rows].view(np.int64)),
                         "node": pa.array(node[rows]), "band": pa.array(band[rows].astype(np.int32))})

    return postings.groupBy("bucket").applyInArrow(run, "tile long, node long, band int").distinct()


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the similarity."""

    @lean
    def run(batches):
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(i).to_pylist() for i in range(6))
            keep = [may_reach(w, x, xor_count(y, z), percent) for w, x, y, z in zip(na, nb, ba, bb)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb")
    return in_batches(rows).mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    """(fp) of every set in a pair, once; each side is made distinct before the two meet."""
    return pairs.select(F.col("a").alias("fp")).distinct().union(pairs.select(F.col("b").alias("fp")).distinct()).distinct()


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(fp, text) of the wanted fingerprints, one text of each.

    A small filter of fixed size keeps most other texts out of the shuffle; a join then decides.
    """
    words = bit_filter(wanted)

    @lean
    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            fp = [fingerprint(s) for _, s in shingle_sets(batch.column(0))]
            keep = [bool(x) and x not in sent and bool(passes(words, x)) for x in fp]
            if len(sent) < SEEN:
                sent.update(x for x, k in zip(fp, keep) if k)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), batch.column(0)], names=["fp", "text"]).filter(
                pa.array(keep, pa.bool_()))

    rows = in_batches(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "fp long, text string")
    return rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by exact intersection of the sorted shingle arrays."""

    @lean
    def run(batches):
        for batch in batches:
            ok = []
            for (_, x), (_, y) in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    rows = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
    return in_batches(rows.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long, linked boolean")


def _allowed(node, comp, band, own, n, bits, within: bool, percent: int):
    """Positions i, j of the pairs of different components whose bitmaps allow a link, and their least difference.

    within: a block with itself.
    """
    lists = []
    width = np.array([len(x) // 8 for x in bits])
    for v in np.unique(band):
        at = np.flatnonzero((band == v) | (band == v + 1))
        w = width[at].min()
        m = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w), axis=0) for i in at])
        size = n[at]
        for k, i in enumerate(at):
            if band[i] != v:
                continue
            ok = (comp[at] != comp[i]) & ((band[at] > v) | (node[at] > node[i]))
            if not within:
                ok &= own[at] != own[i]
            ok = np.flatnonzero(ok)
            far = np.bitwise_count(m[ok] ^ m[k]).sum(axis=1, dtype=np.int64)
            common = np.minimum((size[ok] + n[i] - far) // 2, np.minimum(size[ok], n[i]))
            union = size[ok] + n[i] - common
            may = 100 * common >= percent * union
            j = at[ok[may]]
            lists.append(np.stack([np.full(len(j), i), j, (union - common)[may]]))
    return np.concatenate(lists, axis=1) if lists else np.zeros((3, 0), np.int64)


def _cell_pairs(node, comp, band, own, n, bits, within: bool, percent: int, most: int) -> tuple[list, bool]:
    """Pairs whose bitmaps allow a link between two components, and whether some were held back.

    Of each two components the ``most`` likeliest pairs are given: one link joins them.
    """
    i, j, far = _allowed(node, comp, band, own, n, bits, within, percent)
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    x, y = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    order = np.lexsort((b, a, far, y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    keep = order[place < most]
    return list(zip(a[keep].tolist(), b[keep].tolist(), x[keep].tolist(), y[keep].tolist())), len(keep) < len(order)


def _between(open_tiles: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, tile): pairs between components of a tile, and tiles (with no pair) that held some back.

    A tile of many nodes is cut into blocks of about ``BLOCK`` nodes, and each pair of blocks is a cell of its own. The
    tiles of a crowd, which have the same least component ``lo``, send the same cell to the same group, so that two
    components get their ``most`` pairs once and not in every tile. A group holds two blocks of as many tiles as a set
    has shingles in its prefix, however large the crowd.
    """
    blocks = open_tiles.groupBy("tile").agg(F.ceil(F.count("node") / BLOCK).alias("blocks"))
    cells = (
        open_tiles.join(sets.select(F.col("fp").alias("node"), "n", "bits"), "node").join(blocks, "tile")
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        .withColumn("g", F.pmod(F.xxhash64("lo", "x", "y"), F.lit(CELL_GROUPS)))
        .select("g", "tile", "x", "y", "node", "comp", "band", "own", "n", "bits")
    )

    @lean_groups
    def run(key, table):
        found: dict[tuple[int, int], set[tuple[int, int]]] = {}
        cut = set()
        for (tile, x, y), c in table.to_pandas().groupby(["tile", "x", "y"], sort=False):
            arrays = (c[k].to_numpy() for k in ("node", "comp", "band", "own", "n", "bits"))
            pairs, more = _cell_pairs(*arrays, x == y, percent, most)
            for a, b, c1, c2 in pairs:
                sent = found.setdefault((c1, c2), set())
                if len(sent) < most:
                    sent.add((a, b))
                elif (a, b) not in sent:
                    more = True
            if more:
                cut.add(tile)
        rows = [(a, b, None) for sent in found.values() for a, b in sent] + [(None, None, t) for t in cut]
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("a", "b", "tile"), list(zip(*rows)) or [()] * 3)})

    return cells.groupBy("g").applyInArrow(run, "a long, b long, tile long").distinct()


def _candidates(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, comp), distinct: pairs of a component that share a tile and whose bitmaps allow a link.

    members: (tile, comp, node, band), each node with the tiles its pairs are made in. Cells are cut as in ``_between``;
    the tiles of a component send the same cell to the same group, which sends a pair once.
    """
    blocks = members.groupBy("tile", "comp").agg(F.count("node").alias("c")).filter("c > 1").select(
        "tile", "comp", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    cells = (
        members.join(sets.select(F.col("fp").alias("node"), "n", "bits"), "node").join(blocks, ["tile", "comp"])
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        .withColumn("g", F.pmod(F.xxhash64("comp", "x", "y"), F.lit(CELL_GROUPS)))
        .select("g", "tile", "comp", "x", "y", "node", "band", "own", "n", "bits")
    )

    @lean_groups
    def run(key, table):
        found = []
        for (comp, _, x, y), c in table.to_pandas().groupby(["comp", "tile", "x", "y"], sort=True):
            node, band, own, n, bits = (c[k].to_numpy() for k in ("node", "band", "own", "n", "bits"))
            i, j, _ = _allowed(node, node, band, own, n, bits, x == y, percent)
            ends = np.stack([np.full(len(i), comp), np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1)
            found.append(ends)
            if sum(map(len, found[1:])) > len(found[0]):  # copies of a pair are dropped as they come
                found = [np.unique(np.concatenate(found), axis=0)]
        comp, a, b = np.unique(np.concatenate(found), axis=0).T
        return pa.table({"a": pa.array(a), "b": pa.array(b), "comp": pa.array(comp)})

    return cells.groupBy("g").applyInArrow(run, "a long, b long, comp long").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link, by exact intersection in cells of two blocks of a component."""
    sizes = labels.groupBy(F.col("label").alias("comp")).agg(F.ceil(F.count("node") / BLOCK).alias("blocks"))
    placed = pairs.join(sizes, "comp").select("a", "b", F.xxhash64(
        "comp", F.pmod(F.xxhash64("a"), "blocks"), F.pmod(F.xxhash64("b"), "blocks")).alias("cell"))
    placed = settle(placed)
    ends = placed.select("cell", F.col("a").alias("fp")).distinct().union(placed.select("cell", F.col("b").alias("fp")).distinct())
    held = ends.distinct().join(texts, "fp").select(F.col("cell").alias("place"), "fp", "text")

    @lean_groups
    def run(left, right):
        a, b = (left.column(k).to_numpy() for k in ("a", "b"))
        fp, sets = right.column("fp").to_numpy(), [s for _, s in shingle_sets(right.column("text"))]
        size = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(code, np.cumsum(size)[:-1])
        order = np.argsort(fp)
        i, j = (order[np.searchsorted(fp, v, sorter=order)] for v in (a, b))
        by = np.argsort(i, kind="stable")
        common, mark = np.zeros(len(a), np.int64), np.zeros(code.max() + 1, np.int64)
        at = starts_of(i[by])
        for lo, hi in zip(at[:-1], at[1:]):
            first = codes[i[by[lo]]]
            mark[first] = 1
            for k in range(lo, hi, BLOCK):
                some = by[k : min(k + BLOCK, hi)]
                others = j[some]
                common[some] = np.add.reduceat(mark[np.concatenate([codes[o] for o in others])], np.cumsum(size[others]) - size[others])
            mark[first] = 0
        ok = 100 * common >= percent * (size[i] + size[j] - common)
        return pa.table({"a": pa.array(a[ok]), "b": pa.array(b[ok])})

    return placed.groupBy("cell").cogroup(held.groupBy("place")).applyInArrow(run, "a long, b long")


def set_links(docs: DataFrame, described: DataFrame, tiles: DataFrame, labels: DataFrame, text_col: str, percent: int = 75) -> DataFrame:
    """(a, b), a < b: every two different sets (fingerprints) that link, once; the arguments are those of ``similar_sets``."""
    sets = described.filter("bits IS NOT NULL").groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    members = tiles.join(labels, "node").select("tile", F.col("label").alias("comp"), "node", "band")
    inner = members.groupBy("comp", "tile").agg(F.count("node").alias("c"))
    work = inner.groupBy("comp").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
    size = labels.groupBy(F.col("label").alias("comp")).agg(F.count("node").alias("size"))
    whole = settle(work.join(size, "comp").select("comp", (F.col("size") * F.col("size") <= F.col("work")).alias("whole")))
    members = members.join(whole, "comp").select(
        F.when(F.col("whole"), F.col("comp")).otherwise(F.col("tile")).alias("tile"), "comp", "node", "band").distinct()
    pairs = settle(_candidates(members, sets, percent))
    return _linked(pairs, settle(_texts(docs, text_col, _ends(pairs))), labels, percent)


def similar_sets(docs: DataFrame, id_col: str, text_col: str, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, labels, described, tiles): per row id, n and fp; per fingerprint with a link, the label of its component.

    described and tiles are what the links of the components can be made from, see ``set_links``.
    """
    described = settle(_described(docs, id_col, text_col))
    rows = described.filter("fp IS NOT NULL").select("id", "n", "fp")
    sets = described.filter("bits IS NOT NULL").groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    total = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, int(total * (100 - percent) / 100 / BUCKET_ROWS))
    tiles = every = settle(_tiles(_postings(docs, text_col, _crowding(described), percent, buckets)))

    hubs = tiles.groupBy("tile").agg(F.min(F.struct("node", "band")).alias("h"))
    pairs = (
        tiles.join(hubs, "tile").filter("node <> h.node AND abs(band - h.band) <= 1")
        .select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    pairs = settle(_bounded(pairs, sets, percent))
    now = settle(_verified(pairs, _texts(docs, text_col, _ends(pairs)), percent))
    tested, labels = now.select("a", "b"), components(now.filter("linked").select("a", "b"))
    texts, most = None, FIRST_PAIRS
    while True:
        comp = tiles.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        spread = comp.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        left = settle(comp.join(spread.select("tile", "lo"), "tile"))
        found = settle(_between(left, sets, percent, most))
        pairs = settle(found.filter("tile IS NULL").select("a", "b").join(tested, ["a", "b"], "left_anti"))
        # a tile that sent all its pairs is settled by their tests; joining components makes no new pair
        tiles = settle(left.join(found.filter("tile IS NOT NULL").select("tile"), "tile", "left_semi").select("tile", "node", "band"))
        done = tiles.isEmpty()
        if not pairs.isEmpty():
            if texts is None:  # later rounds only meet nodes of tiles that held pairs back
                texts = settle(_texts(docs, text_col, _ends(pairs).union(tiles.select("node")).distinct()))
            now = settle(_verified(pairs, texts, percent))
            links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            tested, labels = settle(tested.union(now.select("a", "b"))), components(links.union(now.filter("linked").select("a", "b")))
        if done:
            return rows, labels, described, every
        most *= 16


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row id, n, fp and component_id."""
    placed = rows.join(labels, rows.fp == labels.node, "left").select("id", "n", "fp", F.coalesce("label", "fp").alias("comp"))
    least = placed.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    return placed.join(least, "comp", "left").select(
        "id", "n", "fp", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id, the least id reachable by links, its own included.

    Null and empty texts, and texts of white space only, have no shingles and link with nothing. Texts below five
    words are one shingle. Repeated rows stay, each with its component. A row without an id takes part in links; its
    component_id is the least id of the others, null if none has one. An empty table gives an empty table. Columns other
    than the two named are not read. The links themselves are counted by ``link_counts``.
    """
    rows, labels, _, _ = similar_sets(docs, id_col, text_col, percent)
    return _placed(rows, labels).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``near_duplicates`` with n_links: how many other rows of ``docs`` each row links with, its copies included.

    Every link is counted, those inside a component too. Rows without an id count.
    """
    rows, labels, described, tiles = similar_sets(docs, id_col, text_col, percent)
    links = settle(set_links(docs, described, tiles, labels, text_col, percent))
    copies = settle(rows.filter("n > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("copies")))
    both = links.union(links.select("b", "a")).toDF("fp", "other")
    near = both.join(copies.select(F.col("fp").alias("other"), "copies"), "other").groupBy("fp").agg(F.sum("copies").alias("near"))
    counts = copies.join(near, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return _placed(rows, labels).join(counts, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the least id (rows without an id come last).

    Texts without a word link with nothing and all stay. Columns are kept as they are. Only rows of groups are moved;
    a filter of fixed size tells most others apart where they are read.
    """
    rows, labels, _, _ = similar_sets(docs, id_col, text_col, percent)
    placed = rows.filter("n > 0").join(labels, rows.fp == labels.node, "left").select("id", "fp", F.coalesce("label", "fp").alias("comp"))
    first = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    groups = placed.groupBy("comp").agg(F.count("fp").alias("n"), F.min(first).alias("first")).filter("n > 1")
    groups = settle(groups.select("comp", F.col("first.id").alias("first_id"), F.col("first.fp").alias("first_fp")))
    crowd = settle(placed.join(groups, "comp").select(F.col("fp").alias("__fp"), "first_id", "first_fp").distinct())
    words = bit_filter(crowd.select("__fp"))

    @lean
    def run(batches):
        for batch in batches:
            fp = [fingerprint(s) for _, s in shingle_sets(batch.column(1))]
            may = [bool(x) and bool(passes(words, x)) for x in fp]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), pa.array(may, pa.bool_())],
                                             names=["__row", "__fp", "__may"])

    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    schema = whole.select("__row").schema.add("__fp", "long").add("__may", "boolean")
    marked = in_batches(whole).mapInArrow(run, schema)
    apart = marked.filter("NOT __may").select("__row.*")
    met = marked.filter("__may").join(crowd, "__fp", "left")
    alone = met.filter("first_fp IS NULL").select("__row.*")
    kept = met.filter((F.col("__fp") == F.col("first_fp")) & F.col("__row")[id_col].cast("long").eqNullSafe(F.col("first_id")))
    return apart.union(alone).union(kept.dropDuplicates(["__fp"]).select("__row.*"))
