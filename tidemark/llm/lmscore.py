"""Cross-entropy difference: how much likelier a target model finds a text, per word, than a model of the whole corpus.

Both are interpolated bigram models with the same vocabulary, the words of all documents, and the same smoothing; the
target model counts only the documents marked as target. A text is scored by models that have not seen it: its own
counts are taken off both. Low scores are close to the target.

Counting and scoring are one exchange. A chunk of texts sends each distinct word and bigram once, with its two counts,
to the bucket of its hash; the bucket adds the counts of all chunks and answers in the order it was asked; the chunk looks
up its tokens. Frequent words are sent once a chunk like any other, so nothing is hot, and what is gathered grows with the
corpus. The start of a text is a context like a word: its count is the number of texts with words in the whole corpus, in
both models, however the texts are chunked. The texts meet the target's marks once and are settled with their flags, and
both readings that form the chunks (see ``bytebpe``) are of that table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from .arrays import in_batches, lean, lean_groups, mixed, slices, starts_of
from .bytebpe import BUCKET_BYTES, CHUNK, LEAST_BUCKETS, _chunks, _row, pack, unpack
from .decontaminate import _words

LOW = np.uint64((1 << 48) - 1)  # of a hash, its bucket and its low 48 bits are kept
STRENGTH = 4.0  # weight of the shorter history's estimate, in counts
START = np.uint64(0x5851F42D4C957F2D)
PAIR = np.uint64(0xD6E8FEB86659FD93)


def _order(keys, buckets: int):
    """A key's bucket and low bits in one number."""
    bucket = ((keys >> np.uint64(49)) * np.uint64(buckets) >> np.uint64(15)).astype(np.uint64)
    return (bucket << np.uint64(48)) | (keys & LOW)


def _start_key(buckets: int) -> int:
    return int(_order(mixed(np.array([START])) << np.uint64(1), buckets)[0])


def _tokens(held):
    """(name, ids, target flags, first token of each text, word hashes, bigram hashes) of a chunk."""
    table = pa.Table.from_batches(held).combine_chunks()
    words, firsts, n = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in slices(table.column(1)):
        h, _, first = _words(data, offsets)
        words.append(h)
        firsts.append(first[1:] + n)
        n += len(h)
    h, first = np.concatenate(words), np.concatenate(firsts)
    before = np.concatenate(([START], h[:-1])) if n else h
    before[first[:-1][first[1:] > first[:-1]]] = START
    two = mixed(before * PAIR + h)
    flags = np.array(table.column(2).to_pylist(), bool)
    ids = table.column(0).to_pylist()
    digest = hashlib.blake2b(repr(ids).encode() + h.tobytes() + first.tobytes() + flags.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True), ids, flags, first, before, h, two


def _coded(held, buckets: int):
    """A chunk's distinct keys by bucket, with counts, and the code of each token's context, word and bigram."""
    name, ids, flags, first, before, h, two = _tokens(held)
    # words take even keys and bigrams odd ones
    keys = np.concatenate([mixed(before), mixed(h), two]) << np.uint64(1)
    keys[2 * len(h) :] |= np.uint64(1)
    distinct, code = np.unique(_order(keys, buckets), return_inverse=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = code[len(h) :]  # contexts are words of the text too, counted once
    aim = np.tile(flags[text], 2)
    every = np.bincount(own, minlength=len(distinct))
    target = np.bincount(own[aim], minlength=len(distinct))
    every[distinct == np.uint64(_start_key(buckets))] = (np.diff(first) > 0).sum()
    return name, ids, flags, first, text, code.reshape(3, -1), distinct, every, target


def _asked(rows: DataFrame, buckets: int) -> DataFrame:
    @lean
    def run(batches):
        for held in _chunks(batches):
            name, _, _, _, _, _, distinct, every, target = _coded(held, buckets)
            where = (distinct >> np.uint64(48)).astype(np.int64)
            cut = starts_of(where)
            yield _row([(name, int(where[a]), None, pack(
                np.diff((distinct[a:b] & LOW).astype(np.int64), prepend=0), every[a:b], target[a:b]))
                for a, b in zip(cut[:-1], cut[1:])] or [(name, 0, None, pack(*[np.zeros(0, np.int64)] * 3))])

    return in_batches(rows).mapInArrow(run, CHUNK)


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket the corpus counts of the keys asked for; one row per bucket, without a chunk, has its totals.

    The totals are the distinct words, all words, those of target texts, and the texts with words.
    """
    start_bucket, start = divmod(_start_key(buckets), 1 << 48)

    @lean_groups
    def run(key, table):
        chunks = table.column("chunk").to_pylist()
        got = [unpack(x) for x in table.column("data").to_pylist()]
        keys = [np.cumsum(g[0]) for g in got]
        seen, first = {}, []
        for i, c in enumerate(chunks):  # chunks with the very same texts have the same name, and are answered once
            first.append(c not in seen)
            seen.setdefault(c, i)
        distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.bincount(code, np.concatenate([g[1] for g in got]), len(distinct)).astype(np.int64)
        target = np.bincount(code, np.concatenate([g[2] for g in got]), len(distinct)).astype(np.int64)
        b = key[0].as_py()
        starts = (distinct == start) & (b == start_bucket)
        word = (distinct % 2 == 0) & ~starts
        out = [(None, b, None, np.array(
            [(word & (every > 0)).sum(), every[word].sum(), target[word].sum(), every[starts].sum()], np.int64).tobytes())]
        at = np.cumsum([0] + [len(k) for k in keys])
        for c, ok, lo, hi in zip(chunks, first, at[:-1], at[1:]):
            if ok:
                out.append((c, b, None, pack(every[code[lo:hi]], target[code[lo:hi]])))
        return pa.Table.from_batches([_row(out)])

    return asked.groupBy("bucket").applyInArrow(run, CHUNK)


def _kept(rows: DataFrame, buckets: int) -> DataFrame:
    """A chunk's texts as codes of its distinct keys."""

    @lean
    def run(batches):
        for held in _chunks(batches):
            name, ids, flags, first, text, code, _, _, _ = _coded(held, buckets)
            null = np.array([i is None for i in ids], bool)
            values = np.array([i or 0 for i in ids], np.int64)
            yield _row([(name, -1, zstandard.compress(values.tobytes() + null.tobytes() + flags.tobytes()),
                         pack(np.diff(first), code[1], code[2]))])

    return in_batches(rows).mapInArrow(run, CHUNK)


def _own(text, code, n: int):
    """How often the text of each token has that token's key."""
    _, back, count = np.unique(text.astype(np.int64) * n + code, return_inverse=True, return_counts=True)
    return count[back]


def _scored(both: DataFrame, words: int, every_n: int, target_n: int, texts_n: int) -> DataFrame:
    @lean_groups
    def run(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "id", "data"))), key=lambda r: r[0])
        twins = sum(r[0] == -1 for r in rows)
        if not twins:
            raise RuntimeError("the texts did not read the same way twice")
        _, id_blob, blob = rows[0]
        size, one, two = unpack(blob)
        got = [unpack(r[2]) for r in rows if r[0] >= 0]
        every, target = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        n = len(size)
        raw = zstandard.decompress(id_blob)
        values, null, flags = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, 8 * n), np.frombuffer(raw, bool, n, 9 * n)
        text = np.repeat(np.arange(n), size)
        first = np.cumsum(size) - size
        starts = np.zeros(len(one), bool)
        starts[first[size > 0]] = True
        context = np.concatenate(([0], one[:-1])) if len(one) else one
        own1, own2 = _own(text, one, len(every)), _own(text, two, len(every))
        length = size[text]
        loss = []
        for counts, total, seen in ((every, every_n, np.ones(len(text), bool)), (target, target_n, flags[text])):
            c1, c2 = counts[one] - own1 * seen, counts[two] - own2 * seen
            own_before = np.concatenate(([0], own1[:-1])) if len(one) else own1
            before = np.where(starts, texts_n, counts[context] - own_before * seen)
            base = (c1 + 1) / (total - length * seen + words + 1)
            loss.append(-np.log2((c2 + STRENGTH * base) / (np.maximum(before, c2) + STRENGTH)))
        sums = [np.bincount(text, x, n) / np.maximum(size, 1) for x in loss]
        out = pa.table({"id": pa.array(values, pa.int64(), mask=null), "n_words": pa.array(size, pa.int64()),
                        "target_loss": pa.array(sums[1]), "corpus_loss": pa.array(sums[0]), "score": pa.array(sums[1] - sums[0])})
        return pa.concat_tables([out] * twins)

    return both.groupBy("chunk").applyInArrow(
        run, "id long, n_words long, target_loss double, corpus_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, target_loss, corpus_loss (bits per word) and score, their difference.

    ``target`` names the target documents by id (repeats and nulls do not matter). Words are runs of letters and digits
    without ASCII case. Null texts and texts without a word score 0. Repeated rows count and are scored one by one. With
    no target document the target model is the smoothing alone. An empty table gives an empty one.
    """
    marks = target.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct().withColumn("aim", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    # the same join at every size, whether the marks could be broadcast or not; rows without an id cannot be marked, and
    # would all meet in one task of an outer join
    named = rows.filter("id IS NOT NULL").join(marks.hint("merge"), "id", "left")
    flagged = settle(named.select("id", "text", F.coalesce("aim", F.lit(False)).alias("aim")).union(
        rows.filter("id IS NULL").withColumn("aim", F.lit(False))))
    answers = settle(_answered(_asked(flagged, buckets), buckets))
    sums = np.zeros(4, np.int64)
    for r in answers.filter("chunk IS NULL").select("data").toLocalIterator():  # a row per bucket
        sums += np.frombuffer(r.data, np.int64)
    both = answers.filter("chunk IS NOT NULL").union(_kept(flagged, buckets))
    return _scored(both, *(int(x) for x in sums)).withColumnRenamed("id", id_col)
