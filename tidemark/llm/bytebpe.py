"""Byte-level BPE encoding and decoding with one encoding per distinct word of the whole corpus.

1. Texts are taken in chunks. A chunk splits its texts into pre-tokens and knows, for each position, which of its
   distinct words stands there. Per chunk and bucket of the word's hash one row carries the words, another the positions.
2. The words of a bucket meet from all chunks; each distinct one is encoded once (``merge_sequences``) and every chunk
   gets the ids of its words back. A word that is everywhere is sent once a chunk, so no word makes a hot key.
3. Ids and positions of a chunk meet again: texts are put together by position, and decoded through the token table.

The chunks are formed twice from the same input, once for the words and once for the positions, because keeping the
positions would cost more than making them again. The input must therefore read the same way twice, as a table does; a
chunk is named by a digest of its texts, so that a difference is an error and never a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import in_batches, lean, lean_groups, span_hashes, text_bytes
from .merging import PairTable, merge_sequences

CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 40 << 20  # text per bucket; its distinct words are a fraction of that
LEAST_BUCKETS = 32
CHUNK = "chunk long, bucket long, id binary, data binary"


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a rank file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def vocabulary(path: str) -> tuple[PairTable, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that merge, id of each byte, all token bytes end to end, where each id's bytes begin)."""
    ids = ranks(path)
    rows = [(ids[t[:j]], ids[t[j:]], i, i) for t, i in ids.items() for j in range(1, len(t)) if t[:j] in ids and t[j:] in ids]
    single = np.array([ids[bytes([b])] for b in range(256)], np.int32)
    parts = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        parts[i] = t
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return PairTable(*(np.array(x) for x in zip(*rows))), single, np.frombuffer(b"".join(parts), np.uint8), begins


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each word): a word that is a token is that token, others are merged from bytes."""
    table, single, _, _ = vocabulary(path)
    known = ranks(path)
    whole = np.array([known.get(w, -1) for w in words], np.int32)
    rest = np.flatnonzero(whole < 0)
    flat = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
    sym, length = merge_sequences(single[flat], np.array([len(words[i]) for i in rest], np.int64), table)
    size = np.ones(len(words), np.int64)
    size[rest] = length
    begin = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int32)
    out[begin[whole >= 0]] = whole[whole >= 0]
    out[np.repeat(begin[rest] - (np.cumsum(length) - length), length) + np.arange(len(sym))] = sym
    return out, size


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays in the least width that holds them, compressed."""
    parts = []
    for a in arrays:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if k is np.int64 or not len(a) or a.max() <= np.iinfo(k).max)
        body = a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T.tobytes()  # byte planes compress better
        parts.append(np.array([np.dtype(kind).itemsize, len(a)], np.int64).tobytes() + body)
    return zstandard.compress(b"".join(parts), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        width, n = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
        out.append(planes.T.copy().view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]).ravel().astype(np.int64))
        at += 16 + width * n
    return out


def pack_words(words: list[bytes]) -> bytes:
    return pack(np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(words), np.uint8))


def unpack_words(blob: bytes) -> list[bytes]:
    size, flat = unpack(blob)
    raw, ends = flat.astype(np.uint8).tobytes(), np.cumsum(size).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _chunks(batches):
    """(ids as Arrow, texts as Arrow) of about CHUNK_BYTES of text each."""
    held, size = [], 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(np.diff(text_bytes(batch.column(1))[1]))
        while at < len(batch):
            done = sizes[at - 1] if at else 0
            end = min(len(batch), max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES - size, "right"))))
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1] - done)
            at = end
            if size >= CHUNK_BYTES or at < len(batch):
                yield held
                held, size = [], 0
    if held:
        yield held


def _split(held, pattern, buckets: int):
    """(chunk name, ids, pre-tokens of each text, code of each pre-token, distinct words by bucket)."""
    table = pa.Table.from_batches(held)
    texts = pc.fill_null(table.column(1), "").to_pylist()
    find = pattern.findall
    tokens: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = hashlib.blake2b(digest_size=8)
    for i, t in enumerate(texts):
        got = find(t)
        sizes[i] = len(got)
        tokens += got
        digest.update(b"%d," % len(t))
        digest.update(t.encode())
    ids = table.column(0).to_pylist()
    digest.update(repr(ids).encode())
    codes, words = pd.factorize(np.array(tokens, object)) if tokens else (np.zeros(0, np.int64), [])
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
    h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends) \
        if raw else np.zeros(0, np.uint64)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    raw = [raw[i] for i in order]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    name = int.from_bytes(digest.digest(), "little", signed=True)
    return name, ids, sizes, place[codes], [(b, raw[lo:hi]) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]


def _row(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
        zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "id", "data"])


def _words(rows: DataFrame, pattern: str, buckets: int) -> DataFrame:
    @lean
    def run(batches):
        split = regex.compile(pattern)
        for held in _chunks(batches):
            name, _, _, _, words = _split(held, split, buckets)
            if words:
                yield _row([(name, b, None, pack_words(w)) for b, w in words])

    return in_batches(rows).mapInArrow(run, CHUNK)


def _positions(rows: DataFrame, pattern: str, buckets: int) -> DataFrame:
    @lean
    def run(batches):
        split = regex.compile(pattern)
        for held in _chunks(batches):
            name, ids, sizes, codes, _ = _split(held, split, buckets)
            null = np.array([i is None for i in ids])
            values = np.array([i or 0 for i in ids], np.int64)
            yield _row([(name, -1, zstandard.compress(values.tobytes() + null.tobytes()), pack(sizes, codes))])

    return in_batches(rows).mapInArrow(run, CHUNK)


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """The ids of each chunk's words of a bucket, in the order the chunk sent the words."""

    @lean_groups
    def run(key, table):
        chunks = table.column("chunk").to_pylist()
        lists = [unpack_words(x) for x in table.column("data").to_pylist()]
        place: dict[bytes, int] = {}
        codes = [np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int64, len(ws)) for ws in lists]
        ids, size = encode_words(list(place), path)
        begin = np.cumsum(size) - size
        out = []
        for chunk, c in zip(chunks, codes):
            n = size[c]
            at = np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((chunk, key[0].as_py(), None, pack(n, ids[at])))
        return pa.Table.from_batches([_row(out)])

    return words.groupBy("bucket").applyInArrow(run, CHUNK)


def _assembled(both: DataFrame, path: str) -> DataFrame:
    """Ids of each text by position, and its bytes decoded from them."""

    @lean_groups
    def run(key, table):
        _, _, token_bytes, token_begin = vocabulary(path)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "id", "data"))), key=lambda r: r[0])
        twins = sum(r[0] == -1 for r in rows)
        if not twins or len({r[2] for r in rows if r[0] == -1}) > 1:
            raise RuntimeError("the texts did not read the same way twice")
        _, id_blob, blob = rows[0]
        sizes, codes = unpack(blob)
        answer: dict[int, bytes] = {r[0]: r[2] for r in rows if r[0] >= 0}
        got = [unpack(answer[b]) for b in sorted(answer)]
        n = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
        ids = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        if len(codes) and codes.max() >= len(n):
            raise RuntimeError("the texts did not read the same way twice")
        begin = np.cumsum(n) - n
        width = np.diff(token_begin)
        raw = zstandard.decompress(id_blob)
        count = len(sizes)
        values, null = np.frombuffer(raw, np.int64, count), np.frombuffer(raw, bool, count, 8 * count)
        coded, back = [], []
        at = 0
        for size in sizes.tolist():
            c = codes[at : at + size]
            at += size
            k = n[c]
            x = ids[np.repeat(begin[c] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            w = width[x]
            text = token_bytes[np.repeat(token_begin[x] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            coded.append(x.astype("<u4").tobytes())
            back.append(text.tobytes())
        out = pa.table({"id": pa.array(values, pa.int64(), mask=null), "ids": pa.array(coded, pa.binary()),
                        "decoded": pa.array(back, pa.binary())})
        return pa.concat_tables([out] * twins)  # chunks with the very same rows have the same name

    return both.groupBy("chunk").applyInArrow(run, "id long, ids binary, decoded binary")


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``ids`` (its tokens as little-endian 32-bit integers) and ``decoded`` (the bytes they stand for).

    ``pattern`` splits the text; each match is encoded on its own by the ranks in ``path``, with no special tokens. The
    ids are decoded where they are put together, by look-up in the vocabulary's token bytes (a table of fixed size that
    every task has anyway for encoding). Null and empty texts have no tokens and no bytes. Repeated rows are encoded one by one; an id may be null;
    an empty table gives an empty one. Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    words = _encoded(_words(rows, pattern, buckets), path)
    both = words.union(_positions(rows, pattern, buckets))
    return _assembled(both, path).withColumnRenamed("id", id_col)


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``encoded``: id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    return encoded(docs, path, pattern, id_col, text_col).select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
