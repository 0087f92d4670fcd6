"""Batches of very long texts stay bounded, and removal gives the text that is left."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm import arrays, lmscore, repeats  # noqa: E402


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 50, 1, 2).select("id", F.repeat(F.lit("abcde fghi "), 480_000).alias("text"))  # 5 MB each

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = arrays.in_batches(docs).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 50 and max(r["size"] for r in got) < arrays.BATCH_BYTES + (6 << 20)


def test_removal_gives_spans_and_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", 5)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghé", k=6))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80))) + (passage[i:] if i % 2 else "") + word()) for i in range(30)]
    rows += [(50, None), (51, ""), (None, "short"), (52, passage * 2), (53, passage * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "removed", "kept", "id", "times")})
    cut = {}
    for r in repeats.deduplicated(docs).collect():
        cut[r.doc_id] = r
    told = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert set(cut) == set(told) == {i for i, _ in rows}
    for i, text in rows:
        body, at, left = (text or "").encode(), 0, b""
        for s in cut[i].removed:
            assert at <= s.low < s.high <= len(body) and (at == 0 or s.low > at)
            left, at = left + body[at : s.low], s.high
        left += body[at:]
        assert bytes(cut[i].kept) == left
        assert (told[i].n_removed, told[i].n_spans) == (len(body) - len(left), len(cut[i].removed))
        assert told[i].kept_sha256 == hashlib.sha256(left).hexdigest()
    assert told[52].n_removed == told[52].n_bytes and told[1].n_removed > 400
    assert repeats.deduplicated(docs.filter("false")).count() == 0


def test_scores_of_rows_without_an_id(spark):
    rows = [(None, "alpha beta gamma")] * 40 + [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "aim", "chunk", "score")})
    marks = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    got = lmscore.cross_entropy_difference(docs, marks).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, t in rows)
    # an id of their own instead of none changes no score
    named = docs.withColumn("doc_id", F.coalesce("doc_id", 100 + F.monotonically_increasing_id()))
    want = lmscore.cross_entropy_difference(named, marks).collect()
    losses = lambda rows: sorted((r.n_words, round(r.target_loss, 9), round(r.corpus_loss, 9)) for r in rows)
    assert losses(got) == losses(want)
    assert [r.score for r in got if r.doc_id == 2] == [0]
