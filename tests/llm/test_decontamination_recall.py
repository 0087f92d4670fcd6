"""Edited items against an exact version that tries every place of a text."""

import os
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidemark.llm import decontaminate  # noqa: E402

SF = "/root/testdata/sf0.01"


def edited(words, kind, rng, filler):
    x = list(words)
    if kind == "insert":
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x) + 1)
            x[at:at] = [rng.choice(filler) for _ in range(rng.randrange(1, 4))]
    elif kind == "replace":
        for _ in range(rng.randrange(1, 4)):
            x[rng.randrange(len(x))] = rng.choice(filler)
    elif kind == "delete":
        for _ in range(rng.randrange(1, 4)):
            del x[rng.randrange(len(x))]
    else:
        keep = int(len(x) * rng.uniform(0.75, 1))
        at = rng.randrange(len(x) - keep + 1)
        x = x[at : at + keep]
    return x


@pytest.mark.parametrize("kind", ["insert", "replace", "delete", "cut", "bare"])
def test_recall_of_edited_items(kind):
    rng = random.Random(kind)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    filler = " ".join(t for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:200] if t).split()
    pad = lambda: [rng.choice(filler) for _ in range(rng.randrange(40))]
    index = decontaminate.Index(items)
    texts = []
    for i, t in items * 3:
        if len(t.split()) >= 8:
            x = edited(t.split(), kind, rng, filler)
            texts.append((i, t, " ".join(x if kind == "bare" else pad() + x + pad())))
    found = index.matches(pa.array([x for _, _, x in texts], pa.large_string()))
    held = [(i in m, brute.held_share(t, x)) for (i, t, x), m in zip(texts, found)]
    assert not [h for h in held if h[0] and h[1] < 0.75]  # nothing that the exact version does not hold
    true = [got for got, share in held if share >= 0.75]
    assert len(true) >= 30 and sum(true) / len(true) >= 0.98
