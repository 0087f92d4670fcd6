"""The cumulative-link model against its definition, written out in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import quality

GOOD, POOR, BAD = "careful clear useful lesson".split(), "filler meh stuff things".split(), "awful vile hate slur".split()


def sample(rng, n=240):
    rows = []
    for _ in range(n):
        grade = rng.randrange(3)
        own = (BAD, POOR, GOOD)[grade if rng.random() < 0.8 else rng.randrange(3)]
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(3, 9))), grade))
    return rows


def objective(score, grade, t, share, w):
    """The weighted negative log-likelihood of the grades, with the penalty on the weights."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    edge = [-math.inf, *t, math.inf]
    up = lambda e, s: 1.0 if e == math.inf else 0.0 if e == -math.inf else sig(e - s)
    loss = -sum(share[g] * math.log(max(up(edge[g + 1], s) - up(edge[g], s), 1e-12)) for s, g in zip(score, grade))
    return loss + 1e-5 * float((w * w).sum())


def test_fit_is_a_minimum_of_the_likelihood():
    rows = sample(random.Random(4))
    texts = pa.array([t for t, _ in rows], pa.string())
    grade = np.array([g for _, g in rows])
    (lo, hi, data, offsets), = quality.slices(texts)
    text, feature, value = quality._features(data, offsets)
    rated = np.bincount(grade, minlength=3).astype(float)
    w, t = quality._fit(text, feature, value, grade, 3, rated)
    weight = np.sqrt(rated) / rated
    share = weight / weight[grade].sum()
    score = lambda w: np.bincount(text, value * w[feature], len(rows)).tolist()
    at = objective(score(w), grade, t.tolist(), share, w)
    assert t[0] < t[1] and at < 0.75 * objective([0.0] * len(rows), grade, [-0.5, 0.5], share, w * 0)
    for j in range(2):
        for d in (-0.1, 0.1):
            moved = t.copy()
            moved[j] += d
            assert objective(score(w), grade, moved.tolist(), share, w) > at - 1e-3
    for f in np.argsort(-np.bincount(feature, value, quality.DIMENSION))[:6]:
        for d in (-0.2, 0.2):
            moved = w.copy()
            moved[f] += d
            assert objective(score(moved), grade, t.tolist(), share, moved) > at - 1e-3


def test_grades_follow_the_definition(spark):
    rng = np.random.default_rng(3)
    model = (rng.normal(size=quality.DIMENSION), np.array([-0.4, 0.3, 1.1]))
    texts = ["careful lesson", "awful", "Things, things!", "", None, "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = quality._scores(pa.array([t or "" for t in texts], pa.string()), model[0])
    for best in (1, 3):
        got = {r.doc_id: r for r in quality.graded(df, model, best=best).collect()}
        for i in range(len(texts)):
            above = [1 / (1 + math.exp(t - score[i])) for t in model[1]]  # P(grade > j)
            p = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
            assert abs(got[i].expected_grade - sum(g * x for g, x in enumerate(p))) < 1e-9
            assert abs(got[i].tail_prob - sum(p[best:])) < 1e-9
