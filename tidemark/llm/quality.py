"""Quality by ordinal regression: a cumulative-link model on hashed text features.

One weight vector gives every text a score s; ordered thresholds t_1 < t_2 < ... turn it into grades:
P(grade >= j) = 1 / (1 + exp(t_j - s)). All grades share the weights, so a text graded between two others teaches both
thresholds. The expected grade and the probability of the best grades serve selection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER_BYTE, in_batches, lean, lean_groups, mixed, slices, word_hashes
from .decontaminate import _words

DIMENSION = 1 << 16
SAMPLE = 6000  # rated texts a model is fitted on at most, spread evenly over the grades
STEPS = 400


def _features(data: np.ndarray, offsets: np.ndarray):
    """(text, feature, value) triples: words with and without punctuation, and byte 3-grams, hashed; square roots of
    counts, of unit length per text."""
    parts = []
    for k, (h, first) in enumerate((word_hashes(data, offsets), _words(data, offsets)[::2])):
        parts.append((np.repeat(np.arange(len(offsets) - 1), np.diff(first)), mixed(h + np.uint64(k)) % np.uint64(DIMENSION // 2)))
    if len(data) > 2:
        letters = LOWER_BYTE[data]
        gram = mixed((letters[:-2] * np.uint64(3) + letters[1:-1]) * np.uint64(0x100000001B3) + letters[2:])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = text[:-2] == text[2:]
        parts.append((text[:-2][inside], gram[inside] % np.uint64(DIMENSION // 2) + np.uint64(DIMENSION // 2)))
    text = np.concatenate([p[0] for p in parts])
    feature = np.concatenate([p[1] for p in parts]).astype(np.int64)
    both, count = np.unique(text * DIMENSION + feature, return_counts=True)
    text, feature = both // DIMENSION, both % DIMENSION
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(text, value * value, len(offsets) - 1))
    return text, feature, value / norm[text]


def _scores(column, weights: np.ndarray) -> np.ndarray:
    out = []
    for lo, hi, data, offsets in slices(column, 1 << 19):
        text, feature, value = _features(data, offsets)
        out.append(np.bincount(text, value * weights[feature], hi - lo))
    return np.concatenate(out) if out else np.zeros(0)


def _fit(text, feature, value, grade: np.ndarray, grades: int, rated: np.ndarray):
    """Weights and thresholds, by gradient steps with momentum on the weighted negative log-likelihood.

    rated: how many texts have each grade. A grade weighs the square root of that, between its share of the ratings and
    an equal share, however many of its texts the sample holds.
    """
    n = len(grade)
    size = np.bincount(grade, minlength=grades)
    share = (np.sqrt(rated) / np.maximum(size, 1))[grade]
    share /= share.sum()
    w, speed = np.zeros(DIMENSION), np.zeros(DIMENSION)
    t = np.arange(grades - 1) - (grades - 2) / 2.0
    for _ in range(STEPS):
        s = np.bincount(text, value * w[feature], n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        high = 1 / (1 + np.exp(np.clip(s - edge[grade + 1], -40, 40)))
        low = 1 / (1 + np.exp(np.clip(s - edge[grade], -40, 40)))
        p = np.maximum(high - low, 1e-9)
        pull = share * (1 - high - low)
        speed = 0.9 * speed - 6 * (np.bincount(feature, value * pull[text], DIMENSION) + 2e-5 * w)
        w += speed
        up, down = share * high * (1 - high) / p, share * low * (1 - low) / p
        for j in range(grades - 1):
            t[j] -= 1.0 * (down[grade == j + 1].sum() - up[grade == j].sum())
        t = np.maximum.accumulate(t + np.arange(grades - 1) * 1e-6)
    return w, t


def _texts_of(chosen: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grade, text) of the ``chosen`` ids, SAMPLE at most: they travel to the texts, and no other text is shuffled."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "id")


def fit(rated: DataFrame, docs: DataFrame, id_col: str, text_col: str, grade_col: str, grades: int):
    """(weights, thresholds) from at most ``SAMPLE`` rated texts.

    The ids to learn from are drawn from the ratings by hash, equally many of each grade where there are enough; only
    then are they sent to the texts. One task fits the model on them, so its input does not grow with the corpus.
    """
    ids = rated.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter(
        f"id IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}").groupBy("id").agg(F.min("grade").alias("grade"))
    sizes = {r[0]: r[1] for r in ids.groupBy("grade").count().collect()}  # a row a grade
    if not sizes:
        return np.zeros(DIMENSION), np.arange(grades - 1) - (grades - 2) / 2.0
    rated_n = np.array([float(sizes.get(g, 0)) for g in range(grades)])
    each = max(1, SAMPLE // len(sizes))
    order = F.xxhash64("id")
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 1.3 * each / n + 20 / n))])
    near = ids.filter(F.pmod(order, F.lit(1_000_000)) < share[F.col("grade")] * 1_000_000)
    place = F.row_number().over(Window.partitionBy("grade").orderBy(order))
    chosen = near.withColumn("place", place).filter(F.col("place") <= each).drop("place")
    texts = _texts_of(chosen, docs, id_col, text_col)

    @lean_groups
    def run(key, table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        n, parts = 0, []
        for lo, hi, data, offsets in slices(table.column("text")):
            text, feature, value = _features(data, offsets)
            parts.append((text + lo, feature, value))
        w, t = _fit(*(np.concatenate(x) for x in zip(*parts)), np.array(table.column("grade").to_pylist()), grades, rated_n)
        return pa.table({"w": pa.array([np.concatenate([w, t]).tobytes()], pa.binary())})

    row = texts.select(F.lit(0).alias("g"), "id", "text", "grade").groupBy("g").applyInArrow(run, "w binary").first()
    if row is None:
        return np.zeros(DIMENSION), np.arange(grades - 1) - (grades - 2) / 2.0
    both = np.frombuffer(row.w)
    return both[:DIMENSION], both[DIMENSION:]


def graded(docs: DataFrame, model, text_col: str = "text", best: int | None = None) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to the top grade) and ``tail_prob``, P(grade >= ``best``), the top by default.

    Columns of these names are replaced, the others kept. A null or empty text has no features, so its grade is what
    the thresholds alone say. Repeated rows are graded one by one; an empty table gives an empty one.
    """
    weights, t = model
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail_prob")]
    top = len(t) if best is None else best

    @lean
    def run(batches):
        for batch in batches:
            s = _scores(batch.column(batch.num_columns - 1), weights)
            above = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(above.sum(axis=1)), pa.array(above[:, top - 1])],
                                             names=[*keep, "expected_grade", "tail_prob"])

    rows = in_batches(docs.select(*keep, F.col(text_col).cast("string").alias("__text")))
    return rows.mapInArrow(run, docs.select(*keep).schema.add("expected_grade", "double").add("tail_prob", "double"))
