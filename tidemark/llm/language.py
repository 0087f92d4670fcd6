"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, a logistic regression on hashed byte n-grams,
predicts its bit; decoding takes the codeword with the least total logistic loss over all bits. The classifiers share one
feature vector, so a text is read once whatever the number of bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER_BYTE, in_batches, lean, lean_groups, mixed, slices

DIMENSION = 1 << 13
SAMPLE = 4000  # labelled texts a model is fitted on at most, spread evenly over the languages
EPOCHS = 60
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """A (k, bits) matrix of -1 and 1 whose rows differ in many places.

    Up to seven classes get the exhaustive code (every split into two non-empty halves once), more get the random
    code, of several hundred drawn, with the largest least distance.
    """
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        splits = np.arange(1, 2 ** (k - 1))
        return np.where((splits[None, :] >> np.arange(k)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(8)
    bits = int(np.ceil(10 * np.log2(k)))
    draws = (np.where(rng.random((k, bits)) < 0.5, -1.0, 1.0) for _ in range(300))
    return max(draws, key=lambda c: -(c @ c.T - 2 * bits * np.eye(k)).max())


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed counts of the byte 1- to 4-grams of each text (ASCII case folded), square-rooted, of unit length."""
    docs = len(offsets) - 1
    base = np.repeat(np.arange(docs, dtype=np.int64) * DIMENSION, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the end of the text
    out = np.zeros(docs * DIMENSION, np.float32)
    h = np.zeros(len(data), np.uint64)
    letters = LOWER_BYTE[data]
    for n in range(1, 5):
        part = h[: len(data) - n + 1] if len(data) >= n else h[:0]
        part *= np.uint64(0x100000001B3)
        part += letters[n - 1 :] if n > 1 else letters
        h = part
        ok = left[: len(part)] >= n
        at = base[: len(part)][ok] + (mixed(part[ok] + np.uint64(n)) % np.uint64(DIMENSION)).astype(np.int64)
        out += np.bincount(at, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(docs, DIMENSION))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1)


def _blocks(column):
    """(first row, feature matrix) of successive blocks of at most 256 texts."""
    for lo, hi, data, offsets in slices(column):
        for a in range(0, hi - lo, 256):
            o = offsets[a : a + 257]
            yield lo + a, _features(data[o[0] : o[-1]], o - o[0])


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """(languages, weights of every bit with its intercept) from a sample of at most ``SAMPLE`` labelled texts.

    The sample takes equally many texts of each language (all, where there are fewer) by a hash of text and id. One
    task fits the model on it, so its input does not grow with the corpus; only weights come back.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1, DIMENSION + 1))
    each = max(1, SAMPLE // len(langs))
    order = F.xxhash64(F.col(text_col), F.col(id_col))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * each / n + 20 / n))])
    near = labelled.filter(F.pmod(order, F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000)
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy(order, id_col))
    sample = near.withColumn("__place", place).filter(F.col("__place") <= each)
    code = codewords(len(langs))

    @lean_groups
    def run(key, table):
        table = table.sort_by([("lang", "ascending"), ("text", "ascending")])
        x = np.concatenate([x for _, x in _blocks(table.column("text"))])
        y = code[np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist()))].astype(np.float32)
        w = np.zeros((DIMENSION, code.shape[1]), np.float32)
        b = np.zeros(code.shape[1], np.float32)
        speed = np.zeros_like(w)
        for _ in range(EPOCHS):  # gradient steps with momentum on the logistic loss of all bits at once
            pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
            speed = 0.9 * speed - 20 * (x.T @ pull + 1e-5 * w)
            w = w + speed
            b = b - 2 * pull.sum(axis=0)
        return pa.table({"w": pa.array([np.vstack([w, b]).T.astype(np.float32).tobytes()], pa.binary())})

    rows = sample.select(F.lit(0).alias("g"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = rows.groupBy("g").applyInArrow(run, "w binary").first().w
    return langs, np.frombuffer(got, np.float32).reshape(code.shape[1], -1)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
               margin: float = 0.02) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, in place of columns of these names.

    score: the softmax share of the nearest codeword; ambiguous: its lead over the next is below ``margin`` of the
    loss, or nothing could be predicted. Null texts, texts without a letter and any text when no language was learned
    get ``und`` with score 0. The columns of ``docs`` are never inputs, apart from the text.
    """
    langs, weights = model
    code = codewords(len(langs))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    rows = docs.select(*keep, F.when(letter, F.col(text_col).cast("string")).alias("__text"))

    @lean
    def run(batches):
        for batch in batches:
            pred, score, vague = [], [], []
            column = batch.column(batch.num_columns - 1)
            known = np.array(column.is_valid()) if langs else np.zeros(len(column), bool)
            for at, x in _blocks(column):
                out = x @ weights[:, :-1].T + weights[:, -1]
                loss = np.stack([np.logaddexp(0, -out * c).sum(axis=1) for c in code]) if langs else np.zeros((1, len(x)))
                best = loss.argmin(axis=0)
                share = np.exp(loss.min(axis=0) - loss)
                share /= share.sum(axis=0)
                least = np.sort(loss, axis=0)[:2]
                lead = (least[-1] - least[0]) / np.maximum(least[-1], 1e-9) if len(langs) > 1 else np.ones(len(x))
                for j, ok in enumerate(known[at : at + len(x)]):
                    pred.append(langs[best[j]] if ok else UNKNOWN)
                    score.append(float(share[best[j], j]) if ok else 0.0)
                    vague.append(bool(not ok or lead[j] < margin))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())],
                names=[*keep, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return in_batches(rows).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The documents no model learns from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with predictions by a model learned from its documents that are not held out and carry a language.

    Rows without an id are neither learned from nor held out. Repeated rows are predicted one by one. An empty table
    gives an empty one.
    """
    usable = F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    return identified(docs, fit(docs.filter(usable), id_col, text_col, lang_col), text_col)
