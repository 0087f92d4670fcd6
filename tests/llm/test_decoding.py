"""Loss-weighted decoding of language codewords, written out in plain Python."""

import math

import numpy as np
import pyarrow as pa

from tidemark.llm import language

TEXTS = ["the quick brown fox", "der schnelle Fuchs läuft", "le renard brun", "x", "çé", "the der le " * 400, None, "", "12345 ..", "Ünïcödé 日本"]


def plain(x, langs, weights, margin=0.02):
    """(language, score, ambiguous) of one feature vector."""
    code = language.codewords(len(langs))
    out = [sum(float(a) * float(b) for a, b in zip(x, row[:-1])) + float(row[-1]) for row in weights]
    loss = [sum(math.log1p(math.exp(-o * float(c))) for o, c in zip(out, word)) for word in code]
    order = sorted(range(len(langs)), key=lambda k: (loss[k], k))
    share = 1 / sum(math.exp(loss[order[0]] - v) for v in loss)
    return langs[order[0]], share, (loss[order[1]] - loss[order[0]]) / loss[order[1]] < margin


def test_decoding_equals_plain_version(spark):
    langs = ["de", "en", "fr", "it", "nl"]
    rng = np.random.default_rng(2)
    bits = language.codewords(len(langs)).shape[1]
    weights = rng.normal(size=(bits, language.DIMENSION + 1)).astype(np.float32)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identified(df, (langs, weights)).collect()}
    features = {at + k: row for at, m in language._blocks(pa.array([t or "" for t in TEXTS])) for k, row in enumerate(np.asarray(m))}
    for i, t in enumerate(TEXTS):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, True)
            continue
        lang, share, vague = plain(features[i], langs, weights)
        assert got[i].lang_pred == lang and abs(got[i].score - share) < 1e-4 and got[i].ambiguous == vague


def test_a_text_between_languages_is_ambiguous(spark):
    """A model that tells nothing apart must not decide."""
    langs = ["de", "en", "fr"]
    flat = np.zeros((language.codewords(3).shape[1], language.DIMENSION + 1), np.float32)
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = language.identified(df, (langs, flat)).first()
    assert r.ambiguous and abs(r.score - 1 / 3) < 1e-6
