"""Whitening, centroid clustering and chat formatting against plain versions, SQL and round trips."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from compare import connect, diff  # noqa: E402

from tidemark.llm import catalog, centroids, chat, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_chat_formatting"])
def test_query_equals_sql(spark, name):
    assert diff(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLES[name]) is None


# -- 11: whitening


def integers(vectors):
    return np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000


def check_whitening(got, ids, x, k=8):
    """``got`` rows (sorted by id and component) against numpy; the sign of a component is free."""
    n, d = x.shape
    sums = [int(s) for s in x.sum(0)]
    mean = np.array([s / n for s in sums])
    cov = np.cov((x - 100_000).T.astype(float), bias=True).reshape(d, d)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == n * min(k, d)
    z = np.array([r.whitened for r in got], float).reshape(n, -1)
    assert sorted(ids) == [r.vec_id for r in got][:: min(k, d)]
    order = np.argsort(ids, kind="stable")
    want = ((x[order] - mean) @ u) / np.sqrt(e)
    gaps = np.abs(np.diff(np.concatenate([[np.inf], e, [0]]))) / e[0]
    for j in range(z.shape[1]):
        if min(gaps[j], gaps[j + 1] if j + 1 < len(e) else 1) > 1e-6:
            sign = np.sign((z[:, j] * want[:, j]).sum())
            assert np.allclose(sign * z[:, j], want[:, j], atol=1e-7)
        assert abs(got[j].explained - e[j] / np.trace(cov)) <= 1e-9
    for i, row in zip(range(0, len(got), z.shape[1]), x[order]):
        assert got[i].deviation == sum((n * int(a) - s) ** 2 for a, s in zip(row, sums))
        assert got[i].n == n and [r.component for r in got[i : i + z.shape[1]]] == list(range(1, z.shape[1] + 1))
    assert np.abs(np.cov(z.T, bias=True).reshape(z.shape[1], -1) - np.eye(z.shape[1])).max() < 1e-9
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = catalog.QUERIES["op11_embedding_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    check_whitening(got, [r.vec_id for r in table], integers([r.embedding for r in table]))


def test_whitening_edge_cases(spark):
    rng = random.Random(3)
    sound = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(40)]
    sound += [(7, sound[7][1]), (7, [9.0, 1.0, 2.0, 3.0, 1e3]), (41, [0.0] * 5)]  # a repeated row, a repeated id
    odd = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [NAN] * 5), (54, [INF] * 5), (55, [1.0, 2.0]), (56, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in sound + odd], "vec_id long, embedding array<double>, x int, ids string, id string")
    got = whitening.whiten(df).orderBy("vec_id", "component", "deviation").collect()
    ids = [i for i, _ in sound]
    plain = [r for r in got if r.vec_id != 7]
    x = integers([v for _, v in sound])
    assert len(got) == 43 * 5 and {r.vec_id for r in got} == set(ids)
    n, sums = 43, [int(s) for s in x.sum(0)]
    want = {sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x}
    assert {r.deviation for r in got} == want and len(plain) == 40 * 5
    check_whitening(whitening.whiten(df.filter("vec_id <> 7")).orderBy("vec_id", "component").collect(),
                    [i for i in ids if i != 7], integers([v for i, v in sound if i != 7]))
    nulls = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>"))
    assert nulls.filter("vec_id IS NULL").count() == 4
    assert whitening.whiten(df.filter("false")).count() == 0 and whitening.whiten(df.filter("vec_id >= 53 AND vec_id < 55")).count() == 0


def test_whitening_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 9 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in one)
    line = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).orderBy("vec_id", "component").collect()
    assert [round(r.explained, 12) for r in got[:3]] == [1.0, 0.0, 0.0] and [r.whitened is None for r in got[:3]] == [False, True, True]
    assert got[0].identity_error < 1e-9


class Dense:
    def __init__(self, a):
        self.a = a

    def __matmul__(self, b):
        return self.a @ b


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 300), 1 / np.arange(1, 65.0) ** 2, np.ones(40), np.r_[[3.0] * 5, np.linspace(1, 2, 95)], np.r_[5.0, np.zeros(20)],
    np.zeros(6), np.r_[2.0], np.arange(1, 4.0), 1e-30 * np.arange(1, 30.0), np.exp(-np.arange(200) / 8.0)], ids=range(10))
def test_solver_reaches_double_precision(values):
    rng, d = np.random.default_rng(0), len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, u = whitening.leading_pairs(Dense(a), d, 8)
    want = np.sort(values)[::-1][:8]
    assert len(e) == min(8, d) and np.allclose(e, want, rtol=0, atol=1e-13 * max(want[0], 1e-300))
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
    assert np.abs(a @ u - u * e).max() <= 1e-13 * want[0]


def test_solver_recovers_after_full_subspaces():
    """More dimensions than the subspace may have, and close eigenvalues: it has to restart."""
    values = np.r_[1 + 1e-4 * np.arange(10.0), np.linspace(0.5, 0.99, 290)]
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(300, 300)))[0]
    a = (q * values) @ q.T
    e, u = whitening.leading_pairs(Dense((a + a.T) / 2), 300, 8, basis=40)
    assert np.allclose(e, 1 + 1e-4 * np.arange(9, 1, -1.0), atol=1e-12)


def test_deviation_beyond_63_bits():
    x = np.array([[1 << 40, 0], [3, 4], [-5, 6]], np.int64)
    n, sums = 3, [int(s) for s in x.sum(0)]
    got = whitening.deviations(x, n, sums)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert got == [w if w < 2**63 else None for w in want] and None in got


# -- 12: clustering


def brute_clusters(rows, k, rounds):
    """The contract, in plain Python: rows of (vec_id, integers)."""
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    cents = [list(v) for _, v in start]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((away(v, c), j) for j, c in enumerate(cents)) for _, v in rows]
    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(rows, at) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    total = {j: sum(d for d, c in at if c == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(rows, at)), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("k", [1, 5, 200])
def test_clusters_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.5, 0.999]) for _ in range(4)]) for i in range(90)]
    rows += [(7, rows[7][1]), (7, [0.1] * 4), (None, [0.2] * 4), (None, rows[3][1])] + [(500 + i, [0.25, -0.25, 0.5, 1.0]) for i in range(60)]
    bad = [(91, None), (92, []), (93, [1.0] * 3), (94, [1.0] * 5), (95, [1.0, None, 1.0, 1.0]), (96, [NAN] * 4), (97, [INF] * 4), (98, [1e300] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, "z") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, v int, distance string")
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in centroids.clustered(df, dims=4, k=k).select(*COLUMNS).collect()), key=repr)
    assert got == brute_clusters(whole, k, 5)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<float>")
    assert centroids.clustered(df).count() == 0 and centroids.clustered(df.filter("false")).columns == list(COLUMNS)
    unnamed = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert centroids.clustered(unnamed).count() == 0


# -- 13: chat formatting

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\/INST]", "<", "[", "\\", "/s>", "INST]", "s>", "[[INST]", "</s", "é日😀", "\n", "", "$1", " ok "]


def told(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def brute_chat(rows):
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    out = []
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), told(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(CONTROLS) for _ in range(rng.randrange(12))) for _ in range(600)] + CONTROLS
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.restored(F.col("e")).alias("b")).collect():
        assert back == t and not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tidemark.plans.pieces.PIECE_ROWS", 50)
    monkeypatch.setattr(chat, "CHUNK", 16)
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(6)))
    roles = ["user", "assistant", "system", None, "assistant", "a</s>b[/INST]", ""]
    rows = [(c, k, rng.choice(roles), rng.choice([None, noise(), noise()])) for c in range(12) for k in range(rng.randrange(1, 9))]
    rows += [(99, rng.randrange(100), rng.choice(roles), noise()) for _ in range(400)]  # a long conversation, with ties of turn
    rows += [(50, 0, "assistant", None)] * 3 + [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (51, None, "assistant", "late"), (51, 0, None, None)]
    rows += [(52, None, None, None), (53, 0, "assistant", "long " * 200_000 + "</s>")]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "conv_id long, turn long, role string, text string, c string, k int")
    got = chat.digests(df)
    plain = sorted((tuple(r)[:5] for r in got.collect()), key=repr)
    assert plain == brute_chat(rows)
    output = chat.formatted(chat.canonical_turns(df)).filter("conv_id = 99").first()
    data = output.formatted.encode()
    assert len(data.decode()) == {r.conv_id: r.formatted_chars for r in got.collect()}[99]
    spans = [data[s.start : s.start + s.length].decode() for s in output.loss_spans]
    assert len(spans) == sum(r[2] == "assistant" for r in rows if r[0] == 99) and not any("</s>" in s for s in spans)
    assert chat.digests(df.filter("false")).count() == 0


def test_layouts_are_told_by_their_paths(spark):
    schema = ("conv_id long, turn long, role string, text string, prompt string, completion string, response string, instruction string, "
              "input string, output string, system string, messages array<struct<role:string,content:string>>, "
              "conversations array<struct<`from`:string,value:string>>, score double")
    names = [c.strip().split(" ")[0] for c in schema.replace("struct<role:string,content:string>", "x").replace("struct<`from`:string,value:string>", "x").split(",")]

    def row(i, **has):
        return tuple(i if n == "conv_id" else has.get(n) for n in names)

    rows = [
        row(1, turn=0, role="user", text="a", score=0.5), row(1, turn=1, role="assistant", text="b"),
        row(2, prompt="p", completion="c"), row(3, prompt="p", response="r", system="be kind"),
        row(4, instruction="do", input="this", output="done"), row(5, instruction="do", output="done"),
        row(6, messages=[("user", "u"), ("assistant", None)], system="s"), row(7, conversations=[("human", "h"), ("gpt", "g"), ("tool", "t")]),
        row(8, prompt="p", instruction="neither"), row(9, messages=[]), row(10, prompt="only asked"),
    ]
    df = spark.createDataFrame(rows, schema)
    turns = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn", "i").collect():
        turns.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert turns[1] == [("turns", "user", "a"), ("turns", "assistant", "b")]
    assert turns[2] == [("prompt", "user", "p"), ("prompt", "assistant", "c")]
    assert turns[3] == [("response", "system", "be kind"), ("response", "user", "p"), ("response", "assistant", "r")]
    assert turns[4] == [("instruction", "user", "do\n\nthis"), ("instruction", "assistant", "done")]
    assert turns[5] == [("instruction", "user", "do"), ("instruction", "assistant", "done")]
    assert turns[6] == [("messages", "system", "s"), ("messages", "user", "u"), ("messages", "assistant", "")]
    assert turns[7] == [("conversations", "user", "h"), ("conversations", "assistant", "g"), ("conversations", "tool", "t")]
    assert turns[8] == [(None, None, None)] and turns[9] == [(None, None, None)]
    assert turns[10] == [("prompt", "user", "only asked"), ("prompt", "assistant", "")]
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[4].turns_sha256 == told([("user", "do\n\nthis"), ("assistant", "done")]) and 8 not in got and got[7].loss_chars == 1


def test_chat_runs_without_python(spark):
    plan = catalog.QUERIES["op13_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
