"""Whitening of vectors by their leading principal components: a matrix-free block Jacobi-Davidson solver.

The covariance is never formed. A product with it is one Spark job: every task multiplies its centred rows with a block
of a few directions and sends the sums (dimensions x block numbers), which Spark adds up. The driver holds only
vectors of the dimension's length.

One step of the solver: Rayleigh-Ritz on the subspace gives the current eigenpairs; pairs whose residual has reached
double precision are locked, leading ones first; for the others the correction equation

    (I - Q Q') (V - theta I) (I - Q Q') t = -r,      Q: locked and current vectors

is solved by a few steps of MINRES. All corrections of a step are solved side by side, so an inner step is one product
whatever their number. The corrections, made orthogonal, extend the subspace; when it is full it restarts from its best
vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle
from .arrays import lean

LARGEST = float(1 << 43)  # entries below this are exact when scaled by 1024
BLOCK_BYTES = 1 << 20
GUARD = 4  # pairs beyond those wanted that are carried along, so that none is passed over
EPS = np.finfo(float).eps
TOLERANCE = 32 * EPS  # of a residual, against the largest eigenvalue
STALLED = 4096 * EPS  # where rounding in the products leaves more than that, residuals that fall no further may be this large


@dataclass
class Whitening:
    """A fitted model. ``sums`` are exact; ``vectors`` has a unit column per component."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    products: int

    @property
    def variances(self) -> np.ndarray:
        """Eigenvalues, 0 where they cannot be told from rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return np.where(self.values > least, self.values, 0.0)


# -- rows in blocks


def _sound(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the integer vectors of rows whose vector is not null and holds numbers only."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    whole = F.transform(x, lambda e: F.floor(e * scale).cast("long") + F.lit(shift).cast("long"))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_col).alias("id"), whole.alias("x"))


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """(ids, x): blocks of up to about BLOCK_BYTES; x holds the vectors of a block as 64-bit integers."""
    most = max(1, BLOCK_BYTES // (8 * d))
    id_type = pa.int64()

    @lean
    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for lo in range(0, len(flat), most):
                part = np.ascontiguousarray(flat[lo : lo + most])
                ids = pa.array([batch.column(0)[lo : lo + most].cast(id_type).to_pylist()], pa.list_(id_type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([part.tobytes()], pa.binary())], names=["ids", "x"])

    return rows.mapInArrow(run, "ids array<long>, x binary")


def _summed(blocks: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """The sum over all rows of ``part(rows)``, which has ``size`` numbers: added up in each task, then by Spark."""
    whole = kind == "decimal(38,0)"

    @lean
    def run(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = part(np.frombuffer(x.as_py(), np.int64))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array([str(v) for v in total] if whole else total)], names=["i", "v"])

    sums = blocks.select("x").mapInArrow(run, f"i long, v {'string' if whole else kind}")
    got = sums.groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()  # one row a number
    out = [0] * size
    for r in got:
        out[r.i] = r.v
    return out


class Covariance:
    """Products with the covariance of the rows of ``blocks``, each one job."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.d, self.products = blocks, n, len(sums), 0
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s - n * (s // n)) / n for s in sums])  # the mean is base + rest, to full precision

    def centred(self, flat: np.ndarray) -> np.ndarray:
        return (flat.reshape(-1, self.d) - self.base).astype(float) - self.rest

    def trace(self) -> float:
        centred = _centring(self)
        return sum(_summed(self.blocks, self.d, lambda flat: np.square(centred(flat)).sum(0), "double")) / self.n

    def __matmul__(self, b: np.ndarray) -> np.ndarray:
        self.products += 1
        centred, k = _centring(self), b.shape[1]

        def part(flat):
            x = centred(flat)
            return (x.T @ (x @ b)).ravel()

        return np.array(_summed(self.blocks, self.d * k, part, "double")).reshape(self.d, k) / self.n


def _centring(v: Covariance) -> Callable[[np.ndarray], np.ndarray]:
    """The centring of ``v`` without its table, which tasks must not carry."""
    d, base, rest = v.d, v.base, v.rest
    return lambda flat: (flat.reshape(-1, d) - base).astype(float) - rest


# -- the solver


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the (orthonormal) columns of ``against``."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more for what rounding left
        for q in against:
            new = new - q @ (q.T @ new)
    q, r = np.linalg.qr(new)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    for a in against:
        q = q - a @ (a.T @ q)
    return np.linalg.qr(q)[0]


def _minres(v, theta: np.ndarray, q: np.ndarray, rhs: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Approximate solutions t of P (v - theta I) P t = rhs, P = I - q q', a column for each theta.

    The columns run side by side; one whose residual has fallen by ``drop`` stands still.
    """
    clean = lambda a: a - q @ (q.T @ a)
    rhs = clean(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    t, live = np.zeros_like(rhs), beta > 0
    goal, phi = beta * drop, beta.copy()
    old, now = np.zeros_like(rhs), np.where(live, rhs / np.where(live, beta, 1), 0)
    w0, w1 = np.zeros_like(rhs), np.zeros_like(rhs)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        a = now[:, at]
        y = clean(v @ a - a * theta[at])
        alpha = (a * y).sum(0)
        y = clean(y - a * alpha - old[:, at] * last[at])
        nxt = np.linalg.norm(y, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before and by a new one
        eps, delta = s0[at] * last[at], c0[at] * last[at]
        diag, delta = c1[at] * alpha - s1[at] * delta, s1[at] * alpha + c1[at] * delta
        rho = np.hypot(diag, nxt)
        ok = rho > 0
        safe = np.where(ok, rho, 1)
        c, s = np.where(ok, diag / safe, 1), np.where(ok, nxt / safe, 0)
        w = (a - w1[:, at] * delta - w0[:, at] * eps) / safe
        t[:, at] += np.where(ok, w * (c * phi[at]), 0)
        phi[at] = -s * phi[at]
        w0[:, at], w1[:, at] = w1[:, at], w
        c0[at], c1[at], s0[at], s1[at] = c1[at], c, s1[at], s
        old[:, at], now[:, at], last[at] = a, y / np.where(nxt > 0, nxt, 1), nxt
        live[at] = ok & (nxt > 1e-14 * np.abs(alpha)) & (np.abs(phi[at]) > goal[at])
    return clean(t)


def leading_pairs(v, d: int, k: int, basis: int = 64, inner: int = 3, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of the symmetric ``v``, known by its products ``v @ block``.

    Ends when every residual is at most TOLERANCE times the largest eigenvalue, or at most STALLED times it and has not
    halved in three steps; raises if neither comes within ``steps`` steps.
    """
    k, wide = min(k, d), min(k + GUARD, d)
    basis = min(d, max(basis, 3 * wide))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(1).normal(size=(d, wide)))
    image = v @ space
    least, idle = np.inf, 0
    for step in range(steps):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, vu = space @ s, image @ s
        top = max(values.max(initial=0.0), theta.max(initial=0.0), np.finfo(float).tiny)
        left = k - len(values)
        wanted = min(left + GUARD, u.shape[1])
        r = vu[:, :wanted] - u[:, :wanted] * theta[:wanted]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        whole = locked.shape[1] + space.shape[1] == d
        idle = idle + 1 if size[0] > least / 2 else 0
        least = min(least, size[0]) if idle else size[0]
        enough = (STALLED if idle >= 3 else TOLERANCE) * top
        done = 0
        while done < left and size[done] <= enough:
            done += 1
        if done:
            least, idle = np.inf, 0
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.concatenate([values, theta[:done]])
            u, vu, theta, r, size = u[:, done:], vu[:, done:], theta[done:], r[:, done:], size[done:]
            if len(values) == k:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            space, image = u, vu
        if space.shape[1] + r.shape[1] > basis - locked.shape[1] and not whole:  # restart from the best vectors
            keep = min(u.shape[1], max(2 * (k - len(values)) + GUARD, 1))
            space = _orthonormal(u[:, :keep], locked)
            image = v @ space  # anew: rounding has gathered in the old one
        if whole:  # the space cannot grow: its image is made anew, from vectors freed of rounding
            space = _orthonormal(u, locked)
            image = v @ space
            continue
        open_ = size > TOLERANCE * top
        q = np.hstack([locked, u[:, : r.shape[1]]])
        t = _minres(v, theta[: r.shape[1]][open_], q, -r[:, open_], inner, 2.0 ** -(step + 2))
        t = np.where(np.linalg.norm(t, axis=0) > 0, t, r[:, open_])
        new = _orthonormal(t, locked, space)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(step + 2).normal(size=(d, 1)), locked, space)
        space, image = np.hstack([space, new]), np.hstack([image, v @ new])
    raise ArithmeticError(f"no convergence: residuals {size}")


# -- the operator


def prepare(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
            shift: int = 100_000) -> tuple[DataFrame, int]:
    """The integer rows of ``vectors`` in settled blocks, and their dimension (0: there are none)."""
    rows = _sound(vectors, id_col, vec_col, scale, shift)
    # the dimension is that of most rows; of two as frequent the larger
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None, 0
    return settle(_packed(rows.filter(F.size("x") == sizes.d), sizes.d)), sizes.d


def fit(blocks: DataFrame, d: int, components: int = 8) -> Whitening:
    """Mean and leading components of the rows of ``blocks`` (see ``prepare``)."""
    n = blocks.agg(F.sum(F.size("ids"))).first()[0]
    exact = lambda flat: np.array([int(x) for x in flat.reshape(-1, d).sum(0)], object)
    sums = [int(s) for s in _summed(blocks, d, exact, "decimal(38,0)")]
    v = Covariance(blocks, n, sums)
    values, u = leading_pairs(v, d, components)
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, u, v.trace(), v.products)


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """Integer rows to their whitened components; those without variance get 0."""
    v = Covariance(None, model.n, model.sums)
    centred, e = _centring(v), model.variances
    to = model.vectors * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0)
    return lambda flat: centred(flat) @ to


def identity_error(blocks: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    project, on = _projection(model), np.flatnonzero(model.variances > 0)
    k, n = len(on), model.n
    if not k:
        return None
    mean = np.array(_summed(blocks, k, lambda flat: project(flat)[:, on].sum(0), "double")) / n

    def part(flat):
        z = project(flat)[:, on] - mean
        return (z.T @ z).ravel()

    cov = np.array(_summed(blocks, k * k, part, "double")).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2 of each row, exact; null where it needs more than 63 bits."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    y = x - base  # n x - sum = n y - rest
    far = np.abs(y).max(1, initial=0).astype(float) * n + n
    if (far.max(initial=0.0) ** 2) * x.shape[1] < 2.0**62:
        z = y * n - rest
        return (z * z).sum(1).tolist()
    out = []
    for row in y.tolist():
        total = sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist()))
        out.append(total if total < 2**63 else None)
    return out


def whitened(blocks: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """A row for each vector of ``blocks`` and component of the model."""
    d, k, n, sums = len(model.sums), len(model.values), model.n, model.sums
    project, on = _projection(model), model.variances > 0
    share = [float(e / model.trace) if model.trace > 0 else None for e in model.variances]

    @lean
    def run(batches):
        for batch in batches:
            for ids, block in zip(batch.column(0), batch.column(1)):
                flat = np.frombuffer(block.as_py(), np.int64)
                z, m = project(flat), len(flat) // d
                off = np.tile(~on, m)
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(ids.as_py(), object), k), pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(np.array(deviations(flat.reshape(-1, d), n, sums), object), k), pa.int64()),
                    pa.array(z.ravel(), pa.float64(), mask=off),
                    pa.array(share * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ], names=names)

    return blocks.select("ids", "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8,
           scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Each row's ``components`` leading whitened components, with the fit's quality, a row for each of them.

    An entry c counts as floor(scale * c) + shift. Rows take no part when their vector is null or empty, holds a null, a
    non-finite entry or one of 2^43 or more (which has no exact integer here), or is not as long as most vectors are
    (of lengths as frequent, the longer counts). Ids may be null or repeated: every row counts and is returned. A
    component without variance has ``explained`` 0 and ``whitened`` null, and does not count for ``identity_error``,
    which is null if no component has any; ``explained`` is null if all rows are equal. With fewer dimensions than
    ``components`` there are as many components as dimensions. ``deviation`` is null where it needs more than 63 bits.
    An empty table gives an empty result. Other columns are not read.
    """
    blocks, d = prepare(vectors, id_col, vec_col, scale, shift)
    if not d:
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], kinds)
    model = fit(blocks, d, components)
    return whitened(blocks, model, identity_error(blocks, model))
