"""Embedding whitening by Jacobi-Davidson on a matrix-free covariance.

The covariance V of the fit list is never formed: tasks centre their rows, then
multiply, ``Xc.T @ (Xc @ Q) / n``, and only sums of the size of Q come back.
The search starts from a few directions. Rayleigh-Ritz in the subspace gives
the leading pairs; for each pair not yet exact the projected correction
equation ``(I - UU')(V - theta)(I - UU') t = -r`` is solved by a few steps of
MINRES, all of them in step, so one step costs one distributed product; the
solutions enlarge the subspace. A pair whose residual is at double precision is
locked and the rest of the subspace stays orthogonal to it.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, saved

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 8 << 20            # int64 bytes of the rows packed into one matrix
TASK_BYTES = 64 << 20            # packed bytes a task multiplies
INNER_STEPS = 4
BESIDE = 8                       # pairs after the wanted ones that are corrected with them
MAX_OUTER = 500
SEED = 11
_EPS = float(np.finfo(np.float64).eps)
_LONG = 1 << 63


# ------------------------------------------------------------------ rows and blocks
def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry as bigint (saturated beyond it);
    NULL where the vector is NULL or holds a NULL or non-finite entry."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pack(dims: int, batches):
    """Matrices of whole numbers in the narrowest type that holds them."""
    schema = pa.schema([("type", pa.string()), ("cells", pa.binary())])
    rows = max(1, BLOCK_BYTES // (8 * max(dims, 1)))

    def packed(parts):
        x = np.concatenate(parts)
        low, high = int(x.min()), int(x.max())
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())],
                                          schema=schema)

    held, n = [], 0
    for b in batches:
        x = _matrix(b.column("x"), dims)
        for lo in range(0, len(x), rows):
            held.append(x[lo:lo + rows])
            n += len(held[-1])
            if n >= rows:
                yield packed(held)
                held, n = [], 0
    if n:
        yield packed(held)


def _blocks_of(batches, dims: int):
    for b in batches:
        for kind, cells in zip(b.column("type").to_pylist(), b.column("cells").to_pylist()):
            yield np.frombuffer(cells, dtype=kind).reshape(-1, dims)


@dataclass
class FitList:
    """The distinct vectors as saved blocks, their number and per-dimension sums."""
    blocks: DataFrame
    dims: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def summed(self, of_block: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """Sum over all blocks of a function (centred rows -> matrix of
        ``width`` columns). Every task adds up its own; the tasks' sums meet by row."""
        dims, mean = self.dims, self.mean
        names = [f"c{j}" for j in range(width)]

        def run(batches):
            total = None
            for x in _blocks_of(batches, dims):
                part = of_block(x - mean)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))),
                                                  *(pa.array(total[:, j]) for j in range(width))], names=["i", *names])

        rows = (self.blocks.mapInArrow(run, "i bigint, " + ", ".join(f"{c} double" for c in names))
                .groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect())
        out = np.zeros((len(rows), width))
        for r in rows:
            out[r["i"]] = [r[c] for c in names]
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """V @ q, centred before multiplying."""
        return self.summed(lambda xc: xc.T @ (xc @ q), q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda xc: (xc * xc).sum(axis=0)[:, None], 1).sum()) / self.n


def fit_list(vectors: DataFrame, dims: int) -> FitList:
    """Each distinct ``x`` (array<bigint> of ``dims`` entries) of ``vectors``
    once, packed and saved. Equal vectors meet in a partial aggregate first, so
    a vector that a third of all rows hold costs one row a task."""
    spark = vectors.sparkSession
    packed = saved(vectors.select("x").distinct()
                   .mapInArrow(partial(_pack, dims), "type string, cells binary"))

    def sums(batches):
        total, n = np.zeros(dims, dtype=object), 0
        for x in _blocks_of(batches, dims):
            fits = np.abs(x.astype(np.float64)).max(initial=0) * len(x) < _LONG / 4
            total, n = total + (x.sum(axis=0, dtype=np.int64) if fits else x.astype(object).sum(axis=0)), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int64()),
                                          pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    rows = dict(packed.mapInArrow(sums, "i bigint, v string")
                .groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    n = int(rows.get(-1) or 0)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * dims * 8 // TASK_BYTES))
    return FitList(packed.coalesce(tasks), dims, n, [int(rows[i]) for i in range(dims)] if n else [])


# ------------------------------------------------------------------ Jacobi-Davidson
def minres(b: np.ndarray, steps: int, tol: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for ``A x = b`` as a coroutine: yields v, is sent A v, returns x."""
    x, size = np.zeros_like(b), float(np.linalg.norm(b))
    if size == 0:
        return x
    v_before, v, beta = np.zeros_like(b), b / size, 0.0
    d2, d1, rest = np.zeros_like(b), np.zeros_like(b), size
    c1, c, s1, s = 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        p = yield v
        alpha = float(v @ p)
        p = p - alpha * v - beta * v_before
        beta_next = float(np.linalg.norm(p))
        turned = c * alpha - c1 * s * beta
        rho = float(np.hypot(turned, beta_next))
        if rho <= _EPS * (abs(alpha) + beta):
            break
        d = (v - s1 * beta * d2 - (s * alpha + c1 * c * beta) * d1) / rho
        c1, s1, c, s = c, s, turned / rho, beta_next / rho
        x = x + c * rest * d
        rest = -s * rest
        if abs(rest) <= tol * size or beta_next <= _EPS * rho:
            break
        d2, d1, v_before, v, beta = d1, d, v, p / beta_next, beta_next
    return x


def in_step(solvers: list[Generator], product_of: Callable[[np.ndarray, list[int]], np.ndarray]) -> list[np.ndarray]:
    """Run the coroutines together: what they ask for at one time is one product."""
    results: list = [None] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def resume(i, value):
        try:
            asked[i] = solvers[i].send(value)
        except StopIteration as end:
            results[i] = end.value

    for i in range(len(solvers)):
        resume(i, None)
    while asked:
        which, vectors = list(asked), np.column_stack(list(asked.values()))
        asked.clear()
        answers = product_of(vectors, which)
        for j, i in enumerate(which):
            resume(i, answers[:, j])
    return results


def _outside(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The part of v orthogonal to the columns of q (projected twice)."""
    for _ in range(2):
        v = v - q @ (q.T @ v)
    return v


def _joined(basis: np.ndarray, new: list[np.ndarray]) -> list[np.ndarray]:
    """Unit directions of ``new`` outside ``basis`` and each other."""
    out: list[np.ndarray] = []
    for t in new:
        size = np.linalg.norm(t)
        if size > 0 and np.isfinite(size):
            t = _outside(t / size, np.column_stack([basis, *out]) if out else basis)
            rest = np.linalg.norm(t)
            if rest > 1e-10:
                out.append(_outside(t / rest, np.column_stack([basis, *out]) if out else basis))
                out[-1] /= np.linalg.norm(out[-1])
    return out


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int,
                  inner_steps: int = INNER_STEPS, beside: int = BESIDE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of a
    symmetric operator known by its products alone. Some more pairs than asked
    are corrected beside them: a product takes any number of columns at once,
    and close eigenvalues part sooner in a wider subspace."""
    k = min(k, dims)
    rng = np.random.default_rng(seed)
    widest = min(dims, max(16 * k, 32))
    locked = np.zeros((dims, 0))
    basis = np.linalg.qr(rng.standard_normal((dims, min(dims, 2 * k))))[0]
    image = product(basis)
    scale, best, stalled, outer = 0.0, np.inf, 0, 0
    while locked.shape[1] < k:
        outer += 1
        if outer > MAX_OUTER:
            raise ArithmeticError(f"residual {best:.3g} after {MAX_OUTER} steps")
        inner = basis.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, float(np.abs(theta).max()))
        missing = min(k - locked.shape[1], len(theta))
        want = min(missing + beside, len(theta))
        residual = _outside(image[:, :want] - basis[:, :want] * theta[:want], locked)
        size = np.linalg.norm(residual, axis=0)
        exact = 64 * _EPS * np.sqrt(dims) * scale
        stalled = stalled + 1 if size[0] > best / 2 else 0
        best = min(best, float(size[0]))
        # the leading pair is locked at double precision, or where rounding lets it come no closer
        if size[0] <= exact or (stalled >= 4 and size[0] <= 100 * exact):
            lead = max(1, int(np.argmax(np.append(size[:missing] > exact, True))))
            locked = np.column_stack([locked, basis[:, :lead]])
            basis, image = basis[:, lead:], image[:, lead:]
            best, stalled = np.inf, 0
            if locked.shape[1] < k and not basis.shape[1]:
                fresh = _joined(locked, [rng.standard_normal(dims) for _ in range(k)])
                basis = np.column_stack(fresh)
                image = product(basis)
            continue
        if basis.shape[1] + want > widest - locked.shape[1]:
            keep = max(want, min(3 * k, widest - locked.shape[1] - want))
            basis, image = basis[:, :keep], image[:, :keep]
        open_pairs = [i for i in range(want) if size[i] > exact]
        ritz = np.column_stack([locked, basis[:, :want]])

        def corrected(vectors, which):
            inside = _outside(vectors, ritz)
            shifts = np.array([theta[open_pairs[i]] for i in which])
            return _outside(product(inside) - inside * shifts, ritz)

        steps = min(inner_steps, max(1, dims - ritz.shape[1]))
        solved = in_step([minres(-residual[:, i], steps, max(2.0 ** -outer, 1e-3)) for i in open_pairs], corrected)
        new = _joined(np.column_stack([locked, basis]), solved)
        if not new and basis.shape[1] + locked.shape[1] < dims:
            new = _joined(np.column_stack([locked, basis]), [rng.standard_normal(dims)])
        if new:
            new = np.column_stack(new)
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        else:                       # the subspace is everything: refresh the products
            image = product(basis)
    locked = np.linalg.qr(locked)[0]
    inner = locked.T @ product(locked)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (locked @ turn)[:, ::-1]


# ------------------------------------------------------------------------ operator
_OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double")


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained,
    identity_error``: one row per vector and component.

    Rows whose vector is NULL or holds NULL or non-finite entries are dropped.
    Every entry becomes ``floor(scale * c)``; entries beyond bigint are
    saturated. Shorter vectors (an empty one too) count as filled up with zeros
    to the longest length of the table. Equal vectors count once in the fit but
    each row is returned, repeated ids and NULL ids as well. Components without
    variance (all vectors equal, fewer independent directions than asked) are
    not returned. Among equal eigenvalues any basis of their space may come.
    ``deviation`` beyond bigint is NULL. Other columns are not read. An
    empty table gives no rows. Very long vectors are fine: blocks are cut by bytes.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    rows = (table.select(F.col(id_col).cast("bigint").alias("vec_id"),
                         whole_numbers(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], _OUT)
    rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("x")))
                       .alias("x"))
    fit = fit_list(rows, dims)
    trace = fit.trace()
    if trace <= 0:
        return spark.createDataFrame([], _OUT)
    values, vectors = leading_pairs(fit.product, dims, components)
    real = values > dims * _EPS * values[0]
    values, vectors = values[real], vectors[:, real]
    white = vectors / np.sqrt(values)
    identity = fit.summed(lambda xc: (z := xc @ white).T @ z, len(values)) / fit.n
    error = float(np.abs(identity - np.eye(len(values))).max())
    explained = values / trace
    n, sums, mean, k = fit.n, fit.sums, fit.mean, len(values)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), dims)
            if not len(x):
                continue
            top = float(n) * float(np.abs(x.astype(np.float64)).max()) + max(map(abs, sums))
            wide = object if top * top * dims >= _LONG / 4 else np.int64
            away = x.astype(wide) * n - np.array(sums, dtype=wide)
            deviation = [v if v < _LONG else None for v in map(int, (away * away).sum(axis=1))]
            z = (x - mean) @ white
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(z.ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _OUT)
