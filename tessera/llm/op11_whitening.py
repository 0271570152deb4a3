"""Whitening of vectors by matrix-free block Lanczos.

The covariance V of the distinct vectors is never formed. A pass over the stored
vectors gives V Q for a block Q: each partition centres its vectors, multiplies and
adds up a small matrix, Spark sums these. The block's product, freed twice of all
earlier directions (full reorthogonalisation), is the next block; where it breaks
down, random directions that are orthogonal to all earlier ones restart it. The
Ritz vectors of the largest values are done when their residuals are at the level
of rounding; a basis that grows too large is restarted from its best Ritz vectors
and their residuals. The trace of V is the sum of the vectors' deviations, which
are exact, so the explained shares need no other eigenvalue.

Defined results: rows whose vector is null, holds a null or non-finite entry or is
shorter than the longest one are dropped; repeated vectors count once in the fit,
but each row gets its results; null and repeated ids are kept as they are; V has no
more components than its rank (none where all vectors are equal); of equal
eigenvalues any basis is taken; a deviation beyond the range of a long is null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, vectors

SCALE, COMPONENTS = 256, 4
#: Vectors multiplied at once in a pass, and directions kept before a restart.
BLOCK, MOST_DIRECTIONS = 8, 256
#: Residuals this small, relative to the largest eigenvalue, are rounding; as is a direction this short.
DONE, BROKEN = 2e-14, 1e-12
#: Passes after which residuals are taken as they are (the model tells them).
MOST_PASSES = 400
_ROWS = 8192


@dataclass(frozen=True)
class Whitening:
    """n vectors of sums S, V's components (columns) and eigenvalues, its trace, the largest residual."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


# ---- passes


def _pieces(batches: Iterator[pa.RecordBatch], d: int, wide: bool) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            yield vectors.matrix(batch.column("x").slice(a, _ROWS), d, wide)


def summed(fit: DataFrame, d: int, wide: bool, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` (a matrix of that shape for some vectors) over all vectors of fit (x)."""
    rows, columns = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for x in _pieces(batches, d, wide):
            if len(x):
                total, some = total + of(x), True
        if some:
            yield pa.record_batch([pa.array(range(rows), pa.int32()), *[pa.array(total[:, j]) for j in range(columns)]], names=["i", *[f"c{j}" for j in range(columns)]])

    parts = fit.select("x").mapInArrow(partial, "i int, " + ", ".join(f"c{j} double" for j in range(columns)))
    out = np.zeros(shape)
    for r in parts.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(columns)]).collect():  # as many rows as the shape has
        out[r["i"]] = [r[f"c{j}"] for j in range(columns)]
    return out


def exact_sums(fit: DataFrame, d: int, wide: bool) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sum for each entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for x in _pieces(batches, d, wide):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(range(d + 1), pa.int32()), pa.array([str(n), *map(str, total.tolist())])], names=["i", "v"])

    parts = fit.select("x").mapInArrow(partial, "i int, v string")
    told = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    return (told[0], [told[i + 1] for i in range(d)]) if told else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum of (n * x - S) ** 2 of each vector."""
    least, most = int(x.min()), int(x.max())
    size = max(abs(n * v - s) for v in (least, most) for s in (min(sums), max(sums)))
    if len(sums) * size * size >= 1 << 63 or n * max(abs(least), abs(most)) >= 1 << 63:
        x = x.astype(object)
        return ((n * x - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()


# ---- block Lanczos


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal directions of a block outside a basis; where it breaks down, random ones in place; none if the space is full."""
    d, k = block.shape
    out = np.zeros((d, 0))
    for j in range(min(k, d - basis.shape[1])):
        v, least = block[:, j] / scale, BROKEN
        while True:
            before = np.linalg.norm(v)
            for _ in range(2):  # twice is enough
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least and size > BROKEN * before:
                break
            v, least = rng.standard_normal(d), 0.0  # a restart
        # once more at full length: a short rest is all rounding otherwise
        v = v / size
        v = v - basis @ (basis.T @ v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most: int = MOST_DIRECTIONS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors as columns, largest residual) of the k largest eigenvalues of a symmetric operator on d dimensions.

    times: the operator's product with a block of columns.
    """
    rng, k = np.random.default_rng(seed), min(k, d)
    block, most = min(max(block, k), d), max(most, 4 * max(block, k))
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(rng.standard_normal((d, block)), basis, 1.0, rng)
    for _ in range(MOST_PASSES):
        basis, products = np.column_stack([basis, new]), np.column_stack([products, times(new)])
        t = basis.T @ products
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, image = basis @ y[:, :k], products @ y[:, :k]
        rest = image - ritz * values[:k]
        size = np.linalg.norm(rest, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == d or len(size) == k and size.max() <= DONE * top:
            break
        following = products[:, -new.shape[1] :]
        if basis.shape[1] + block > most:
            # all that leads on is what the best Ritz vectors lack
            held = max(k, block)
            best = basis @ y[:, :held]
            following = products @ y[:, :held] - best * values[:held]
            basis, products = best, products @ y[:, :held]
        new = _orthonormal(following[:, :block], basis, top, rng)
    sign = np.sign(ritz[np.abs(ritz).argmax(axis=0), range(k)])
    return values[:k], ritz / np.linalg.norm(ritz, axis=0) * sign, float(size.max())


def fit_whitening(fit: DataFrame, d: int, wide: bool, k: int = COMPONENTS) -> Whitening:
    """The whitening of distinct vectors fit (x: d longs), stored."""
    n, sums = exact_sums(fit, d, wide)
    mean = np.array([s / n for s in sums])

    def times(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = x.astype(float) - mean
            return c.T @ (c @ q)

        return summed(fit, d, wide, q.shape, of) / n

    trace = float(summed(fit, d, wide, (1, 1), lambda x: np.array([[sum(v / n / n for v in deviations(x, n, sums))]]))[0, 0] / n)
    if not trace:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    values, components, residual = lanczos(times, d, min(k, n - 1))
    own = values > d * np.finfo(float).eps * values[0]
    return Whitening(n, sums, components[:, own], values[own], trace, residual)


def identity_error(fit: DataFrame, d: int, wide: bool, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    mean, by = model.mean, model.components / np.sqrt(model.values)
    k = by.shape[1]
    own = summed(fit, d, wide, (1, k), lambda x: ((x.astype(float) - mean) @ by).sum(axis=0, keepdims=True)) / model.n

    def of(x: np.ndarray) -> np.ndarray:
        w = (x.astype(float) - mean) @ by - own
        return w.T @ w

    return float(np.abs(summed(fit, d, wide, (k, k), of) / model.n - np.eye(k)).max())


# ---- rows

_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whiten(kept: DataFrame, d: int, wide: bool, model: Whitening, error: float) -> DataFrame:
    """vec_id and _RESULT of each row of kept (vec_id, x) and component."""
    k = len(model.values)
    by, mean, shares = model.components / np.sqrt(model.values), model.mean, model.values / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = vectors.matrix(batch.column("x"), d, wide)
            m = len(x)
            far = pa.array([v if v < 1 << 63 else None for v in deviations(x, model.n, model.sums)], pa.int64())
            white = (x.astype(float) - mean) @ by
            for j in range(k):
                same = lambda v, t, m=m: pa.array(np.full(m, v), t)
                yield pa.record_batch(
                    [batch.column("vec_id"), same(j + 1, pa.int32()), same(model.n, pa.int64()), far, pa.array(white[:, j]), same(shares[j], pa.float64()), same(error, pa.float64()), same(model.values[j], pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
                )

    return kept.select("vec_id", "x").mapInArrow(rows, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, {_RESULT}")


def whitened(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id and _RESULT of each row of rows (vec_id, embedding) that is kept, for each of the first k components."""
    kept, d, wide = vectors.whole(rows, SCALE, "vec_id")
    if not d:
        return kept.where("false").select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _RESULT.split(", ")])
    fit = common.written(kept.select("x").distinct())
    model = fit_whitening(fit, d, wide, k)
    error = identity_error(fit, d, wide, model) if len(model.values) else 0.0
    return whiten(kept, d, wide, model, error)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
#: Eigenvectors are no SQL; tests hold the query against a dense solver.
ORACLES: dict[str, str] = {}
