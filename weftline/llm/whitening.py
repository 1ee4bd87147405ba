"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 12).

The covariance matrix is never formed. A block of directions Q is multiplied by it in passes over the rows, each task adding
up Xc'(Xc Q) of its own rows, Xc being centred before it is multiplied. A polynomial recurrence over such passes damps the
part of the spectrum that isn't wanted; QR and a Rayleigh-Ritz step then turn the block towards eigenvectors, and residuals
|V q - e q| say when to stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Entries are taken as fixed-point numbers ``floor(SCALE * c) + SHIFT``; those of ``LARGEST`` or more don't fit.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
#: Degree of a filter, filters at most, and directions of the block for each component that is asked for.
DEGREE, FILTERS, BLOCK = 10, 60, 4
#: Residuals, as shares of the largest eigenvalue: what ends the iteration, and what must be reached when they fall no more.
DONE, CERTIFIED = 4e-15, 1e-12
#: Components whose eigenvalue is a smaller share of the first one's hold rounding errors alone.
RANK = 1e-12
#: Numbers that are handled at once.
SLICE = 1 << 20


def fixed(column: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and fixed-point vectors, a slice of the rows at a time; of each width, or of ``dims`` entries alone.

    Null vectors, those without entries and those with null, non-finite or too large entries are left out.
    """
    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(width) - width
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    for d in [dims] if dims else np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == d)
        for rows in np.array_split(of, max(1, -(-len(of) * d // SLICE))):
            c = flat[start[rows][:, None] + np.arange(d)]
            whole = (np.abs(c) < LARGEST).all(1)
            yield rows[whole], np.floor(SCALE * c[whole]).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors have the commonest width (of equally common ones the larger), and their sum in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in fixed(batch.column(0)):
                if len(x):
                    total[x.shape[1]] = total.get(x.shape[1], 0) + np.append(x.sum(0), len(x))
        rows = [(d, i, int(s)) for d, sums in total.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_pylist([{"d": d, "i": i, "s": s} for d, i, s in rows], pa.schema([("d", pa.int32()), ("i", pa.int32()), ("s", pa.int64())]))

    sums = materialise(vectors.mapInArrow(add, "d int, i int, s long").groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    most = sums.where("d = i").orderBy(F.desc("s"), F.desc("d")).first()
    if most is None:
        return 0, []
    return int(most["s"]), [int(r["s"]) for r in sums.where(F.col("d") == most["d"]).where("i < d").orderBy("i").collect()]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` as doubles, rounded once: the difference is taken in whole numbers."""
    high = [abs(s) for s in sums]
    if n * int(np.abs(x).max(initial=0)) + max(high) < 1 << 63:
        return (x * n - np.array(sums, np.int64)) / n
    mean = [divmod(s, n) for s in sums]
    return (x - np.array([q for q, _ in mean], np.int64)) - np.array([r / n for _, r in mean])


def product(vectors: DataFrame, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """``V q`` in one pass: every task adds up its rows' part, of which only d rows of m numbers are shuffled."""
    d, m = q.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, m))
        for batch in batches:
            for _, x in fixed(batch.column(0), d):
                c = centred(x, n, sums)
                total += c.T @ (c @ q)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = vectors.mapInArrow(add, "i int, v array<double>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(m)]).alias("v")).collect()
    out = np.zeros((d, m))
    for r in rows:
        out[r["i"]] = r["v"]
    return out / n


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``n`` vectors with the sums ``sums``, the covariance's ``trace``, its largest eigenvalues ``values``
    with unit eigenvectors ``vectors`` (one a column), the largest residual as a share of the first eigenvalue, and passes."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int

    def _whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def _deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - sums)^2``, exact; null where it has more than 63 bits."""
        sums = np.array(self.sums, object)
        if (2 * self.n * max(map(abs, [int(np.abs(x).max(initial=0)), *[s // self.n + 1 for s in self.sums]]))) ** 2 * len(sums) < 1 << 63:
            away = x * self.n - sums.astype(np.int64)
            return (away * away).sum(1).tolist()
        away = x.astype(object) * self.n - sums
        return [s if s < 1 << 63 else None for s in (away * away).sum(1).tolist()]

    def transform(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """The id, ``deviation`` long and ``whitened`` array<double> of every row whose vector can be taken, in one pass."""
        d = len(self.sums)

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in fixed(batch.column(1), d) if d else ():
                    arrays = [batch.column(0).take(pa.array(at)), pa.array(self._deviation(x), pa.int64()), pa.array(list(self._whitened(x)), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "deviation", "whitened"])

        kind = rows.schema[id_col].dataType.simpleString()
        out = rows.select(F.col(id_col).alias("id"), F.col(vector_col)).mapInArrow(change, f"id {kind}, deviation long, whitened array<double>")
        return out.withColumnRenamed("id", id_col)

    def identity_error(self, rows: DataFrame, vector_col: str = "embedding") -> float:
        """Largest absolute entry of the whitened rows' covariance minus the identity, in one pass; 0 without components."""
        k, d = len(self.values), len(self.sums)
        if not k:
            return 0.0

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for batch in batches:
                for _, x in fixed(batch.column(0), d):
                    z = self._whitened(x)
                    total += np.vstack([z.T @ z, z.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(total.ravel())], names=["i", "j", "v"])

        found = np.zeros((k + 1, k))
        for r in rows.select(vector_col).mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            found[r["i"], r["j"]] = r["v"] / self.n
        return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


class _Lanczos:
    """Single-vector Lanczos beside the filter, in the same passes: a lower bound of the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta, self.ended = [start / np.linalg.norm(start)], [], [], False

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        if self.ended:
            return
        self.alpha.append(float(self.column @ product))
        q = np.array(self.basis)
        rest = product - q.T @ (q @ product)
        rest -= q.T @ (q @ rest)
        self.beta.append(float(np.linalg.norm(rest)))
        self.ended = self.beta[-1] <= 1e-10 * max(map(abs, self.alpha)) or len(self.basis) == len(product)
        if not self.ended:
            self.basis.append(rest / self.beta[-1])

    def lowest(self) -> float:
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - (0 if self.ended else self.beta[-1] * abs(vectors[-1, 0]))))


def fit(rows: DataFrame, k: int = 8, vector_col: str = "embedding", seed: int = 12) -> Whitening:
    """The ``k`` first principal components of all vectors that can be taken (see ``whiten``).

    The block has ``BLOCK * k`` random directions. A filter is a Chebyshev polynomial of degree ``DEGREE`` of the covariance V,
    small between a lower bound of the spectrum (from Lanczos steps in the same passes) and the smallest Ritz value of the
    block; each degree is a pass over the rows. QR and Rayleigh-Ritz follow; the pass of the latter is the next filter's first.
    It ends when the residuals of all ``k`` are at the rounding error, or fall no more and are under ``CERTIFIED``; it raises an
    error if ``FILTERS`` filters don't get there. The driver holds d x m numbers, tasks too, whatever the number of rows.
    """
    vectors = rows.select(vector_col)
    n, sums = _sums(vectors)
    d = len(sums)
    empty = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0, 1)
    if not n:
        return empty
    m = min(d, BLOCK * k)
    rng = np.random.default_rng(seed)
    trace = _trace(vectors, n, sums)
    if not trace:
        return empty
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    lanczos = _Lanczos(rng.standard_normal(d))
    passes, last = 2, np.inf

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if lanczos.ended or len(lanczos.basis) > 2 * DEGREE:
            return product(vectors, n, sums, block)
        both = product(vectors, n, sums, np.column_stack([block, lanczos.column]))
        lanczos.take(both[:, -1])
        return both[:, :-1]

    for _ in range(FILTERS):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        some = int((values[:k] > RANK * values[0]).sum())
        residual = float(np.linalg.norm(vq[:, :some] - q[:, :some] * values[:some], axis=0).max() / values[0])
        if residual <= DONE or m == d or residual <= CERTIFIED and residual > last / 2:
            return Whitening(n, sums, trace, values[:some], q[:, :some], residual, passes)
        last = residual
        low, cut = lanczos.lowest(), float(values[-1])
        if low >= cut:
            low = 0.0
        half, mid = max((cut - low) / 2, RANK * values[0]), (cut + low) / 2
        # Scaled so that the first eigenvector keeps its length.
        scale = first = half / (values[0] - mid)
        before, now = q, (vq - mid * q) * (scale / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / first - scale)
            before, now = now, 2 * following / half * (times(now) - mid * now) - scale * following * before
            scale = following
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"residual {last:.1e} after {passes} passes")


def _trace(vectors: DataFrame, n: int, sums: list[int]) -> float:
    d = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for _, x in fixed(batch.column(0), d):
                total += float((centred(x, n, sums) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    return float(vectors.mapInArrow(add, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]) / n


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of all vectors: one row for each of them and each of the first ``k`` components.

    Columns: the id, ``component`` int (from 1, by falling eigenvalue), ``n`` long (vectors), ``deviation`` long (sum over the
    dimensions of ``(n x - S)^2``, exact; null if it has more than 63 bits), ``whitened`` double, ``explained`` double (share
    of the trace), ``identity_error`` double (one value).

    Vectors that are null or hold null or non-finite entries, or entries of 2^40 or more in size, take no part, nor do empty
    ones or those of another width than most (of equally common widths the larger counts). Repeated rows and rows with null
    ids are vectors like others. Where the vectors have fewer than ``k`` directions of spread there are fewer components; none,
    and so no rows, for an empty table or one vector repeated. Components keep the same sign for all rows. Other columns
    aren't read.
    """
    found = fit(rows, k, vector_col)
    error = found.identity_error(rows, vector_col)
    share = F.array(*[F.lit(float(v / found.trace)) for v in found.values]).cast("array<double>")
    each = found.transform(rows, id_col, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return each.select(
        id_col, (F.col("__at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("__at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
