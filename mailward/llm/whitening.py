"""Embedding whitening by matrix-free block Lanczos (operator 11).

The covariance is never formed. A pass over the rows multiplies it with a block of vectors V: each task sums
its rows' x (x'V), x centred first, and the d x b sums are added by dimension in a shuffle, so a pass brings
d short rows to the driver, however many rows there are. The driver keeps the Krylov basis and its images
(d x at most ``most`` doubles) and

* orthogonalises each new block twice against the whole basis;
* where a direction breaks down, that is, all of it lies in the basis, starts again with a random one
  orthogonal to the basis, until the basis fills the space;
* solves the small projected problem and stops when the residuals of all wanted pairs are small, or the basis
  fills the space, which makes the projection exact;
* before it accepts an early stop, adds one random block and goes on, so that no copy of a repeated
  eigenvalue stays unseen; it is done when the wanted values are as before;
* beyond ``most`` vectors keeps the wanted Ritz vectors and the newest block only (thick restart).

Numbers. Entries become whole numbers x = floor(64 c) + 1000000. Their sums are exact, n x - S is formed in
whole numbers (64 bits where a checked bound allows, Python's integers beyond) and divided once, so centring
loses nothing; each deviation is exact. The trace is the sum of the deviations over n cubed. Components leave
only when all passes are done, so every row is projected on the same vectors.

Defined results. A row takes no part if its vector is null, holds null or non-finite entries, or has an entry
whose x is no whole number of 53 bits; nor if it is longer or shorter than most vectors (ties: than the longer
ones). Components whose eigenvalue is 0 up to rounding (equal rows, constant dimensions, one row) do not exist
and give no rows. A deviation beyond 64 bits is null. Repeated rows and equal or null vec_ids are rows of
their own. Empty tables give an empty result. Extra columns are ignored. Among equal eigenvalues the vectors are
any orthonormal ones, the same for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
_EXACT = 1 << 53
_SAFE = 1 << 62
#: Rows of a batch that are multiplied at once.
ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether a vector (array<double>) may take part, its length apart."""
    limit = F.lit(float(_EXACT / SCALE) - SHIFT)
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit)), F.lit(False))


def fit_list(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, values array<double>) of the rows that take part, and their dimension (0 without any)."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("values")).filter(finite(F.col("values")))
    sizes = own.groupBy(F.size("values").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return own.filter(F.size("values") == d), d


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of a batch's rows."""
    values = batch.column(batch.schema.get_field_index("values")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _parts(batches, d: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _whole(part, d)
    released()


@dataclass(frozen=True)
class Center:
    """n and the exact sum of each dimension: what centring needs."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; 64-bit numbers where they surely fit, else Python's."""
        most = int(np.abs(x).max(initial=0))
        if self.n * most + max(map(abs, self.sums), default=0) < _SAFE:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        """x - S / n from n x - S, rounded once."""
        if scaled.dtype == object:
            return (scaled / self.n).astype(np.float64)
        return scaled / self.n if int(np.abs(scaled).max(initial=0)) < _EXACT else (scaled.astype(object) / self.n).astype(np.float64)

    @staticmethod
    def deviations(scaled: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exact; None beyond 64 bits."""
        most = int(np.abs(scaled).max(initial=0))
        if scaled.dtype != object and most * most * max(1, scaled.shape[1]) < _SAFE:
            return (scaled * scaled).sum(1).tolist()
        whole = (scaled.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in whole]


def center(fit: DataFrame, d: int) -> Center:
    """Exact n and sums: one row a dimension comes to the driver."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for _, x in _parts(batches, d):
            bound = int(np.abs(x).max(initial=0)) * len(x)
            total = total + (x.sum(0) if bound < _SAFE else x.astype(object).sum(0)).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows.sort()
    return Center(int(rows[0]["n"]) if rows else 0, tuple(int(r["s"]) for r in rows))


def _added(fit: DataFrame, d: int, b: int, partial) -> np.ndarray:
    """Sum over tasks of the d x b arrays that partial(parts) gives, added by row in a shuffle."""

    def run(batches):
        total = partial(_parts(batches, d))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(b)]], names=["i", *[f"v{j}" for j in range(b)]])

    schema = ", ".join(["i int", *[f"v{j} double" for j in range(b)]])
    rows = fit.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(b)]).collect()
    return np.array([tuple(r)[1:] for r in sorted(rows)], np.float64)


def multiplied(fit: DataFrame, d: int, about: Center, block: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) times a block of vectors, in one pass over the rows."""
    shared = fit.sparkSession.sparkContext.broadcast((about, block))

    def partial(parts):
        where, v = shared.value
        total = None
        for _, x in parts:
            c = where.centred(where.scaled(x))
            product = c.T @ (c @ v)
            total = product if total is None else total + product
        return total

    try:
        return _added(fit, d, block.shape[1], partial) / about.n
    finally:
        shared.unpersist()


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng, size: float) -> np.ndarray:
    """An orthonormal block for the basis: the block's directions outside of it, random ones where they break down."""
    d, kept = len(block), []
    for column in block.T:
        for attempt in range(8):
            v = column if not attempt else rng.normal(size=d)
            scale = size if not attempt else float(np.linalg.norm(v))
            for _ in range(2 + (attempt > 0)):
                v = v - basis @ (basis.T @ v)
                for k in kept:
                    v = v - k * (k @ v)
            norm = float(np.linalg.norm(v))
            if norm > 1e-10 * scale:
                v = v / norm
                v = v - basis @ (basis.T @ v)
                for k in kept:
                    v = v - k * (k @ v)
                kept.append(v / np.linalg.norm(v))
                break
            if basis.shape[1] + len(kept) >= d:
                break
    return np.array(kept).T.reshape(d, len(kept))


def leading(times, d: int, wanted: int, block: int = 16, most: int = 256, tolerance: float = 1e-13, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, passes) of the symmetric operator times(V), V of d rows."""
    wanted, block = min(wanted, d), min(block, d)
    most = min(d, max(most, wanted + 2 * block))
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    newest = _orthonormal(rng.normal(size=(d, block)), basis, rng, 1.0)
    passes, before = 0, None
    while True:
        product = times(newest)
        passes += 1
        basis, image = np.hstack([basis, newest]), np.hstack([image, product])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        size = max(float(np.abs(values).max(initial=0.0)), 1e-300)
        take = turns[:, :wanted]
        if basis.shape[1] >= d:
            return values[:wanted], _unit(basis @ take), passes
        rest = image @ take - (basis @ take) * values[:wanted]
        if basis.shape[1] >= wanted and float(np.linalg.norm(rest, axis=0).max()) <= tolerance * size:
            if before is not None and float(np.abs(values[:wanted] - before).max()) <= 10 * tolerance * size:
                return values[:wanted], _unit(basis @ take), passes
            before, product = values[:wanted].copy(), rng.normal(size=(d, block))
            scale = float(np.sqrt(d))
        else:
            scale = size
        # Against the whole basis, before a restart lets some of it go: what is left are the residuals' directions.
        newest = _orthonormal(product, basis, rng, scale)
        if basis.shape[1] + newest.shape[1] > most:
            kept = turns[:, : max(wanted, most - 2 * block)]
            basis, image = basis @ kept, image @ kept


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=0)


@dataclass(frozen=True)
class Whitening:
    """What projects rows: centre, eigenvalues, eigenvectors, trace, passes, and the error of the identity."""

    about: Center
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    error: float

    @property
    def filters(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _trace(fit: DataFrame, d: int, about: Center) -> float:
    """Trace of the covariance from the deviations of all rows: their sum over n cubed."""

    def run(batches):
        total = 0.0
        for _, x in _parts(batches, d):
            total += float((about.scaled(x).astype(np.float64) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

    return (fit.mapInArrow(run, "t double").agg(F.sum("t").alias("t")).first()["t"] or 0.0) / float(about.n) ** 3


def _identity_error(fit: DataFrame, d: int, about: Center, filters: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by one more pass."""
    k = filters.shape[1]

    def partial(parts):
        total = None
        for _, x in parts:
            w = about.centred(about.scaled(x)) @ filters
            product = np.vstack([w.T @ w, w.sum(0)])
            total = product if total is None else total + product
        return total

    sums = _added(fit, d, k, partial) / about.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS, block: int = 16, most: int = 256) -> Whitening | None:
    """The whitening of the rows of fit_list(); None if no component exists."""
    about = center(fit, d) if d else Center(0, ())
    if not about.n:
        return None
    trace = _trace(fit, d, about)
    if not trace:
        return None
    values, vectors, passes = leading(lambda v: multiplied(fit, d, about, v), d, components, block, most)
    real = values > 1e-13 * trace
    values, vectors = values[real], vectors[:, real]
    return Whitening(about, values, vectors, trace, passes, _identity_error(fit, d, about, vectors / np.sqrt(values)))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = 16, most: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component.

    block: vectors multiplied in one pass. most: basis vectors kept between restarts.
    """
    fit, d = fit_list(rows, key, vector)
    model = fit_whitening(fit, d, components, block, most)
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    about, filters, k = model.about, model.filters, len(model.values)
    names = [c.split()[0] for c in RESULT.split(", ")][:5]

    def run(batches):
        for part, x in _parts(batches, d):
            scaled = about.scaled(x)
            w = about.centred(scaled) @ filters
            where = np.repeat(np.arange(len(x)), k)
            columns = [part.column(0).take(pa.array(where)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(where), about.n)), pa.array(about.deviations(scaled), pa.int64()).take(pa.array(where)), pa.array(w.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shares = F.array(*[F.lit(float(v)) for v in model.values / model.trace])
    out = fit.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double")
    return out.select("*", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(model.error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
