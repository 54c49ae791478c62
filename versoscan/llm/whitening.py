"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are made integers, x = floor(256 * c), so that sums and squared deviations are exact. The fit list holds each
distinct x once, as a table in the shared folder whose rows are blocks of vectors in the narrowest integers that hold
them, so that a pass costs little more than its arithmetic. The leading eigenvectors of its covariance are found without forming
it: every step is one distributed pass over the fit list that returns (X - mean)'(X - mean)Q / n for a narrow block Q,
summed by dimension on the executors, so the driver sees one row a dimension.

A round applies a Chebyshev polynomial of the covariance to the block: its three-term recurrence stays small on the
unwanted part of the spectrum, from 0 to the block's least Ritz value, and grows fast above. QR and a Rayleigh-Ritz
step follow, whose pass also gives the residuals. Rounds end when the wanted components' residuals have fallen to
rounding errors of their passes and no longer fall; then a fresh random block, kept orthogonal to what was found, is
filtered in the same way and must hold no larger eigenvalue (else it joins the block and the rounds go on). If
``rounds`` don't suffice an error is raised: nothing uncertified is returned.

Defined results: null vectors and those with null or non-finite entries are dropped; an entry whose x is beyond a long
counts as the nearest long; vectors shorter than the longest count 0 in the entries they lack; repeated rows and equal
vectors get the same values each and count once in the fit; components of eigenvalue 0 (to rounding) are not returned,
so a table whose vectors are all equal, or an empty table, gives an empty result; within a repeated eigenvalue any
orthonormal basis is right; a deviation beyond a long is null, ``deviation_decimal`` has it up to 38 digits. Columns
that are not asked for are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoscan.llm.shared import remove, shared_dir, table

COMPONENTS = 4
GUARD = 28  # columns of the block beyond the wanted ones
SCALE = 256
CELLS = 1 << 18  # entries of vectors that are worked on at once
BLOCK = 1 << 12  # entries of a row of the fit list
CERTIFIED, ROUNDING = 1e-11, 4e-15  # residuals relative to the largest eigenvalue: allowed at most; not worth another round


class Whitener(NamedTuple):
    """What the fit gives: n, exact sums by dimension, and the components as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is whole and finite, with ``x`` in its place."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(column, lambda c: F.floor(SCALE * c.cast("double")))
    return vectors.where(F.col(column).isNotNull() & ~bad).withColumn("x", x).drop(*(column,) * (column != "x"))


def matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Rows of a column of lists as int64 matrices of ``width`` columns, a bounded number of entries each."""
    step = max(1, CELLS // max(width, 1))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        sizes = part.value_lengths().to_numpy(zero_copy_only=False)
        values = part.flatten().to_numpy(zero_copy_only=False)
        if (sizes == width).all():
            yield values.reshape(len(part), width)
        else:
            out = np.zeros((len(part), width), np.int64)
            row = np.repeat(np.arange(len(part)), sizes)
            out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            yield out


def packed(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """(block binary): the vectors of ``x``, BLOCK entries or one vector a row, as integers of the numpy type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // width)
        for batch in batches:
            for x in matrices(batch.column(0), width):
                rows = [x[at : at + step].astype(kind).tobytes() for at in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["block"])

    return vectors.select("x").mapInArrow(run, "block binary")


def unpacked(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[np.ndarray]:
    """The vectors of packed rows as int64 matrices, a bounded number of entries each."""
    step = max(1, CELLS // width)
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        x = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)
        for at in range(0, len(x), step):
            yield x[at : at + step].astype(np.int64)


class Fit(NamedTuple):
    """The fit list: its table, the vectors' width and the integers' numpy type."""

    table: DataFrame
    width: int
    kind: str


def exact(x: np.ndarray, terms: int) -> np.ndarray:
    """x as it is if sums of ``terms`` squares of its entries fit into a long, else as Python integers."""
    most = max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0
    return x if most * most * terms < 1 << 62 else x.astype(object)


def fit_sums(fit: Fit) -> tuple[int, list[int], list[int]]:
    """The number of vectors, and each dimension's sum and sum of squares, exact."""
    table, width, kind = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(width, object), np.zeros(width, object)
        for x in unpacked(batches, width, kind):
            n, x = n + len(x), exact(x, len(x))
            total, squares = total + x.sum(axis=0).astype(object), squares + (x * x).sum(axis=0).astype(object)
        texts = lambda v: pa.array([str(i) for i in v])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), texts(total), texts(squares)], names=["dim", "n", "total", "squares"])

    parts = table.mapInArrow(run, "dim long, n long, total string, squares string")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = sorted(parts.groupBy("dim").agg(F.sum("n"), big("total"), big("squares")).collect())
    return (rows[0][1] if rows else 0), [int(r[2]) for r in rows], [int(r[3]) for r in rows]


def summed(fit: Fit, rows: int, columns: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of add(x) over blocks x of vectors: a matrix of ``rows`` by ``columns``, added up row by row in Spark."""
    table, width, kind = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for x in unpacked(batches, width, kind):
            total += add(x.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *(pa.array(total[:, j]) for j in range(columns))], names=["dim", *(f"c{j}" for j in range(columns))])

    names = [f"c{j}" for j in range(columns)]
    parts = table.mapInArrow(run, "dim long, " + ", ".join(f"{c} double" for c in names))
    return np.array([r[1:] for r in sorted(parts.groupBy("dim").agg(*(F.sum(c) for c in names)).collect())])


def rayleigh_ritz(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), Ritz vectors, and what the operator makes of them, from one pass."""
    q = np.linalg.qr(block)[0]
    aq = apply(q)
    h = q.T @ aq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, aq @ turn


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, applied: np.ndarray, cut: float, top: float, wanted: float) -> np.ndarray:
    """The block times a Chebyshev polynomial that is small on [0, cut], scaled to about 1 at ``top``; ``applied`` is the
    operator times the block. The degree is as high as leaves the columns apart, and no higher than ``wanted`` needs."""
    half = cut / 2
    grows = lambda x: np.arccosh(max(x / half - 1, 1 + 1e-12))  # noqa: E731  # a degree's growth, as a logarithm
    degree = int(np.clip(min(np.log(1e10) / grows(top), np.log(1e14) / grows(wanted)), 1, 16))
    sigma = first = half / (top - half)
    before, now = block, (applied - half * block) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], width: int, components: int, rounds: int = 60, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvalues and eigenvectors of a symmetric operator without negative eigenvalues, and the largest
    residual of a component relative to the first eigenvalue."""
    random = np.random.default_rng(seed)
    size = min(width, components + GUARD)
    values, block, applied = rayleigh_ritz(apply, random.standard_normal((width, size)))
    best, probed = np.inf, size == width
    for _ in range(rounds):
        if values[0] <= 0:
            return values[:0], block[:, :0], 0.0
        keep = max(1, min(components, int((values > 1e-13 * values[0]).sum())))
        worst = float(np.linalg.norm(applied[:, :keep] - block[:, :keep] * values[:keep], axis=0).max() / values[0])
        if worst <= CERTIFIED and (worst <= ROUNDING or worst > best / 2):
            if probed:
                return values[:keep], block[:, :keep], worst
            # a fresh block must hold nothing above the last component
            fresh = random.standard_normal((width, min(size, width - size)))
            away = lambda b: b - block @ (block.T @ b)
            fresh = np.linalg.qr(away(fresh))[0]
            cut = max(values[-1], 1e-12 * values[0])
            other, vectors, _ = rayleigh_ritz(lambda b: away(apply(b)), away(chebyshev(apply, fresh, apply(fresh), cut, values[0], values[keep - 1])))
            if other[0] <= values[keep - 1]:
                probed = True
                continue
            values, block, applied = rayleigh_ritz(apply, np.hstack([block[:, : size - len(other) // 2], vectors[:, : len(other) // 2]]))
            best = np.inf
            continue
        best = min(best, worst)
        if size == width:
            values, block, applied = rayleigh_ritz(apply, block)  # the block is the whole space
            continue
        cut = max(values[-1], 1e-12 * values[0])
        values, block, applied = rayleigh_ritz(apply, chebyshev(apply, block, applied, cut, values[0], values[keep - 1]))
    raise RuntimeError(f"components not certified in {rounds} rounds: residual {best:.2g}")


def fit_whitener(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of integers(..) rows, from each distinct x once; None without rows."""
    spark = vectors.sparkSession
    width, low, high = vectors.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not width:
        return None
    low, high = min(low, 0), max(high, 0)
    kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    path = f"{shared_dir(spark)}/fit-{uuid.uuid4().hex}"
    try:
        short = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0).cast("long"), width - F.size("x")))).otherwise(F.col("x"))
        packed(vectors.select(short.alias("x")).distinct(), width, kind).write.parquet(path)
        fit = Fit(spark.read.schema("block binary").parquet(path), width, kind)
        n, sums, squares = fit_sums(fit)
        mean = np.array([s / n for s in sums])
        trace = sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n / n

        def apply(block: np.ndarray) -> np.ndarray:
            def add(x: np.ndarray) -> np.ndarray:
                x = x - mean
                return x.T @ (x @ block)

            return summed(fit, width, block.shape[1], add) / n

        values, found, residual = leading(apply, width, components)
        if not len(values):
            return Whitener(n, sums, found, values, trace, 0.0, 0.0)

        def spread(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ found / np.sqrt(values)
            return y.T @ y

        error = float(np.abs(summed(fit, len(values), len(values), spread) / n - np.eye(len(values))).max())
        return Whitener(n, sums, found, values, trace, residual, error)
    finally:
        remove(spark, path)


def whiten(vectors: DataFrame, whitener: Whitener | None, key: str = "vec_id") -> DataFrame:
    """A row for each row of integers(..) and each component, in one narrow pass."""
    types = dict(vectors.dtypes)
    schema = f"{key} {types[key]}, component int, n long, deviation long, deviation_decimal decimal(38,0), whitened double, explained double, identity_error double"
    fitted = whitener or Whitener(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0)
    n, sums, found, values, trace, _, error = fitted
    width, k = len(sums), len(values)
    mean, total = np.array([s / n for s in sums]), np.array(sums, object)
    squared, most = sum(s * s for s in sums), max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list[int]:
        """sum((n * x - S)^2) = n * (n * sum(x^2) - 2 * sum(x * S)) + sum(S^2), in integers."""
        x = exact(x, width)
        fits = x.dtype != object and x.size and int(np.abs(x).max()) * most * width < 1 << 62
        a, b = (x * x).sum(axis=1), x @ (total.astype(np.int64) if fits else total)
        return [n * (n * int(p) - 2 * int(q)) + squared for p, q in zip(a, b, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in matrices(batch.column("x"), width) if k else ():
                apart = [d for d in deviations(x) for _ in range(k)]
                y = (x.astype(float) - mean) @ found / np.sqrt(values)
                row = np.repeat(np.arange(at, at + len(x)), k)
                at += len(x)
                columns = [
                    batch.column(key).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), n)),
                    pa.array([d if d < 1 << 63 else None for d in apart], pa.int64()), pa.array([d if d < 10**38 else None for d in apart], pa.decimal128(38, 0)),
                    pa.array(y.ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(row), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "deviation_decimal", "whitened", "explained", "identity_error"])

    return vectors.select(key, "x").mapInArrow(run, schema)


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whiten(vectors, fit_whitener(vectors)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
